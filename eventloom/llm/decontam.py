"""Benchmark decontamination: rare n-gram seeds join passages to test items, and Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import NO_ID, join_small, join_unique, materialize, with_key
from eventloom.llm.textvec import ALNUM_WORD, LOWER, buffers, chunks, grams, hashes, words

GRAM = 3
#: The rarest n-grams of each third of an item are seeds whatever their count.
SEEDS_EACH = 4
#: N-grams that make up no more than this share of the corpus, or stand RARE_COUNT times at most, are seeds in any case.
RARE_SHARE = 1e-6
RARE_COUNT = 20
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Texts are sifted for n-grams of the benchmark by a bitmap of 64 bits for each of them, but at most so many, whatever the benchmark's size;
#: the join decides.
SIFT_BITS = 1 << 26


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, start, end, document) of lower-cased alphanumeric words."""
    starts, ends, doc = words(data, off, ALNUM_WORD)
    return hashes(LOWER[data], starts, ends), starts, ends, doc


def item_words(benchmark: DataFrame, n: int) -> DataFrame:
    """(item, item_id, m, words): a key of each different item, and its m word hashes as bytes; items without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            h, _, _, doc = tokens(data, off)
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            size = np.diff(edge)
            some = np.flatnonzero(size)
            cols = [b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(size[some]), pa.array([h[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item", "item_id", "m", "words"])

    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long"), F.lower("text").alias("text")).dropDuplicates(["item"])
    return rows.mapInArrow(run, "item long, item_id long, m long, words binary")


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item, m, key, place, size) of the n-grams of each item; an item with fewer than n words is one gram of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, key, place, size = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, raw in enumerate(b.column(2)):
                w = np.frombuffer(raw.as_py(), np.uint64)
                own = min(n, len(w))
                g, _ = grams(w, np.zeros(len(w), np.int64), own)
                at.append(np.full(len(g), k))
                key.append(g ^ np.uint64(own))
                place.append(np.arange(len(g)))
                size.append(np.full(len(g), own))
            rows = pa.array(np.concatenate(at))
            cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(place)), pa.array(np.concatenate(size))]
            yield pa.RecordBatch.from_arrays(cols, ["item", "m", "key", "place", "size"])

    return items.select("item", "m", "words").mapInArrow(run, "item long, m long, key long, place long, size long")


def sift_of(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the low bits of the keys, 8 to a byte: 64-bit words that are combined before they come to the driver."""
    bits = min(SIFT_BITS, 1 << max(16, (64 * seeds.count()).bit_length()))
    bit = F.col("key").bitwiseAND(bits - 1)
    word = seeds.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(key & 63 AS INT))").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in word.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = r.b
    return out.view(np.uint8)


def sifted(sift: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The places of the keys that the bitmap lets pass."""
    low = g & np.uint64(8 * len(sift) - 1)
    return np.flatnonzero(sift[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)


def corpus_hits(keyed: DataFrame, sift: np.ndarray, sizes: list[int]) -> DataFrame:
    """(_k_id, _k_rid, key, pos, n_words): n-grams of the texts that the bitmap lets pass, and for each batch a row of key 0 with its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            row, key, pos, n_words = [], [], [], 0
            for lo, hi in chunks(off):
                h, _, _, doc = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n_words += len(h)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                for n in sizes:
                    g, at = grams(h, doc, n)
                    g = g ^ np.uint64(n)
                    ok = sifted(sift, g)
                    row.append(lo + doc[at[ok]])
                    key.append(g[ok])
                    pos.append(at[ok] - edge[doc[at[ok]]])
            some = np.concatenate([np.zeros(0, np.int64), *row])
            rows = pa.array(some)
            cols = [pa.concat_arrays([b.column(k).take(rows), pa.array([None], pa.int64())]) for k in (0, 1)]
            cols += [pa.array(np.append(np.concatenate([np.zeros(0, np.uint64), *key]), np.uint64(0)).view(np.int64)), pa.array(np.append(np.concatenate([np.zeros(0, np.int64), *pos]), 0))]
            cols += [pa.array(np.append(np.zeros(len(some), np.int64), n_words))]
            yield pa.RecordBatch.from_arrays(cols, ["_k_id", "_k_rid", "key", "pos", "n_words"])

    return keyed.select("_k_id", "_k_rid", "text").mapInArrow(run, "_k_id long, _k_rid long, key long, pos long, n_words long")


def chosen_seeds(seeds: DataFrame, counts: DataFrame, rare: float) -> DataFrame:
    """The rare n-grams of each item, the rarest of each of its thirds, and, so that no edit of a much copied item can hide all of them,
    n-grams side by side that cover it whole."""
    third = F.floor(3 * F.col("place") / F.greatest(F.lit(1), F.col("m") - F.col("size") + 1))
    rows = join_unique(seeds, counts, "key", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "_third": third})
    rank = F.row_number().over(Window.partitionBy("item", "_third").orderBy("n", "place"))
    last = F.col("place") == F.col("m") - F.col("size")
    return rows.withColumn("_rank", rank).where((F.col("n") <= rare) | (F.col("_rank") <= SEEDS_EACH) | (F.col("place") % F.col("size") == 0) | last).select("item", "m", "key", "place")


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best local score, column of its start, column after its end) of the item against each row of passages, by Smith-Waterman with linear gaps.

    0 in a passage is a place outside of the document and matches nothing.
    """
    n, width = passages.shape
    h, cols = np.zeros((n, width + 1), np.int32), np.arange(width + 1, dtype=np.int32)
    begin = np.broadcast_to(cols, h.shape).copy()  # where the alignment that ends in a cell starts
    slope = cols * -GAP
    best, start, end, every = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for w in item:
        diagonal, up = h[:, :-1] + np.where(passages == w, MATCH, MISMATCH).astype(np.int32), h[:, 1:] + GAP
        new, origin = np.zeros_like(h), np.broadcast_to(cols, h.shape).copy()
        t = np.maximum(diagonal, up)
        new[:, 1:] = np.maximum(t, 0)
        origin[:, 1:] = np.where(t <= 0, origin[:, 1:], np.where(diagonal >= up, begin[:, :-1], begin[:, 1:]))
        sloped = new + slope
        top = np.maximum.accumulate(sloped, axis=1)
        source = np.maximum.accumulate(np.where(sloped == top, cols, 0), axis=1)  # the cell that a gap along the passage comes from
        h, begin = top - slope, np.take_along_axis(origin, source, axis=1)
        at = h.argmax(axis=1)
        value = h[every, at]
        better = value > best
        best[better], start[better], end[better] = value[better], begin[every, at][better], at[better]
    return best, start, end


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = GRAM, min_score: float = MIN_SCORE) -> DataFrame:
    """(_k_id, _k_rid, doc_id, item_id, score, start, end) of the documents' best passage for each item that scores min_score or more.

    The n-grams of all items are a table of seeds, counted in all documents; the chosen ones are joined to the n-grams of the texts.
    Around each hit the item is aligned with the passage, word by word (2 a match, -1 a mismatch or gap), and the score is the share
    of 2 x the item's words. start and end are the word positions of the aligned passage. Nothing of items or texts is gathered but
    a bitmap of bounded size. Null or wordless items and texts match nothing; repeated items and rows give equal matches; null ids
    are ids of their own; columns other than doc_id, text and item_id, text are not used; empty tables give no rows.
    """
    keyed = with_key(docs).select("_k_id", "_k_rid", F.lower("text").alias("text"))
    items = materialize(item_words(benchmark, n))
    seeds = materialize(item_grams(items, n))
    sizes = [r.size for r in seeds.select("size").distinct().orderBy("size").collect()]  # n at most
    hits = materialize(corpus_hits(keyed, sift_of(seeds), sizes))
    keys = materialize(seeds.select("key").distinct())
    counts = materialize(join_unique(hits.where("_k_rid IS NOT NULL"), keys, "key").groupBy("key").agg(F.count("*").alias("n")))
    n_words = hits.agg(F.sum("n_words")).first()[0] or 0
    chosen = materialize(chosen_seeds(seeds, counts, max(RARE_COUNT, RARE_SHARE * n_words)))
    pad = F.floor(F.col("m") / 2) + 4
    near = join_small(hits.where("_k_rid IS NOT NULL"), chosen, ["key"]).select("_k_id", "_k_rid", "item", "m", F.floor((F.col("pos") - F.col("place")) / pad).cast("long").alias("near")).distinct()
    asked = materialize(near.groupBy("_k_id", "_k_rid").agg(F.collect_list(F.struct("item", "m", "near")).alias("asked")))
    cut = materialize(passages(join_small(keyed.dropDuplicates(["_k_id", "_k_rid"]), asked, ["_k_id", "_k_rid"])))
    found = aligned(join_unique(cut, items, "item"), min_score)
    best = found.groupBy("_k_id", "_k_rid", "item_id").agg(F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("m"))
    return best.select("_k_id", "_k_rid", F.when(F.col("_k_id") != NO_ID, F.col("_k_id")).alias("doc_id"), "item_id", "m.score", (-F.col("m.s")).alias("start"), "m.end")


def passages(rows: DataFrame) -> DataFrame:
    """(_k_id, _k_rid, item, first, passage) of what each text is asked for: word hashes from word `first` on, 0 outside of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            asked = b.column(3)
            for lo, hi in chunks(off):
                h, _, _, doc = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                at, item, first, held = [], [], [], []
                for row in range(hi - lo):
                    own = h[edge[row] : edge[row + 1]]
                    for r in asked[lo + row].as_py():
                        pad = r["m"] // 2 + 4
                        a, z = r["near"] * pad - pad, r["near"] * pad + 2 * pad + r["m"]  # holds every passage of hits with this quotient
                        passage = np.zeros(z - a, np.uint64)
                        x, y = max(0, a), min(z, len(own))
                        if y > x:
                            passage[x - a : y - a] = own[x:y]
                        at.append(lo + row)
                        item.append(r["item"])
                        first.append(a)
                        held.append(passage.tobytes())
                rows_ = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows_), b.column(1).take(rows_), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(held, pa.binary())], ["_k_id", "_k_rid", "item", "first", "passage"])

    return rows.select("_k_id", "_k_rid", "text", "asked").mapInArrow(run, "_k_id long, _k_rid long, item long, first long, passage binary")


def aligned(rows: DataFrame, min_score: float) -> DataFrame:
    """(_k_id, _k_rid, item_id, score, start, end) of passages (with item_id and words of their item) that score min_score or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words_, texts, first = b.column(3).to_pylist(), b.column(5).to_pylist(), b.column(4).to_numpy()
            by: dict[bytes, list[int]] = {}
            for k, w in enumerate(words_):
                by.setdefault(w, []).append(k)
            at, score, start, end = [], [], [], []
            for w, rows_ in by.items():
                item = np.frombuffer(w, np.uint64)
                step = max(1, 4_000_000 // len(texts[rows_[0]]))
                for lo in range(0, len(rows_), step):
                    part = rows_[lo : lo + step]
                    best, s, e = align(item, np.frombuffer(b"".join(texts[k] for k in part), np.uint64).reshape(len(part), -1))
                    for k in np.flatnonzero(best >= min_score * MATCH * len(item)):
                        at.append(part[k])
                        score.append(float(best[k]) / (MATCH * len(item)))
                        start.append(int(first[part[k]] + s[k]))
                        end.append(int(first[part[k]] + e[k]))
            rows__ = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows__), b.column(1).take(rows__), b.column(2).take(rows__), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["_k_id", "_k_rid", "item_id", "score", "start", "end"])

    return rows.select("_k_id", "_k_rid", "item_id", "words", "first", "passage").mapInArrow(run, "_k_id long, _k_rid long, item_id long, score double, start long, end long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without those that hold a passage of the benchmark; columns as in docs. Both tables may be empty."""
    hits = materialize(contaminated(docs, benchmark, **options).select("_k_id", "_k_rid").distinct())
    return join_small(with_key(docs), hits, ["_k_id", "_k_rid"], "left_anti").select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contaminated(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start", "end")
