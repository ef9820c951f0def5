"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary of pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import carry, materialize
from eventloom.llm.textvec import ALNUM_WORD, BASE, buffers, chunks, hashes, mix, words

#: The vocabulary's file unless the session's spark.eventloom.vocabulary or an argument names another.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The classifier is fitted on about so many labelled documents of each language, chosen by a hash of their id.
DOCS_EACH = 1_000
ROUNDS = 2
LONGEST_PIECE = 12
#: Words longer than this are scored apart, in logarithms.
LONG_WORD = 40
UNKNOWN = 1e-7
START = "▁"
CACHED = 1_000_000
SPLIT = r"[^\p{L}\p{M}\p{N}]+"


class Pieces:
    """The vocabulary's pieces by length, found by hash in matrices of code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        texts = sorted({t.lower() for t in texts if len(t) <= LONGEST_PIECE})
        self.size = len(texts)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for t in texts}):
            ids = np.array([k for k, t in enumerate(texts) if len(t) == n])
            h = mix(self.window(np.array([[ord(c) for c in texts[k]] for k in ids], np.uint64), 0, n))
            order = np.argsort(h)
            low = np.zeros(1 << 16, bool)
            low[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.by_length[n] = (h[order], ids[order], low)

    @staticmethod
    def window(points: np.ndarray, at: int, n: int) -> np.ndarray:
        out = np.zeros(len(points), np.uint64)
        for k in range(at, at + n):
            out = out * BASE + points[:, k] + np.uint64(1)
        return out

    def lattice(self, points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, pieces): the rows of equally long words whose `length` code points before `end` are a piece, by rising end.

        A code point that is no piece of its own is the unknown piece, the last id.
        """
        for end in range(1, points.shape[1] + 1):
            for n, (keys, ids, low) in self.by_length.items():
                if n > end:
                    break
                h = mix(self.window(points, end - n, n))
                rows = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
                k = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
                ok = keys[k] == h[rows]
                if n == 1:
                    found = np.full(len(points), self.size)
                    found[rows[ok]] = ids[k[ok]]
                    yield end, 1, np.arange(len(points)), found
                elif ok.any():
                    yield end, n, rows[ok], ids[k[ok]]


def matrix(texts: list[str]) -> np.ndarray:
    """Code points of equally long words."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1).astype(np.uint64)


def forward(pieces: Pieces, points: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Forward sums [words, languages] at every place: the probability of all segmentations of the word up to there."""
    f = [np.ones((len(points), p.shape[1]))] + [np.zeros((len(points), p.shape[1])) for _ in range(points.shape[1])]
    for end, n, rows, ids in pieces.lattice(points):
        f[end][rows] += f[end - n][rows] * p[ids]
    return f


def log_scores(pieces: Pieces, texts: list[str], p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(texts), p.shape[1]))
    texts = [START + t for t in texts]
    size = np.array([len(t) for t in texts])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for lo in range(0, len(at), 5000):
            some = at[lo : lo + 5000]
            points = matrix([texts[k] for k in some])
            if n <= LONG_WORD:
                total = forward(pieces, points, p)[-1]
                # Products of many rare pieces leave the range of doubles; those words are summed in logarithms instead.
                low = (total < 1e-280).any(axis=1)
                out[some[~low]] = np.log(total[~low])
                some, points = some[low], points[low]
                if not len(some):
                    continue
            # In logarithms, a place at a time, keeping the last few places only.
            logs, last = np.log(p), {0: np.zeros((len(some), p.shape[1]))}
            for end, m, rows, ids in pieces.lattice(points):
                if end not in last:
                    last = {k: v for k, v in last.items() if k > end - LONGEST_PIECE - 1} | {end: np.full((len(some), p.shape[1]), -np.inf)}
                last[end][rows] = np.logaddexp(last[end][rows], last[end - m][rows] + logs[ids])
            out[some] = last[int(n)]
    return out


def expected_counts(pieces: Pieces, texts: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of words of one language (forward and backward sums)."""
    out = np.zeros(pieces.size + 1)
    texts = [START + t for t in texts]
    size = np.array([len(t) for t in texts])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for lo in range(0, len(at), 5000):
            some = at[lo : lo + 5000]
            points = matrix([texts[k] for k in some])
            arcs = list(pieces.lattice(points))
            f, g = np.zeros((int(n) + 1, len(some))), np.zeros((int(n) + 1, len(some)))
            f[0] = g[n] = 1
            for end, m, rows, ids in arcs:
                f[end][rows] += f[end - m][rows] * p[ids]
            for end, m, rows, ids in reversed(arcs):
                g[end - m][rows] += g[end][rows] * p[ids]
            for end, m, rows, ids in arcs:
                np.add.at(out, ids, weight[some][rows] * f[end - m][rows] * p[ids] * g[end][rows] / f[n][rows])
    return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, vocabulary: str | None = None, docs_each: int = DOCS_EACH, rounds: int = ROUNDS) -> tuple[Pieces, list[str], np.ndarray]:
    """(pieces, languages, probabilities [pieces + 1, languages]) by expectation maximisation over the word counts of the sample.

    Only documents that are not held out and have a language are used; words are cut after LONG_WORD / 2 code points for fitting.
    """
    pieces = Pieces(vocabulary or docs.sparkSession.conf.get("spark.eventloom.vocabulary", VOCABULARY))
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return pieces, [], np.zeros((pieces.size + 1, 0))
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1_000_000, docs_each * 1_000_000 // sizes[lang] + 1)).otherwise(share)
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    cut = F.lit(f".{{1,{LONG_WORD // 2}}}")
    piece = F.flatten(F.transform(F.split(F.lower("text"), SPLIT), lambda w: F.regexp_extract_all(w, cut, 0)))
    counts = materialize(some.select("lang", piece.alias("ws")).select("lang", F.explode("ws").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    p = np.full((pieces.size + 1, len(langs)), 1 / pieces.size)
    for _ in range(rounds):
        now = p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(langs), pieces.size + 1))
            for b in batches:
                lang, word, n = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, name in enumerate(langs):
                    at = np.flatnonzero(lang == name)
                    if len(at):
                        total[k] += expected_counts(pieces, [word[j] for j in at], n[at].astype(float), now[:, k])
            k, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(total[k, j])], ["k", "piece", "n"])

        total = np.full((pieces.size + 1, len(langs)), 0.1)
        for r in counts.mapInArrow(run, "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect():
            total[r.piece, r.k] += r.n
        p = total / total.sum(axis=0)
        p[-1] = np.minimum(p[-1], UNKNOWN)
    return pieces, langs, p


_CACHE: dict[str, list[np.ndarray]] = {}


@carry("text", "doc_id", "held_out")
def predict(docs: DataFrame, model: tuple[Pieces, list[str], np.ndarray], keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score (the posterior of the prediction under even priors); und and 0 where the text is null or has no letter.

    Every whole text counts. A word's log-probabilities are computed once and kept in the Python worker for later batches. Rows are
    judged one by one; ties go to the first language by name; with no language learned all are und. Unless keep_text, the text is left
    out and does not come back from the Python workers. Extra columns are carried; an empty table gives no rows.
    """
    pieces, langs, p = model
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CACHE:
            _CACHE.clear()
            _CACHE[name] = [np.zeros(0, np.uint64), np.zeros((0, len(langs)))]
        for b in batches:
            data, off = buffers(b.column(b.num_columns - 1))
            total = np.zeros((b.num_rows, len(langs)))
            for lo, hi in chunks(off, 4 << 20):
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, ends, doc = words(d, o, ALNUM_WORD)
                if not len(starts):
                    continue
                h, first, place = np.unique(hashes(d, starts, ends), return_index=True, return_inverse=True)
                keys, values = _CACHE[name]
                at = np.searchsorted(keys, h)
                got = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h) if len(keys) else np.zeros(0, np.int64)
                scores = np.zeros((len(h), len(langs)))
                scores[got] = values[at[got]]
                new = np.setdiff1d(np.arange(len(h)), got, assume_unique=True)
                if len(new):
                    raw = d.tobytes()
                    scores[new] = log_scores(pieces, [raw[starts[k] : ends[k]].decode(errors="replace") for k in first[new]], p)
                    if len(keys) + len(new) > CACHED:
                        keys, values = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
                    keys, values = np.concatenate([keys, h[new]]), np.concatenate([values, scores[new]])
                    order = np.argsort(keys)
                    _CACHE[name] = [keys[order], values[order]]
                for k in range(len(langs)):
                    total[lo:hi, k] += np.bincount(doc, scores[place, k], minlength=hi - lo)
            best = total.argmax(axis=1)
            z = np.exp(total - total.max(axis=1, keepdims=True))
            score = z[np.arange(len(best)), best] / z.sum(axis=1)
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([langs[k] for k in best], pa.string()), pa.array(score)], [*b.schema.names[:-1], "lang_pred", "score"])

    keep = [c for c in docs.columns if keep_text or c != "text"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not langs:
        return docs.select(*keep).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    carried = docs.select(*keep, letters.alias("_k_letters"), F.lower("text").alias("_k_lower"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]) + ", lang_pred string, score double"
    out = carried.mapInArrow(run, schema)
    return out.withColumns({"lang_pred": F.when(F.col("_k_letters"), F.col("lang_pred")).otherwise("und"), "score": F.when(F.col("_k_letters"), F.col("score")).otherwise(0.0)}).drop("_k_letters")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    model = fit(docs, vocabulary)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep_text=False)
