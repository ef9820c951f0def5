"""Exact repeats of long byte strings by a distributed sparse suffix array.

Suffixes are taken at content-chosen anchors, so that equal strings of `length` bytes have their anchor at the same place. Sampled
splitters range-partition the suffixes by their leading token of eight bytes; buckets sort locally by multikey quicksort over tokens
and compare neighbours byte by byte. Suffixes travel with their bytes, packed in a block for each bucket and batch. Groups that a splitter
may have cut, or whose bucket is too large for one piece, are compared across the boundaries afterwards. Hashes only choose anchors, deal rows and propose equal strings; bytes decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import join_small, materialize, with_key
from eventloom.llm.simhash import groups
from eventloom.llm.textvec import BASE, BYTE_CODE, buffers, chunks, mix

LENGTH = 100
GRAM = 32
#: Windows whose anchors are sought at once; their places fit the low bits of a key, and the other bits are the hash.
BLOCK_BITS = 20
#: Groups with more runs than this are compared in window rows instead of in one task.
HEAVY = 20_000
SAMPLED_DOCS = 2_000
SAMPLED_EACH = 10
#: Text of a bucket, on average, and of the documents whose suffixes are packed together.
BUCKET_BYTES = 1 << 23
PACKED_BYTES = 1 << 24
#: Suffixes sorted at once; slabs end between leading tokens.
SLAB = 10_000
ROWS = "bucket int, n int, raw int, block binary"


def gram_hashes(d: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 32-byte gram, by doubling."""
    h, n, base = BYTE_CODE[d], 1, int(BASE)
    while n < GRAM:
        m = len(h) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = h[:m] * np.uint64(base) + h[n : n + m]
        base, n = base * base % 2**64, 2 * n
    return h


def anchors(raw: np.ndarray, length: int) -> np.ndarray:
    """The anchor of each window of `length` bytes: its leftmost gram of the least hash. Depends on the window's bytes alone."""
    out, wide = [], length - GRAM + 1
    bits = np.uint64(BLOCK_BITS)
    step = (1 << BLOCK_BITS) - wide
    for lo in range(0, len(raw) - wide + 1, step):
        part = raw[lo : lo + step + wide - 1]
        m, n = (mix(part) >> bits << bits) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * n <= wide:
            m, n = np.minimum(m[:-n], m[n:]), 2 * n
        if n < wide:
            m = np.minimum(m[: len(m) - (wide - n)], m[wide - n :])
        out.append((m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) + lo)
    return np.concatenate(out)


def runs(d: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor) of the runs of windows of `length` bytes, within documents, with one anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(d) < length:
        return none
    anchor = anchors(gram_hashes(d), length)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    j = np.flatnonzero(np.arange(len(anchor)) + length <= off[1:][doc])
    if not len(j):
        return none
    anchor, doc = anchor[j], doc[j]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[first], j[first], np.diff(np.append(first, len(j))), anchor[first]


def lead_of(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token, eight bytes as a number that sorts like them, at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | d[at + k]
    return out


def slices(d: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of d from each place, as a binary column."""
    off = np.concatenate(([0], np.cumsum(size)))
    data = d[np.arange(off[-1]) + np.repeat(lo - off[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


def tokens(data: np.ndarray, off: np.ndarray, pre: np.ndarray, length: int) -> np.ndarray:
    """Tokens of each run's suffix: the bytes from its anchor, those before it, and both sizes. Rows are equal if and only if anchor and bytes are."""
    size = np.diff(off)
    width = -(-length // 8) * 8
    m = np.zeros((len(size), 2 * width + 8), np.uint8)
    for lo in range(0, len(size), SLAB):
        part, p = size[lo : lo + SLAB], pre[lo : lo + SLAB]
        row = np.repeat(np.arange(len(part)), part)
        k = np.arange(len(row)) - np.repeat(off[lo : lo + len(part)] - off[lo] + p, part)
        m[row + lo, np.where(k < 0, k + width + np.repeat(p, part), k)] = data[off[lo] : off[lo + len(part)]]
    t = m.view(">u8").astype(np.uint64)
    t[:, -1] = (size.astype(np.uint64) << np.uint64(16)) | pre.astype(np.uint64)
    return t


def multikey_quicksort(t: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): sorts rows of tokens within segments of neighbours that share the first token; same marks places whose row equals the one before.

    In each round every open segment is parted around the token of its middle row into less, equal and greater rows; the equal ones go on
    to their next token. Parting keeps the order of equal rows. Segments of one row, and those out of tokens, are closed.
    """
    order, same = np.arange(len(t)), np.zeros(len(t), bool)
    at, depth = np.arange(len(t)), np.ones(len(t), np.int64)
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if len(t) else np.zeros(0, np.int64)
    while len(at):
        size = np.diff(np.append(first, len(at)))
        keep = np.repeat(size > 1, size)
        at, depth, size = at[keep], depth[keep], size[size > 1]
        if not len(at):
            break
        first = np.cumsum(size) - size
        rows = order[at]
        x = t[rows, depth]
        pivot = np.repeat(x[first + size // 2], size)
        place = np.repeat(first, size)
        to, kind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
        for k, part in enumerate((x < pivot, x == pivot, x > pivot)):
            n = np.cumsum(part)
            before = n[first] - part[first]
            to[part] = (place + n - 1 - np.repeat(before, size))[part]
            place = place + np.repeat(np.add.reduceat(part, first, dtype=np.int64), size)
            kind[to[part]] = k
        moved = np.empty_like(rows)
        moved[to] = rows
        order[at] = moved
        edge = np.concatenate(([True], kind[1:] != kind[:-1]))
        edge[first] = True
        depth = depth + (kind == 1)
        done = depth == t.shape[1]
        same[at[done & ~edge]] = True
        at, depth = at[~done], depth[~done]
        first = np.flatnonzero(edge[~done])
    return order, same


def spread(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) * BASE)


#: The columns of a block, before the bytes of its runs.
PACKED = (("id", np.int64), ("rid", np.int64), ("start", np.int32), ("pre", np.int16), ("size", np.int16), ("cut", np.bool_))


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def pack(cols: list[np.ndarray], data: np.ndarray, at: np.ndarray) -> tuple[int, int, bytes]:
    """(rows, raw size, block) of the columns of PACKED and the bytes of data from each place."""
    content = buffers(slices(data, at, cols[4].astype(np.int64)))[0]
    raw = b"".join([*(c.astype(t).tobytes() for c, (_, t) in zip(cols, PACKED)), content.tobytes()])
    return len(at), len(raw), codec().compress(raw, asbytes=True)


def unpack(n: int, raw: int, block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns and the bytes of a block."""
    rest = codec().decompress(block, raw, asbytes=True)
    cols, at = [], 0
    for _, t in PACKED:
        cols.append(np.frombuffer(rest, t, n, at))
        at += n * np.dtype(t).itemsize
    return cols, np.frombuffer(rest, np.uint8, offset=at)


def suffixes(keyed: DataFrame, length: int, splits: tuple[np.ndarray, np.ndarray] | None, each: int | None = None) -> DataFrame:
    """The runs of all documents with their bytes, and whether a splitter falls among suffixes of the same leading token: a block a bucket and batch.

    each: instead, so many (lead, spread id) of each document, to choose splitters from.
    """

    def found(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        parts = []
        for lo, hi in chunks(off, 1 << 17):
            doc, *places = runs(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], length)
            start, count, anchor = places
            parts.append((doc + lo, start + off[lo], count, anchor + off[lo]))
        return [np.concatenate(x) for x in zip(*parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            ids, rids = (b.column(k).to_numpy() for k in (0, 1))
            for lo, hi in chunks(off, PACKED_BYTES):
                doc, start, count, anchor = found(data, off[lo : hi + 1])
                doc = doc + lo
                lead, own = lead_of(data, anchor), ids[doc]
                if each is not None:
                    pick = np.flatnonzero(np.random.default_rng(int(lo)).random(len(doc)) < each * (hi - lo) / max(1, len(doc)))
                    yield pa.RecordBatch.from_arrays([pa.array(lead[pick].view(np.int64)), pa.array(spread(own[pick]).view(np.int64))], ["lead", "x"])
                    continue
                if splits is None:
                    bucket, cut = np.zeros(len(doc), np.int64), np.zeros(len(doc), bool)
                else:
                    left, bucket = np.searchsorted(splits[0], lead, "left"), np.searchsorted(splits[0], lead, "right")
                    cut = left != bucket
                    hot = np.flatnonzero(cut)
                    hot = hot[np.argsort(left[hot], kind="stable")]
                    for at in np.split(hot, np.flatnonzero(np.diff(left[hot])) + 1):
                        if len(at):
                            first, last = left[at[0]], bucket[at[0]]
                            bucket[at] = first + np.searchsorted(splits[1][first:last], spread(own[at]), "right")
                order = np.lexsort((lead, bucket))
                blocks = []
                for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(at):
                        cols = [own[at], rids[doc[at]], start[at] - off[doc[at]], anchor[at] - start[at], count[at] + length - 1, cut[at]]
                        blocks.append((bucket[at[0]], *pack(cols, data, start[at])))
                if blocks:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "n", "raw", "block"])

    return keyed.select("_k_id", "_k_rid", "text").mapInArrow(run, "lead long, x long" if each is not None else ROWS)


def splitters(keyed: DataFrame, length: int, buckets: int, n_docs: int) -> tuple[np.ndarray, np.ndarray] | None:
    """buckets - 1 (lead, spread id) splitters from a sample of documents, SAMPLED_DOCS or one a bucket; they only balance, and change no result."""
    share = max(1, n_docs // max(SAMPLED_DOCS, buckets))
    some = keyed.where(F.pmod(F.xxhash64("_k_id", "_k_rid", F.lit(5)), F.lit(share)) == 0)
    got = suffixes(some, length, None, SAMPLED_EACH).collect()
    if not got or buckets < 2:
        return None
    lead = np.array([r.lead for r in got], np.int64).view(np.uint64)
    x = np.array([r.x for r in got], np.int64).view(np.uint64)
    order = np.lexsort((x, lead))
    at = order[(np.arange(1, buckets) * len(order)) // buckets]
    return lead[at], x[at]


def words_at(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The `length` bytes at each place in turns of eight; the last turn may overlap the one before."""
    every = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    for k in (*range(0, length - 8, 8), length - 8):
        yield every[at + k]


def repeated(data: np.ndarray, off: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, whether an earlier row or window of the group has its bytes) of the windows of rows that come in order of place.

    A hash proposes equal windows and their bytes decide; where they differ, all windows of that hash are told apart by their bytes.
    """
    n = np.diff(off) - (length - 1)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    later = np.zeros(len(row), bool)
    if not len(row):
        return row, k, later
    p, g = off[:-1][row] + k, group.view(np.uint64)[row]
    w = mix(window_hashes(gram_hashes(data), p, length) + g * BASE)
    order = np.argsort(w, kind="stable")
    hit = np.flatnonzero(w[order][1:] == w[order][:-1]) + 1
    x, y = order[hit - 1], order[hit]
    equal = g[x] == g[y]
    for one, two in zip(words_at(data, p[x], length), words_at(data, p[y], length)):
        equal &= one == two
    later[y[equal]] = True
    for h in np.unique(w[y[~equal]]):
        seen: set[tuple[int, bytes]] = set()
        for j in np.flatnonzero(w == h):
            key = (int(g[j]), data[p[j] : p[j] + length].tobytes())
            later[j] = key in seen
            seen.add(key)
    return row, k, later


def window_hashes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes (up to 192) at each place, from the hashes of the grams that cover them."""
    out = np.zeros(len(at), np.uint64)
    for i in range(6):
        out = mix(out * BASE + h[at + min(GRAM * i, length - GRAM)])
    return out


def spans(row: np.ndarray, k: np.ndarray, hit: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): the bytes of runs of neighbouring windows that are hit."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.concatenate(([True], (row[at][1:] != row[at][:-1]) | (k[at][1:] != k[at][:-1] + 1))))
    last = np.append(new[1:], len(at)) - 1
    r = row[at][new]
    return r, start[r] + k[at][new], start[r] + k[at][last] + length


def decided(rows: DataFrame, length: int, held: int = 1_000_000) -> DataFrame:
    """Sorts the buckets and compares neighbours: (_k_id, _k_rid, lo, hi, h, bytes).

    bytes null: bytes lo to hi lie in windows that also start earlier. Else a run that is the first of its bytes here but whose group, all
    suffixes of its leading 32 bytes, may go on in another bucket or piece: its windows have to be compared with those of the same h.
    Blocks come sorted by bucket. A bucket of over `held` suffixes is handled in pieces.
    """
    names = ["_k_id", "_k_rid", "lo", "hi", "h", "bytes"]

    def slab(cols: list[np.ndarray], lead: np.ndarray, content: pa.Array) -> Iterator[pa.RecordBatch]:
        i, r, start, pre, size, cut = cols
        data, off = buffers(content)
        t = tokens(data, off, pre.astype(np.int64), length)
        order, same = multikey_quicksort(t, lead)
        top = t[order, : GRAM // 8]
        group = np.cumsum(np.concatenate(([True], (top[1:] != top[:-1]).any(axis=1))))
        # A place whose run equals the one before is later than it, as equal runs stay in order of place.
        whole = order[same]
        head, group = order[~same], group[~same]
        mates = np.bincount(group)[group] > 1
        here = np.flatnonzero(mates & ~cut[head])
        here = here[np.lexsort((start[head[here]], r[head[here]], i[head[here]], group[here]))]
        row, k, later = repeated(*buffers(content.take(pa.array(head[here]))), group[here], length)
        x, lo, hi = spans(row, k, later, start[head[here]].astype(np.int64), length)
        x = head[here][x]
        end = start.astype(np.int64) + size
        left = head[cut[head]]
        at = np.concatenate((whole, x, left))
        lo, hi = np.concatenate((start[whole], lo, start[left])), np.concatenate((end[whole], hi, end[left]))
        h = np.zeros(len(t), np.uint64)
        for j in range(GRAM // 8):
            h = mix(h * BASE + t[:, j])
        kept = pa.concat_arrays([pa.nulls(len(at) - len(left), pa.binary()), content.take(pa.array(left))])
        out = [pa.array(v) for v in (i[at], r[at], lo.astype(np.int32), hi.astype(np.int32), h[at].view(np.int64))]
        if len(at):
            yield pa.RecordBatch.from_arrays([*out, kept], names)

    def piece(blocks: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
        parts = [unpack(*b) for b in blocks]
        cols = [np.concatenate(x) for x in zip(*(c for c, _ in parts))]
        data = np.concatenate([d for _, d in parts])
        del parts
        if not whole:
            cols[5] = np.ones(len(cols[0]), bool)
        size = cols[4].astype(np.int64)
        at = np.cumsum(size) - size
        lead = lead_of(data, at + cols[3])
        order = np.lexsort((cols[2], cols[1], cols[0], lead))
        lead = lead[order]
        ends = np.append(np.flatnonzero(lead[1:] != lead[:-1]) + 1, len(lead))
        lo = 0
        while lo < len(order):
            hi = int(ends[min(np.searchsorted(ends, lo + SLAB), len(ends) - 1)])
            some = order[lo:hi]
            yield from slab([c[some] for c in cols], lead[lo:hi], slices(data, at[some], size[some]))
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, n, whole = None, [], 0, True
        for b in batches:
            for k, *block in zip(*(c.to_pylist() for c in b.columns)):
                if blocks and (k != bucket or n > held):
                    whole = whole and k != bucket
                    yield from piece(blocks, whole)
                    blocks, n = [], 0
                if k != bucket:
                    bucket, whole = k, True
                blocks.append(block)
                n += block[0]
        if blocks:
            yield from piece(blocks, whole)

    return rows.mapInArrow(run, "_k_id long, _k_rid long, lo int, hi int, h long, bytes binary")


def compared(runs_: DataFrame, length: int) -> DataFrame:
    """(_k_id, _k_rid, lo, hi): bytes of windows that another run of the same h holds earlier. runs_: h, _k_id, _k_rid, lo, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, i, r, start, content in groups(batches):
            row, k, later = repeated(*buffers(pa.array(content, pa.large_binary())), h, length)
            x, lo, hi = spans(row, k, later, start.astype(np.int64), length)
            yield pa.RecordBatch.from_arrays([pa.array(i[x]), pa.array(r[x]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["_k_id", "_k_rid", "lo", "hi"])

    parts = int(runs_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs_.repartition(parts, "h").sortWithinPartitions("h", "_k_id", "_k_rid", "lo").select("h", "_k_id", "_k_rid", "lo", "bytes")
    return dealt.mapInArrow(run, "_k_id long, _k_rid long, lo int, hi int")


def compared_heavy(runs_: DataFrame, length: int) -> DataFrame:
    """As compared(), for groups of any size: a row for each window with its bytes, of which the first place is an aggregate."""
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("k")
    window = F.expr(f"substring(bytes, k + 1, {length})").alias("w")
    rows = runs_.select("_k_id", "_k_rid", "lo", "bytes", at).select("_k_id", "_k_rid", (F.col("lo") + F.col("k")).alias("lo"), window)
    place = F.struct("_k_id", "_k_rid", "lo")
    least = rows.groupBy("w").agg(F.min(place).alias("least"), F.count("*").alias("m")).where("m > 1").drop("m")
    return rows.join(least, "w").where(place != F.col("least")).select("_k_id", "_k_rid", "lo", (F.col("lo") + length).alias("hi"))


def cut_out(rows: DataFrame) -> DataFrame:
    """_k_id, _k_rid, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of rows with text and spans (array of lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            raw, col = data.tobytes(), b.column(3)
            flat, counts = col.flatten(), np.diff(np.asarray(col.offsets)) if len(col) else np.zeros(0, np.int64)
            counts = np.where(np.asarray(col.is_valid()), counts, 0) if len(col) else counts
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out: list[tuple] = []
            at = 0
            for k in range(b.num_rows):
                text, n = raw[off[k] : off[k + 1]], int(counts[k])
                gone, spans_, kept, end = 0, 0, [], 0
                if n:
                    order = np.argsort(lo[at : at + n], kind="stable") + at
                    top = np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(np.concatenate(([True], lo[order][1:] > top[:-1])))
                    for x, y in zip(lo[order][new], top[np.append(new[1:], n) - 1]):
                        kept.append(text[end:x])
                        gone, spans_, end = gone + int(y - x), spans_ + 1, int(y)
                    at += n
                kept.append(text[end:])
                rest = b"".join(kept)
                out.append((len(text), gone, spans_, hashlib.sha256(rest).hexdigest(), rest))
            cols = [b.column(0), b.column(1)] + [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["_k_id", "_k_rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("_k_id", "_k_rid", "text", "spans").mapInArrow(run, "_k_id long, _k_rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, which may cut a character) of every row of docs.

    A byte goes if it lies in a string of `length` bytes (64 to 160) that also starts earlier: in a smaller doc_id, or earlier in
    the same document. Matches do not cross documents and are judged on the input. A null text is empty. Null ids come first, and rows of
    one id come in the order of a hash of id and text; rows equal in both are one document that does not repeat itself. Columns other than doc_id
    and text are not used; an empty table gives no rows.
    """
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("some"), F.count_distinct("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).first()
    keyed = with_key(docs.select("doc_id", "text"))
    if ids.n == ids.some == ids.ids:  # the id alone tells the documents apart
        keyed = keyed.withColumn("_k_rid", F.lit(0).cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = keyed if ids.n == ids.ids else keyed.dropDuplicates(["_k_id", "_k_rid"])
    splits = splitters(single, length, max(parts, (ids.bytes or 0) // BUCKET_BYTES), ids.n)
    rows = suffixes(single, length, splits).repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    marks = materialize(decided(rows, length), release=True)  # the suffixes are a multiple of the text, and done with
    open_ = marks.where("bytes IS NOT NULL")
    big = materialize(open_.groupBy("h").count().where(F.col("count") > heavy).select("h"))
    if big.count():
        edges = compared(join_small(open_, big, ["h"], "left_anti"), length).unionByName(compared_heavy(join_small(open_, big, ["h"], "left_semi"), length))
    else:
        edges = compared(open_, length)
    edges = marks.where("bytes IS NULL").select("_k_id", "_k_rid", "lo", "hi").unionByName(edges)
    per_doc = edges.groupBy("_k_id", "_k_rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    text = single.select("_k_id", "_k_rid", F.coalesce("text", F.lit("")).alias("text"))
    done = cut_out(text.join(per_doc, ["_k_id", "_k_rid"], "left"))
    if ids.n != ids.ids:
        done = keyed.select("doc_id", "_k_id", "_k_rid").join(done, ["_k_id", "_k_rid"])
        return done.drop("_k_id", "_k_rid")
    return done.withColumn("doc_id", F.when(F.col("_k_id") != -(2**63), F.col("_k_id"))).drop("_k_id", "_k_rid")


def digest(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
