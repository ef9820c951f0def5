"""SimHash near-duplicates: generalised pigeonhole with correlated-bit partitions and per-query thresholds by dynamic programming."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import NO_ID, carry, components, join_small, join_unique, materialize, split_hot, with_key
from eventloom.llm.textvec import buffers

BITS, RADIUS, SHINGLE = 64, 3, 3
LANES = np.uint64(0x0101010101010101)
BIN_BITS = 12
#: Probing one more value costs about as much as verifying so many candidates.
PROBE_COST = 2.0


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles of a text, A-Z lower-cased, repeats included; one of the whole sequence if it is shorter."""
    import xxhash

    w = text.lower().split()
    if len(w) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[k:] for k in range(n)))), repeat(42)), np.uint64, len(w) - n + 1)


def majority_bits(hs: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the 64-bit number whose bits are set in over half of them; 0 for none."""
    out = np.zeros(len(hs), np.uint64)
    sizes = np.array([len(h) for h in hs])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h, n = np.concatenate([hs[i] for i in full]), sizes[full]
    # Sums of at most 255 hashes at once, eight bits to a word.
    ends = np.cumsum(n)
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(ends - n, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for lane in range(8):
        sums = np.add.reduceat((h >> np.uint64(lane)) & LANES, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for k in range(8):
            out[full] |= (2 * counts[:, k] > n).astype(np.uint64) << np.uint64(lane + 8 * k)
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(_k_id, _k_rid, fp): the SimHash of every text; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(2))
            raw = data.tobytes()
            fps, hs, held = [np.zeros(0, np.uint64)], [], 0
            for i in range(len(off) - 1):
                hs.append(shingle_hashes(raw[off[i] : off[i + 1]], n))
                held += len(hs[-1])
                if held > 200_000 or i == len(off) - 2:
                    fps.append(majority_bits(hs))
                    hs, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(fps).view(np.int64))], ["_k_id", "_k_rid", "fp"])

    return with_key(docs).select("_k_id", "_k_rid", F.col("text")).mapInArrow(run, "_k_id long, _k_rid long, fp long")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with bits i and j both set, summed over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel().astype(np.int64))], ["i", "j", "c"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        out[r.i, r.j] = r.c
    return out


def group_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the 64 bits, correlated bits together: each starts with the bit most correlated with the rest and grows greedily."""
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        rest = sorted(free)
        got = [max(rest, key=lambda b: corr[b, rest].sum())]
        free.discard(got[0])
        while len(got) < width:
            got.append(max(sorted(free), key=lambda b: corr[b, got].sum()))
            free.discard(got[-1])
        out.append(sorted(got))
    return out


def partition_values(fp: np.ndarray, parts: list[list[int]]) -> list[np.ndarray]:
    out = []
    for bits in parts:
        v = np.zeros(len(fp), np.uint64)
        for k, b in enumerate(bits):
            v |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
        out.append(v)
    return out


def balls(width: int, t: int) -> np.ndarray:
    """Masks with at most t of `width` bits set, fewest first."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(width), k)], np.uint64)


def histograms(fps: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """Counts of the high bits (at most 12) of each partition's value over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), 1 << BIN_BITS), np.int64)
        for b in batches:
            for i, v in enumerate(partition_values(b.column(0).to_numpy().view(np.uint64), parts)):
                total[i] += np.bincount((v >> np.uint64(max(0, len(parts[i]) - BIN_BITS))).astype(np.int64), minlength=1 << BIN_BITS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "c"])

    out = [np.zeros(1 << BIN_BITS) for _ in parts]
    for r in fps.select("fp").mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
        out[r.i][r.j] = r.c
    return out


def allocate(values: list[np.ndarray], parts: list[list[int]], hists: list[np.ndarray], radius: int) -> np.ndarray:
    """Thresholds [m, fingerprints] in -1..radius that sum to radius - m + 1 at the least estimated cost, by dynamic programming."""
    m, n = len(parts), len(values[0])
    cost = np.zeros((m, radius + 2, n))
    for i, bits in enumerate(parts):
        each = hists[i][(values[i] >> np.uint64(max(0, len(bits) - BIN_BITS))).astype(np.int64)] / 2.0 ** max(0, len(bits) - BIN_BITS)
        for t in range(radius + 1):
            size = len(balls(len(bits), t)) if len(bits) <= 32 and t <= 2 else float(sum(_choose(len(bits), k) for k in range(t + 1)))
            cost[i, t + 1] = size * (PROBE_COST + each)
    need = radius - m + 1 + m  # sums of threshold + 1
    best = np.full((need + 1, n), np.inf)
    best[0] = 0
    back = np.zeros((m, need + 1, n), np.int8)
    for i in range(m):
        new = np.full((need + 1, n), np.inf)
        for s in range(need + 1):
            for t in range(min(radius + 1, s) + 1):
                c = best[s - t] + cost[i, t]
                better = c < new[s]
                new[s][better], back[i, s][better] = c[better], t
        best = new
    out, s = np.zeros((m, n), np.int64), np.full(n, need)
    for i in reversed(range(m)):
        out[i] = back[i, s, np.arange(n)]
        s = s - out[i]
    return out - 1


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def choose_parts(n: int, radius: int) -> int:
    """The number of partitions, at most radius + 1, with the least cost a fingerprint if values were uniform."""

    def cost(m: int) -> float:
        left, total = radius - m + 1 + m, 0.0
        for i in range(m):
            t = left // m + (i < left % m) - 1
            size = sum(_choose(BITS // m, k) for k in range(t + 1))
            total += size * (PROBE_COST + n / 2.0 ** (BITS // m))
        return total

    return min(range(2, radius + 2), key=cost)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) edges that connect what the edges (a, b) connect."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ab[: len(a)], ab[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[at], nodes[low[at]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all pairs of distinct fingerprints with at most `radius` differing bits, and no others.

    fps: a materialised table of distinct fingerprints (fp). Index rows hold each partition's value, probe rows the values within the
    allocated threshold; both meet by value, hot values are split into cells, and verified pairs of a task shrink to a forest.
    """
    n = fps.count()
    parts = group_bits(bit_counts(fps), n, choose_parts(n, radius))
    hists = histograms(fps, parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 20_000):
                fp = whole.column(0)[lo : lo + 20_000].to_numpy().view(np.uint64)
                values = partition_values(fp, parts)
                limits = allocate(values, parts, hists, radius)
                for i, bits in enumerate(parts):
                    tag = np.uint64(i) << np.uint64(60)
                    own = limits[i] >= 0  # an own value that is probed too is one row for both
                    every = np.arange(len(fp))
                    rows = [(values[i] | tag, every, np.where(own, 3, 1).astype(np.int32))]
                    for t in range(1, radius + 1):
                        if (some := limits[i] >= t).any():
                            masks = balls(len(bits), t)[len(balls(len(bits), t - 1)) :]
                            rows.append((((values[i][some][:, None] ^ masks) | tag).ravel(), np.repeat(every[some], len(masks)), np.full(some.sum() * len(masks), 2, np.int32)))
                    for k, at, role in rows:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(role), pa.array(fp[at].view(np.int64))], ["key", "role", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            x, y = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for cell, fp, role, block in groups(batches):
            live, d = np.arange(len(cell)), 1
            while len(live := live[live + d < len(cell)]) and len(live := live[cell[live] == cell[live + d]]):
                x, y = live, live + d
                # Cells of two blocks compare across the blocks only; the rows of a cell are sorted by block.
                ok = ((role[x] & 1) & (role[y] >> 1) | (role[y] & 1) & (role[x] >> 1)).astype(bool) & ((block[x] != block[y]) | one_block(cell, block)[x])
                near = ok & (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= radius)
                if near.any():
                    held.append((fp[x[near]], fp[y[near]]))
                    count += int(near.sum())
                    if count > 500_000:
                        yield flush()
                        held, count = [], 0
                d += 1
        if held:
            yield flush()

    rows = split_hot(materialize(fps.select("fp").mapInArrow(emit, "key long, role int, fp long")), "key", "fp")
    parts_n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts_n, "cell").sortWithinPartitions("cell", "block").select("cell", "fp", "role", "block")
    return dealt.mapInArrow(verify, "a long, b long").where("a != b")


def one_block(cell: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each row of cells sorted by (cell, block), whether all rows of its cell are of one block."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    same = np.minimum.reduceat(block, starts) == np.maximum.reduceat(block, starts)
    return np.repeat(same, np.diff(np.append(starts, len(cell))))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Column arrays of whole groups: rows sorted by the first column are handed on without the last group, which the next batch may go on with."""
    rest: list[list[np.ndarray]] = []  # parts that end with the group that is still open
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if rest and (cut or rest[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(c) for c in zip(*rest, [x[:cut] for x in cols])]
            rest = []
        elif cut:
            yield [x[:cut] for x in cols]
        rest.append([x[cut:] for x in cols])
    if rest:
        yield [np.concatenate(c) for c in zip(*rest)]


@carry("doc_id", "text")
def simhash_dedup(docs: DataFrame, n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with fp (long) and component_id (the smallest doc_id of its component).

    Rows equal in id and text are one document. Null and wordless texts share fingerprint zero and link like others. A component of
    null ids only has a null component_id. Extra columns are carried; an empty table gives no rows. Fingerprints that very many
    documents share, and components of very many fingerprints, are joined apart from the rest.
    """
    docs = with_key(docs)
    marks = materialize(fingerprints(docs, n).distinct())
    distinct = materialize(marks.groupBy("fp").agg(F.min(F.when(F.col("_k_id") != NO_ID, F.col("_k_id"))).alias("least")))
    edges = materialize(links(distinct.drop("least"), radius))
    roots = materialize(components(edges))
    joined = materialize(join_small(distinct, roots.withColumnsRenamed({"node": "fp"}), ["fp"], "left").withColumn("root", F.coalesce("root", "fp")))
    # Components of one fingerprint need no second look.
    several = joined.where("fp != root").select("root").distinct()
    multi = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")).join(several, "root", "left_semi"))
    by_fp = materialize(join_unique(joined, multi, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    tagged = join_unique(marks, by_fp, "fp")
    return docs.join(tagged.select("_k_id", "_k_rid", "fp", "component_id"), ["_k_id", "_k_rid"]).drop("_k_id", "_k_rid")


def digest(docs: DataFrame) -> DataFrame:
    out = simhash_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
