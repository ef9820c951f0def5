"""Near-duplicate documents: SimHash links and MinHash bands find candidate pairs, the exact Jaccard similarity of five-word shingles decides.

SimHash alone cannot do it: at a similarity of 0.8 fingerprints of 64 bits differ in 10 bits on average, and a radius that finds most
such pairs makes an index that grows faster than the input. So its exact 3-bit join finds the closest pairs, and bands the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import NO_ID, carry, components, join_small, join_unique, materialize, split_hot, with_key
from eventloom.llm.simhash import groups, links, majority_bits, shingle_hashes
from eventloom.llm.textvec import buffers

SHINGLE, LEAST = 5, 0.8
#: A pair of similarity s agrees in no band with probability (1 - s^5)^30: by calculation 7e-6 at 0.8, and less above.
BANDS, ROWS = 30, 5
_RNG = np.random.default_rng(5)
XORS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hs: list[np.ndarray]) -> np.ndarray:
    """[sets, BANDS] keys of sets of shingle hashes, none of them empty; equal in a band where all its minima are."""
    h, starts = np.concatenate(hs), np.cumsum([0] + [len(x) for x in hs[:-1]])
    out = np.empty((len(hs), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(hs), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = (key ^ np.minimum.reduceat((h ^ XORS[k]) * FACTORS[k], starts)) * MIX
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out


def batched_sets(b: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """(rows, shingle hashes, sorted sets of them, band keys of the sets that are not empty) of the texts of a column, in parts."""
    data, off = buffers(b.column(column))
    raw = data.tobytes()
    at, all_, held = [], [], 0
    for i in range(len(off) - 1):
        at.append(i)
        all_.append(shingle_hashes(raw[off[i] : off[i + 1]], SHINGLE))
        held += len(all_[-1])
        if held > 100_000 or i == len(off) - 2:
            sets = [np.unique(h) for h in all_]
            full = [s for s in sets if len(s)]
            yield at, all_, sets, band_keys(full) if full else np.zeros((0, BANDS), np.uint64)
            at, all_, held = [], [], 0


def signatures(docs: DataFrame) -> DataFrame:
    """(_k_id, _k_rid, sid, fp, bands) of every text: a hash of its set of shingles, its SimHash, and its band keys; a wordless text has none."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, all_, sets, keys in batched_sets(b, 2):
                sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0] + [BANDS * bool(len(s)) for s in sets])
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                rows = pa.array(at, pa.int64())
                cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array(sid), pa.array(majority_bits(all_).view(np.int64)), bands]
                yield pa.RecordBatch.from_arrays(cols, ["_k_id", "_k_rid", "sid", "fp", "bands"])

    return with_key(docs).select("_k_id", "_k_rid", "text").mapInArrow(run, "_k_id long, _k_rid long, sid long, fp long, bands array<long>")


def linked(sets: list[np.ndarray], bands: np.ndarray, block: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs of sets that connect all pairs that share a band and have a similarity of `least` or more, and no others.

    Where there are two blocks, pairs within one are left out. A pair that is connected already is not compared.
    """
    sizes, root, one, out = np.array([len(s) for s in sets]), np.arange(len(sets)), block.min() == block.max(), []
    for b in range(bands.shape[1]):
        order = np.argsort(bands[:, b], kind="stable")
        value = bands[order, b]
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        for lo, hi in zip(starts, np.append(starts[1:], len(order))):
            run = order[lo:hi]
            for i, x in enumerate(run[:-1]):
                if (root[run] == root[x]).all():
                    break
                rest = run[i + 1 :]
                ok = (root[rest] != root[x]) & (np.minimum(sizes[rest], sizes[x]) >= least * np.maximum(sizes[rest], sizes[x]) - 1e-9)
                if not one:
                    ok &= block[rest] != block[x]
                # A pair counts in the first band that it shares.
                rest, step = rest[ok & ~(bands[rest, :b] == bands[x, :b]).any(axis=1)], 1
                while len(rest):
                    now, rest = rest[:step], rest[step:]
                    step = min(4 * step, 256)
                    every = np.concatenate([sets[y] for y in now])
                    hit = sets[x][np.minimum(np.searchsorted(sets[x], every), sizes[x] - 1)] == every
                    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
                    for y in now[both >= least * (sizes[now] + sizes[x] - both) - 1e-9]:
                        if root[y] != root[x]:
                            out.append((int(x), int(y)))
                            root[root == root[y]] = root[x]
                    rest = rest[root[rest] != root[x]]
    return out


def verified(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what pairs of similarity LEAST or more connect; rows: sid, root (of its candidates), near (of its SimHash), text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, sets, keys in batched_sets(b, 3):
                own = pa.array(at, pa.int64())
                # The component of its SimHash is one more band.
                keys = np.column_stack([keys, np.asarray(b.column(2).take(own)).view(np.uint64)])
                cols = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *cols], ["sid", "root", "shingles", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, block, sid, shingles, bands in groups(batches):
            starts = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell))
            found: list[tuple[int, int]] = []
            for lo, hi in zip(starts, starts[1:]):
                sets = [np.frombuffer(s, np.uint64) for s in shingles[lo:hi]]
                keys = np.frombuffer(b"".join(bands[lo:hi]), np.uint64).reshape(hi - lo, BANDS + 1)
                found += [(lo + x, lo + y) for x, y in linked(sets, keys, block[lo:hi])]
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sid[at[:, 0]]), pa.array(sid[at[:, 1]])], ["a", "b"])

    cells = split_hot(materialize(rows.select("sid", "root", "near", "text").mapInArrow(read, "sid long, root long, shingles binary, bands binary")), "root", "sid")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell", "block").select("cell", "block", "sid", "shingles", "bands")
    return dealt.mapInArrow(run, "a long, b long")


@carry("doc_id", "text", exact=True)
def stage(docs: DataFrame) -> DataFrame:
    """One document, the least by doc_id (null last), of each component of documents of similarity LEAST or more, in the columns of docs.

    Similarity is that of the sets of five-word shingles, A-Z lower-cased; a shorter text is one shingle. Wordless and null texts are
    equal. Equal sets are one node; nodes that share a band, or whose SimHashes are linked, are joined to candidate components, whose
    pairs with a shared band or linked SimHashes are compared exactly. Repeated rows are one document, of which one row stays; an
    empty table gives no rows.
    """
    keyed = with_key(docs)
    marks = materialize(signatures(docs).dropDuplicates(["_k_id", "_k_rid"]))
    nodes = materialize(marks.where(F.size("bands") > 0).dropDuplicates(["sid"]).select("sid", "fp", "bands"))
    fps = materialize(nodes.select("fp").distinct())
    near = materialize(components(materialize(links(fps))).withColumnsRenamed({"node": "fp", "root": "near"}))
    nodes = materialize(join_unique(nodes, near, "fp", "left").withColumn("near", F.coalesce("near", "fp")).drop("fp"))
    # Band keys carry their band's number, and so does that of the SimHash.
    keys = nodes.select("sid", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit(BANDS), "near")))).alias("key"))
    heads = materialize(keys.groupBy("key").agg(F.min("sid").alias("head"), F.max("sid").alias("_last")).where("head != _last").drop("_last"))
    found = materialize(join_unique(keys, heads, "key").select(F.col("sid").alias("a"), F.col("head").alias("b")).where("a != b").distinct())
    candidates = materialize(components(found).withColumnRenamed("node", "sid"))
    slim = marks.drop("bands", "fp")
    one = join_small(slim, candidates, ["sid"]).groupBy("sid", "root").agg(F.min(F.struct("_k_id", "_k_rid")).alias("m"))
    one = materialize(one.select("sid", "root", "m.*").join(nodes.select("sid", "near"), "sid"))
    texts = join_small(keyed.select("_k_id", "_k_rid", "text"), one, ["_k_id", "_k_rid"]).groupBy("sid", "root", "near").agg(F.min("text").alias("text"))
    roots = materialize(components(materialize(verified(texts))).withColumnRenamed("node", "sid"))
    order = F.when(F.col("_k_id") == NO_ID, F.lit(2**63 - 1)).otherwise(F.col("_k_id"))
    tagged = join_unique(slim, roots, "sid", "left").groupBy(F.coalesce("root", "sid").alias("root"))
    kept = tagged.agg(F.min(F.struct(order.alias("i"), F.col("_k_rid"), F.col("_k_id"))).alias("m")).select("m._k_id", "m._k_rid")
    return keyed.join(kept, ["_k_id", "_k_rid"]).dropDuplicates(["_k_id", "_k_rid"])
