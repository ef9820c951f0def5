"""Near-duplicate lines by the segment-partition edit join: each line is cut into threshold + 1 segments, probed by length-aware substrings."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import NO_ID, carry, components, join_small, join_unique, materialize, split_hot, with_key
from eventloom.llm.simhash import forest, groups

#: An edit for every so many code points of the shorter line, TAU at most: lines of under PER_EDIT code points have to be equal.
TAU = 2
PER_EDIT = 20
BLANKS = " \t\r\x0b\x0c"
#: The lines of a segment that more than so many lines share meet by a second segment of what is left of them.
HOT = 1000


def allowed(length: int, tau: int = TAU, per_edit: int = PER_EDIT) -> int:
    """The edits allowed between a line of that length and one that is no shorter."""
    return min(tau, length // per_edit)


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, size) of the tau + 1 segments of a line of that length; the last ones are one longer where it does not divide evenly."""
    size, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = size + (i > tau - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, other: int, tau: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the substrings that a line of `length` probes for lines of length `other`, no longer than it: only the
    starts from which the parts left and right of a matching segment can still be within tau edits."""
    gap, out = length - other, []
    if gap > tau:
        return out
    for i, (p, n) in enumerate(segments(other, tau)):
        lo = max(0, p - i, p + gap - (tau - i))
        hi = min(length - n, p + i, p + gap + (tau - i))
        out += [(i, s, s + n) for s in range(lo, hi + 1)]
    return out


@functools.lru_cache(maxsize=100_000)
def plan(length: int, tau: int, per_edit: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, end) of all that a line of `length` probes, for itself first to last by rising length."""
    lengths = range(max(per_edit, length - tau), length + 1)
    return [(other, *x) for other in lengths for x in probes(length, other, allowed(other, tau, per_edit))]


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance of a and b is at most tau: banded bit-parallel dynamic programming over diagonals -tau..tau."""
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    # What both share at the ends takes no part.
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    # reach[e]: bit d is set if the cell on diagonal d - tau of this row is reached with at most e edits.
    band = (1 << (2 * tau + 1)) - 1
    rows = [sum(1 << (tau + d) for d in range(-e, e + 1) if d >= 0) for e in range(tau + 1)]
    for i, c in enumerate(a):
        same = 0
        for d in range(-tau, tau + 1):
            if 0 <= i + d < len(b) and b[i + d] == c:
                same |= 1 << (tau + d)
        new: list[int] = []
        for e in range(tau + 1):
            r = rows[e] & same
            if e:
                r |= rows[e - 1] | (rows[e - 1] >> 1) | new[e - 1]  # replace, drop c, or what takes fewer edits
                r |= (new[e - 1] << 1) & band  # add a character of b
            new.append(r & band)
        rows = new
        if not rows[tau]:
            return False
    d = len(b) - len(a) + tau
    return bool(rows[tau] >> d & 1)


def _key(text: str, other: int, i: int, within: int = 0) -> int:
    """The key of a segment's text; `within` is the key of the group that it divides."""
    import xxhash

    return xxhash.xxh64_intdigest(text, other * 64 + i) ^ within * 0x9E3779B97F4A7C15 & 2**64 - 1


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line that holds a word, blanks at its ends aside: _k_id, _k_rid, pos (from 0), line, h1 and h2 (its hashes)."""
    lines = docs.select("_k_id", "_k_rid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def segment_keys(docs: DataFrame, tau: int, per_edit: int) -> DataFrame:
    """(key, lid, role): what each line of at least per_edit code points indexes (role 1) and probes (2); both are one row (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash_ = xxhash.xxh64_intdigest
        plans: dict[int, list[tuple[int, int, int, int]]] = {}
        for b in batches:
            seen: set[int] = set()
            keys: list[int] = []
            lids: list[int] = []
            sizes: list[int] = []
            roles: list[int] = []

            def out() -> pa.RecordBatch:
                cols = [np.array(keys, np.uint64).view(np.int64), np.repeat(np.array(lids, np.uint64).view(np.int64), sizes), np.array(roles, np.int8)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "lid", "role"])

            for text in b.column(0):
                for line in (text.as_py() or "").split("\n"):
                    line = line.strip(BLANKS)
                    if len(line) < per_edit or (lid := hash_(line, 42)) in seen:
                        continue
                    seen.add(lid)
                    if (own := plans.get(len(line))) is None:
                        at = [p for p, _ in segments(len(line), allowed(len(line), tau, per_edit))]
                        own = plans[len(line)] = [(o * 64 + i, s, e, 3 if o == len(line) and s == at[i] else 2) for o, i, s, e in plan(len(line), tau, per_edit)]
                    keys += [hash_(line[s:e], seed) for seed, s, e, _ in own]
                    roles += [r for _, _, _, r in own]
                    lids.append(lid)
                    sizes.append(len(own))
                    if len(keys) > 200_000:
                        yield out()
                        keys, lids, sizes, roles = [], [], [], []
            yield out()

    return docs.select("text").mapInArrow(run, "key long, lid long, role byte")


def divided(rows: DataFrame, tau: int, per_edit: int) -> DataFrame:
    """(key, lid, role, whole) of lines that meet under a hot key (rows: whole, lid, line): new keys from the segments of what is left of them.

    Two lines that agree on a segment and are within so many edits are within as many without it, so one of the segments of the rest
    agrees as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wholes, lids, lines = (b.column(k).to_pylist() for k in range(3))
            out: list[tuple[int, int, int, int]] = []
            for whole, lid, line in zip(wholes, lids, lines):
                got: dict[int, int] = {}
                for other, i, s, e in plan(len(line), tau, per_edit):
                    if _key(line[s:e], other, i) != whole & 2**64 - 1:
                        continue
                    rest, t = line[:s] + line[e:], allowed(other, tau, per_edit)
                    for j, x, y in probes(len(rest), other - (e - s), t):
                        got[_key(rest[x:y], other, j, whole)] = got.get(_key(rest[x:y], other, j, whole), 0) | 2
                    if other == len(line) and s == segments(other, t)[i][0]:
                        for j, (p, n) in enumerate(segments(len(rest), t)):
                            got[_key(rest[p : p + n], other, j, whole)] = got.get(_key(rest[p : p + n], other, j, whole), 0) | 1
                out += [(k - 2**64 if k >= 2**63 else k, lid, r, whole) for k, r in got.items()]
            types = (pa.int64(), pa.int64(), pa.int8(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["key", "lid", "role", "whole"])

    return rows.select("whole", "lid", "line").mapInArrow(run, "key long, lid long, role byte, whole long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The (key, lid) of keys that two lines or more have, one of them as an index entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lid, role in groups(batches):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])))
            at = np.flatnonzero(new)
            key, lid, role = key[at], lid[at], np.bitwise_or.reduceat(role, at)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(starts, len(key)))
            ok = np.repeat((size > 1) & (np.bitwise_or.reduceat(role, starts) & 1 > 0), size)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(lid[ok])], ["key", "lid"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key", "lid").mapInArrow(run, "key long, lid long")


def verified(rows: DataFrame, tau: int, per_edit: int) -> DataFrame:
    """(h1, h2, n_links, _a, _r, _p, to) of each task: of lines, how many other texts are within tau edits, and the first place of
    those; and, where `to` is set, edges (h1, to) that connect what the pairs of the task connect.

    rows: cell, block, key, whole (the hot key that key divides, or null), h1, h2, line, first (struct). A pair that meets under several
    keys counts under the first alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, block, key, whole, split, h1, h2, line, a, r, p in groups(batches):
            starts = np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell))
            links: dict[int, int] = defaultdict(int)
            least_at: dict[int, tuple] = {}
            pairs: list[tuple[int, int]] = []
            for lo, hi in zip(starts, starts[1:]):
                one = block[lo:hi].min() == block[lo:hi].max()
                rows_ = sorted(range(lo, hi), key=lambda k: (len(line[k]), h1[k], h2[k]))
                for n, y in enumerate(rows_):
                    ly = line[y]
                    for x in reversed(rows_[:n]):
                        lx = line[x]
                        if len(ly) - len(lx) > tau:
                            break
                        if (not one and block[x] == block[y]) or key[x] != key[y] or (h1[x] == h1[y] and h2[x] == h2[y]):
                            continue
                        if not is_first(lx, ly, int(key[x]), int(whole[x]) if split[x] else None, tau, per_edit) or not within(lx, ly, allowed(len(lx), tau, per_edit)):
                            continue
                        pairs.append((x, y))
                        for u, v in ((x, y), (y, x)):
                            links[u] += 1
                            place = (a[v], r[v], p[v])
                            if u not in least_at or place < least_at[u]:
                                least_at[u] = place
            if links:
                at = np.array(list(links))
                places = [least_at[k] for k in links]
                cols = [pa.array(h1[at]), pa.array(h2[at]), pa.array(list(links.values()), pa.int64())]
                cols += [pa.array([x[k] for x in places], pa.int64()) for k in range(3)]
                names = ["h1", "h2", "n_links", "_a", "_r", "_p", "to"]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(at), pa.int64())], names)
                u, v = forest(h1[[x for x, _ in pairs]], h1[[y for _, y in pairs]])
                yield pa.RecordBatch.from_arrays([pa.array(u), *[pa.nulls(len(u), pa.int64())] * 5, pa.array(v)], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["cell", "block", "key", F.coalesce("whole", F.lit(0)).alias("whole"), F.col("whole").isNotNull().alias("split"), "h1", "h2", "line", "first.a", "first.r", "first.p"]
    dealt = rows.repartition(n, "cell").sortWithinPartitions("cell", "block").select(*cols)
    return dealt.mapInArrow(run, "h1 long, h2 long, n_links long, _a long, _r long, _p long, to long")


def line_links(found: DataFrame) -> DataFrame:
    """(h1, h2, n_links, linked) of each line in what verified() gives."""
    place = F.struct(F.col("_a").alias("a"), F.col("_r").alias("r"), F.col("_p").alias("p"))
    return found.where("to IS NULL").groupBy("h1", "h2").agg(F.sum("n_links").alias("n_links"), F.min(place).alias("linked"))


def line_groups(marked: DataFrame, found: DataFrame) -> DataFrame:
    """marked with head: the first place of all lines that equal lines and links connect with a line."""
    roots = materialize(components(found.where("to IS NOT NULL").select("h1", "to"), "h1", "to").withColumnsRenamed({"node": "h1"}))
    grouped = materialize(join_small(marked, roots, ["h1"], "left").withColumn("root", F.coalesce("root", "h1")))
    return materialize(grouped.join(grouped.groupBy("root").agg(F.min("first").alias("head")), "root").drop("root"))


def classes(found: DataFrame) -> DataFrame:
    """(_k_id, _k_rid, class_id): the least id of the documents that shared or linked lines connect with each; null if none has an id.

    found: _k_id, _k_rid and the head of each line's group.
    """
    head_id = F.when(F.col("head.a") == 2**63 - 1, F.lit(NO_ID)).otherwise(F.col("head.a"))
    own = materialize(found.select("_k_id", "_k_rid", F.xxhash64("_k_id", "_k_rid").alias("node"), F.xxhash64(head_id, "head.r").alias("b")).distinct())
    roots = materialize(components(own, "node", "b"))
    docs = join_small(own.select("_k_id", "_k_rid", "node").distinct(), roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    least = docs.groupBy("root").agg(F.min(F.when(F.col("_k_id") != NO_ID, F.col("_k_id"))).alias("class_id"))
    return docs.join(least, "root").select("_k_id", "_k_rid", "class_id")


def is_first(x: str, y: str, key: int, whole: int | None, tau: int, per_edit: int) -> bool:
    """Whether `key`, which may divide a hot key `whole`, is the first under which y finds x, the shorter line or the first of equal length."""
    t = allowed(len(x), tau, per_edit)
    segs = segments(len(x), t)
    for i, s, e in probes(len(y), len(x), t):
        p, n = segs[i]
        if x[p : p + n] == y[s:e]:
            if whole is None:
                return _key(y[s:e], len(x), i) == key & 2**64 - 1
            if _key(y[s:e], len(x), i) != whole & 2**64 - 1:
                return False
            rx, ry = x[:p] + x[p + n :], y[:s] + y[e:]
            rest = segments(len(rx), t)
            for j, u, v in probes(len(ry), len(rx), t):
                if rx[rest[j][0] : sum(rest[j])] == ry[u:v]:
                    return _key(ry[u:v], len(x), j, whole) == key & 2**64 - 1
            return False
    return False


@carry("doc_id", "text")
def line_dedup(docs: DataFrame, tau: int = TAU, per_edit: int = PER_EDIT, classed: bool = False, hot: int = HOT) -> DataFrame:
    """docs with clean_text, n_lines, n_removed, n_links and dup_of.

    Lines that hold a word take part, blanks at their ends aside. A line goes if an equal line stands earlier (by doc_id, null last,
    then place), or if a line within the allowed edits has its first place earlier: an edit for every per_edit code points of the
    shorter line, tau at most. n_links counts, over the lines of the document, the different texts within the allowed edits of each;
    dup_of lists the ids of the documents that hold the earlier lines. Rows equal in id and text are one document: neither loses lines
    to the other. Null and empty texts have no lines. Lines without a word stay as they are. Extra columns are carried; an empty table
    gives no rows. classed: also class_id, the least id of the documents that equal and linked lines connect with the document, or its
    own. Lines of a segment that more than `hot` lines share are compared only where a second segment agrees too, which loses no pair.
    """
    docs = with_key(docs)
    order = F.when(F.col("_k_id") == -(2**63), F.lit(2**63 - 1)).otherwise(F.col("_k_id"))
    place = F.struct(order.alias("a"), F.col("_k_rid").alias("r"), F.col("pos").cast("long").alias("p"))
    lines = materialize(line_rows(docs).drop("line"))
    repeated = lines.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    shared = materialize(shared_keys(segment_keys(docs, tau, per_edit)))
    wanted = materialize(shared.select("lid").distinct())
    texts = join_small(line_rows(docs).withColumn("lid", F.col("h1")), wanted, ["lid"], "left_semi", rows=1_000_000)
    texts = texts.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.min("line").alias("line"))
    many = materialize(shared.groupBy("key").count().where(F.col("count") > hot).select("key"))
    if many.isEmpty():
        met = shared.withColumn("whole", F.lit(None).cast("long"))
    else:
        texts = materialize(texts)
        crowded = join_small(shared, many, ["key"], "left_semi").select(F.col("key").alias("whole"), "lid").join(texts.select(F.col("h1").alias("lid"), "line"), "lid")
        parts = divided(crowded, tau, per_edit)
        again = shared_keys(parts.drop("whole")).join(parts.select("key", "whole").distinct(), "key")
        met = materialize(join_small(shared, many, ["key"], "left_anti").withColumn("whole", F.lit(None).cast("long")).unionByName(again))
    pairs = split_hot(met, "key", "lid").join(texts, F.col("lid") == F.col("h1"))
    linked = materialize(verified(pairs, tau, per_edit))
    links = materialize(line_links(linked))
    needed = materialize(repeated.unionByName(links.select("h1", "h2")).distinct())
    found = materialize(join_unique(lines, needed, ["h1", "h2"]))
    marked = materialize(join_small(found.groupBy("h1", "h2").agg(F.min(place).alias("first")), links, ["h1", "h2"], "left"))
    if classed:
        marked = line_groups(marked, linked)
    found = join_unique(found, marked, ["h1", "h2"])
    if classed:
        found = materialize(found)
    mine = F.least("first", "linked")
    found = found.withColumn("gone", (place != F.col("first")) | F.coalesce(F.col("linked") < F.col("first"), F.lit(False)))
    per_doc = found.groupBy("_k_id", "_k_rid").agg(
        F.collect_set(F.when(F.col("gone"), F.col("pos"))).alias("_gone"),
        F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.collect_set(F.when(F.col("gone") & (mine["a"] != 2**63 - 1), mine["a"])).alias("dup_of"),
    )
    out = docs.join(per_doc, ["_k_id", "_k_rid"], "left")
    if classed:
        out = out.join(classes(found), ["_k_id", "_k_rid"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    none = F.array().cast("array<int>")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    clean = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return out.withColumns({
        "n_lines": F.size(F.filter(split, lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long"),
        "n_removed": F.size(F.coalesce("_gone", none)).cast("long"),
        "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
        "dup_of": F.array_sort(F.coalesce("dup_of", F.array().cast("array<bigint>"))),
        "clean_text": F.when(F.size(F.coalesce("_gone", none)) > 0, clean).otherwise(F.col("text")),
    }).drop("_k_id", "_k_rid", "_gone")


def digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"), classed=True)
    return out.select("doc_id", "class_id", "n_lines", "n_removed", "n_links", "dup_of")


@carry("doc_id", "text", "n_chars", exact=True)
def stage(docs: DataFrame) -> DataFrame:
    """The documents without their duplicate lines, in the columns of docs; a document of which no word is left goes."""
    out = line_dedup(docs).where("n_removed = 0 OR clean_text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.select(*[F.col("clean_text").alias("text") if c == "text" else F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
