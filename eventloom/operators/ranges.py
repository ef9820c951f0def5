"""Ranges of validity: islands of events, relations, splits at file switches, and sums that count nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(events: DataFrame) -> DataFrame:
    """(run, subrun, begin, end): half-open ranges of consecutive event numbers; repeated events count once."""
    e = events.select("run", "subrun", "event").distinct()
    e = e.withColumn("_g", F.col("event") - F.row_number().over(Window.partitionBy("run", "subrun").orderBy("event")))
    return e.groupBy("run", "subrun", "_g").agg(F.min("event").alias("begin"), (F.max("event") + 1).alias("end")).drop("_g")


def merged(ranges: DataFrame) -> DataFrame:
    """The union of ranges that overlap or touch."""
    before = Window.partitionBy("run", "subrun").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    r = ranges.withColumn("_new", F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)).cast("int"))
    r = r.withColumn("_g", F.sum("_new").over(Window.partitionBy("run", "subrun").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("run", "subrun", "_g").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_g")


def overlaps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (with run and subrun) two of whose ranges overlap."""
    before = Window.partitionBy(*keys, "run", "subrun").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.where(F.col("begin") < F.col("end")).withColumn("_top", F.max("end").over(before)).where("begin < _top").select(*keys, "run", "subrun").distinct()


def relation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, relation) of two sets of ranges for each key that both have: same, disjoint or overlapping.

    Each set holds merged() ranges. Ranges overlap across sets where one begins before an earlier one of the other set has ended.
    """
    both = None
    for side, df in enumerate((left, right)):
        m = df.where(F.col("begin") < F.col("end")).groupBy(*keys, "run", "subrun", "begin", "end").agg(F.lit(side).alias("_side"))
        both = m if both is None else both.unionByName(m)
    w = Window.partitionBy(*keys, "run", "subrun").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    top = lambda k: F.max(F.when(F.col("_side") == k, F.col("end"))).over(w)
    other = F.when(F.col("_side") == 0, top(1)).otherwise(top(0))
    rows = both.withColumn("_meets", F.coalesce(F.col("begin") < other, F.lit(False)))
    pairs = rows.groupBy(*keys, "run", "subrun", "begin", "end").agg(F.count("*").alias("_n"), F.max("_meets").alias("_meets"), F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    sums = pairs.groupBy(*keys).agg(F.min("_n").alias("_n"), F.max("_meets").alias("_meets"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    name = F.when(F.col("_n") == 2, "same").when(F.col("_meets"), "overlapping").otherwise("disjoint")
    return sums.where((F.col("_lo") == 0) & (F.col("_hi") == 1)).select(*keys, name.alias("relation"))


def split_at(ranges: DataFrame, run: int, subrun: int, event: int, last_in_subrun: bool = False) -> DataFrame:
    """Ranges with part 0 (this file) and 1 (the next), split after an event unless it was the last of its subrun.

    Ranges before the event's count as seen whether or not their events came.
    """
    r, s, b, e = F.col("run"), F.col("subrun"), F.col("begin"), F.col("end")
    here = (r == run) & (s == subrun)
    cut = F.least(e, F.greatest(b, F.lit(event + 1))) if not last_in_subrun else e
    earlier = (r < run) | (r == run) & (s < subrun)
    seen_end = F.when(earlier, e).when(here, cut).otherwise(b)
    parts = F.array(F.struct(F.lit(0).alias("part"), b.alias("begin"), seen_end.alias("end")), F.struct(F.lit(1).alias("part"), seen_end.alias("begin"), e.alias("end")))
    return ranges.select("run", "subrun", F.inline(parts)).where("begin < end")


def current_range(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """(run, subrun, last, n_seen): the last event of each subrun and how many of its given ranges begin at or before it."""
    last = events.groupBy("run", "subrun").agg(F.max("event").alias("last"))
    return ranges.join(last, ["run", "subrun"]).groupBy("run", "subrun", "last").agg(F.count_if(F.col("begin") <= F.col("last")).cast("long").alias("n_seen"))


def closed_ranges(events: DataFrame, ranges: DataFrame, flush: bool = False) -> DataFrame:
    """The ranges (run, subrun, begin, end) with seen: whether output that closes after the given events leaves the range behind.

    All ranges before the one that the last event (in id order) has reached are behind, whether or not their events came; that one too
    if the event is its last; all are with a flush.
    """
    if flush:
        return ranges.select("run", "subrun", "begin", "end", F.lit(True).alias("seen"))
    last = events.agg(F.max(F.struct("run", "subrun", "event"))).first()[0]
    if last is None:
        return ranges.select("run", "subrun", "begin", "end", F.lit(False).alias("seen"))
    at, e = F.struct("run", "subrun", (F.col("end") - 1).alias("event")), F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in ("run", "subrun", "event")])
    return ranges.select("run", "subrun", "begin", "end", (at <= e).alias("seen"))


def guarded_sum(fragments: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sum of fragments (keys, run, subrun, begin, end, value) for each key and run.

    Fragments of the same range count once; fragments without a range count nothing; ranges that overlap otherwise raise an error.
    """
    f = fragments.where(F.col("begin") < F.col("end")).dropDuplicates([*keys, "run", "subrun", "begin", "end"])
    before = Window.partitionBy(*keys, "run", "subrun").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    bad = F.coalesce(F.col("begin") < F.max("end").over(before), F.lit(False))
    f = f.withColumn("_bad", bad)
    f = f.where(F.when(F.col("_bad"), F.raise_error(F.lit("ranges overlap")).cast("boolean")).otherwise(True))
    return f.groupBy(*keys, "run").agg(F.sum(value).alias("total"), F.sum(F.col("end") - F.col("begin")).alias("n_events"))


def sum_arrays(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Elementwise sum of fixed-size arrays."""
    e = df.select(*keys, F.posexplode(column).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    return e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(column))
