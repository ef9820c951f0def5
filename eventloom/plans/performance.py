"""Queries over per-event and per-module time and memory tables, which are DataFrames with the columns of those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ID = ["Run", "SubRun", "Event"]
MODULE = ["Path", "ModuleLabel", "ModuleType"]


def _times(column, *, label=None):
    return [F.min(column).alias("min_s"), F.avg(column).alias("avg_s"), F.max(column).alias("max_s"), F.count(column).alias("n")]


def full_events(source: DataFrame, event: DataFrame, module: DataFrame, union_all: bool = False) -> DataFrame:
    """The time of each event with its reading and writing. Equal (id, time) rows of the three tables count once, unless union_all."""
    cols = [*ID, "Time"]
    rows = event.select(*cols).unionByName(module.where(F.col("ModuleType").ilike("%(write)")).select(*cols)).unionByName(source.select(*cols))
    rows = rows if union_all else rows.distinct()
    return rows.groupBy(*ID).agg(F.sum("Time").alias("FullTime"))


def event_summary(source, event, module) -> DataFrame:
    full = full_events(source, event, module)
    return full.agg(F.lit("Full Event").alias("label"), *_times("FullTime")[:3], F.count("*").alias("n"))


def slowest_events(source, event, module, n: int = 5) -> DataFrame:
    """The n slowest events by their summed time."""
    return full_events(source, event, module).orderBy(F.desc("FullTime"), *ID).limit(n)


def module_summary(module) -> DataFrame:
    return module.groupBy(*MODULE).agg(*_times("Time"))


def read_summary(source) -> DataFrame:
    return source.agg(F.min("Source").alias("Source"), *_times("Time"))


def event_deltas(info: DataFrame, value: str) -> DataFrame:
    pre, post = (info.where(F.col("Step") == s).select(*ID, F.col(value).alias(n)) for s, n in (("PreProcessEvent", "_a"), ("PostProcessEvent", "_b")))
    return pre.join(post, ID).select(*ID, (F.col("_b") - F.col("_a")).alias("Delta"))


def top_event_deltas(info, value: str, n: int = 5) -> DataFrame:
    return event_deltas(info, value).orderBy(F.desc("Delta"), *ID).limit(n)


def top_events(info, value: str, n: int = 5) -> DataFrame:
    return info.where("Step = 'PostProcessEvent'").select(*ID, value).orderBy(F.desc(value), *ID).limit(n)


def top_by_module(rows: DataFrame, value: str, n: int = 3) -> DataFrame:
    """The n greatest values of each path and label, ties included; only values above 0."""
    w = Window.partitionBy("Path", "ModuleLabel").orderBy(F.desc(value))
    return rows.withColumn("_r", F.rank().over(w)).where((F.col("_r") <= n) & (F.col(value) > 0)).drop("_r")


def module_deltas(info, value: str) -> DataFrame:
    keys = [*MODULE, *ID]
    pre, post = (info.where(F.col("Step") == s).select(*keys, F.col(value).alias(n)) for s, n in (("PreProcessModule", "_a"), ("PostProcessModule", "_b")))
    return pre.join(post, keys).select(*keys, (F.col("_b") - F.col("_a")).alias("Delta"))


def top_module_deltas(info, value: str, n: int = 3) -> DataFrame:
    return top_by_module(module_deltas(info, value), "Delta", n).orderBy(*MODULE, F.desc("Delta"), *ID)


def top_module_values(info, value: str, n: int = 3) -> DataFrame:
    return top_by_module(info.where("Step = 'PostProcessModule'").select(*MODULE, *ID, value), value, n).orderBy(*MODULE, F.desc(value), *ID)


def peak_usage(info: DataFrame) -> DataFrame:
    """Name, Value and Description of the process's peaks."""
    peaks = info.agg(F.max("Vsize").alias("v"), F.max("RSS").alias("r"))
    row = lambda n, c, d: F.struct(F.lit(n).alias("Name"), F.col(c).alias("Value"), F.lit(d).alias("Description"))
    return peaks.select(F.inline(F.array(row("VmPeak", "v", "Peak virtual memory (MB)"), row("VmHWM", "r", "Peak resident set size (MB)"))))


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, mean, max, median and both readings of rms (root mean square, standard deviation), and the count."""
    aggs = [F.min(value).alias("min_v"), F.avg(value).alias("mean_v"), F.max(value).alias("max_v"), F.median(value).alias("median_v")]
    aggs += [F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms_v"), F.stddev_pop(value).alias("sd_v"), F.count(value).alias("n")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def time_report(source: DataFrame, event: DataFrame, module: DataFrame) -> DataFrame:
    """statistics() of the full events, of reading (`source:` with its label) and of each module on each path, one row each, by name."""
    name = lambda df, *parts: df.withColumn("name", F.concat_ws(":", *parts))
    rows = name(full_events(source, event, module).withColumnRenamed("FullTime", "Time"), F.lit("Full event")).select("name", "Time")
    rows = rows.unionByName(name(source, F.lit("source"), F.concat("Source", F.lit("(read)"))).select("name", "Time"))
    rows = rows.unionByName(name(module, "Path", "ModuleLabel", "ModuleType").select("name", "Time"))
    return statistics(rows, ["name"], "Time").orderBy("name")


def modules(module: DataFrame) -> DataFrame:
    """Each module on each path, once."""
    return module.select(*MODULE).distinct()


def check_tables(event: DataFrame, module: DataFrame) -> None:
    """Module times without event times are malformed."""
    if event.isEmpty() and not module.isEmpty():
        raise ValueError("module times without event times")


def migrated(df: DataFrame, id_column: str, renames: dict[str, str]) -> DataFrame:
    """An old table: `run:subrun:event` text split into columns, and columns renamed."""
    parts = F.split(F.col(id_column), ":")
    return df.withColumns({c: parts[k].cast("long") for k, c in enumerate(ID)}).drop(id_column).withColumnsRenamed(renames)
