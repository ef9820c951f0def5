"""Output files: which events go to which file, what a file holds, and how it is called."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.patterns import COUNTER, check_counter, substituted
from eventloom.functions.tables import in_order, ordinal

UNLIMITED = 2**31 - 1
GRANULARITY = {"SubRun": ["run", "subrun"], "Run": ["run"], "InputFile": []}


def by_events(df: DataFrame, order: list, max_events: int) -> DataFrame:
    """Adds segment: files of max_events events in a total order."""
    if max_events < 1:
        raise ValueError("a limit is 1 or more")
    return ordinal(df, order, "_n").withColumn("segment", F.floor((F.col("_n") - 1) / max_events).cast("long")).drop("_n")


def by_criteria(df: DataFrame, granularity: str = "SubRun", max_events: int = UNLIMITED, max_subruns: int = UNLIMITED, max_runs: int = UNLIMITED, max_files: int = UNLIMITED, max_bytes: int | None = None, max_seconds: float | None = None, file: str = "file", size: str = "size", time: str = "ts") -> DataFrame:
    """Adds segment: a file closes at the first boundary of the granularity where any limit is reached.

    Runs and subruns count where they end: one that a switch interrupts counts once, in the file that holds its end. Bytes are the sum
    of a column; seconds are those between the first and the last event of the file. Boundaries follow each other in the order of their
    ids; only one row for each passes the step that needs the one before.
    """
    given = [max_events, max_subruns, max_runs, max_files, *[x for x in (max_bytes, max_seconds) if x is not None]]
    if min(given) <= 0:
        raise ValueError("a limit is above 0")
    if granularity == "Job":
        return df.withColumn("segment", F.lit(0).cast("long"))
    if granularity not in GRANULARITY:
        raise ValueError("use by_events for files that close between events")
    keys = GRANULARITY[granularity] or [file]
    at = lambda f, c: F.unix_micros(f(c)) if max_seconds is not None else F.lit(0).cast("long")
    groups = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(F.struct("run", "subrun")).alias("_a"), F.max(F.struct("run", "subrun")).alias("_z"), F.count_distinct("run").alias("runs"),
        F.count_distinct("run", "subrun").alias("subruns"), (F.sum(size) if max_bytes is not None else F.lit(0)).cast("long").alias("size"), at(F.min, time).alias("first"), at(F.max, time).alias("last"),
    )
    groups = groups.select(*keys, "n", "runs", "subruns", "size", "first", "last", F.col("_a.run").alias("r0"), F.col("_a.subrun").alias("s0"), F.col("_z.run").alias("r1"), F.col("_z.subrun").alias("s1"))
    files = granularity == "InputFile"

    def assign(batches):
        segment, prev, began = 0, None, None
        n = subruns = runs = inputs = total = 0
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if prev is not None:
                    n, total, inputs = n + prev.n, total + prev.size, inputs + files
                    runs += prev.runs - (row.r0 == prev.r1)
                    subruns += prev.subruns - ((row.r0, row.s0) == (prev.r1, prev.s1))
                    old = max_seconds is not None and prev.last - began >= max_seconds * 1e6
                    if old or n >= max_events or subruns >= max_subruns or runs >= max_runs or inputs >= max_files or (max_bytes is not None and total >= max_bytes):
                        segment, began = segment + 1, None
                        n = subruns = runs = inputs = total = 0
                began, prev = row.first if began is None else min(began, row.first), row
                out.append(segment)
            yield pdf[keys].assign(segment=out)

    types = dict(df.dtypes)
    segments = in_order(groups, keys, assign, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", segment long")
    return df.join(segments, keys)


def file_stats(df: DataFrame) -> DataFrame:
    """segment, n_events, lowest and highest event, run and subrun, and n_subruns, in one aggregation."""
    event, subrun = F.struct("run", "subrun", "event"), F.struct("run", "subrun")
    low, high = F.min(event), F.max(event)
    return df.groupBy("segment").agg(
        F.count("*").alias("n_events"), low["run"].alias("lowest_run"), low["subrun"].alias("lowest_subrun"), low["event"].alias("lowest_event"),
        high["run"].alias("highest_run"), high["subrun"].alias("highest_subrun"), high["event"].alias("highest_event"), F.count_distinct(subrun).alias("n_subruns"),
    )


def file_statistics(df: DataFrame, time: str = "ts", file: str = "file") -> DataFrame:
    """file_stats() with opened and closed (first and last time), the start times of the lowest and highest run and subrun (their first
    event in the file) and parents, the sorted names of the input files."""
    stats = file_stats(df)
    subrun = F.struct("run", "subrun")
    starts = df.groupBy("segment", "run", "subrun").agg(F.min(time).alias("_t"), F.max(time).alias("_z"), F.collect_set(F.regexp_extract(F.col(file).cast("string"), "[^/]*$", 0)).alias("_f"))
    runs = starts.withColumn("_r", F.min("_t").over(Window.partitionBy("segment", "run")))
    pick = lambda f, v: f(F.struct(subrun.alias("k"), F.col(v).alias("v")))["v"]
    times = runs.groupBy("segment").agg(
        F.min("_t").alias("opened"), F.max("_z").alias("closed"), pick(F.min, "_r").alias("lowest_run_time"), pick(F.max, "_r").alias("highest_run_time"),
        pick(F.min, "_t").alias("lowest_subrun_time"), pick(F.max, "_t").alias("highest_subrun_time"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f")))).alias("parents"),
    )
    return stats.join(times, "segment")


def file_names(stats: DataFrame, pattern: str, several: bool = True, **fixed) -> DataFrame:
    """(segment, name) of each closed file: the pattern is filled in Arrow batches and `%#` numbers the files of one filled pattern."""
    check_counter(pattern, several)

    @F.pandas_udf("string")
    def fill(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([substituted(pattern, {**fixed, **{k: None if pd.isna(v) else v for k, v in r.items()}}) for r in rows.to_dict("records")], dtype=object)

    filled = stats.select("segment", fill(F.struct(*stats.columns)).alias("_f"))
    n = (F.row_number().over(Window.partitionBy("_f").orderBy("segment")) - 1).cast("string")
    width = F.coalesce(F.regexp_extract("_f", COUNTER, 1).try_cast("int"), F.lit(0))
    number = F.lpad(n, F.greatest(width, F.length(n)), F.lit("0"))
    return filled.withColumn("_n", number).select("segment", F.regexp_replace("_f", F.lit(COUNTER), F.col("_n")).alias("name"))


def results(df: DataFrame, aggregates: dict) -> DataFrame:
    """Per-file results: aggregates that are cleared at each file."""
    return df.groupBy("segment").agg(*[c.alias(n) for n, c in aggregates.items()])


def metadata(stats: DataFrame, base: dict[str, str], stream: dict[str, str] | None = None) -> DataFrame:
    """segment and a JSON of its metadata; the stream's values override the common ones."""
    values = {**base, **(stream or {})}
    fixed = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    own = [c for c in stats.columns if c != "segment" and c not in values]
    pairs = fixed + [x for c in own for x in (F.lit(c), F.col(c).cast("string"))]
    return stats.select("segment", F.to_json(F.create_map(*pairs)).alias("metadata"))


def carry_over(df: DataFrame, keys: list[str]) -> DataFrame:
    """Level headers of each file: (segment, keys, is_repeat), where a level that an earlier file began is a repeat and not counted again."""
    levels = df.select("segment", *keys).distinct()
    return levels.withColumn("is_repeat", F.row_number().over(Window.partitionBy(*keys).orderBy("segment")) > 1)
