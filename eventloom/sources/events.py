"""Event sources: generated ids, headers from tables, integrity rules, levels, limits and input lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventloom.functions.tables import ordinal


def generated(spark: SparkSession, max_events: int, events_in_run: int = 0, events_in_subrun: int = 0, first: tuple[int, int, int] = (1, 0, 1), reset_event_on_subrun: bool = True, skip: int = 0, timestamp: Callable[[Column], Column] | None = None, max_time: float | None = None, max_subruns: int | None = None) -> DataFrame:
    """run, subrun, event of `max_events` generated events in closed form over a range; sizes of 0 or less never roll over.

    A run that is full starts the next at the first subrun and event; a full subrun starts the next at the first event, or goes on
    counting unless reset_event_on_subrun. skip moves the first id only. timestamp maps the position to a column `ts`.
    """
    if max_time is not None and (max_events >= 0 or max_subruns is not None):
        raise ValueError("a time limit excludes limits of events and subruns")
    i = F.col("id") + skip
    r0, s0, e0 = (F.lit(x).cast("long") for x in first)
    in_run = F.pmod(i, F.lit(events_in_run)) if events_in_run > 0 else i
    run = r0 + (F.floor(i / events_in_run) if events_in_run > 0 else 0)
    subrun = s0 + (F.floor(in_run / events_in_subrun) if events_in_subrun > 0 else 0)
    event = e0 + (F.pmod(in_run, F.lit(events_in_subrun)) if events_in_subrun > 0 and reset_event_on_subrun else in_run)
    df = spark.range(max_events).select("id", run.cast("long").alias("run"), subrun.cast("long").alias("subrun"), event.cast("long").alias("event"))
    if max_subruns is not None and events_in_subrun > 0:
        df = df.where(F.col("id") < max_subruns * events_in_subrun)
    if timestamp is not None:
        df = df.withColumn("ts", timestamp(F.col("id")))
    return df.drop("id")


def headers(events: DataFrame) -> DataFrame:
    """The event table with (run, subrun, event) from its time stamp and number."""
    return events.withColumns({"run": F.dayofmonth("ts").cast("long"), "subrun": F.hour("ts").cast("long"), "event": F.col("event_id") + 1})


def levels(header: DataFrame, mode: str = "RunsSubRunsAndEvents") -> DataFrame:
    """(level, run, subrun, event) items of a job that processes `Runs`, `RunsAndSubRuns` or `RunsSubRunsAndEvents`."""
    if mode not in ("Runs", "RunsAndSubRuns", "RunsSubRunsAndEvents"):
        raise ValueError(f"unknown processing mode {mode!r}")
    none = F.lit(None).cast("long")
    out = header.select(F.lit("Run").alias("level"), "run", none.alias("subrun"), none.alias("event")).distinct()
    if mode != "Runs":
        out = out.unionByName(header.select(F.lit("SubRun").alias("level"), "run", "subrun", none.alias("event")).distinct())
    if mode == "RunsSubRunsAndEvents":
        out = out.unionByName(header.select(F.lit("Event").alias("level"), "run", "subrun", "event"))
    return out


def limited(header: DataFrame, order: list, max_events: int = -1, max_subruns: int = -1) -> DataFrame:
    """The first events and the first subruns of a job, -1 for no limit. Subruns come in the order of their ids."""
    if max_subruns >= 0:
        subruns = ordinal(header.select("run", "subrun").distinct(), ["run", "subrun"], "_n").where(F.col("_n") <= max_subruns)
        header = header.join(subruns.drop("_n"), ["run", "subrun"], "left_semi")
    return ordinal(header, order, "_n").where(F.col("_n") <= max_events).drop("_n") if max_events >= 0 else header


def handled_levels(parents: DataFrame, events: DataFrame, keys: list[str], empty: bool = True) -> DataFrame:
    """Run or subrun headers that begin: all, or only those with an event below when empty ones are not handled."""
    return parents if empty else parents.join(events.select(*keys).distinct(), keys, "left_semi")


def forward_filled(items: DataFrame) -> DataFrame:
    """Items (file, pos, kind r/s/e, number) with the run and subrun in force: a new file goes on with the last run and subrun."""
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run, sub = F.when(F.col("kind") == "r", F.col("number")), F.when(F.col("kind") == "s", F.col("number"))
    df = items.withColumns({"_r": F.last(run, ignorenulls=True).over(up_to("file")), "_g": F.count(run).over(up_to("file"))})
    df = df.withColumn("_s", F.last(sub, ignorenulls=True).over(up_to("file", "_g")))
    # What is in force at the end of each file: a row for each file, and so few enough for one window.
    ends = df.groupBy("file").agg(F.max_by("_r", "pos").alias("r"), F.max_by("_s", "pos").alias("s"), F.max("_g").alias("g"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when((F.col("g") > 0) | F.col("s").isNotNull(), F.struct("s"))
    ends = ends.select("file", F.last("r", ignorenulls=True).over(before).alias("_r0"), F.last(known, ignorenulls=True).over(before)["s"].alias("_s0"))
    df = df.join(ends, "file").withColumn("run", F.coalesce("_r", "_r0"))
    df = df.withColumn("subrun", F.when(F.col("_g") > 0, F.col("_s")).otherwise(F.coalesce("_s", "_s0")))
    return df.withColumn("event", F.when(F.col("kind") == "e", F.col("number"))).drop("_r", "_g", "_s", "_r0", "_s0")


def integrity_violations(header: DataFrame, file: str, pos: str) -> DataFrame:
    """Rows of a file's item stream that break a rule: (file, pos, rule).

    invalid_id: a null, run 0, event 0 or the largest u32; repeated_subrun: a subrun that comes back after another one in the file;
    repeated_event: an event id that stands in the file before.
    """
    top = 2**32 - 1
    w = Window.partitionBy(file).orderBy(pos)
    bad = F.col("run").isNull() | F.col("subrun").isNull() | F.col("event").isNull() | (F.col("run") == 0) | (F.col("event") == 0) | (F.col("run") >= top) | (F.col("subrun") >= top) | (F.col("event") >= top)
    new = (F.coalesce(F.lag("run").over(w) != F.col("run"), F.lit(True)) | F.coalesce(F.lag("subrun").over(w) != F.col("subrun"), F.lit(True)))
    df = header.withColumn("_new", new)
    again = F.col("_new") & (F.sum(F.col("_new").cast("int")).over(Window.partitionBy(file, "run", "subrun").orderBy(pos)) > 1)
    twice = F.row_number().over(Window.partitionBy(file, "run", "subrun", "event").orderBy(pos)) > 1
    df = df.withColumns({"_bad": bad, "_again": again, "_twice": twice})
    rules = F.array_compact(F.array(F.when(F.col("_bad"), "invalid_id"), F.when(F.col("_again"), "repeated_subrun"), F.when(F.col("_twice"), "repeated_event")))
    return df.withColumn("rule", F.explode(rules)).select(file, pos, "rule")


def stream_violations(items: DataFrame, file: str = "file", pos: str = "pos") -> DataFrame:
    """Items of a reader that break its contract: (file, pos, rule).

    An item says whether it has more to give (`more`) and what is new: new_run; new_subrun with the run it names (subrun_run); new_event
    with the run and subrun it names (event_run, event_subrun). Rules: nothing_new, data_at_end, no_run, no_subrun, same_run,
    same_subrun, event_without_subrun (a new run with an event but no subrun), run_mismatch, subrun_mismatch, invalid_id.
    """
    top = 2**32 - 1
    before = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda *c: F.last(F.when(F.col("new_subrun").isNotNull(), F.struct(*c)), ignorenulls=True).over(before)
    df = items.withColumns({"_run": F.last("new_run", ignorenulls=True).over(before), "_sub": last(F.col("subrun_run").alias("r"), F.col("new_subrun").alias("s"))})
    r, s, e, more = F.col("new_run"), F.col("new_subrun"), F.col("new_event"), F.col("more")
    run = F.coalesce(r, "_run")
    in_force = F.when(s.isNotNull(), F.struct(F.col("subrun_run").alias("r"), s.alias("s"))).otherwise(F.col("_sub"))
    bad = lambda c: (c == 0) | (c >= top)
    some = r.isNotNull() | s.isNotNull() | e.isNotNull()
    rules = {
        "nothing_new": more & ~some, "data_at_end": ~more & some, "no_run": more & run.isNull(), "no_subrun": more & in_force.isNull(), "same_run": more & (r == F.col("_run")),
        "same_subrun": more & (s == F.col("_sub.s")) & (F.col("subrun_run") == F.col("_sub.r")), "event_without_subrun": more & F.col("_run").isNotNull() & F.col("_sub").isNotNull() & r.isNotNull() & s.isNull() & e.isNotNull(),
        "run_mismatch": more & (F.col("subrun_run") != run), "subrun_mismatch": more & ((F.col("event_run") != in_force["r"]) | (F.col("event_subrun") != in_force["s"])),
        "invalid_id": more & (bad(r) | (s >= top) | bad(e)),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return df.select(file, pos, F.explode(names).alias("rule"))


def principals(ids: DataFrame, is_real: bool = True, kind: str = "Data") -> DataFrame:
    """Run, subrun and event rows of a reader with their defaults: real data, of kind Data."""
    if kind not in ("Any", "Align", "Calib", "Cosmics", "Data", "Mc", "Raw", "Test"):
        raise ValueError(f"unknown kind of events {kind!r}")
    return ids.withColumns({"is_real": F.lit(is_real), "kind": F.lit(kind)})


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """The names in a list file: one a line, `#` starts a comment, blank lines go."""
    name = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(name.alias("name")).where("name <> ''")


class UserSource(DataSource):
    """A user reader as a Spark data source: spark.read.format("eventloom").option("reader", "module:function").load([file, ...]).

    function(file) yields (run, subrun, event) triples, None for a level that is not new; files are read in parallel, one to a
    partition. Options max_events and max_subruns are limits in each file, -1 for none.
    """

    @classmethod
    def name(cls) -> str:
        return "eventloom"

    def schema(self) -> str:
        return "file string, pos long, run long, subrun long, event long"

    def reader(self, schema) -> UserReader:
        return UserReader(self.options)


class UserReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        import json

        given = self.options.get("paths") or self.options.get("path", "")
        files = json.loads(given) if given.startswith("[") else [f for f in given.split(",") if f]
        return [InputPartition(f) for f in files]

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["reader"].partition(":")
        read = getattr(importlib.import_module(module), name)
        most, most_subruns = int(self.options.get("max_events", -1)), int(self.options.get("max_subruns", -1))
        run = subrun = None
        events = subruns = 0
        for pos, (r, s, e) in enumerate(read(partition.value)):
            if r is None and s is None and e is None:
                raise ValueError(f"{partition.value}: item {pos} has nothing new")
            if r is not None:
                if r == run:
                    raise ValueError(f"{partition.value}: run {r} is not new")
                run, subrun = r, None
            if s is not None:
                if run is None or s == subrun and r is None:
                    raise ValueError(f"{partition.value}: subrun {s} is not new or has no run")
                if subruns == most_subruns:
                    return
                subrun, subruns = s, subruns + 1
            if e is not None:
                if subrun is None:
                    raise ValueError(f"{partition.value}: event {e} has no subrun")
                if events == most:
                    return
                events += 1
            yield partition.value, pos, run, subrun, e
