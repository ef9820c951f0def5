"""The product catalog as a whole: listings, tags, views, what is available, how run and subrun products are put, process history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.lookup import visible

FULL, FRAGMENT, RANGED = "full", "fragment", "ranged"
LEVELS = ("Event", "SubRun", "Run", "Results")


def listing(catalog: DataFrame, only_present: bool = False) -> DataFrame:
    """(level, process, process_seq, module_label, instance, type, friendly_class, product_id, size, present) of each product.

    catalog: those columns, with `available` for what is present; size is null where it is not known.
    """
    cols = ["level", "process", "process_seq", "module_label", "instance", "type", "friendly_class", "product_id", "size", F.col("available").alias("present")]
    out = catalog.select(*cols)
    return out.where("present") if only_present else out


def totals(products: DataFrame) -> DataFrame:
    """(level, process, n_total, n_present, n_missing, size) of a listing."""
    n = lambda c: F.count_if(c).cast("long")
    return products.groupBy("level", "process").agg(F.count("*").alias("n_total"), n("present").alias("n_present"), n(~F.col("present")).alias("n_missing"), F.sum(F.when(F.col("present"), F.col("size"))).cast("long").alias("size"))


def printed(products: DataFrame) -> DataFrame:
    """(level, process_seq, line): the listing as lines of text, fields side by side; a product that is not there has a minus before it."""
    field = lambda c, n: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.greatest(F.lit(n), F.length(F.coalesce(F.col(c).cast("string"), F.lit("-")))), F.lit(" "))
    fields = [field("process", 10), field("module_label", 16), field("instance", 10), field("type", 24), field("product_id", 10), F.coalesce(F.col("size").cast("string"), F.lit("-"))]
    return products.select("level", "process_seq", F.concat(F.when(F.col("present"), "  ").otherwise("- "), F.concat_ws(" ", *fields)).alias("line"))


def tags(catalog: DataFrame, selector: Column, keys: list[str]) -> DataFrame:
    """(keys, tag): the tags label:instance:process of what a selector matches, newest process first (column place from 1); nothing is resolved."""
    tag = F.concat_ws(":", "module_label", "instance", "process").alias("tag")
    rows = catalog.where(selector).select(*keys, "process_seq", "module_label", "instance", tag).distinct()
    order = Window.partitionBy(*keys).orderBy(F.desc("process_seq"), "module_label", "instance")
    return rows.select(*keys, "tag", F.row_number().over(order).cast("long").alias("place"))


def single_view(catalog: DataFrame, selector: Column, keys: list[str], viewable: Column, collection: str = "items", path_labels: list[str] | None = None) -> DataFrame:
    """(keys, pos, element): the elements of the one container of each key that can be viewed.

    Products of this process are looked at first, then files in their order, and the first place with a hit is the last. There,
    processes do not compete: two containers, or a key of the catalog without any, are errors. viewable: whether the container's element
    is, or is derived from, what is asked for.
    """
    hits = catalog.where(selector & viewable & visible(path_labels) & F.col("available"))
    at = F.when(F.col("origin") == "produced", -1).otherwise(F.col("tier"))
    hits = hits.select(*keys, at.alias("_at"), F.col(collection).alias("_items"))
    best = hits.groupBy(*keys).agg(F.min("_at").alias("_at"))
    # One group for each key: its containers are counted before one of them is taken.
    found = hits.join(best, [*keys, "_at"]).groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value("_items").alias("_items"))
    every = catalog.select(*keys).distinct().join(found, keys, "left")
    one = F.when(F.coalesce("_n", F.lit(0)) == 1, F.col("_items")).otherwise(F.raise_error(F.lit("not exactly one container can be viewed")))
    return every.select(*keys, one.alias("_items")).select(*keys, F.posexplode("_items").alias("pos", "element"))


def available(combinable: Column) -> Column:
    """Whether a product can be had, from `dropped`, `produced`, `level` and `status` (null: no provenance yet).

    combinable: a run or subrun product of which some fragment is there, so that it is whole once fragments are combined. Such a product is
    available before it is read, and where its own fragment is the dummy that keeps sums from counting twice.
    """
    spans = F.col("level").isin("Run", "SubRun")
    after = spans & combinable
    here = F.coalesce(F.col("status") == "present", F.lit(False))
    return (
        F.when(F.col("dropped"), False).when(F.col("status").isNull(), after & ~F.col("produced")).when(spans & ~after, here)
        .when(F.col("status") == "dummy", True).otherwise(here)
    )


def with_availability(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments (keys of a product, level, dropped, produced, status) with available; a product is combinable if any fragment of it is present."""
    some = F.max(F.coalesce(F.col("status") == "present", F.lit(False))).over(Window.partitionBy(*keys))
    return fragments.withColumn("_c", some).withColumn("available", available(F.col("_c"))).drop("_c")


def put_spanning(products: DataFrame, keys: list[str], semantic: str, ranges: DataFrame | None = None, aggregable: bool = True) -> DataFrame:
    """Run or subrun products as rows with whole, and begin and end of the events that they stand for.

    full: the whole run or subrun, begin and end null. fragment: the ranges seen so far; ranged: given ranges; both are rows of `ranges` (keys,
    run, subrun, begin, end, whole), take products that can be added up only, and may be neither empty nor a whole run.
    """
    if semantic not in (FULL, FRAGMENT, RANGED):
        raise ValueError(f"unknown semantic {semantic!r}")
    none = F.lit(None).cast("long")
    if semantic == FULL:
        return products.withColumns({"whole": F.lit(True), "begin": none, "end": none})
    if not aggregable:
        raise ValueError("a fragment has to be of a product that can be added up")
    if ranges is None:
        raise ValueError("a fragment needs the ranges that it stands for")
    out = products.join(ranges, keys, "left")
    bad = F.when(F.col("whole"), F.raise_error(F.lit("a fragment may not be of a whole run"))).when(F.coalesce(F.col("begin") >= F.col("end"), F.lit(True)), F.raise_error(F.lit("a fragment needs a valid range")))
    return out.withColumn("whole", F.coalesce(bad.cast("boolean"), F.lit(False)))


def put(products: DataFrame, keys: list[str], level: str, order: str) -> DataFrame:
    """What a level holds after its puts: on runs and subruns the last put of a key replaces those before; on events a second one is an error."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    w = Window.partitionBy(*keys)
    if level in ("Run", "SubRun"):
        return products.withColumn("_last", F.row_number().over(w.orderBy(F.desc(order)))).where("_last = 1").drop("_last")
    twice = F.when(F.count("*").over(w) > 1, F.raise_error(F.lit("a product is put twice")).cast("boolean")).otherwise(True)
    return products.withColumn("_ok", twice).where("_ok").drop("_ok")


def inserted(products: DataFrame, label: str, process: str, process_seq: int, instance: str = "") -> DataFrame:
    """Products that a source puts in the name of a module that does not run: catalog rows under that label, as of the given process."""
    if not label or "_" in label or "_" in instance:
        raise ValueError("a module label and an instance name have no underscore")
    values = {"module_label": label, "instance": instance, "process": process, "process_seq": process_seq, "origin": "produced", "dropped": False, "available": True, "tier": 0}
    return products.withColumns({k: F.lit(v) for k, v in values.items()})


def adjacent_unique(history: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """History rows without those that repeat the row before them; a value that comes back after another stays."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return history.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def newly_dropped(catalog: DataFrame, kept: Column) -> DataFrame:
    """The catalog with kept, and newly_dropped: there until now, and not kept by this output."""
    return catalog.withColumn("kept", kept).withColumn("newly_dropped", ~F.col("kept") & ~F.col("dropped") & ~F.col("transient"))


def parents(events: DataFrame, subruns: DataFrame | None = None, runs: DataFrame | None = None, small: int = 1_000_000) -> DataFrame:
    """Events with the columns of their subrun and run (joined by their ids); a parent table is broadcast if its counted rows are few."""
    out = events
    for table, keys in ((subruns, ["run", "subrun"]), (runs, ["run"])):
        if table is not None:
            out = out.join(F.broadcast(table) if table.count() <= small else table, keys, "left")
    return out
