"""Reading tables, cutting lineage in the shared folder, and a global ordinal without a single-partition window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the folder that spark.checkpoint.dir names. A local session without one gets a folder of its own; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """A copy of df in the shared folder, without its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordinal(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """Adds the 1-based position of each row in a total order.

    Rows are range-partitioned and sorted once and numbered within their partition; only a count for each partition is gathered, and
    its running sum is joined back as a table of that bounded size.
    """
    ranged = _ranged(df, order)
    started = _started(ranged, F.count("*"))
    return started.withColumn(name, F.col("_m").bitwiseAND(2**33 - 1) + F.col("_before") + 1).drop("_m", "_p", "_before")


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the sum of an integer column over the rows before each row in a total order, partition by partition as in ordinal()."""
    started = _started(_ranged(df, order), F.sum(value))
    own = F.sum(value).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    return started.withColumn(name, F.coalesce(own, F.lit(0)) + F.col("_before")).drop("_m", "_p", "_before")


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(sorted_.withColumn("_m", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_m", 33))


def _started(ranged: DataFrame, total: Column) -> DataFrame:
    """With _before: the total of the partitions before the row's."""
    totals = {r._p: r.n for r in ranged.groupBy("_p").agg(total.alias("n")).collect()}
    rows, before = [], 0
    for p in sorted(totals):
        rows.append((p, before))
        before += totals[p] or 0
    starts = ranged.sparkSession.createDataFrame(rows, "_p long, _before long")
    return ranged.join(F.broadcast(starts), "_p", "left")


def in_order(df: DataFrame, order: list[Column | str], step: Callable, schema: str) -> DataFrame:
    """Maps the rows of df in a total order, batch after batch in one task of constant memory: step takes and yields pandas batches.

    For decisions that need the one before, over rows that stand for many others: boundaries of levels, requests of primaries.
    """
    return df.repartition(1).sortWithinPartitions(*order).mapInPandas(step, schema)
