"""Output files as a folder of Parquet tables: one directory for each file, and side tables that describe them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The side tables of an output, in the order in which they are written.
SECTIONS = ("version", "ids", "index", "history", "parameters", "registry", "parentage", "metadata", "dependencies")


def write_events(df: DataFrame, path: str, wanted: Column | None = None, keep: list[str] | None = None) -> None:
    """Writes the wanted events (a segment column says to which file) with the kept columns, partitioned by file.

    Rows of a file are brought together before the write, in as many tasks as the size of the file asks for.
    """
    rows = df if wanted is None else df.where(wanted)
    rows = rows if keep is None else rows.select("segment", *[c for c in keep if c != "segment"])
    rows.hint("rebalance", "segment").write.partitionBy("segment").mode("overwrite").parquet(f"{path.rstrip('/')}/events")


def write_tail(path: str, sections: Mapping[str, DataFrame]) -> None:
    """Writes the side tables in their fixed order; unknown ones are errors."""
    if unknown := set(sections) - set(SECTIONS):
        raise ValueError(f"unknown sections {sorted(unknown)}")
    for name in SECTIONS:
        if name in sections:
            sections[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read(spark: SparkSession, path: str, section: str = "events") -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{section}")


def index(df: DataFrame) -> DataFrame:
    """(segment, level, run, subrun, event, entry): where each run, subrun and event begins in its file; entry counts from 0 in id order."""
    none = F.lit(None).cast("long")
    levels = [df.select("segment", F.lit("Event").alias("level"), "run", "subrun", "event"), df.select("segment", F.lit("SubRun").alias("level"), "run", "subrun", none.alias("event")).distinct()]
    levels.append(df.select("segment", F.lit("Run").alias("level"), "run", none.alias("subrun"), none.alias("event")).distinct())
    order = Window.partitionBy("segment", "level").orderBy("run", "subrun", "event")
    rows = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return rows.withColumn("entry", (F.row_number().over(order) - 1).cast("long"))


def save_table(df: DataFrame, name: str, overwrite: bool = True) -> None:
    """Time and memory tables at the end of a job: replaced, or added to."""
    df.write.mode("overwrite" if overwrite else "append").saveAsTable(name)


def check_metadata(values: Mapping[str, str], syntax: bool = True) -> dict[str, str]:
    """Metadata values; with a syntax check each is JSON by itself."""
    if syntax:
        for k, v in values.items():
            try:
                json.loads(v)
            except ValueError as e:
                raise ValueError(f"metadata {k} is no JSON: {v!r}") from e
    return dict(values)


def inherited(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """One row of the values (file type, run type) that all input files share; values that differ are an error."""
    agree = inputs.agg(*[F.min(k).alias(k) for k in keys], *[F.max(k).alias(f"_{k}") for k in keys])
    for k in keys:
        agree = agree.where(F.when(F.col(k) != F.col(f"_{k}"), F.raise_error(F.lit(f"input files differ in {k}")).cast("boolean")).otherwise(True))
    return agree.select(*keys)
