"""Filters that count the events they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.tables import ordinal


def prescale(df: DataFrame, order: list, factor: int, offset: int = 0, visited: Column | None = None) -> DataFrame:
    """Every factor-th row that is visited, by 1-based position: kept where position % factor = offset."""
    if factor < 1:
        raise ValueError("a prescale factor is 1 or more")
    rows = ordinal(df if visited is None else df.where(visited), order, "_n")
    return rows.where(F.pmod("_n", F.lit(factor)) == offset).drop("_n")


def block_prescale(df: DataFrame, order: list, step: int, block: int = 1, offset: int = 0) -> DataFrame:
    """Blocks of rows: with 0-based position c, kept where c >= offset and (c - offset) % step < block."""
    if step < block or block < 1:
        raise ValueError("a step is at least its block")
    c = F.col("_n") - 1
    return ordinal(df, order, "_n").where((c >= offset) & (F.pmod(c - offset, F.lit(step)) < block)).drop("_n")
