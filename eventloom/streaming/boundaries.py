"""Streams of run, subrun and event items: aggregates that close at boundaries, not at times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run long, subrun long, n_events long, total double, begin long, end long"
STATE = "subrun long, n long, total double, begin long, end long"


def with_flush(items: DataFrame) -> DataFrame:
    """Items (run, seq, subrun, event, value) with flush, and at the end of each run a flush item that closes what is open.

    For an input that is known to end; in an endless stream the sender puts flush items in.
    """
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("subrun", "long"), ("event", "long"), ("value", "double"))}
    ends = items.groupBy("run").agg((F.max("seq") + 1).alias("seq")).select("run", "seq", *none.values(), F.lit(True).alias("flush"))
    return items.select("run", "seq", "subrun", "event", "value", F.lit(False).alias("flush")).unionByName(ends)


def close_on_boundary(stream: DataFrame) -> DataFrame:
    """Per run: a row for each subrun when an item of another subrun, or a flush item, closes it.

    Items: run, seq (their order), subrun, event, value, flush. Items of a batch are put in order within their run; a subrun that
    comes back later is closed again with what came then, so sums over the output count every event once. The state of a run is its open
    subrun alone; the items of a run in one micro-batch are summed column by column, so micro-batches bound what a task holds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b[["seq", "subrun", "event", "value", "flush"]] for b in batches]).sort_values("seq")
        if state.exists:
            subrun, n, total, begin, end = state.get
        else:
            subrun, n, total, begin, end = None, 0, 0.0, None, None
        # Stretches of items of one subrun; a flush item is a stretch of its own.
        new = (rows["subrun"] != rows["subrun"].shift()) | rows["flush"] | rows["flush"].shift(fill_value=False)
        some = rows["event"].notna()
        sums = pd.DataFrame({"g": new.cumsum(), "flush": rows["flush"], "subrun": rows["subrun"], "n": some, "value": rows["value"].where(some, 0.0), "event": rows["event"]})
        sums = sums.groupby("g").agg(flush=("flush", "any"), subrun=("subrun", "first"), n=("n", "sum"), total=("value", "sum"), begin=("event", "min"), end=("event", "max"))
        out = []
        for r in sums.itertuples():
            if r.flush or r.subrun != subrun:
                if subrun is not None and n:
                    out.append((key[0], subrun, n, total, begin, end + 1))
                subrun, n, total, begin, end = None if r.flush else int(r.subrun), 0, 0.0, None, None
            if not r.flush and r.n:
                n, total = n + int(r.n), total + float(r.total)
                begin, end = min(int(r.begin), begin if begin is not None else int(r.begin)), max(int(r.end), end if end is not None else int(r.end))
        state.update((subrun, n, total, begin, end))
        if out:
            yield pd.DataFrame(out, columns=["run", "subrun", "n_events", "total", "begin", "end"])

    return stream.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_prescale(stream: DataFrame, keys: list[str], order: str, factor: int, offset: int = 0) -> DataFrame:
    """Every factor-th row of each key as it arrives, counted across batches: kept where position % factor = offset.

    A counter for each key is the whole state; rows of one batch count in the order of a column.
    """
    if factor < 1:
        raise ValueError("a prescale factor is 1 or more")
    cols = stream.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(order)
        place = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield rows[[p % factor == offset for p in place]][cols]

    return stream.groupBy(*keys).applyInPandasWithState(step, stream.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there, with its checkpoint and its output below path, and returns the output."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
