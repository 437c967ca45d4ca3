"""The same analyses on streams of events: an extension; the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.intervals import DisjointIntervals


def with_time(events: DataFrame, late: str) -> DataFrame:
    """Events with a timestamp of their time and a watermark."""
    return events.filter("ts_us is not null").withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", late)


def windowed_stats(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, total and extremes per operation and window of time, repeated deliveries counted once."""
    rows = with_time(events, late).dropDuplicatesWithinWatermark(["event_seq"])
    return rows.groupBy(F.window("at", width), "pid", "name").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("dur_us").alias("sum_us"), F.min("dur_us").alias("min_us"), F.max("dur_us").alias("max_us")
    )


def live_sessions(events: DataFrame, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of each device, closed once the watermark has passed."""
    rows = with_time(events.filter("pid is not null"), late).dropDuplicatesWithinWatermark(["event_seq"])
    return rows.groupBy(F.session_window("at", gap), "pid").agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("n_events")
    )


def split_late(events: DataFrame, allowed_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows loaded in time, and those loaded more than ``allowed_us`` after they happened, for a side output."""
    lag = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.col("ts_us")
    return events.filter(lag <= allowed_us), events.filter(lag > allowed_us)


_STATE = "starts array<bigint>, ends array<bigint>"
_OUT = "pid string, start_us bigint, end_us bigint"


def _merge(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Keeps a device's disjoint intervals; hands over those that the watermark has passed."""
    held = DisjointIntervals()
    if state.exists:
        starts, ends = state.get
        held.starts, held.ends = list(starts), list(ends)
    if state.hasTimedOut:
        done = held.drain()
        state.remove()
    else:
        for pdf in batches:
            for s, e in zip(pdf["start_us"].tolist(), pdf["end_us"].tolist()):
                held.insert(s, e)
        done = held.drain(state.getCurrentWatermarkMs() * 1000)
        if held.starts:
            state.update((held.starts, held.ends))
            state.setTimeoutTimestamp(max(held.ends[-1] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
    yield pd.DataFrame({"pid": [key[0]] * len(done), "start_us": [s for s, _ in done], "end_us": [e for _, e in done]})


def live_busy(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Continuous busy periods per device, from an interval map in keyed state, as the watermark passes them."""
    rows = with_time(events.filter("pid is not null and dur_us > 0"), late).select("pid", "at", F.col("ts_us").alias("start_us"), F.expr("ts_us + dur_us").alias("end_us"))
    return rows.groupBy("pid").applyInPandasWithState(_merge, _OUT, _STATE, "append", "EventTimeTimeout")
