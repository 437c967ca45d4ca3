"""Busy periods and gaps of entities whose intervals overlap, nest or touch."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.chunks import chunked, scan, small
from tracequarry.session import cut


class DisjointIntervals:
    """Ordered map of disjoint intervals; touching ones are joined.

    ``insert`` finds the overlapped neighbours by binary search, so intervals
    may come in any order; ``drain`` hands over what can no longer change.
    """

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> None:
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end, lo)
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def drain(self, before: int | None = None) -> list[tuple[int, int]]:
        """Removes and returns the intervals that end before ``before`` (all, if null)."""
        n = len(self.ends) if before is None else bisect_left(self.ends, before)
        out = list(zip(self.starts[:n], self.ends[:n]))
        del self.starts[:n], self.ends[:n]
        return out

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


_FRAGMENT = "chunk int, entity string, start_us bigint, end_us bigint, prev_end bigint, last boolean"


def _fragments(chunk: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Disjoint intervals of one chunk; rows come by (entity, start)."""
    state, entity, prev_end = DisjointIntervals(), None, None
    out: list[tuple] = []

    def close(before: int | None) -> None:
        nonlocal prev_end
        done = state.drain(before)
        for i, (s, e) in enumerate(done):
            out.append((chunk, entity, s, e, prev_end, before is None and i == len(done) - 1))
            prev_end = e

    def flush() -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["chunk", "entity", "start_us", "end_us", "prev_end", "last"])
        pdf["prev_end"] = pdf["prev_end"].astype("Int64")
        out.clear()
        return pdf

    for pdf in batches:
        for who, group in pdf.groupby("entity", sort=False):
            if who != entity:
                if entity is not None:
                    close(None)
                entity, prev_end = who, None
            starts, ends = group["start_us"].tolist(), group["end_us"].tolist()
            for s, e in zip(starts, ends):
                state.insert(s, e)
            close(starts[-1])
        if out:
            yield flush()
    if entity is not None:
        close(None)
    if out:
        yield flush()


def merge_intervals(
    df: DataFrame, entity: str, start: str, end: str, chunks: int | None = None
) -> DataFrame:
    """Continuous periods and gaps: (entity string, kind, start_us, end_us).

    ``start`` and ``end`` are bigint columns; overlapping or touching
    intervals of an entity form one row of kind ``busy``, the time between
    two successive busy rows is one of kind ``gap``. Rows with a null entity,
    start or end and rows whose end isn't after their start are no intervals.
    Repeated rows change nothing. Other columns of ``df``, whatever their
    names, are ignored. An empty table gives no rows.

    Rows are cut by range of (entity, start) and each chunk is scanned with an
    ordered map of disjoint intervals. Only an entity that runs over several
    chunks needs more: the furthest end so far is carried from chunk to chunk
    (one row per entity and chunk), and intervals that begin before it are
    absorbed by the period it belongs to.
    """
    rows = df.select(
        F.col(entity).cast("string").alias("entity"),
        F.col(start).cast("bigint").alias("start_us"),
        F.col(end).cast("bigint").alias("end_us"),
    ).filter("entity is not null and start_us is not null and end_us > start_us")
    pieces = cut(scan(chunked(rows, "entity", "start_us", "end_us", chunks=chunks), _fragments, _FRAGMENT))

    in_order = Window.partitionBy("entity").orderBy("chunk")
    ends = pieces.groupBy("entity", "chunk").agg(F.max("end_us").alias("furthest"))
    carries = (
        ends.withColumn("carry", F.max("furthest").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("carry is not null")
        .select("entity", "chunk", "carry")
    )
    seen = pieces.join(small(carries), ["entity", "chunk"], "left").withColumn(
        "absorbed", F.expr("carry is not null and start_us <= carry")
    )

    # What later chunks add to the period that is open at the end of a chunk.
    spans = Window.partitionBy("entity")
    per_chunk = (
        seen.groupBy("entity", "chunk")
        .agg(
            F.max(F.expr("if(absorbed, end_us, null)")).alias("reach"),
            F.max(F.expr("not absorbed")).alias("begins"),
        )
        .withColumn("chunks", F.count(F.lit(1)).over(spans))
        .filter("chunks > 1")
        .withColumn(
            "leader",
            F.last(F.expr("if(begins, chunk, null)"), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
        )
    )
    reaches = (
        per_chunk.filter("reach is not null and leader is not null")
        .groupBy("entity", F.col("leader").alias("chunk"))
        .agg(F.max("reach").alias("reach"))
        .withColumn("last", F.lit(True))
    )
    periods = (
        seen.filter("not absorbed")
        .join(small(reaches), ["entity", "chunk", "last"], "left")
        .select(
            "entity",
            "start_us",
            F.greatest("end_us", "reach").alias("end_us"),
            F.greatest("prev_end", "carry").alias("gap_from"),
        )
    )
    return periods.select(
        "entity",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("busy").alias("kind"), F.col("start_us").alias("s"), F.col("end_us").alias("e")),
                    F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("s"), F.col("start_us").alias("e")),
                ),
                lambda x: x.s.isNotNull(),
            )
        ).alias("x"),
    ).select("entity", "x.kind", F.col("x.s").alias("start_us"), F.col("x.e").alias("end_us"))
