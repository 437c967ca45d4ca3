"""Ordered scans over range-partitioned rows.

Operators that look at neighbouring rows of one key (sessions, intervals,
runs) normally put the whole key into one task. Here rows are cut by range of
the *full* sort key instead, so that one key with a third of all rows lies in
many partitions ("chunks"), each of which is scanned in order. What a scan
cannot decide at the two ends of its chunk it returns as at most a few rows
per chunk; those are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.session import cut

Scan = Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def chunked(df: DataFrame, *keys: str | Column, chunks: int | None = None) -> DataFrame:
    """Rows cut into ``chunks`` ranges of ``keys`` and sorted within each.

    The number is given explicitly (``spark.sql.shuffle.partitions`` unless
    stated), so adaptive execution leaves the ranges as they are.
    """
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def scan(df: DataFrame, body: Scan, schema: str) -> DataFrame:
    """Runs ``body(chunk number, batches in order)`` once per chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx = TaskContext.get()
        yield from body(ctx.partitionId() if ctx else 0, batches)

    return df.mapInPandas(run, schema)


def small(df: DataFrame) -> DataFrame:
    """Marks a table of at most a few rows per chunk for a broadcast join."""
    return F.broadcast(df)


def global_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with its rows' numbers (from 0) in the order of ``key``, without one task for all.

    Rows are numbered within their chunk; the chunks' sizes, one row each,
    give what to add.
    """
    rows = chunked(df, key).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_chunk", F.shiftright("_id", 33)).withColumn("_pos", F.expr("_id & 8589934591")))
    sizes = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(small(offsets), "_chunk").withColumn(name, F.col("_before") + F.col("_pos")).drop("_id", "_chunk", "_pos", "_before")
