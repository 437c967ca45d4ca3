"""Joins of events: by step, by interval, by occurrence, with and without a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the finest blocks of time that interval joins compare, in bits of microseconds.
BLOCK_BITS = 9
#: Blocks of the next level are so many bits wider; spans of any length fill at most 2 ** LEVEL_BITS + 1 blocks of theirs.
LEVEL_BITS = 6
LEVELS = 8


def _level(length: Column, bits: int) -> Column:
    """Level of blocks for a span: the finest in which it fills few."""
    out = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        out = F.when(length <= F.lit(1 << min(62, bits + LEVEL_BITS * (i + 1))), i).otherwise(out)
    return out


def _width(level: Column, bits: int) -> Column:
    return F.least(level * LEVEL_BITS + bits, F.lit(62)).cast("int")


def _blocked(spans: DataFrame, bits: int) -> DataFrame:
    """Spans [start_us, end_us) with each block of their level that they meet."""
    rows = spans.filter("end_us > start_us").withColumn("_level", _level(F.col("end_us") - F.col("start_us"), bits))
    shift = lambda c: F.call_function("shiftright", c, _width(F.col("_level"), bits))
    return rows.withColumn("_block", F.explode(F.sequence(shift(F.col("start_us")), shift(F.col("end_us") - 1))))


def _probed(points: DataFrame, lo: Column, hi: Column, bits: int) -> DataFrame:
    """Points with each block of each level that [lo, hi] meets."""
    levels = F.explode(F.array(*[F.lit(i) for i in range(LEVELS)]))
    rows = points.withColumns({"_lo": lo, "_hi": hi}).withColumn("_level", levels)
    shift = lambda c: F.call_function("shiftright", F.col(c), _width(F.col("_level"), bits))
    return rows.withColumn("_block", F.explode(F.sequence(shift("_lo"), shift("_hi"))))


def touching(points: DataFrame, spans: DataFrame, key: list[str], lo: Column, hi: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows of ``points`` (with an ``id``) whose short probe [lo, hi] meets a span [start_us, end_us) of the same key.

    Probes and spans are put into blocks of time, so the join is an equality
    of key, level and block; only the ends that lie in a common block are
    compared. A span goes into the blocks of one level, by its length, so a
    long one fills as few as a short one; a probe looks into all levels.
    """
    probes = _probed(points.select("id", *key, lo.alias("_from"), hi.alias("_to")), F.col("_from"), F.col("_to"), bits)
    busy = _blocked(spans.select(*key, "start_us", "end_us"), bits)
    met = probes.join(busy, [*key, "_level", "_block"]).filter("_lo < end_us and _hi >= start_us")
    return points.join(met.select("id").distinct(), "id", "left_semi")


def not_touching(points: DataFrame, spans: DataFrame, key: list[str], lo: Column, hi: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows of ``points`` whose probe meets no span of the same key."""
    met = touching(points, spans, key, lo, hi, bits).select("id")
    return points.join(met, "id", "left_anti")


def within_spans(points: DataFrame, spans: DataFrame, key: list[str], bits: int) -> DataFrame:
    """Pairs of a span (span_id) and the points (id, at_us) that lie in [start_us, end_us)."""
    inner = _probed(points.select("id", *key, "at_us"), F.col("at_us"), F.col("at_us"), bits)
    outer = _blocked(spans.select("span_id", *key, "start_us", "end_us"), bits)
    return outer.join(inner, [*key, "_level", "_block"]).filter("at_us >= start_us and at_us < end_us").select("span_id", "id")


def numbered(events: DataFrame, keys: list[str], name: str = "occurrence") -> DataFrame:
    """Events with their number within the key (by time)."""
    from tracequarry.operators.ordered import running

    rows = running(events, keys, "ts_us", ["event_seq"], {name: ("sum", F.lit(1).cast("bigint"))})
    return rows.withColumn(name, F.col(name) - 1)


def same_occurrence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th event of a key in ``a`` with the n-th in ``b``."""
    left = numbered(a, keys).select(*keys, "occurrence", F.col("event_seq").alias("a_seq"), F.col("ts_us").alias("a_us"), F.col("dur_us").alias("a_dur"))
    right = numbered(b, keys).select(*keys, "occurrence", F.col("event_seq").alias("b_seq"), F.col("ts_us").alias("b_us"), F.col("dur_us").alias("b_dur"))
    return left.join(right, [*keys, "occurrence"])


def clip_receives(pairs: DataFrame) -> DataFrame:
    """Receives that start before their send are cut: (…, b_us, b_dur) with b_us >= a_us, durations not below 0."""
    late = F.greatest(F.col("a_us") - F.col("b_us"), F.lit(0))
    return pairs.withColumn("b_dur", F.greatest(F.col("b_dur") - late, F.lit(0))).withColumn("b_us", F.col("b_us") + late)


def lookup(ops: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """Mean of each operation, 0 where there is none."""
    return ops.join(stats, key, "left").withColumn("avg_ms", F.coalesce("avg_ms", F.lit(0.0)))


def share_ranked(events: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` longest events of each key; ties by number (a top-k report)."""
    order = Window.partitionBy(*key).orderBy(F.desc("dur_us"), "event_seq")
    return events.withColumn("rnk", F.row_number().over(order)).filter(f"rnk <= {n}")
