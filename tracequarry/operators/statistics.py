"""Statistics of operations, categories, devices and iterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.ordered import running

DAY_US = 86_400_000_000


def ms(us: Column) -> Column:
    return F.round(us / 1000, 9)


def distinct_events(events: DataFrame, *cols: str) -> DataFrame:
    """Each event once, with the columns that are needed only (others never reach the shuffle).

    A repeated delivery has the same content, so whole rows are compared,
    which a hash does without a sort; maps can't be compared, with them the
    first delivery is taken.
    """
    rows = events.select(*dict.fromkeys(["event_seq", *cols])).filter("event_seq is not null")
    if any(t.startswith("map") for _, t in rows.dtypes):
        return rows.dropDuplicates(["event_seq"])
    return rows.distinct()


def timed_events(events: DataFrame, *cols: str) -> DataFrame:
    """Distinct events that statistics are made of.

    Left out: instants, debug rows, rows without pid, name or time, and
    durations below zero or above a day.
    """
    need = ["pid", "name", "ts_us", "dur_us"]
    rows = events.filter(
        f"pid is not null and name is not null and ts_us is not null and dur_us between 0 and {DAY_US} "
        "and lower(ph) <> 'i' and coalesce(cat, '') <> 'debug'"
    )
    return distinct_events(rows, *need, *[c for c in cols if c not in need])


def _spread(us: str) -> tuple[Column, Column, Column]:
    """Exact sums for a population variance: count, sum, sum of squares."""
    x = F.col(us).cast("decimal(18,0)")
    return F.count(us).alias("cnt"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q")


def _variance() -> Column:
    """From the exact sums, in square milliseconds, so the order of addition has no say."""
    mean = F.col("_s").cast("double") / F.col("cnt")
    n = F.col("cnt").cast("double")
    return (F.col("_q").cast("double") / n - mean * mean) / 1e6


def op_stats(events: DataFrame) -> DataFrame:
    """Per device and operation: count, min, max, mean, variance and upper median, in ms.

    The upper median is the element at ``count / 2`` of the sorted durations.
    Durations are counted by ranges (quarter octaves) first, where the rows
    are; the ranges' counts tell which one holds the median and at which
    place, and only its durations are then counted and ordered. So no task
    gets a busy operation's rows.
    """
    key = ["pid", "name", "cat_fine"]
    d = F.col("dur_us").cast("decimal(18,0)")
    part = F.floor(F.log2(F.col("dur_us") + 1.0) * 4).cast("int")
    ranges = events.groupBy(*key, part.alias("_range")).agg(
        F.count(F.lit(1)).alias("n"), F.min("dur_us").alias("_min"), F.max("dur_us").alias("_max"), F.sum(d).alias("_s"), F.sum(d * d).alias("_q")
    )
    span = Window.partitionBy(*key)  # a row per range
    upto = span.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumns({"_upto": F.sum("n").over(upto), "cnt": F.sum("n").over(span)})
    middle = F.floor(F.col("cnt") / 2)
    inside = (F.col("_upto") > middle) & (F.col("_upto") - F.col("n") <= middle)
    stats = ranges.groupBy(*key).agg(
        F.max("cnt").alias("cnt"),
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
        F.sum("_s").alias("_s"),
        F.sum("_q").alias("_q"),
        F.max(F.when(inside, F.col("_range"))).alias("_range"),
        F.max(F.when(inside, middle - (F.col("_upto") - F.col("n")))).alias("_at"),
    )
    values = events.groupBy(*key, part.alias("_range"), "dur_us").agg(F.count(F.lit(1)).alias("n"))
    found = values.join(stats, [*key, "_range"])
    found = found.withColumn("_upto", F.sum("n").over(span.orderBy("dur_us").rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.first(c).alias(c) for c in ("cnt", "_min", "_max", "_s", "_q")]
    found = found.groupBy(*key).agg(*same, F.min(F.when(F.col("_upto") > F.col("_at"), F.col("dur_us"))).alias("_median"))
    return found.select(
        *key,
        "cnt",
        ms(F.col("_min")).alias("min_ms"),
        ms(F.col("_max")).alias("max_ms"),
        ms(F.col("_s").cast("double") / F.col("cnt")).alias("avg_ms"),
        F.round(F.sqrt(F.greatest(_variance(), F.lit(0.0))), 3).alias("std_ms"),
        ms(F.col("_median")).alias("median_hi_ms"),
    )


def op_means(events: DataFrame) -> DataFrame:
    """Count and sums only: the part of ``op_stats`` that most operators need."""
    return events.groupBy("pid", "name", "cat_fine").agg(F.count(F.lit(1)).alias("cnt"), F.sum("dur_us").alias("sum_us"))


def category_stats(events: DataFrame) -> DataFrame:
    """Per category: largest mean of an operation and its name, total, counts, mean."""
    ops = op_means(events).withColumn("avg_us", F.col("sum_us") / F.col("cnt"))
    first = F.struct(F.col("avg_us"), F.concat_ws("->", "pid", "name"))
    return ops.groupBy("cat_fine").agg(
        ms(F.max("avg_us")).alias("max_ms"),
        F.max_by(F.concat_ws("->", "pid", "name"), first).alias("max_name"),
        ms(F.sum("sum_us")).alias("time_ms"),
        F.sum("cnt").alias("cnt"),
        F.count(F.lit(1)).alias("op_cnt"),
        ms(F.sum("sum_us") / F.sum("cnt")).alias("avg_ms"),
    )


def top_ops(events: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` slowest operations by mean duration; ties by name."""
    ops = op_means(events).withColumn("avg_ms", ms(F.col("sum_us") / F.col("cnt")))
    return ops.select("pid", "name", "cnt", "avg_ms").orderBy(F.desc("avg_ms"), "pid", "name").limit(n)


def iterations(events: DataFrame) -> DataFrame:
    """Per device and step: start, end of the last-started operation, and time of each phase, in ms."""
    last = F.struct("ts_us", "name", "event_seq")
    phase = lambda c: F.sum(F.when(F.col("cat_fine") == c, F.col("dur_us")).otherwise(0))
    return (
        events.filter("step is not null and cat = 'operator'")
        .groupBy("pid", "step")
        .agg(
            F.min("ts_us").alias("start_us"),
            F.max_by(F.expr("ts_us + dur_us"), last).alias("end_us"),
            ms(phase("operator.FW")).alias("fw_ms"),
            ms(phase("operator.BW")).alias("bw_ms"),
            ms(phase("operator.UPDATE")).alias("update_ms"),
        )
        .withColumn("iter_ms", ms(F.col("end_us") - F.col("start_us")))
    )


def device_iterations(iters: DataFrame) -> DataFrame:
    """Per device: number of steps, mean and population deviation of the iteration time, means of the phases."""
    return iters.groupBy("pid").agg(
        F.count(F.lit(1)).alias("steps"),
        F.round(F.avg("iter_ms"), 4).alias("avg_ms"),
        F.round(F.stddev_pop("iter_ms"), 3).alias("std_ms"),
        F.round(F.avg("fw_ms"), 4).alias("fw_ms"),
        F.round(F.avg("bw_ms"), 4).alias("bw_ms"),
        F.round(F.avg("update_ms"), 4).alias("update_ms"),
    )


def overall_iteration(iters: DataFrame, unstable: float = 0.1) -> DataFrame:
    """Iteration time of each trial: devices cut to the fewest steps, mean per step, then over steps.

    Where the deviation is above ``unstable`` of the mean the median is taken
    instead. ``opt_step`` is the step index whose time is nearest to it.
    """
    order = Window.partitionBy("trial", "pid").orderBy("step")
    per = iters.withColumn("k", F.row_number().over(order) - 1)
    fewest = per.groupBy("trial", "pid").agg(F.count(F.lit(1)).alias("n")).groupBy("trial").agg(F.min("n").alias("fewest"))
    steps = per.join(fewest, "trial").filter("k < fewest").groupBy("trial", "k").agg(F.avg("iter_ms").alias("x"))
    whole = steps.groupBy("trial").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"), F.median("x").alias("mid")
    )
    whole = whole.withColumn("iter_ms", F.expr(f"if(mean <> 0 and dev / mean > {unstable}, mid, mean)"))
    near = steps.join(whole.select("trial", "iter_ms"), "trial").groupBy("trial").agg(
        F.min_by("k", F.struct(F.round(F.abs(F.col("x") - F.col("iter_ms")), 6), F.col("k"))).alias("opt_step")
    )
    return whole.join(near, "trial").select(
        "trial", "steps", F.round("mean", 4).alias("mean_ms"), F.round("dev", 3).alias("std_ms"), F.round("iter_ms", 4).alias("iter_ms"), "opt_step"
    )


def straggler(events: DataFrame) -> DataFrame:
    """Per device and category: count, total, and its share of the category's total over all devices."""
    per = events.groupBy("pid", "cat_fine").agg(F.count(F.lit(1)).alias("cnt"), F.sum("dur_us").alias("us"))
    whole = per.groupBy("cat_fine").agg(F.sum("us").alias("whole"))
    return per.join(whole, "cat_fine").select(
        "pid", "cat_fine", "cnt", ms(F.col("us")).alias("time_ms"), F.round(F.col("us") / F.col("whole"), 6).alias("share")
    )


def spans(events: DataFrame, *key: str) -> DataFrame:
    """First start and last end of each key."""
    return events.groupBy(*key).agg(F.min("ts_us").alias("start_us"), F.max(F.expr("ts_us + dur_us")).alias("end_us"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean durations of two trials by operation; operations that one lacks are left out."""
    left, right = (
        df.groupBy("name").agg(F.sum("dur_us").alias(s), F.count(F.lit(1)).alias(n)) for df, s, n in ((a, "sa", "na"), (b, "sb", "nb"))
    )
    va, vb = F.col("sa") / F.col("na") / 1000, F.col("sb") / F.col("nb") / 1000
    return left.join(right, "name").select(
        "name",
        F.round(va, 6).alias("avg_a"),
        F.round(vb, 6).alias("avg_b"),
        F.round(vb - va, 6).alias("absolute"),
        F.round(F.when(va != 0, (vb - va) / va), 6).alias("relative"),
    )


def modal_counts(events: DataFrame, slack: int) -> DataFrame:
    """Operations whose number of events lies more than ``slack`` off the most frequent number."""
    counts = events.groupBy("pid", "name").agg(F.count(F.lit(1)).alias("cnt"))
    often = counts.groupBy("pid", "cnt").agg(F.count(F.lit(1)).alias("k"))
    mode = often.groupBy("pid").agg(F.max_by("cnt", F.struct(F.col("k"), -F.col("cnt"))).alias("mode"))
    return counts.join(mode, "pid").filter(F.abs(F.col("cnt") - F.col("mode")) > slack).select("pid", "name", "cnt", "mode")


def trimmed_means(events: DataFrame, cut: int = 10, many: int = 100) -> DataFrame:
    """Mean duration without the first and last ``cut`` samples (of the last ``many``, if there are more)."""
    counts = events.groupBy("pid", "name").agg(F.count(F.lit(1)).alias("n"))
    rows = running(events, ["pid", "name"], "ts_us", ["event_seq"], {"rn": ("sum", F.lit(1).cast("bigint"))}).join(counts, ["pid", "name"])
    kept = rows.filter(
        (F.col("rn") <= F.col("n") - cut) & (F.col("rn") > F.when(F.col("n") > many, F.col("n") - many).otherwise(F.lit(cut)))
    )
    return kept.groupBy("pid", "name").agg(F.count(F.lit(1)).alias("kept"), ms(F.avg("dur_us")).alias("avg_ms"))


def bandwidth(events: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bits per microsecond of each tensor group: its size over the time from first start to last end."""
    span = events.groupBy("trial", "op_name").agg(F.min("ts_us").alias("a"), F.max(F.expr("ts_us + dur_us")).alias("b"))
    return span.join(sizes, "op_name").filter("b > a").select(
        "trial", "op_name", "size_bytes", F.round(F.col("size_bytes") * 8 / (F.col("b") - F.col("a")), 9).alias("bits_per_us")
    )


def error_report(df: DataFrame, actual: str, predicted: str, large: float) -> DataFrame:
    """Relative errors of predictions: mean, median, by size, and how many lie above or below."""
    ape = F.abs(F.col(predicted) - F.col(actual)) / F.col(actual)
    rows = df.filter(f"{actual} > 0 and {predicted} is not null").withColumn("ape", F.round(ape, 9))
    big = F.col(actual) >= large
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("ape"), 6).alias("mape"),
        F.round(F.median("ape"), 6).alias("median_ape"),
        F.round(F.avg(F.when(big, F.col("ape"))), 6).alias("mape_large"),
        F.round(F.avg(F.when(~big, F.col("ape"))), 6).alias("mape_small"),
        F.sum(F.when(F.col(predicted) > F.col(actual), 1).otherwise(0)).alias("over"),
        F.sum(F.when(F.col(predicted) < F.col(actual), 1).otherwise(0)).alias("under"),
    )
