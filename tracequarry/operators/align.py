"""Alignment of clocks: drift of hosts, bounds from transfers, and the least shifts that satisfy them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def host_drift(syncs: DataFrame) -> DataFrame:
    """Drift of each host: mean end of the first host's synchronisations less its own, per trial, in us."""
    base = syncs.groupBy("trial").agg(F.min("ts_us").alias("base"))
    means = (
        syncs.join(base, "trial")
        .groupBy("trial", "host")
        .agg(F.avg(F.col("ts_us") + F.col("dur_us") - F.col("base")).alias("m"))
    )
    first = means.groupBy("trial").agg(F.min_by("m", "host").alias("m0"))
    return means.join(first, "trial").select("trial", "host", F.round(F.col("m0") - F.col("m"), 6).alias("drift_us"))


def shift_times(events: DataFrame, shifts: DataFrame, key: list[str], shift: str = "drift_us") -> DataFrame:
    """Times moved by their key's shift (0 where there is none)."""
    moved = events.join(shifts.select(*key, F.col(shift).alias("_shift")), key, "left")
    return moved.withColumn("ts_us", F.col("ts_us") + F.round(F.coalesce("_shift", F.lit(0))).cast("bigint")).drop("_shift")


def drift_bounds(transfers: DataFrame) -> DataFrame:
    """Upper bounds of shift differences: (a, b, bound_us) with S_a - S_b <= bound.

    ``transfers`` has src, dst, sent_us, got_us: nothing arrives before it was
    sent, so the source may be moved on against the target by no more than the
    shortest time under way.
    """
    return transfers.filter("src <> dst").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(
        F.min(F.col("got_us") - F.col("sent_us")).alias("bound_us")
    )


def least_shifts(bounds: list[tuple[str, str, float]], rounds: int = 100_000) -> tuple[dict[str, float], float]:
    """Shifts with the least sum of squares under ``S_a - S_b <= bound``; the first key stays at 0.

    One constraint per pair of hosts, so this runs on the driver: cyclic dual
    ascent (each step meets one constraint, multipliers never below zero), to
    its end or until the bounds prove contradictory: a round then moves on
    for ever, by as much as the one before. The second result is by how much
    the shifts miss their bounds at most (0 where they can be met).
    """
    keys = sorted({k for a, b, _ in bounds for k in (a, b)})
    if not keys:
        return {}, 0.0
    free = keys[1:]
    at = {k: i for i, k in enumerate(free)}
    rows, limits = np.zeros((len(bounds), len(free))), np.array([float(v) for *_, v in bounds])
    for i, (a, b, _) in enumerate(bounds):
        if a in at:
            rows[i, at[a]] += 1
        if b in at:
            rows[i, at[b]] -= 1
    norm = (rows**2).sum(1)
    x, dual = np.zeros(len(free)), np.zeros(len(bounds))
    before = np.inf
    for k in range(rounds):
        moved = 0.0
        for i in np.flatnonzero(norm):
            step = max(-dual[i], (rows[i] @ x - limits[i]) / norm[i])
            dual[i] += step
            x -= step * rows[i]
            moved = max(moved, abs(step))
        if moved < 1e-9 or (k > 1000 and abs(moved - before) < 1e-9 * moved):
            break
        before = moved
    missed = float(np.max(rows @ x - limits, initial=0.0))
    found = {keys[0]: 0.0, **{k: float(x[i]) for k, i in at.items()}}
    return found, missed if missed > 1e-6 else 0.0


def solve_shifts(bounds: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``least_shifts`` of a table of bounds (one row per pair of hosts): (host, shift_us, missed_us).

    ``missed_us`` is 0 where all bounds are met, else by how much the worst is
    missed; shifts under contradictory bounds are no more than near.
    """
    rows = bounds.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs of hosts")
    found, missed = least_shifts([(r["a"], r["b"], r["bound_us"]) for r in rows])
    return bounds.sparkSession.createDataFrame([(k, v, missed) for k, v in sorted(found.items())], "host string, shift_us double, missed_us double")


def link_delays(pairs: DataFrame) -> DataFrame:
    """Per link: mean and least latency of transfers that weren't queued: (src, dst, n, avg_us, min_us)."""
    latency = F.col("got_us") - F.col("sent_us")
    return pairs.filter("not queued").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(latency), 6).alias("avg_us"), F.min(latency).alias("min_us")
    )


def align_transfers(intervals: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Transfers with clocks moved by the least shifts: ``intervals`` (src, dst, sent_us, got_us) with both ends shifted.

    Bounds come from the shortest time under way of each direction, from
    ``probes`` if given (say transfers that weren't queued), else from all.
    Hosts are few, so the solver runs on the driver; transfers are moved in a
    join.
    """
    shifts = solve_shifts(drift_bounds(probes if probes is not None else intervals))
    of = lambda side: shifts.select(F.col("host").alias(side), F.round("shift_us").cast("bigint").alias(f"_{side}"))
    moved = intervals.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    at = lambda c, side: (F.col(c) + F.coalesce(F.col(f"_{side}"), F.lit(0))).alias(c)
    rest = [c for c in intervals.columns if c not in ("sent_us", "got_us")]
    return moved.select(*rest, at("sent_us", "src"), at("got_us", "dst"))
