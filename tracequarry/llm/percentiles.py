"""Percentiles per group of very large numeric columns, from states that can be combined."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.operators.chunks import chunked, scan
from tracequarry.session import stored

DAY_US = 86_400_000_000
PROBS = (0.5, 0.9, 0.99, 0.999)


def representative(value: Column, bits: int | None, whole: bool = True) -> Column:
    """``value``, or with ``bits`` the middle of all values that share its first ``bits`` binary digits.

    The middle is off by at most ``2 ** -bits`` of the value. ``whole`` tells
    integers from floating-point numbers.
    """
    if bits is None:
        return value
    if not whole:
        size = F.abs(value)
        step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - (bits - 1))
        return F.when((size > 0) & (size < float("inf")), F.signum(value) * (F.floor(size / step) + 0.5) * step).otherwise(value)
    size = F.abs(F.greatest(value, F.lit(-(2**63) + 1)))
    width = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    return F.call_function(
        "if",
        width == 0,
        value,
        F.signum(value.cast("double")).cast("bigint")
        * (F.call_function("shiftleft", F.call_function("shiftright", size, width), width)
           + F.call_function("shiftleft", F.lit(1).cast("bigint"), width - 1)),
    )


def value_states(
    df: DataFrame, group: str, value: str, event_id: str | None, ts_us: str | None, bits: int | None = None
) -> DataFrame:
    """Combinable state: (grp string, day date, value, n bigint).

    Counts of each value per group and UTC day (null where there is no time),
    over distinct ids if ``event_id`` names them. Integers are counted as
    bigint, floating-point numbers as double, decimals as they are (without
    ``bits`` only). With ``bits`` values are kept to so many binary digits,
    which bounds a state to ``2 ** bits`` rows per group, day and power of
    two; without, the state is exact. Rows with a null group or value (or,
    with ``event_id``, a null id) and those of NaN are left out. Rows that
    repeat an id are taken to have the same content.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, T.IntegralType):
        number = F.col(value).cast("bigint")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    elif isinstance(kind, T.DecimalType) and bits is None:
        number = F.col(value)
    else:
        raise TypeError(f"no percentiles of {kind.simpleString()}")
    rows = df.select(
        F.col(group).cast("string").alias("grp"),
        number.alias("value"),
        *([F.col(event_id).alias("event_id")] if event_id else []),
        (F.date_from_unix_date(F.floor(F.col(ts_us) / DAY_US).cast("int")) if ts_us else F.lit(None).cast("date")).alias("day"),
    ).dropna(subset=["grp", "value", *(["event_id"] if event_id else [])])
    if event_id:
        rows = rows.distinct()  # an id has one content, so whole rows tell; hashed without a sort
    kept = representative(F.col("value"), bits, isinstance(kind, T.IntegralType))
    return combine(rows.select("grp", "day", kept.alias("value"), F.lit(1).cast("bigint").alias("n")))


def combine(*states: DataFrame) -> DataFrame:
    """One state of all rows behind the given ones (days, files, partitions)."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("grp", "day", "value").agg(F.sum("n").alias("n"))


def _counted(chunk: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order with their chunk and the running counts of their group, and of group and day, within it."""
    group, whole, days = None, 0, {}
    for pdf in batches:
        if not len(pdf):
            continue
        names = pdf["grp"].to_numpy(object)
        n = pdf["n"].to_numpy(np.int64)
        day = pdf["day_no"].to_numpy(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        upto, upto_day = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for a, b in zip(begins, [*begins[1:], len(n)]):
            if names[a] != group:
                group, whole, days = names[a], 0, {}
            upto[a:b] = whole + np.cumsum(n[a:b])
            whole = int(upto[b - 1])
            own = day[a:b]
            order = np.argsort(own, kind="stable")
            sums = np.cumsum(n[a:b][order])
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
            sizes = np.diff([*firsts, b - a])
            present = own[order][firsts].tolist()
            before = np.array([days.get(d, 0) for d in present]) - np.concatenate([[0], sums])[firsts]
            sums = sums + np.repeat(before, sizes)
            upto_day[a + order] = sums
            days.update(zip(present, sums[np.cumsum(sizes) - 1].tolist()))
        yield pdf.assign(chunk=chunk, upto=upto, upto_day=upto_day)


def percentiles(
    states: DataFrame,
    probs: Sequence[float] = PROBS,
    bits: int | None = None,
    by_day: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """Percentiles of each group and of each group and day, from a state.

    Columns: grp, level (``all`` or ``day``), day (null for ``all``), n, one
    ``p<digits>`` per probability (linear interpolation between neighbouring
    order statistics, as ``quantile_cont``), and error_bound, the largest
    relative error (0 for an exact state; ``bits`` has to be that of the
    state). Values without a day count for ``all`` only; a value may stand in
    more than one row of a state. An empty state gives no rows.

    Method: one distributed sort of the state by (group, value, day). A scan
    of each sorted partition gives every row its running count within the
    partition, of its group and of its group and day, so the one sort serves
    both. The partitions' counts per group, summed up in their order, are the
    offsets of each partition in the order of all values; they tell the
    partitions that hold a target position, and there the running count finds
    the two neighbouring order statistics, which are interpolated exactly. A
    group of any size is spread over many partitions; what meets per group is
    one row per partition.
    """
    day_no = F.coalesce(F.unix_date("day"), F.lit(-(2**31)))
    rows = states.select("grp", "value", day_no.alias("day_no"), "n")
    kind = rows.schema["value"].dataType.simpleString()
    schema = f"grp string, value {kind}, day_no int, n bigint, chunk int, upto bigint, upto_day bigint"
    ordered = stored(scan(chunked(rows, "grp", "value", "day_no", chunks=chunks), _counted, schema))

    def level(name: str, key: list[str], upto: str) -> DataFrame:
        held = ordered.filter("true" if name == "all" else f"day_no > {-(2**31)}")
        of_key = Window.partitionBy(*key)
        before = of_key.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        parts = held.groupBy(*key, "chunk").agg(F.sum("n").alias("held"))
        parts = parts.withColumns(
            {"offset": F.coalesce(F.sum("held").over(before), F.lit(0)), "total": F.sum("held").over(of_key)}
        )
        at = {q: F.lit(float(q)) * (F.col("total") - 1) for q in probs}
        places = {q: (F.floor(at[q]), F.ceil(at[q])) for q in probs}
        inside = reduce(
            lambda a, b: a | b,
            [(p >= F.col("offset")) & (p < F.col("offset") + F.col("held")) for q in probs for p in places[q]],
        )
        targets = parts.filter(inside).drop("held")
        last = F.col("offset") + F.col(upto) - 1
        first = last - F.col("n") + 1
        found = held.join(targets, [*key, "chunk"])
        found = found.filter(reduce(lambda a, b: a | b, [(first <= p) & (p <= last) for q in probs for p in places[q]]))
        pick = lambda p: F.max(F.when((first <= p) & (p <= last), F.col("value"))).cast("double")
        picks = [x for i, q in enumerate(probs) for x in (pick(places[q][0]).alias(f"lo{i}"), pick(places[q][1]).alias(f"hi{i}"))]
        # a whole number of positions leaves nothing between neighbours, be they infinite
        between = lambda i, q: F.when(
            F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")
        ).otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (at[q] - places[q][0]))
        day = F.date_from_unix_date("day_no") if name == "day" else F.lit(None).cast("date")
        return found.groupBy(*key).agg(F.max("total").alias("total"), *picks).select(
            "grp",
            F.lit(name).alias("level"),
            day.alias("day"),
            F.col("total").alias("n"),
            *[between(i, q).alias("p" + f"{q:.6f}".rstrip("0")[2:].ljust(2, "0")) for i, q in enumerate(probs)],
            F.lit(0.0 if bits is None else 2.0**-bits).alias("error_bound"),
        )

    found = level("all", ["grp"], "upto")
    return found.unionByName(level("day", ["grp", "day_no"], "upto_day")) if by_day else found
