"""Running values and neighbours in time, without one task per key.

A window over a whole device puts all its rows into one task. These run the
window over slots of time within the key and carry one row per slot over to
the next slots, so a key of any size is spread over many tasks and the slots'
summaries are all that meets per key. Results equal those of the plain
window (``ROWS UNBOUNDED PRECEDING`` or ``LAG``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About 18 minutes of microseconds: what one task of a window holds of a key.
SLOT_BITS = 30

_OPS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    values: dict[str, tuple[str, Column]],
    slot_bits: int = SLOT_BITS,
) -> DataFrame:
    """``df`` with running values in the order of ``ts``, then ``ties``.

    ``values`` maps an output column to (operation, expression); operations
    are sum, min, max, last (the last non-null value up to and with the row)
    and lag (the expression's value at the row before, null at the first).
    Rows with a null key or time are left out; (keys, ts, ties) has to be
    unique for a defined result.
    """
    slot, order = "_slot", [ts, *ties]
    src = df.dropna(subset=[*keys, ts]).withColumn(slot, F.shiftright(F.col(ts), slot_bits))
    # one shuffle serves the window, the slots' ends and the join
    src = src.withColumns({f"_in_{k}": v for k, (_, v) in values.items()}).repartition(*keys, slot)
    inner = Window.partitionBy(*keys, slot).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    local: dict[str, Column] = {}
    tails: list[Column] = []
    for k, (op, _) in values.items():
        v = F.col(f"_in_{k}")
        if op in _OPS:
            local[f"_at_{k}"] = _OPS[op][0](v).over(upto)
            tails.append(_OPS[op][0](v).alias(f"_end_{k}"))
        elif op == "last":
            local[f"_at_{k}"] = F.last(v, True).over(upto)
            tails.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_end_{k}"))
        elif op == "lag":
            local[f"_at_{k}"] = F.lag(F.struct(v.alias("v"))).over(inner)
            tails.append(F.max_by(F.struct(v.alias("v")), at).alias(f"_end_{k}"))
        else:
            raise ValueError(f"no operation {op}")
    between = Window.partitionBy(*keys).orderBy(slot)
    before = between.rowsBetween(Window.unboundedPreceding, -1)
    ends = src.groupBy(*keys, slot).agg(*tails)
    carried = ends.select(
        *keys,
        slot,
        *[
            (
                _OPS[op][0](f"_end_{k}").over(before)
                if op in _OPS
                else F.last(f"_end_{k}", True).over(before)
                if op == "last"
                else F.lag(f"_end_{k}").over(between)
            ).alias(f"_from_{k}")
            for k, (op, _) in values.items()
        ],
    )
    joined = src.withColumns(local).join(carried, [*keys, slot])
    out: dict[str, Column] = {}
    for k, (op, _) in values.items():
        a, b = F.col(f"_from_{k}"), F.col(f"_at_{k}")
        if op in _OPS:
            out[k] = _OPS[op][1](a, b)
        elif op == "last":
            out[k] = F.coalesce(b, a)
        else:
            out[k] = F.coalesce(b, a)["v"]
    helper = [slot, *[f"{p}_{k}" for k in values for p in ("_in", "_at", "_from")]]
    return joined.withColumns(out).drop(*helper)


def islands(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], begins: Column, number: str, slot_bits: int = SLOT_BITS
) -> DataFrame:
    """``df`` with the number of ``begins`` so far: rows of one island share it."""
    return running(df, keys, ts, ties, {number: ("sum", F.when(begins, 1).otherwise(0).cast("bigint"))}, slot_bits)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
