"""Operators over events in the order of time: pairing, merging, clipping, gaps, queues.

They use ``ordered.running`` or scan slots of time, so no device's rows come
together in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.chunks import chunked, scan
from tracequarry.operators.ordered import SLOT_BITS, running
from tracequarry.session import cut, stored


def current_step(events: DataFrame, step: str = "step") -> DataFrame:
    """``events`` with the last step seen so far on the device (null before the first)."""
    return running(events, ["pid"], "ts_us", ["event_seq"], {"current_step": ("last", F.col(step))})


def pair_adjacent(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of a begin directly followed by an end of the same name.

    ``marks`` has ph (B or E), name, ts_us, seq. The pair is emitted at its
    end: (keys, name, start_us, dur_us).
    """
    prev = F.struct("ph", "name", "ts_us")
    rows = running(marks, keys, "ts_us", ["seq"], {"before": ("lag", prev)})
    return rows.filter("ph = 'E' and before.ph = 'B' and before.name = name").select(
        *keys, "name", F.col("before.ts_us").alias("start_us"), (F.col("ts_us") - F.col("before.ts_us")).alias("dur_us")
    )


def pair_nested(marks: DataFrame, keys: Sequence[str], slot_bits: int = SLOT_BITS) -> DataFrame:
    """Spans of begins and ends that nest, last in first out: (keys, name, start_us, dur_us, depth).

    ``marks`` has ph (B or E), name, ts_us, seq. An end without a begin is
    passed over, a begin without an end gives no span. The name is the
    begin's. Depth 1 is the outermost. Marks with a null key or time are left
    out.

    Method: rows of a key and slot of time are scanned in order, in one pass
    over one shuffle. Within a slot begins and ends are paired by level; ends
    whose begin lies before the slot and begins still open at its end, a few
    per slot, are paired afterwards. A slot's spans lie as much deeper as
    begins are open where it starts, which follows from the slots' counts.
    """
    keys = list(keys)
    rows = marks.dropna(subset=[*keys, "ts_us"]).select(*keys, F.shiftright("ts_us", slot_bits).alias("slot"), "ts_us", "seq", "name", (F.col("ph") == "B").alias("begin"))
    rows = rows.repartition(*keys, "slot").sortWithinPartitions(*keys, "slot", "ts_us", "seq")
    own = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    schema = own + "kind string, slot bigint, name string, ts_us bigint, seq bigint, begin boolean, dur_us bigint, depth bigint, popped bigint, n_begin bigint, n_end bigint"
    pieces = stored(rows.mapInPandas(_nested_slots(keys), schema))

    slots = pieces.filter("kind = 'slot'").groupBy(*keys, "slot").agg(F.sum("n_begin").alias("b"), F.sum("n_end").alias("a"))
    order = Window.partitionBy(*keys).orderBy("slot")  # a row per slot
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_s", F.coalesce(F.sum(F.col("b") - F.col("a")).over(before), F.lit(0)))
    slots = slots.withColumn("_low", F.col("_s") - F.col("a"))
    height = F.col("_s") - F.least(F.lit(0), F.coalesce(F.min("_low").over(before), F.lit(0)))
    open_ = slots.select(*keys, "slot", height.alias("_open")).filter("_open > 0")
    inner = pieces.filter("kind = 'span'").join(open_, [*keys, "slot"], "left")
    deeper = F.greatest(F.coalesce("_open", F.lit(0)) - F.col("popped"), F.lit(0))
    inner = inner.select(*keys, "name", F.col("ts_us").alias("start_us"), "dur_us", (F.col("depth") + deeper).alias("depth"))

    left = pieces.filter("kind = 'mark'").select(*keys, F.when(F.col("begin"), "B").otherwise("E").alias("ph"), "name", "ts_us", "seq")
    levels = _levels(left, keys).filter("depth > 0")
    levels = running(levels, [*keys, "depth"], "ts_us", ["seq"], {"before": ("lag", F.struct("ph", "name", "ts_us"))})
    outer = levels.filter("ph = 'E' and before.ph = 'B'").select(
        *keys, F.col("before.name").alias("name"), F.col("before.ts_us").alias("start_us"),
        (F.col("ts_us") - F.col("before.ts_us")).alias("dur_us"), "depth",
    )
    return inner.unionByName(outer)


def _nested_slots(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs the marks of each key and slot, rows in order; open begins go from batch to batch."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # open begins of the last slot, with popped
        last: tuple | None = None
        popped = ends = 0  # of the last slot so far

        def closed() -> Iterator[pd.DataFrame]:
            """The last slot's open begins, and its counts."""
            row = {k: [v] for k, v in zip([*keys, "slot"], last)}
            yield pd.DataFrame(row | {"kind": "slot", "n_begin": [len(held)], "n_end": [ends]})
            if len(held):
                yield held[[*keys, "slot", "name", "ts_us", "seq", "begin"]].assign(kind="mark")

        for pdf in batches:
            if not len(pdf):
                continue
            out: list[pd.DataFrame] = []
            first = tuple(pdf[c].iloc[0] for c in [*keys, "slot"])
            if last is not None and first != last:
                out += closed()
                held, popped, ends = None, 0, 0
            carried = 0 if held is None else len(held)
            pdf = pdf.assign(popped=0) if not carried else pd.concat([held, pdf.assign(popped=0)], ignore_index=True)
            n = len(pdf)
            change = np.zeros(n, bool)
            for c in [*keys, "slot"]:
                v = pdf[c].to_numpy(object)
                change[1:] |= v[1:] != v[:-1]
            group = np.cumsum(change)
            begins = np.concatenate([[0], np.flatnonzero(change)])
            sign = np.where(pdf["begin"].to_numpy(bool), 1, -1)
            total = np.cumsum(sign)
            level = total - np.concatenate([[0], total])[begins][group]
            far = np.int64(2 * n + 2)  # parts the groups' running minima
            low = np.minimum.accumulate(np.minimum(level, 0) - far * group) + far * group
            low_before = np.concatenate([[0], low[:-1]])
            low_before[begins] = 0
            depth = np.where(sign > 0, level - low, level + 1 - low_before)
            ok = np.flatnonzero(depth > 0)
            order = ok[np.lexsort((ok, depth[ok], group[ok]))]
            a, b = order[:-1], order[1:]
            pair = (group[a] == group[b]) & (depth[a] == depth[b]) & (sign[a] > 0) & (sign[b] < 0)
            a, b = a[pair], b[pair]
            more = np.where(group == 0, popped, 0)
            gone = np.where(np.arange(n) < carried, pdf["popped"].to_numpy(np.int64), more - low)
            spans = pdf.iloc[a][[*keys, "slot", "name", "ts_us"]].assign(kind="span", depth=depth[a], popped=gone[a])
            out.append(spans.assign(dur_us=pdf["ts_us"].to_numpy(np.int64)[b] - spans["ts_us"].to_numpy(np.int64)))
            lost = (sign < 0) & (depth <= 0)
            out.append(pdf[lost][[*keys, "slot", "name", "ts_us", "seq", "begin"]].assign(kind="mark"))
            waiting = sign > 0
            waiting[a] = False
            done = waiting & (group < group[-1])
            out.append(pdf[done][[*keys, "slot", "name", "ts_us", "seq", "begin"]].assign(kind="mark"))
            inside = np.arange(len(begins) - 1)  # slots that end within the batch
            if len(inside):
                counts = pdf.iloc[begins[:-1]][[*keys, "slot"]].assign(
                    kind="slot", n_begin=np.bincount(group[done], minlength=len(begins))[:-1], n_end=np.bincount(group[lost], minlength=len(begins))[:-1]
                )
                counts.iloc[0, counts.columns.get_loc("n_end")] += ends
                out.append(counts)
            tail = group == group[-1]
            same = group[-1] == 0
            ends = (ends if same else 0) + int((lost & tail).sum())
            popped = (popped if same else 0) - int(low[-1])
            held = pdf[waiting & tail].assign(popped=gone[waiting & tail])
            last = tuple(pdf[c].iloc[-1] for c in [*keys, "slot"])
            yield from (_nested_row(f, keys) for f in out if len(f))
        if last is not None:
            yield from (_nested_row(f, keys) for f in closed())

    return body


def _nested_row(f: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    f = f.reindex(columns=[*keys, "kind", "slot", "name", "ts_us", "seq", "begin", "dur_us", "depth", "popped", "n_begin", "n_end"])
    for c in ("slot", "ts_us", "seq", "dur_us", "depth", "popped", "n_begin", "n_end"):
        f[c] = f[c].astype("Int64")
    f["begin"] = f["begin"].astype("boolean")
    f["kind"], f["name"] = f["kind"].astype(object), f["name"].astype(object).where(f["name"].notna(), None)
    return f


def _levels(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``marks`` with their level: a begin's own depth, for an end the depth before it.

    Running sum and running minimum of that sum in one pass over slots of
    time: a slot adds its total, and its lowest point after what came before.
    """
    slot, sign = "_slot", F.when(F.col("ph") == "B", 1).otherwise(-1).cast("bigint")
    inner = Window.partitionBy(*keys, slot).orderBy("ts_us", "seq")
    upto, before = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.dropna(subset=[*keys, "ts_us"]).withColumn(slot, F.shiftright("ts_us", SLOT_BITS)).withColumn("_sign", sign)
    rows = rows.withColumn("_sum", F.sum("_sign").over(upto))
    rows = rows.withColumn("_low", F.min("_sum").over(upto)).withColumn("_prior_low", F.min("_sum").over(before))
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, slot).agg(F.sum("_sign").alias("_end"), F.min("_sum").alias("_slot_low"))
    ends = ends.withColumn("_from", F.coalesce(F.sum("_end").over(earlier), F.lit(0)))
    ends = ends.withColumn("_from_low", F.min(F.col("_from") + F.col("_slot_low")).over(earlier))
    rows = rows.join(ends.select(*keys, slot, "_from", "_from_low"), [*keys, slot])
    total = F.col("_from") + F.col("_sum")
    deep = lambda x, low: x - F.least(F.lit(0), F.coalesce(F.least(F.col("_from_low"), F.col("_from") + F.col(low)), F.lit(0)))
    depth = F.when(F.col("ph") == "B", deep(total, "_low")).otherwise(deep(total - F.col("_sign"), "_prior_low"))
    return rows.withColumn("depth", depth).drop(slot, "_sign", "_sum", "_low", "_prior_low", "_from", "_from_low")


def marks_of(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Begin and end marks of complete events: keys, name, ph, ts_us, seq.

    Of equal times, ends come first (the latest begun before the others),
    then begins by number.
    """
    both = F.array(
        F.struct(F.lit("B").alias("ph"), F.col("ts_us").alias("at"), (F.col("event_seq") * 2 + 1).alias("seq")),
        F.struct(F.lit("E").alias("ph"), F.expr("ts_us + dur_us").alias("at"), (-F.col("event_seq") * 2).alias("seq")),
    )
    return events.filter("dur_us > 0").select(*keys, "name", F.explode(both).alias("m")).select(
        *keys, "name", "m.ph", F.col("m.at").alias("ts_us"), "m.seq"
    )


def merge_same_name(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive events of one name as one span: (keys, name, start_us, end_us, merged)."""
    rows = running(events, keys, "ts_us", ["event_seq"], {"before": ("lag", F.col("name"))})
    begins = F.when(F.col("before").isNull() | (F.col("before") != F.col("name")), 1).otherwise(0).cast("bigint")
    rows = running(rows, keys, "ts_us", ["event_seq"], {"island": ("sum", begins)})
    return rows.groupBy(*keys, "name", "island").agg(
        F.min("ts_us").alias("start_us"), F.max(F.expr("ts_us + dur_us")).alias("end_us"), F.count(F.lit(1)).alias("merged")
    ).drop("island")


def clip_overlaps(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starts moved to the end before, where events overlap; ends stay.

    In the order of the ends: ``ts = max(ts, previous end)``.
    """
    rows = events.withColumn("end_us", F.expr("ts_us + dur_us"))
    rows = running(rows, keys, "end_us", ["ts_us", "event_seq"], {"before": ("lag", F.col("end_us"))})
    start = F.greatest("ts_us", "before")
    return rows.select(*keys, "event_seq", start.alias("start_us"), "end_us")


def gap_to_previous(events: DataFrame, keys: Sequence[str], longest_us: int, capped: Column | None = None) -> DataFrame:
    """Gap from the end of the event before to each event: (keys, event_seq, name, prev_name, gap_us).

    Negative gaps and those of ``longest_us`` or more are left out. Where
    ``capped`` holds, a gap longer than the event before counts as 10 us.
    """
    prev = F.struct("name", "ts_us", "dur_us")
    rows = running(events, keys, "ts_us", ["event_seq"], {"before": ("lag", prev)})
    gap = F.col("ts_us") - F.col("before.ts_us") - F.col("before.dur_us")
    if capped is not None:
        gap = F.when(capped & (gap > F.col("before.dur_us")), F.lit(10)).otherwise(gap)
    return (
        rows.filter("before is not null")
        .select(*keys, "event_seq", "name", F.col("before.name").alias("prev_name"), gap.cast("bigint").alias("gap_us"))
        .filter(f"gap_us >= 0 and gap_us < {longest_us}")
    )


def min_gaps(gaps: DataFrame, pid: str = "pid") -> DataFrame:
    """Per operation: mean gap from each predecessor, the least of them and whose it is."""
    per = gaps.groupBy(pid, "name", "prev_name").agg(F.avg("gap_us").alias("avg_gap"))
    first = F.struct("avg_gap", "prev_name")
    return per.groupBy(pid, "name").agg(
        F.round(F.min("avg_gap"), 6).alias("min_gap_us"), F.min_by("prev_name", first).alias("prev_name"), F.count(F.lit(1)).alias("preds")
    )


def coalesce_equal_times(events: DataFrame, keys: Sequence[str], ids: Column) -> DataFrame:
    """Events of one time as one, with all their tensor ids: (keys, ts_us, ids, merged, dur_us)."""
    rows = events.withColumn("_ids", ids)
    return rows.groupBy(*keys, "ts_us").agg(
        F.array_join(
            F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_ids")))), lambda x: x.cast("string")), "+"
        ).alias("ids"),
        F.count(F.lit(1)).alias("merged"),
        F.max("dur_us").alias("dur_us"),
    )


def levels_in_use(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running number of events under way at each mark: (keys, ts_us, seq, busy)."""
    marks = marks_of(events, keys)
    sign = F.when(F.col("ph") == "B", 1).otherwise(-1).cast("bigint")
    return running(marks, keys, "ts_us", ["seq"], {"busy": ("sum", sign)}).select(*keys, "ts_us", "seq", "busy")


def most_parallel(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest number of events under way at once, per key."""
    return levels_in_use(events, keys).groupBy(*keys).agg(F.max("busy").alias("most"))


def fifo_replay(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ends if a device runs its events one after the other, none before it is ready.

    ``end = max(end before, ready) + dur`` in the order of readiness; in closed
    form ``end_i = S_i + max over j <= i of (ready_j - S_(j-1))`` with the
    running sum S of the durations, so two running values do it.
    """
    rows = running(events, keys, "ts_us", ["event_seq"], {"_s": ("sum", F.col("dur_us"))})
    slack = F.col("ts_us") - (F.col("_s") - F.col("dur_us"))
    rows = running(rows, keys, "ts_us", ["event_seq"], {"_late": ("max", slack)})
    return rows.select(*keys, "event_seq", F.col("ts_us").alias("ready_us"), (F.col("_s") + F.col("_late")).alias("end_us"))


def clip_to_span(events: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Events that start within the span of their key."""
    return events.join(spans, key).filter("ts_us >= start_us and ts_us < end_us").drop("start_us", "end_us")


def first_after(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First event of each key by time."""
    cols = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*cols), F.struct("ts_us", "event_seq"))
    return events.groupBy(*keys).agg(first.alias("x")).select(*keys, "x.*")


def dense_number(events: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Numbers of ``what`` by its first appearance within the key: (keys, what, number)."""
    firsts = events.groupBy(*keys, what).agg(F.min(F.struct("ts_us", "event_seq")).alias("at"))
    return firsts.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).drop("at")


_STATE = "chunk int, key string, end_us bigint, dur_us bigint, name string"


def gap_sequential(events: DataFrame, keys: Sequence[str], longest_us: int, cap: bool = False, chunks: int | None = None) -> DataFrame:
    """As ``gap_to_previous``, but an event that overlaps the one before isn't a predecessor itself.

    Which event precedes depends on all before it, so chunks of (keys, time)
    are scanned in order with the state at their start. The states, one row
    per chunk, are scanned for until they no longer change (an event that
    starts after all ends so far makes a chunk forget its start, so this takes
    a round or two), then the gaps are read off.
    """
    key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    rows = events.dropna(subset=[*keys, "ts_us"]).select(*keys, key.alias("key"), "event_seq", "name", "ts_us", "dur_us")
    stable = cut(chunked(rows, "key", "ts_us", "event_seq", chunks=chunks))

    def walk(starts: dict[int, tuple], emit: bool):  # noqa: ANN202
        def body(chunk: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = starts.get(chunk)  # key, end, duration, name
            for pdf in batches:
                out = []
                for i, (k, ts, dur, name) in enumerate(zip(pdf["key"], pdf["ts_us"].tolist(), pdf["dur_us"].tolist(), pdf["name"])):
                    gap = ts - state[1] if state and state[0] == k else None
                    if gap is not None and gap < 0:
                        continue
                    if gap is not None and emit:
                        gap = 10 if cap and gap > state[2] else gap
                        if gap < longest_us:
                            out.append((i, state[3], gap))
                    state = (k, ts + dur, dur, name)
                if emit:
                    at = [i for i, _, _ in out]
                    part = pdf.iloc[at][[*keys, "event_seq", "name"]]
                    yield part.assign(prev_name=[p for _, p, _ in out], gap_us=[g for _, _, g in out])
            if not emit and state:
                yield pd.DataFrame([(chunk, *state)], columns=["chunk", "key", "end_us", "dur_us", "name"])

        return body

    starts: dict[int, tuple] = {}
    while True:
        ends = {r["chunk"]: tuple(r)[1:] for r in scan(stable, walk(starts, False), _STATE).collect()}  # one row per chunk
        order = sorted(ends)
        new = {b: ends[a] for a, b in zip(order, order[1:])}
        if new == starts:
            break
        starts = new
    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return scan(stable, walk(starts, True), schema + "event_seq bigint, name string, prev_name string, gap_us bigint")
