"""Sessions: stretches of activity separated by gaps of inactivity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.chunks import chunked, scan, small
from tracequarry.session import cut

_SCHEMA = (
    "kind string, chunk int, part int, entity string, start_us bigint, end_us bigint, "
    "n_events bigint, n_labels bigint, label double"
)


def _scanner(gap_us: int) -> Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lag and running sum over the rows of a chunk, batch by batch.

    Sessions that lie inside the chunk come out whole. The first and the last
    of the chunk may go on in its neighbours: they come out as ``open`` with
    their distinct labels as rows of their own.
    """

    def body(chunk: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = 0
        last: tuple | None = None  # entity, ts, id of the row before
        cur: list | None = None  # entity, start, end, n, labels
        out: list[tuple] = []

        def close(open_end: bool) -> None:
            nonlocal part
            if cur is None:
                return
            who, start, end, n, labels = cur
            if part == 0 or open_end:
                out.append(("open", chunk, part, who, start, end, n, None, None))
                out.extend(("label", chunk, part, who, None, None, None, None, x) for x in labels)
            else:
                out.append(("whole", chunk, part, who, start, end, n, len(labels), None))
            part += 1

        def flush() -> pd.DataFrame:
            pdf = pd.DataFrame(out, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
            for c in ("start_us", "end_us", "n_events", "n_labels"):
                pdf[c] = pdf[c].astype("Int64")
            out.clear()
            return pdf

        for pdf in batches:
            who = pdf["entity"].to_numpy(dtype=object)
            ts = pdf["ts_us"].to_numpy(dtype=np.int64)
            ids = pdf["event_id"].to_numpy(dtype=np.int64)
            lab = pdf["label"].to_numpy(dtype=np.float64)
            same = np.empty(len(who), bool)
            same[1:] = who[1:] == who[:-1]
            lag = np.empty(len(who), np.int64)
            lag[1:] = ts[:-1]
            rep = np.zeros(len(who), bool)
            rep[1:] = (ids[1:] == ids[:-1]) & (ts[1:] == ts[:-1])
            if last is None:
                same[0], lag[0] = False, ts[0]
            else:
                same[0], lag[0] = who[0] == last[0], last[1]
                rep[0] = ids[0] == last[2] and ts[0] == last[1]
            rep &= same
            begins = ~same | (ts - lag > gap_us)
            number = np.cumsum(begins)
            keep = ~rep
            last = (who[-1], int(ts[-1]), int(ids[-1]))
            cuts = np.flatnonzero(begins)
            edges = np.unique(np.concatenate([[0], cuts, [len(who)]]))
            counts = np.add.reduceat(keep.astype(np.int64), edges[:-1])
            good = np.flatnonzero(keep & ~np.isnan(lab))
            pairs = pd.DataFrame({"n": number[good], "x": lab[good]}).drop_duplicates()
            labels = {k: set(v) for k, v in pairs.groupby("n")["x"]}
            for a, b, n in zip(edges[:-1], edges[1:], counts):
                found = labels.get(number[a], set())
                if begins[a]:
                    close(False)
                    cur = [who[a], int(ts[a]), int(ts[b - 1]), int(n), found]
                else:
                    cur[2] = int(ts[b - 1])
                    cur[3] += int(n)
                    cur[4] |= found
            if len(out) > 5000:
                yield flush()
        close(True)
        if out:
            yield flush()

    return body


def sessionize(
    df: DataFrame,
    entity: str,
    ts: str,
    event_id: str,
    label: Column,
    gap_us: int,
    chunks: int | None = None,
) -> DataFrame:
    """Sessions of each entity: (entity, start_us, end_us, n_events, n_labels).

    A session ends where more than ``gap_us`` lie before the entity's next
    event. Rows with a null entity, time or id are left out; rows that repeat
    an id with the same entity and time count once. ``label`` is a double,
    null where there is none; ``n_labels`` counts its distinct values (0 if
    none). Other columns are ignored; an empty table gives no rows.

    Method: lag per entity flags the gaps, the running sum of the flags
    numbers the sessions, and rows are aggregated by it. This is done over
    chunks of (entity, time), so a busy entity is spread over many tasks; a
    window over the at most two open sessions of each chunk joins what was
    cut.
    """
    rows = df.select(
        F.col(entity).cast("string").alias("entity"),
        F.col(ts).cast("bigint").alias("ts_us"),
        F.col(event_id).cast("bigint").alias("event_id"),
        label.cast("double").alias("label"),
    ).filter("entity is not null and ts_us is not null and event_id is not null")
    pieces = cut(scan(chunked(rows, "entity", "ts_us", "event_id", chunks=chunks), _scanner(gap_us), _SCHEMA))

    in_order = Window.partitionBy("entity").orderBy("chunk", "part")
    opened = (
        pieces.filter("kind = 'open'")
        .withColumn("gap", F.col("start_us") - F.lag("end_us").over(in_order))
        .withColumn(
            "session", F.sum(F.expr(f"if(gap is null or gap > {gap_us}, 1, 0)")).over(in_order)
        )
    )
    spans = opened.groupBy("entity", "session").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events")
    )
    labels = (
        pieces.filter("kind = 'label'")
        .select("entity", "chunk", "part", "label")
        .join(small(opened.select("entity", "chunk", "part", "session")), ["entity", "chunk", "part"])
        .select("entity", "session", "label")
        .distinct()
        .groupBy("entity", "session")
        .agg(F.count(F.lit(1)).alias("n_labels"))
    )
    joined = spans.join(labels, ["entity", "session"], "left").select(
        "entity", "start_us", "end_us", "n_events", F.coalesce("n_labels", F.lit(0)).cast("bigint").alias("n_labels")
    )
    whole = pieces.filter("kind = 'whole'").select("entity", "start_us", "end_us", "n_events", "n_labels")
    return whole.unionByName(joined)


def step_number(args: str = "args") -> Column:
    """The step number that ``args['step']`` holds as text, however written; else null."""
    return F.expr(f"try_cast(trim({args}['step']) as double)")
