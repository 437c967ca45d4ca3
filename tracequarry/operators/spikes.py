"""Implausible measurements: impossible values, spikes and stuck runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.chunks import chunked, scan
from tracequarry.session import stored


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the detector; they hold for every source alike."""

    least: int = 1  # smallest possible value
    most: int = 86_400_000_000  # largest possible value
    stuck: int = 8  # successive equal values that count as stuck
    levels: int = 4  # scales of the wavelet
    detail: float = 3.5  # coefficients beyond so many robust scales are spikes, unless the check finds them usual
    bin: float = 0.02  # width of the histogram, in natural logarithms
    mode_share: float = 0.02  # share of a source's rows that makes a level usual,
    mode_rows: int = 3  # and rows that it has at least
    gap: float = 0.25  # empty stretch that parts levels: at least this much,
    gap_spread: float = 0.9  # and so many spreads of the source
    few: int = 20  # below so many rows a source has no usual values


def details(x: np.ndarray, levels: int) -> np.ndarray:
    """Undecimated Haar detail coefficients of ``x`` at each scale and side.

    Row ``2 j`` holds the value less the mean of the ``2**j`` values before,
    row ``2 j + 1`` the value less the mean of those after; at the ends the
    series is mirrored.
    """
    n = len(x)
    out = np.zeros((2 * levels, n))
    if n < 2:
        return out
    for j in range(levels):
        w = min(2**j, n - 1)
        padded = np.concatenate([x[1 : w + 1][::-1], x, x[-w - 1 : -1][::-1]])
        sums = np.concatenate([[0.0], np.cumsum(padded)])
        before = (sums[w : w + n] - sums[:n]) / w
        after = (sums[2 * w + 1 : 2 * w + 1 + n] - sums[w + 1 : w + 1 + n]) / w
        out[2 * j], out[2 * j + 1] = x - before, x - after
    return out


def coefficients(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of the detail of each value at each scale, and the approximation at the coarsest.

    A spike stands out against both sides, the edge of a step against one; so
    the smaller of the two details counts.
    """
    d = details(x, levels)
    size = np.abs(d)
    return np.minimum(size[0::2], size[1::2]), x - d[-1]


#: Details are kept as whole numbers, in steps of a twentieth of their logarithm.
STEPS = 20
LEAST_DETAIL = 1e-3


def code_of(d: np.ndarray) -> np.ndarray:
    return np.round(STEPS * np.log(np.maximum(d, LEAST_DETAIL))).astype(np.int64)


def _median(values: np.ndarray, counts: np.ndarray, share: float = 0.5) -> int:
    order = np.argsort(values)
    upto = np.cumsum(counts[order])
    return int(values[order][np.searchsorted(upto, share * upto[-1])])


_SCHEMA = (
    "kind string, chunk int, run int, event_id bigint, source string, series string, value bigint, n bigint, "
    "codes array<int>, level bigint, edge boolean"
)


def _scanner(rules: SpikeRules) -> Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One pass over rows by (source, series, time, id).

    Comes out: ``bad`` impossible rows, ``stuck`` rows of long zero-detail
    runs, ``run`` and ``member`` rows for the runs at the chunk's ends, ``row``
    every plausible row with its bin as ``n``, the codes of its details, the
    bin of its approximation as ``level`` and whether its details reach over
    the chunk's ends; ``bin`` and ``code`` counts of each source's values and
    details (``run`` is the scale).
    """
    reach = 2 ** (rules.levels - 1)

    def body(chunk: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_id: int | None = None
        # the run that is still open: its key, its length and, while short, its rows
        key: tuple | None = None
        length, members, closed = 0, [], 0

        def close(at_end: bool, out: list) -> None:
            """Runs at the chunk's ends are returned, as they may go on beyond them."""
            nonlocal closed
            if key is not None and (closed == 0 or at_end):
                out.append(("run", chunk, closed > 0, None, *key, length))
                if length < rules.stuck:
                    out.extend(("member", chunk, closed > 0, i, *key, None) for i in members)
            closed += key is not None

        def extend(new: np.ndarray, found: list) -> None:
            nonlocal length, members
            before, length = length, length + len(new)
            if length < rules.stuck:
                members = [*members, *new.tolist()]
                return
            found.append(new)
            if before < rules.stuck:
                found.append(np.asarray(members, np.int64))
                members = []

        # rows whose details aren't known yet, behind as many that they need
        wait = (np.empty(0, np.int64), np.empty(0, object), np.empty(0, object), np.empty(0, bool), np.empty(0, np.int64))
        known = emitted = 0

        def decompose(at_end: bool) -> list[pd.DataFrame]:
            nonlocal wait, known, emitted
            i, who, whose, at_time, v = wait
            upto = len(i) if at_end else max(len(i) - reach, known)
            if upto == known:
                return []
            x = np.log(v)
            same = (who[1:] == who[:-1]) & (whose[1:] == whose[:-1]) & (at_time[1:] == at_time[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(i)]])
            d, approx = np.empty((rules.levels, len(i))), np.empty(len(i))
            for a, b in zip(cuts[:-1], cuts[1:]):
                d[:, a:b], approx[a:b] = coefficients(x[a:b], rules.levels)
            codes, at = code_of(d), np.floor(x / rules.bin).astype(np.int64)
            edge = np.zeros(len(i), bool)
            if emitted - known < reach:  # the series may begin in the chunk before
                edge[: min(int(cuts[1]), reach - (emitted - known))] = True
            if at_end:
                edge[max(int(cuts[-2]), len(i) - reach) :] = True
            part = slice(known, upto)
            rows = pd.DataFrame(
                {
                    "kind": "row", "event_id": i[part], "source": who[part], "n": at[part], "codes": list(codes[:, part].T.astype(np.int32)),
                    "level": np.floor(approx[part] / rules.bin).astype(np.int64), "edge": edge[part],
                }
            )
            frames = [rows]
            counted = [("bin", 0, at[part]), *[("code", j, codes[j, part]) for j in range(rules.levels)]]
            for kind, j, values in counted:
                sums = pd.DataFrame({"source": who[part], "value": values}).groupby(["source", "value"], sort=False).size()
                frames.append(sums.rename("n").reset_index().assign(kind=kind, run=j))
            emitted += upto - known
            left = max(0, upto - reach)
            wait = tuple(y[left:] for y in wait)
            known = upto - left
            return frames

        for pdf in batches:
            ids = pdf["event_id"].to_numpy(np.int64)
            fresh = np.empty(len(ids), bool)
            fresh[1:] = ids[1:] != ids[:-1]
            fresh[0] = last_id is None or ids[0] != last_id
            last_id = int(ids[-1])
            if not fresh.all():
                pdf, ids = pdf[fresh], ids[fresh]
            if not len(pdf):
                continue
            src = pdf["source"].to_numpy(object)
            ser = pdf["series"].to_numpy(object)
            val = pdf["value"].to_numpy(np.int64)
            timed = pdf["timed"].to_numpy(bool)
            n = len(ids)
            out: list[tuple] = []
            frames: list[pd.DataFrame] = []

            # (c) zero details at the finest scale: runs of equal values
            t = np.flatnonzero(timed)
            if len(t):
                ts_src, ts_ser, ts_val, ts_id = src[t], ser[t], val[t], ids[t]
                brk = np.ones(len(t), bool)
                brk[1:] = (ts_val[1:] != ts_val[:-1]) | (ts_src[1:] != ts_src[:-1]) | (ts_ser[1:] != ts_ser[:-1])
                brk[0] = key is None or (ts_src[0], ts_ser[0], int(ts_val[0])) != key
                edges = np.unique(np.concatenate([[0], np.flatnonzero(brk), [len(t)]]))
                sizes, found = np.diff(edges), []
                for k in sorted({0, len(sizes) - 1}):  # the runs in between lie inside the chunk
                    a, b = edges[k], edges[k + 1]
                    if brk[a]:
                        close(False, out)
                        key, length, members = (ts_src[a], ts_ser[a], int(ts_val[a])), 0, []
                    extend(ts_id[a:b], found)
                if len(sizes) > 2:
                    closed += 1
                    long = np.repeat(sizes >= rules.stuck, sizes)
                    long[: edges[1]] = long[edges[-2] :] = False
                    found.append(ts_id[long])
                found = np.concatenate(found) if found else np.empty(0, np.int64)
                if len(found):
                    frames.append(pd.DataFrame({"kind": "stuck", "event_id": found}))

            # (a) out of bounds
            sane = (val >= rules.least) & (val <= rules.most)
            if not sane.all():
                frames.append(pd.DataFrame({"kind": "bad", "event_id": ids[~sane]}))

            # (b) the wavelet's coefficients; the last rows wait for those behind them
            s = np.flatnonzero(sane & (src != None))  # noqa: E711
            new = (ids[s], src[s], ser[s], timed[s], val[s])
            wait = tuple(np.concatenate(x) for x in zip(wait, new))
            frames += decompose(False)
            if out:
                frames.append(_frame(out))
            if frames:
                yield _align(frames)
        out = []
        close(True, out)
        frames = decompose(True)
        if out:
            frames.append(_frame(out))
        if frames:
            yield _align(frames)

    return body


_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLUMNS[:8])
    for c in ("event_id", "value", "n"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def _align(frames: list[pd.DataFrame]) -> pd.DataFrame:
    out = []
    for f in frames:
        f = f.reindex(columns=_COLUMNS)
        for c in ("chunk", "run"):
            f[c] = f[c].astype("Int32")
        for c in ("event_id", "value", "n", "level"):
            f[c] = f[c].astype("Int64")
        f["edge"] = f["edge"].astype("boolean")
        for c in ("source", "series", "codes"):
            f[c] = f[c].astype(object).where(f[c].notna(), None)
        out.append(f)
    return pd.concat(out, ignore_index=True)


def usual_levels(bins: np.ndarray, counts: np.ndarray, rules: SpikeRules) -> list[tuple[int, int]]:
    """Ranges of bins, first and last, that hold a source's usual values.

    Filled bins with less than the gap between them belong together; such a
    group is usual if it holds ``mode_share`` of the rows and ``mode_rows`` at
    least. The gap follows the spread of the rows within their groups.
    """
    order = np.argsort(bins)
    bins, counts = bins[order], counts[order]
    total = counts.sum()

    def groups(gap: float) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(bins) * rules.bin > gap + rules.bin) + 1
        edges = [0, *cuts.tolist(), len(bins)]
        return [(a, b) for a, b in zip(edges[:-1], edges[1:]) if counts[a:b].sum() >= max(rules.mode_share * total, rules.mode_rows)]

    def spread(a: int, b: int) -> float:
        c = np.cumsum(counts[a:b])
        lo, hi = np.searchsorted(c, [0.1587 * c[-1], 0.8413 * c[-1]])
        return (bins[a + min(hi, b - a - 1)] - bins[a + lo]) * rules.bin / 2

    first = groups(rules.gap)
    if not first:
        return [(int(bins[0]), int(bins[-1]))]
    weights = [counts[a:b].sum() for a, b in first]
    inner = sum(w * spread(a, b) for w, (a, b) in zip(weights, first)) / sum(weights)
    wider = groups(max(rules.gap, rules.gap_spread * inner)) or first
    return [(int(bins[a]), int(bins[b - 1])) for a, b in wider]


def flag_implausible(
    df: DataFrame,
    source: str,
    series: str,
    ts: str,
    value: str,
    event_id: str,
    rules: SpikeRules = SpikeRules(),
    chunks: int | None = None,
) -> DataFrame:
    """Rows to distrust: (event_id bigint, reason string), one row per reason.

    * ``impossible``: the value is below ``least`` or above ``most``;
    * ``spike``: it lies apart from the usual values of its ``source``;
    * ``stuck``: it is one of at least ``stuck`` successive equal values of one
      ``series`` (say a device) and source, by time.

    Rows with a null value or id give nothing. Rows without a source can only
    be impossible; rows without series or time can't be stuck. Rows that
    repeat an id (with the same content) count once. Sources of fewer than
    ``few`` plausible rows have no spikes. Ties in time go by id. Other
    columns are ignored; an empty table gives no rows.

    Method: rows are scanned in chunks of (source, series, time). An
    undecimated Haar wavelet of the logarithm of each series' values yields
    detail coefficients per scale and the approximation at the coarsest. Their
    robust scales are drawn per source from all of its rows (medians of
    counted coefficients; the quartiles of the values for the approximation).
    Rows with a coefficient beyond ``detail`` scales are spikes, runs of zero
    details are stuck, bounds find the impossible. The approximation tells
    long stretches of outlying values, whose details are small. As a source
    may switch between usual levels, which makes large coefficients too, an
    exact check follows: a spike stays one if it lies apart from the levels of
    its source's histogram. Rows whose details reach over a chunk's ends (at
    most ``2 ** levels`` per chunk) go to the check whatever theirs are.
    """
    rows = df.select(
        F.col(source).cast("string").alias("source"),
        F.col(series).cast("string").alias("series"),
        F.col(ts).cast("bigint").alias("ts"),
        F.col(event_id).cast("bigint").alias("event_id"),
        F.col(value).cast("bigint").alias("value"),
    ).filter("value is not null and event_id is not null")
    keys = ["source", "series", "ts", "event_id"]
    rows = rows.withColumn("timed", F.expr("ts is not null and series is not null and source is not null"))
    pieces = stored(scan(chunked(rows, *keys, chunks=chunks), _scanner(rules), _SCHEMA))

    counts = pieces.filter("kind in ('bin', 'code')").groupBy("source", "kind", "run", "value").agg(F.sum("n").alias("n"))

    def usual(pdf: pd.DataFrame) -> pd.DataFrame:
        """A source's levels, and the bounds of its coefficients; as many rows as it has bins and codes."""
        held = pdf[pdf["kind"] == "bin"]
        bins, n = held["value"].to_numpy(np.int64), held["n"].to_numpy(np.int64)
        if n.sum() < rules.few:
            return pd.DataFrame({"source": [], "levels": [], "most": [], "low": [], "high": []}, dtype=object)
        most = []
        for j in range(rules.levels):
            own = pdf[(pdf["kind"] == "code") & (pdf["run"] == j)]
            middle = np.exp(_median(own["value"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) / STEPS)
            most.append(int(code_of(np.array([rules.detail * max(middle / 0.6745, rules.bin)]))[0]))
        low, centre, high = (_median(bins, n, q) for q in (0.25, 0.5, 0.75))
        wide = rules.detail * max((high - low) / 1.349, 1.0)
        found = usual_levels(bins, n, rules)
        return pd.DataFrame(
            {"source": [pdf["source"].iloc[0]], "levels": [[list(x) for x in found]], "most": [most],
             "low": [int(centre - wide)], "high": [int(centre + wide)]}
        )

    schema = "source string, levels array<array<bigint>>, most array<int>, low bigint, high bigint"
    bounds = counts.groupBy("source").applyInPandas(usual, schema)
    beyond = F.exists(F.arrays_zip("codes", "most"), lambda x: x["codes"] > x["most"])
    spiky = F.col("edge") | beyond | ~F.col("level").between(F.col("low"), F.col("high"))
    apart = ~F.exists("levels", lambda x: F.col("n").between(x[0], x[1]))
    found = pieces.filter("kind = 'row'").select("event_id", "source", "n", "codes", "level", "edge").join(bounds, "source")
    spikes = found.filter(spiky).filter(apart).select("event_id", F.lit("spike").alias("reason"))

    # Runs cut by the ends of chunks: the last of one and the first of the next.
    ends = pieces.filter("kind = 'run'")
    in_order = Window.orderBy("chunk", "run")  # at most two rows a chunk
    same = F.lit(True)
    for c in ("source", "series", "value"):
        same = same & (F.col(c) == F.lag(c).over(in_order))
    sums = (
        ends.withColumn("apart", F.when(same & (F.col("run") == 0), 0).otherwise(1))
        .withColumn("whole", F.sum("apart").over(in_order))
        .withColumn("total", F.sum("n").over(Window.partitionBy("whole")))
        .filter(f"total >= {rules.stuck}")
        .select("chunk", "run")
    )
    joined = (
        pieces.filter("kind = 'member'").join(F.broadcast(sums), ["chunk", "run"]).select("event_id", F.lit("stuck").alias("reason"))
    )
    return (
        pieces.filter("kind = 'bad'")
        .select("event_id", F.lit("impossible").alias("reason"))
        .unionByName(pieces.filter("kind = 'stuck'").select("event_id", F.lit("stuck").alias("reason")))
        .unionByName(joined)
        .unionByName(spikes)
    )
