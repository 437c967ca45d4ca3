"""Cost models: communication by size, kernels by features, memory, partitions of tensors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators.chunks import global_number
from tracequarry.session import cut

#: Fixed value: default size of a tensor partition, in bytes.
PARTITION_BYTES = 4_096_000


def fit_lines(samples: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per key with slope and intercept not below zero: (key, n, slope, intercept).

    Exact for two variables: where the free line has a negative coefficient,
    the best line with that coefficient at zero is taken. Sums are all that
    meets per key.
    """
    s = samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.avg(F.col(x) * F.col(x)).alias("_xx"),
        F.avg(F.col(x) * F.col(y)).alias("_xy"),
    )
    var = F.col("_xx") - F.col("_mx") * F.col("_mx")
    slope = F.when(var > 0, (F.col("_xy") - F.col("_mx") * F.col("_my")) / var).otherwise(0.0)
    s = s.withColumn("_k", slope).withColumn("_b", F.col("_my") - F.col("_k") * F.col("_mx"))
    return s.select(
        *key,
        "n",
        F.round(F.when(F.col("_k") < 0, 0.0).when(F.col("_b") < 0, F.greatest(F.col("_xy") / F.col("_xx"), F.lit(0.0))).otherwise(F.col("_k")), 6).alias("slope"),
        F.round(F.when(F.col("_k") < 0, F.greatest("_my", F.lit(0.0))).when(F.col("_b") < 0, 0.0).otherwise(F.col("_b")), 3).alias("intercept"),
    )


def interpolate(points: DataFrame, table: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Values of ``points`` (key, at) by the lines between the rows of ``table`` (key, x, y); beyond its ends the last line goes on.

    Tables of a key are short (one row per size); keys with one row give it.
    """
    segments = (
        table.select(*key, F.col(x).alias("x0"), F.col(y).alias("y0"))
        .withColumn("x1", F.lead("x0").over(Window.partitionBy(*key).orderBy("x0")))
        .withColumn("y1", F.lead("y0").over(Window.partitionBy(*key).orderBy("x0")))
        .withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("x0")))
        .withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    )
    usable = segments.filter("x1 is not null or rows = 1")
    first, final = F.col("pos") == 1, F.col("pos") >= F.col("rows") - 1
    hit = points.join(usable, key).filter(
        ((F.col("at") >= F.col("x0")) | first) & ((F.col("at") < F.col("x1")) | final | F.col("x1").isNull())
    )
    slope = F.when(F.col("x1") > F.col("x0"), (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).otherwise(0.0)
    return hit.select(*[c for c in points.columns], F.round(F.col("y0") + slope * (F.col("at") - F.col("x0")), 6).alias("value"))


# Curves of pushing and pulling in log10 of bytes and ms: (x0, y0, x1, y1, slope), and the factor on them.
SERVER_CURVES = {
    "push": (4.70781790174102, -1.7521176854008658, 626.2991919900213, 619.9289905166377, 1.0343874361266248),
    "pull": (4.7581024691199625, -1.6513319055201428, 626.2641292852817, 619.9640547461936, 1.063909142047732),
}
SERVER_FACTOR = 1.8


def server_time(size: Column, way: str) -> Column:
    """Time in ms of a tensor's way to or from a parameter server: flat, then a line, then a line of slope 1, in the logarithms."""
    x0, y0, x1, y1, slope = SERVER_CURVES[way]
    x = F.log10(size)
    y = F.when(x <= x0, F.lit(y0)).when(x > x1, x - x1 + y1).otherwise(slope * (x - x0) + y0)
    return SERVER_FACTOR * F.pow(F.lit(10.0), y)


def best_parts(size: Column, slow: Column, fast: Column) -> Column:
    """Number of partitions that balances transfer and overhead, at least one."""
    return F.greatest(F.lit(1), F.round(F.sqrt(size * slow / fast))).cast("bigint")


def of_types(rows: DataFrame, kind: str, types: list[str], show_all: bool = False) -> DataFrame:
    """Rows whose operation type holds one of ``types``, or all of them."""
    return rows if show_all else rows.filter(F.col(kind).rlike("|".join(types)))


def partitions(size: Column, most: int = PARTITION_BYTES) -> Column:
    return F.ceil(size / most)


def regroup(tensors: DataFrame, n: int, order: str) -> DataFrame:
    """Tensors put into ``n`` groups of neighbours in ``order``: (…, group_id); numbered without one task for all."""
    rows = global_number(tensors, order, "_no")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.withColumn("group_id", F.floor(F.col("_no") * n / total).cast("int")).drop("_no")


def round_robin(keys: DataFrame, by: str, servers: int) -> DataFrame:
    """Servers dealt out in turn in the order of ``by``."""
    return global_number(keys, by, "_no").withColumn("server", F.pmod(F.col("_no"), F.lit(servers))).drop("_no")


def grouped_fit(samples: DataFrame, key: list[str], features: list[str], y: str) -> DataFrame:
    """Non-negative least squares per key from its normal equations: (key, n, coefficients).

    The products of the features are summed up where the rows are, so a key's
    rows never meet; the small system is solved per key.
    """
    names = [*features, "_one"]
    rows = samples.withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(F.col(a) * F.col(y)).alias(f"v_{i}") for i, a in enumerate(names)]
    table = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *sums)
    k = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            m = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            v = np.array([r[f"v_{i}"] for i in range(k)], float)
            out.append([round(float(x), 9) for x in nonnegative(m, v)])
        return pdf[[*key, "n"]].assign(coefficients=out)

    schema = "".join(f"`{c}` {samples.schema[c].dataType.simpleString()}, " for c in key) + "n bigint, coefficients array<double>"
    return table.mapInPandas(lambda it: (solve(p) for p in it if len(p)), schema)


def nonnegative(m: np.ndarray, v: np.ndarray, ridge: float = 1e-9) -> np.ndarray:
    """Minimises x'Mx/2 - v'x with x >= 0: active sets by coefficient."""
    scale = np.sqrt(np.maximum(np.diag(m), 1e-30))
    a, b = m / np.outer(scale, scale) + ridge * np.eye(len(v)), v / scale
    x, passive = np.zeros(len(v)), np.zeros(len(v), bool)
    for _ in range(10 * len(v)):
        grad = b - a @ x
        if passive.all() or (grad[~passive] <= 1e-9).all():
            break
        passive[int(np.where(passive, -np.inf, grad).argmax())] = True
        while True:
            s = np.zeros(len(v))
            s[passive] = np.linalg.solve(a[np.ix_(passive, passive)], b[passive])
            if (s[passive] > 0).all():
                x = s
                break
            neg = passive & (s <= 0)
            step = np.min(x[neg] / np.maximum(x[neg] - s[neg], 1e-30))
            x = x + step * (s - x)
            passive &= x > 1e-12
    return x / scale


#: Curves y = f(x, p) with their start values from the data's ends.
CURVES = {
    "line": (lambda x, p: p[0] * x + p[1], lambda x, y: [(y[-1] - y[0]) / max(x[-1] - x[0], 1e-9), y[0]]),
    "log": (lambda x, p: p[0] * np.log1p(np.maximum(x, 0.0)) + p[1], lambda x, y: [1.0, y[0]]),
    "exp": (lambda x, p: p[0] * np.exp(np.clip(p[1] * x, -50, 50)) + p[2], lambda x, y: [max(y[-1] - y[0], 1e-3), 1.0 / max(x[-1], 1e-9), y[0]]),
    "sigmoid": (
        lambda x, p: p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -50, 50))) + p[3],
        lambda x, y: [y[-1] - y[0], 4.0 / max(x[-1] - x[0], 1e-9), (x[0] + x[-1]) / 2, y[0]],
    ),
    "bend": (lambda x, p: p[0] + p[1] * np.maximum(x - p[2], 0.0), lambda x, y: [y[0], (y[-1] - y[0]) / max(x[-1] - x[0], 1e-9), (x[0] + x[-1]) / 2]),
}


def fit_curve(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 200) -> tuple[list[float], float]:
    """Parameters of a curve by damped Gauss-Newton steps, and the weighted mean square error."""
    f, start = CURVES[kind]
    scale = max(float(np.abs(y).max()), 1e-12)
    span = max(float(np.abs(x).max()), 1e-12)
    u, v = x / span, y / scale
    p = np.array(start(u, v), float)
    loss = lambda q: float(np.average((f(u, q) - v) ** 2, weights=w))
    best, damp = loss(p), 1e-3
    for _ in range(rounds):
        base = f(u, p)
        step = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.stack([(f(u, p + step[i] * np.eye(len(p))[i]) - base) / step[i] for i in range(len(p))], 1)
        a = jac.T @ (jac * w[:, None])
        move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), jac.T @ (w * (v - base)), rcond=None)[0]
        new = loss(p + move)
        if np.isfinite(new) and new < best:
            done = best - new < 1e-12 * max(best, 1e-12)
            p, best, damp = p + move, new, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return [float(z) for z in p], best * scale * scale


def fit_curves(samples: DataFrame, key: list[str], x: str, y: str, points: int = 512) -> DataFrame:
    """The curve of least error per key: (key, n, curve, parameters, rmse).

    Rows are put together into at most ``points`` ranges of x per key (mean,
    count and mean square), which keeps the error exact but for the place
    within a range; no task gets a key's rows. Parameters hold for x and y
    divided by their largest size (x_scale, y_scale).
    """
    ends = samples.groupBy(*key).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.floor(F.when(F.col("_hi") > F.col("_lo"), (F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (points - 1)).otherwise(0.0))
    binned = samples.join(ends, key).groupBy(*key, at.alias("_at")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(F.col(y) * F.col(y)).alias("yy")
    )

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", ignore_index=True)
        u, v, w = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)
        inner = float(np.average(np.maximum(pdf["yy"] - pdf["y"] ** 2, 0.0), weights=w))
        found = min(((*fit_curve(k, u, v, w), k) for k in CURVES), key=lambda r: (round(r[1], 9), list(CURVES).index(r[2])))
        row = {k: [pdf[k].iloc[0]] for k in key}
        row |= {"n": [int(w.sum())], "curve": [found[2]], "parameters": [[round(z, 9) for z in found[0]]], "x_scale": [float(np.abs(u).max())]}
        return pd.DataFrame(row | {"y_scale": [float(np.abs(v).max())], "rmse": [round(float(np.sqrt(found[1] + inner)), 6)]})

    schema = "".join(f"`{c}` {samples.schema[c].dataType.simpleString()}, " for c in key)
    return binned.groupBy(*key).applyInPandas(best, schema + "n bigint, curve string, parameters array<double>, x_scale double, y_scale double, rmse double")


# ------------------------------------------------------------------ memory


def memory_peak(schedule: DataFrame, key: list[str]) -> DataFrame:
    """Peak of a training step's memory in bytes: (key, ops, forward_peak, peak).

    ``schedule`` has seq, bytes and keep (whether the output is kept for the
    backward pass). Forward, kept outputs add up, others count while they are
    made; backward each operation's gradient is as large as its output and
    both are freed after it, in reverse order. All are running sums.
    """
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.when(F.col("keep"), F.col("bytes")).otherwise(0)).over(w)
    rows = schedule.withColumn("held", held)
    now = F.col("held") + F.when(F.col("keep"), 0).otherwise(F.col("bytes"))
    back = F.when(F.col("keep"), F.col("held") + F.col("bytes")).otherwise(F.col("held"))
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("ops"), F.max(now).alias("forward_peak"), F.max(F.greatest(now, back)).alias("peak")
    )


def training_memory(peak: Column, parameters: Column, batch: int, measured_batch: int = 32) -> Column:
    """Bytes of a step with another batch size, and of weights, gradients and two moments."""
    return peak * batch / measured_batch + parameters * 8.0 / 3.0


def checkpoints(ops: DataFrame, key: list[str], share: float = 0.1) -> DataFrame:
    """The slowest ``share`` of each key's operations, at least none: rows of ``ops`` with their place."""
    w = Window.partitionBy(*key)
    rows = ops.withColumn("place", F.row_number().over(w.orderBy(F.desc("avg_ms"), "name"))).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.filter(F.col("place") <= F.floor(F.col("n") * share)).drop("n")


def dispersed(points: np.ndarray, p: int, seed: int = 0) -> list[int]:
    """``p`` points with large distances between them: farthest-first, then exchanges that raise the sum until none does.

    Distances to the chosen points only are held, so space grows with the points.
    """
    rng = np.random.default_rng(seed)
    n = len(points)
    to = lambda i: np.sqrt(((points - points[i]) ** 2).sum(-1))
    chosen = [int(rng.integers(n))]
    dist = [to(chosen[0])]
    while len(chosen) < min(p, n):
        near = np.min(dist, axis=0)
        near[chosen] = -1
        chosen.append(int(near.argmax()))
        dist.append(to(chosen[-1]))
    while True:
        total = np.sum(dist, axis=0)
        best = (1e-9 * max(1.0, float(total[chosen].sum())), -1, -1)
        for i, c in enumerate(chosen):
            gain = total - dist[i] - total[c]
            gain[chosen] = -np.inf
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), i, j)
        if best[1] < 0:
            return sorted(chosen)
        chosen[best[1]], dist[best[1]] = best[2], to(best[2])


def _farthest(points: np.ndarray, p: int) -> list[int]:
    """Farthest-first traversal from the point farthest from the mean; linear in the points."""
    chosen = [int(((points - points.mean(0)) ** 2).sum(1).argmax())]
    near = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(p, len(points)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        chosen.append(i)
        near = np.minimum(near, ((points - points[i]) ** 2).sum(1))
    return chosen


def dispersed_per_key(df: DataFrame, key: str, ident: str, vector: str, p: int, few: int = 4096) -> DataFrame:
    """Per key, ``p`` rows whose vectors lie far from each other: (key, ident).

    Every batch of rows gives its own farthest-first choice, and choices of
    choices are taken until at most ``few`` rows of a key are left, so all
    rows take part and no task holds a key (core-sets compose for this
    measure within a constant factor). The last choice is improved by
    exchanges. Rows with a null key, id or vector are left out.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{ident}` {df.schema[ident].dataType.simpleString()}, `{vector}` array<double>"
    rows = df.select(key, ident, F.col(vector).cast("array<double>").alias(vector)).dropna()

    def thin(batches):
        for pdf in batches:
            parts = []
            for _, g in pdf.groupby(key, sort=False):
                g = g.sort_values(ident)
                parts.append(g.iloc[_farthest(np.array(g[vector].tolist(), float), p)])
            if parts:
                yield pd.concat(parts)

    before = None
    while True:
        rows = cut(rows.mapInPandas(thin, schema))
        most = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        if most <= few or (most == before and rows.rdd.getNumPartitions() == 1):
            break
        before = most
        rows = rows.repartition(max(1, rows.rdd.getNumPartitions() // 8), key, F.pmod(F.xxhash64(ident), F.lit(max(1, most // few))))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident, ignore_index=True)
        return pdf.loc[dispersed(np.array(pdf[vector].tolist(), float), p), [key, ident]]

    return rows.groupBy(key).applyInPandas(last, ", ".join(schema.split(", ")[:2]))
