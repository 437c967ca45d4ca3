"""Reports over traces: the chosen step, delays between phases, differences of runs, memory rules, sample splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators import graph, kernels


def at_chosen_step(events: DataFrame, iters: DataFrame, chosen: DataFrame) -> DataFrame:
    """Events of the step that stands for its trial.

    ``iters`` has trial, pid, step (one row per device and step), ``chosen``
    trial and opt_step, the place of the step among a device's steps.
    """
    place = Window.partitionBy("trial", "pid").orderBy("step")  # a row per step of a device
    steps = iters.select("trial", "pid", "step", (F.row_number().over(place) - 1).alias("k"))
    hit = steps.join(chosen.select("trial", "opt_step"), "trial").filter("k = opt_step").select("trial", "pid", "step")
    return events.join(hit, ["trial", "pid", "step"], "left_semi")


def rebased(events: DataFrame, key: list[str]) -> DataFrame:
    """Times from the first event of the key on."""
    first = events.groupBy(*key).agg(F.min("ts_us").alias("_first"))
    return events.join(first, key).withColumn("ts_us", F.col("ts_us") - F.col("_first")).drop("_first")


def backward_to_comm(events: DataFrame) -> DataFrame:
    """Delay from the end of a host's backward pass to its first communication behind it: (trial, host, steps, avg_us).

    Per device and step from the last end of a backward operation to the first
    communication that starts after it; the least of a host's devices per
    step; the mean over the steps. Steps without either are left out.
    """
    key = ["trial", "host", "pid", "step"]
    rows = events.filter("trial is not null and host is not null and step is not null")
    ends = rows.filter("cat_fine = 'operator.BW'").groupBy(*key).agg(F.max(F.expr("ts_us + dur_us")).alias("done"))
    waits = rows.filter("cat = 'Comm'").join(ends, key).filter("ts_us >= done").groupBy(*key).agg(F.min(F.col("ts_us") - F.col("done")).alias("d"))
    least = waits.groupBy("trial", "host", "step").agg(F.min("d").alias("d"))
    return least.groupBy("trial", "host").agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg("d"), 6).alias("avg_us"))


def first_event(events: DataFrame) -> DataFrame:
    """The first event of each device and name: (pid, name, event_seq, ts_us)."""
    first = F.min_by(F.struct("event_seq", "ts_us"), F.struct("ts_us", "event_seq"))
    return events.groupBy("pid", "name").agg(first.alias("x")).select("pid", "name", "x.event_seq", "x.ts_us")


def kind_spread(events: DataFrame) -> DataFrame:
    """Mean and relative deviation of each operation's mean time, by category: (cat, ops, avg_us, spread)."""
    means = events.groupBy("cat", "pid", "name").agg(F.avg("dur_us").alias("a"))
    return means.groupBy("cat").agg(
        F.count(F.lit(1)).alias("ops"), F.round(F.avg("a"), 6).alias("avg_us"), F.round(F.stddev_pop("a") / F.avg("a"), 6).alias("spread")
    )


def relabelled(nodes: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """``nodes`` (with a column node, ``device->…``) with their name on the device that ``placed`` (key, to) gives their key."""
    moved = F.concat(F.col("to"), F.lit("->"), F.regexp_replace("node", "^.*?->", ""))
    return nodes.join(placed.select(key, "to"), key).withColumn("relabelled", moved).drop("to")


def compared_sets(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two sets with where they are: both, left or right."""
    left, right = a.select(*key).distinct().withColumn("_a", F.lit(True)), b.select(*key).distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return left.join(right, key, "full").select(*key, where.alias("found"))


def induced(edges: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """Edges between the chosen nodes (key, node) and their neighbours."""
    near = edges.join(chosen.select(*key, F.col("node").alias("src")), [*key, "src"], "left_semi").select(*key, F.col("dst").alias("node"))
    near = near.unionByName(edges.join(chosen.select(*key, F.col("node").alias("dst")), [*key, "dst"], "left_semi").select(*key, F.col("src").alias("node")))
    kept = chosen.select(*key, "node").unionByName(near).distinct()
    side = lambda c: kept.select(*key, F.col("node").alias(c))
    return edges.join(side("src"), [*key, "src"], "left_semi").join(side("dst"), [*key, "dst"], "left_semi")


def partial_times(nodes: DataFrame, edges: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """Time of the part of each graph around the chosen nodes: (key, nodes, time_ms)."""
    part = induced(edges, chosen, key)
    ends = part.select(*key, F.col("src").alias("node")).union(part.select(*key, "dst")).distinct()
    kept = nodes.join(ends, [*key, "node"], "left_semi")
    run = lambda k, g: [(len(g.names), round(kernels.replay(g)[1], 6))]
    return graph._per_graph(graph._graphs(kept, part, key), key, run, "nodes int, time_ms double")


def side_by_side(nodes: DataFrame, edges: DataFrame, key: list[str], cases: dict[str, kernels.Delays], base: str) -> DataFrame:
    """Each case's replay beside the base's: (key, scenario, base_ms, time_ms, ratio)."""
    rows = graph.scenarios(nodes, edges, key, cases)
    first = rows.filter(F.col("scenario") == base).select(*key, F.col("time_ms").alias("base_ms"))
    both = rows.filter(F.col("scenario") != base).join(first, key)
    return both.select(*key, "scenario", "base_ms", "time_ms", F.round(F.when(F.col("base_ms") > 0, F.col("time_ms") / F.col("base_ms")), 6).alias("ratio"))


def schedule(nodes: DataFrame, edges: DataFrame, key: list[str], of: str) -> DataFrame:
    """A topological order of the nodes whose name holds ``of``: (key, place, node); leaves without predecessors first."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        order = [i for i in g.order()[0] if of in g.names[i]]
        order.sort(key=lambda i: bool(g.pred[i]))  # stable: the order among the others stays
        return [(n, g.names[i]) for n, i in enumerate(order)]

    return graph._per_graph(graph._graphs(nodes, edges, key), key, run, "place int, node string")


# Operation types whose output may take the place of an input.
ELEMENTWISE = ["Add", "AddN", "AddV2", "BiasAdd", "Cast", "Elu", "Gelu", "Identity", "Mul", "Relu", "Relu6", "Reshape", "Sigmoid", "Sub", "Tanh"]


def in_place(sizes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Outputs that may take the memory of an input of their operation: (record_id, node, pos, bytes).

    ``sizes`` has record_id, node, side, pos, dtype, bytes of tensors, ``kinds``
    record_id, node, kind. The operation works element by element, and an
    input has the type and size of the output.
    """
    own = ["record_id", "node"]
    outs = sizes.filter("side = 'output'").join(kinds.filter(F.col("kind").isin(ELEMENTWISE)), own, "left_semi")
    ins = sizes.filter("side = 'input'").select(*own, "dtype", "bytes").distinct()
    return outs.join(ins, [*own, "dtype", "bytes"], "left_semi").select(*own, "pos", "bytes")


def usable(sizes: DataFrame, kinds: DataFrame, leading: DataFrame) -> DataFrame:
    """Outputs that count in memory: known type and shape, no unknown first dimension, operation not NoOp."""
    own = ["record_id", "node"]
    bad = leading.filter("size = -1").select(*own, "side", "pos")
    rows = sizes.filter("side = 'output'").join(kinds.filter("kind is not null and kind <> 'NoOp'"), own, "left_semi")
    return rows.join(bad, [*own, "side", "pos"], "left_anti")


def within_budget(peaks: DataFrame, peak: Column, budget: int) -> DataFrame:
    """Peaks with what a memory budget asks for: ``fits``, ``accumulate`` (half a batch fits) or ``recompute``."""
    asks = F.when(peak <= budget, "fits").when(peak / 2 <= budget, "accumulate").otherwise("recompute")
    return peaks.withColumn("asks", asks)


def split_samples(samples: DataFrame, key: Column, tenths: int = 9) -> DataFrame:
    """Samples with the part they belong to, ``train`` or ``test``, by a hash of their key, so each run and engine splits alike."""
    digit = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint") % 10
    return samples.withColumn("part", F.when(digit < tenths, "train").otherwise("test"))


def tested_line(samples: DataFrame, key: list[str], x: str, y: str, least_ape: float = 0.6) -> DataFrame:
    """A line per key fitted on the training part and its mean error on the test part: (key, n_train, n_test, slope, intercept, mape, kept).

    ``samples`` has part; a fit whose error is ``least_ape`` or more, or that
    has nothing to be tested on, isn't kept.
    """
    from tracequarry.operators import costs

    fitted = costs.fit_lines(samples.filter("part = 'train'"), key, x, y).withColumnRenamed("n", "n_train")
    ape = F.abs(F.col("slope") * F.col(x) + F.col("intercept") - F.col(y)) / F.col(y)
    tests = samples.filter(f"part = 'test' and {y} > 0").join(fitted, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n_test"), F.round(F.avg(ape), 6).alias("mape"))
    rows = fitted.join(tests, key, "left").withColumn("n_test", F.coalesce("n_test", F.lit(0).cast("bigint")))
    return rows.withColumn("kept", F.coalesce(F.col("mape") < least_ape, F.lit(False)))
