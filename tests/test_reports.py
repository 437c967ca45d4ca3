"""Reports and cost models on small tables and planted curves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.operators import costs, graph, kernels, reports

EDGE = "trial string, step int, src string, dst string"


def test_curves_are_found(spark):
    """Each kind of curve is told from its own noiseless points, and constants and single points don't fail."""
    x = np.linspace(0.0, 40.0, 60)
    made = {
        "line": 3 * x + 5,
        "log": 8 * np.log1p(x / 40.0) + 2,
        "bend": 4 + 2.5 * np.maximum(x - 18, 0),
        "sigmoid": 10 / (1 + np.exp(-0.6 * (x - 21))) + 3,
    }
    rows = [(k, float(a), float(b), "x") for k, y in made.items() for a, b in zip(x, y)]
    rows += [("flat", float(a), 7.0, "x") for a in x] + [("one", 1.0, 2.0, "x")]
    df = spark.createDataFrame(rows, "k string, x double, y double, n string")
    got = {r.k: r for r in costs.fit_curves(df, ["k"], "x", "y").collect()}
    for k in made:
        assert got[k].n == 60 and got[k].rmse < 0.02 * float(np.ptp(made[k])), (k, got[k])
    assert got["line"].curve == "line" and got["flat"].rmse == pytest.approx(0, abs=1e-6) and got["one"].n == 1
    assert costs.fit_curves(df.limit(0), ["k"], "x", "y").collect() == []


def test_server_time_is_flat_then_rises(spark):
    sizes = spark.createDataFrame([(10,), (1000,), (10**6,), (10**7,)], "b bigint")
    t = [r[0] for r in sizes.select(costs.server_time(F.col("b"), "push")).collect()]
    assert t[0] == t[1] == pytest.approx(1.8 * 10**-1.7521176854008658) and t[1] < t[2] < t[3]


def test_induced_part_and_its_replay(spark):
    edges = spark.createDataFrame([("t", 0, a, b) for a, b in ("ab", "bc", "cd", "de")], EDGE)
    nodes = spark.createDataFrame([("t", 0, n, 1.0) for n in "abcde"], "trial string, step int, node string, avg_ms double")
    picked = spark.createDataFrame([("t", 0, "b")], "trial string, step int, node string")
    assert {(r.src, r.dst) for r in reports.induced(edges, picked, ["trial", "step"]).collect()} == {("a", "b"), ("b", "c")}
    r = reports.partial_times(nodes, edges, picked, ["trial", "step"]).collect()
    assert [(x.nodes, x.time_ms) for x in r] == [(3, 3.0)]
    assert reports.partial_times(nodes, edges, picked.limit(0), ["trial", "step"]).collect() == []


def test_sides_splits_and_sets(spark):
    nodes = spark.createDataFrame([("t", 0, "p->FW.a", 2.0), ("t", 0, "p->Comm.1.SEND", 3.0)], "trial string, step int, node string, avg_ms double")
    edges = spark.createDataFrame([("t", 0, "p->FW.a", "p->Comm.1.SEND")], EDGE)
    cases = {"base": kernels.Delays(), "slow": kernels.Delays(communication=(0.0, 2.0))}
    r = reports.side_by_side(nodes, edges, ["trial", "step"], cases, "base").first()
    assert (r.scenario, r.base_ms, r.time_ms, r.ratio) == ("slow", 5.0, 8.0, 1.6)
    parts = reports.split_samples(spark.range(2000).select(F.col("id").cast("string").alias("k")), F.col("k")).groupBy("part").count().collect()
    assert {p.part: p["count"] > 100 for p in parts} == {"train": True, "test": True} and sum(p["count"] for p in parts) == 2000
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("aab", "bc"))
    assert {r.k: r.found for r in reports.compared_sets(a, b, ["k"]).collect()} == {"a": "left", "b": "both", "c": "right"}


def test_global_graph_has_no_cycle(spark):
    ops = spark.createDataFrame([("t", p, n, i) for p in ("p0", "p1") for n, i in (("FW.b", "a:0"), ("BW.b", "c"), ("UPDATE_.w", "b"))], "trial string, pid string, name string, i string")
    comms = spark.createDataFrame([("t", p, "1+2", ["b:0"]) for p in ("p0", "p1")], "trial string, pid string, op_name string, inputs array<string>")
    updates = ops.filter("name like 'UPDATE%'").select("trial", "pid", "name").distinct()
    edges = [(r.src, r.dst) for r in graph.global_edges(ops, comms, updates).collect()]
    assert len(edges) == len(set(edges))
    g = kernels.Graph.build([(n, 1.0) for n in sorted({x for e in edges for x in e})], edges)
    assert g.order()[1] == [] and kernels.reaches(g, g.names.index("p0->BW.b"), g.names.index("p1->UPDATE_.w"))


def test_step_graph_links_devices(spark):
    """A barrier stands at the last Sync; a queue that began before it isn't linked; gaps and pauses."""
    rows = []
    for p, sync, queue in (("p0", 100, 400), ("p1", 250, 240)):
        rows += [(p, "Comm.1.Sync", "Comm", "Comm.Sync", sync, 10), (p, "Comm.1.QUEUE", "Comm", "Comm.QUEUE", queue, 5)]
    rows += [("p0", "BW.a", "operator", "operator.BW", 50, 20), ("p0", "BW.b", "operator", "operator.BW", 90, 5), ("p0", "UPDATE_.w", "operator", "operator.UPDATE", 9000, 5)]
    df = spark.createDataFrame([("t", 0, *r, i) for i, r in enumerate(rows)], "trial string, step int, pid string, name string, cat string, cat_fine string, ts_us bigint, dur_us bigint, event_seq bigint")
    nodes, edges = graph.step_graph(df)
    got = {(r.src.split("~>")[0], r.dst.split("~>")[0]): r.gap_us for r in edges.collect()}
    bar = "all->Barrier.1"
    assert got[("p0->Comm.1.Sync", bar)] == 0 and got[("p1->Comm.1.Sync", bar)] == 0 and (bar, "p0->Comm.1.QUEUE") in got and (bar, "p1->Comm.1.QUEUE") not in got
    assert got[("p0->BW.a", "p0->BW.b")] == 20 and got[("p0->BW.b", "p0->Comm.1.Sync")] == 5 and got[("p0->BW.b", "p0->UPDATE_.w")] == 0
    path = graph.critical_paths(nodes, edges, ["trial", "step"]).orderBy("pos").collect()
    assert path[-1].node.startswith("p0->UPDATE_.w") and sum(r.cost_ms for r in path) > 0
    assert graph.step_graph(df.limit(0))[1].collect() == []


def test_memory_rules(spark):
    sizes = spark.createDataFrame(
        [(1, "n", "input", 0, "float32", 40), (1, "n", "output", 0, "float32", 40), (1, "m", "input", 0, "int8", 40), (1, "m", "output", 0, "float32", 40)],
        "record_id bigint, node string, side string, pos bigint, dtype string, bytes bigint",
    )
    kinds = spark.createDataFrame([(1, "n", "Relu"), (1, "m", "Relu"), (2, "n", "Conv2D")], "record_id bigint, node string, kind string")
    assert [(r.node, r.pos) for r in reports.in_place(sizes, kinds).collect()] == [("n", 0)]
    leading = spark.createDataFrame([(1, "m", "output", 0, 0, -1)], "record_id bigint, node string, side string, pos bigint, dim bigint, size bigint")
    assert [r.node for r in reports.usable(sizes, kinds, leading).collect()] == ["n"]
    peaks = spark.createDataFrame([(5,), (9,), (30,)], "p bigint")
    assert [r.asks for r in reports.within_budget(peaks, F.col("p"), 8).orderBy("p").collect()] == ["fits", "accumulate", "recompute"]
