"""Operators over traces: worked fixtures, brute force and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import align, costs, graph, kernels, matching, models, sequences
from tracequarry.operators import statistics as st
from tracequarry.operators.ordered import running

EV = "event_seq bigint, pid string, name string, cat string, cat_fine string, ph string, ts_us bigint, dur_us bigint, step int, loaded_at string"


def events(spark, rows):
    """Rows of (seq, pid, name, ts, dur); the category follows from the name."""
    full = [(s, p, n, kernels.coarse(n or ""), "operator." + (n or "").split(".")[0].strip("_"), "X", t, d, 0, "x") for s, p, n, t, d in rows]
    return spark.createDataFrame(full, EV)


def test_running_equals_plain_windows(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice("ab"), "n", rng.randrange(1 << 20), rng.choice([None, rng.randrange(100)])) for i in range(300)]
    df = events(spark, rows)
    w = Window.partitionBy("pid").orderBy("ts_us", "event_seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = running(df, ["pid"], "ts_us", ["event_seq"], {
        "a": ("sum", F.coalesce("dur_us", F.lit(1))), "b": ("max", F.col("ts_us") - F.coalesce("dur_us", F.lit(0))), "c": ("min", F.coalesce("dur_us", F.lit(7))),
        "d": ("last", F.col("dur_us")), "e": ("lag", F.col("dur_us")),
    }, slot_bits=14)
    exp = df.withColumns({
        "a": F.sum(F.coalesce("dur_us", F.lit(1))).over(upto), "b": F.max(F.col("ts_us") - F.coalesce("dur_us", F.lit(0))).over(upto),
        "c": F.min(F.coalesce("dur_us", F.lit(7))).over(upto), "d": F.last("dur_us", True).over(upto), "e": F.lag("dur_us").over(w),
    })
    cols = ["event_seq", "a", "b", "c", "d", "e"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, exp.select(*cols).collect()))


def test_op_stats_upper_median(spark):
    df = events(spark, [(i, "p", "FW.a", i, d) for i, d in enumerate([1000, 3000, 2000, 4000])])
    r = st.op_stats(df).first()
    assert (r.cnt, r.min_ms, r.max_ms, r.avg_ms, r.median_hi_ms) == (4, 1.0, 4.0, 2.5, 3.0) and r.std_ms == pytest.approx(1.118, abs=1e-3)


def test_timed_events_drop(spark):
    rows = [(1, "p", "FW.a", 1, 5), (1, "p", "FW.a", 1, 5), (2, None, "FW.a", 1, 5), (3, "p", None, 1, 5), (4, "p", "FW.a", None, 5), (5, "p", "FW.a", 1, -5), (None, "p", "FW.a", 1, 5)]
    assert [r.event_seq for r in st.timed_events(events(spark, rows), "event_seq").collect()] == [1]
    assert st.op_stats(st.timed_events(events(spark, []), "cat_fine")).collect() == []


def test_overall_iteration_takes_median_when_unstable(spark):
    it = lambda rows: spark.createDataFrame(rows, "trial string, pid string, step int, iter_ms double")
    r = st.overall_iteration(it([("t", "a", i, v) for i, v in enumerate([10.0, 12.0, 11.0])] + [("t", "b", 0, 12.0), ("t", "b", 1, 12.0)])).first()
    assert (r.steps, r.iter_ms, r.opt_step) == (2, 11.5, 0)
    r = st.overall_iteration(it([("t", "a", i, v) for i, v in enumerate([10.0, 10.0, 10.0, 30.0])])).first()
    assert (r.iter_ms, r.opt_step) == (10.0, 0)


def test_overlap_clip(spark):
    df = events(spark, [(1, "p", "UPDATE_.0", 0, 10), (2, "p", "UPDATE_.1", 5, 7), (3, "p", "UPDATE_.2", 11, 9)])
    got = sorted((r.start_us, r.end_us) for r in sequences.clip_overlaps(df, ["pid"]).collect())
    assert got == [(0, 10), (10, 12), (12, 20)]


def test_recv_clip(spark):
    pairs = spark.createDataFrame([(100, 90, 30), (100, 90, 5), (80, 90, 5)], "a_us bigint, b_us bigint, b_dur bigint")
    assert [tuple(r)[1:] for r in matching.clip_receives(pairs).collect()] == [(100, 20), (100, 0), (90, 5)]


def test_fifo(spark):
    df = events(spark, [(1, "p", "FW.a", 0, 5), (2, "p", "FW.b", 1, 5), (3, "p", "FW.c", 10, 2)])
    assert [r.end_us for r in sequences.fifo_replay(df, ["pid"]).orderBy("event_seq").collect()] == [5, 10, 12]


def test_gap_with_cap(spark):
    df = events(spark, [(1, "p", "FW.a", 0, 10), (2, "p", "FW.b", 15, 10), (3, "p", "FW.c", 75, 10), (4, "p", "FW.d", 70, 1)])
    got = {r.event_seq: r.gap_us for r in sequences.gap_to_previous(df, ["pid"], 1000, F.lit(True)).collect()}
    assert got == {2: 5, 4: 10, 3: 10}


def stack_pairs(marks):
    stack, out = [], []
    for ph, name, t in marks:
        if ph == "B":
            stack.append((name, t))
        elif stack:
            n, s = stack.pop()
            out.append((n, s, t - s))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_nested_pairing_random(spark, seed):
    rng = random.Random(seed)
    marks = [("B" if rng.random() < 0.5 else "E", rng.choice("xyz"), i * 10) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame([("p", ph, n, t, i) for i, (ph, n, t) in enumerate(marks)], "pid string, ph string, name string, ts_us bigint, seq bigint")
    got = sorted((r.name, r.start_us, r.dur_us) for r in sequences.pair_nested(df, ["pid"]).collect())
    assert got == stack_pairs(marks)


@pytest.mark.parametrize("seed,bits", [(0, 3), (1, 5), (2, 7), (3, 4), (4, 62)])
def test_nested_pairing_over_slots(spark, seed, bits):
    """Spans over many slots of time, several keys, with depths, against a stack."""
    rng = random.Random(seed)
    rows, exp, n = [], [], 0
    for key in ("p", "q", "r"):
        stack = []
        for i in range(rng.randrange(1, 120)):
            ph, name = ("B" if rng.random() < 0.5 else "E"), rng.choice("xyz")
            rows.append((key, ph, name, i * 3, n))
            n += 1
            if ph == "B":
                stack.append((name, i * 3))
            elif stack:
                depth = len(stack)
                b = stack.pop()
                exp.append((key, b[0], b[1], i * 3 - b[1], depth))
    rows += [(None, "B", "x", 1, n), ("p", "B", "x", None, n + 1)]
    df = spark.createDataFrame(rows, "pid string, ph string, name string, ts_us bigint, seq bigint")
    for batch in (10_000, 7, 1):  # slots go over many batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sequences.pair_nested(df, ["pid"], bits).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got)) == sorted(exp)
    assert sequences.pair_nested(df.limit(0), ["pid"]).collect() == []


def test_not_touching(spark):
    spans = spark.createDataFrame([("l", 100, 200)], "link string, start_us bigint, end_us bigint")
    points = spark.createDataFrame([(1, "l", 650), (2, "l", 800), (3, "m", 650)], "id bigint, link string, t bigint")
    free = matching.not_touching(points, spans, ["link"], F.col("t") - 500, F.col("t") - 1)
    assert sorted(r.id for r in free.collect()) == [2, 3]


def test_names(spark):
    rows = ["host0.rank0->Comm.1+2.SEND~>0_0_1_0", "FW.a/SUM", "FW.x", "I/O.r", "zzz"]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    n = F.col("n")
    got = df.select(names.category(n), names.fine_category(n)).collect()
    assert [tuple(r) for r in got] == [("Comm", "Comm.SEND"), ("ServerOp", "ServerOp"), ("operator", "operator.FW"), ("I/O", "I/O"), (None, None)]
    p = df.select(names.parsed(n).alias("x")).first().x
    assert (p.pid, p.op_cat, p.op_name, p.sub_op, p.suffix, p.valid) == ("host0.rank0", "Comm", "1+2", "SEND", "0_0_1_0", True)
    assert spark.range(1).select(names.sorted_tensors(F.lit("10+2+1"))).first()[0] == "1+2+10"
    assert spark.range(1).select(names.tensor_bytes(F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint")), F.lit("float32"))).first()[0] == 24


def test_rules_on_other_names(spark):
    """Names that the test tables don't hold: parts within words, END, fused operations, colours."""
    rows = ["BW.op/APPEND", "END", "host0.rank0->END", "FW.a/I/O", "UPDATE_.BW", "BW.a+FW.b", "OUTPUT.x", "Comm.1.SUM"]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    n = F.col("n")
    got = {r.n: (r.c, r.f, r.p) for r in df.select("n", names.category(n).alias("c"), names.fine_category(n).alias("f"), names.priority(n).alias("p")).collect()}
    assert got["BW.op/APPEND"] == ("operator", "operator.BW", 2) and got["END"] == ("virtual", "virtual", 100)
    assert got["FW.a/I/O"] == ("I/O", "operator.FW", 0) and got["UPDATE_.BW"] == ("operator", "operator.BW", 2)
    assert got["BW.a+FW.b"] == ("operator", "operator.FW+BW", 0) and got["OUTPUT.x"][1:] == ("operator.OUTPUT", 1) and got["Comm.1.SUM"][:2] == ("ServerOp", "ServerOp")
    for r in rows[:2] + rows[3:]:
        assert kernels.coarse("p->" + r + "~>1") == got[r][0] and kernels.rank_of("p->" + r) == got[r][2]
    assert kernels.coarse("p->zzz") == "none" and kernels.coarse(rows[2]) == "virtual"
    kinds = spark.createDataFrame([(k,) for k in ("Sum", "BatchMatMul", "AddN", "Mean", "Relu6", "FusedNorm")], "k string")
    assert [r[0] for r in kinds.select(names.amp_colour(F.col("k"))).collect()] == ["black", "white", "grey", "black", "clear", None]


def test_standard_names(spark):
    no = F.lit(False)
    cases = {
        "Comm.3": "Comm.3", "^a/b/_5": "FW.a/b", "x/GradPushPull_3_4": "Comm.3+4", "a/input_barrier.1": "FW.a/input_barrier_1",
        "HorovodAllreduce.7_0": "Comm.7", "cond/Allreduce.7_x/Switch": "BW.7_Switch", "grads/AllReduce": "BW.grads/AllReduce",
        "gradients/a.b": "BW.gradients/a_b", "gradient_tape/a/ShapeN": "FW.gradient_tape/a/ShapeN", "gradient_tape/x": "BW.gradient_tape/x",
        "gradient_tape/LayoutOptimizer/y": "FW.gradient_tape/LayoutOptimizer/y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.s for r in df.select("n", models.tf_standard_name(F.col("n"), no, no).alias("s")).collect()} == cases
    assert spark.range(1).select(models.tf_standard_name(F.lit("allreduce/x.y"), F.lit(True), no)).first()[0] == "Comm.y"
    assert spark.range(1).select(models.tf_standard_name(F.lit("w.x"), F.lit(True), no)).first()[0] == "UPDATE_.w.x"


def test_bias_ranges(spark):
    r = spark.range(1).select(
        names.bias_both(F.lit(1), F.lit(None), F.lit(3), F.lit(9)).alias("a"), names.bias_sum(F.lit(1), F.lit(None).cast("int"), F.lit(3), F.lit(9)).alias("b")
    ).first()
    assert (r.a.l, r.a.r, r.b.l, r.b.r) == (3, 9, 4, None)


def random_dag(rng, n):
    nodes = [(f"p{rng.randrange(2)}->{rng.choice(['FW', 'BW', 'UPDATE_', 'Comm'])}.{i}", rng.randrange(1, 9)) for i in range(n)]
    edges = [(nodes[a][0], nodes[b][0]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25]
    return nodes, edges


def test_longest_path_example_and_random():
    g = kernels.Graph.build([("A", 2), ("B", 3), ("C", 5), ("D", 1)], [("A", "B"), ("B", "D"), ("A", "C"), ("C", "D")])
    assert kernels.longest_path(g, lambda u, v: g.avg[u]) == [("A", 2), ("C", 5), ("D", 0.0)]
    rng = random.Random(1)
    for _ in range(30):
        g = kernels.Graph.build(*random_dag(rng, 9))

        def walk(u):
            return max([0.0, *(g.avg[u] + walk(v) for v in g.succ[u])])

        path = kernels.longest_path(g, lambda u, v: g.avg[u])
        assert sum(c for _, c in path) == pytest.approx(max(map(walk, range(len(g.names)))))
        runs, time, _ = kernels.replay(g)
        assert len(runs) == len(g.names) and time >= max(r.end for r in runs) / 1000 - 1e-9 or time <= max(r.end for r in runs) / 1000
        assert max(r.end for r in runs) / 1000 >= sum(c for _, c in path) - 1e-9
        ends = {r.node: r.end for r in runs}
        starts = {r.node: r.start for r in runs}
        assert all(starts[v] >= ends[u] for u in range(len(g.names)) for v in g.succ[u])
        by = {}
        for r in sorted(runs, key=lambda r: r.start):
            assert r.start >= by.get(r.device, 0.0)
            by[r.device] = r.end


def test_cycle_is_reported(spark):
    with pytest.raises(ValueError):
        g = kernels.Graph.build([("a", 1), ("b", 1)], [("a", "b"), ("b", "a")])
        kernels.longest_path(g, lambda u, v: 1.0)
    df = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a"), ("t", "c", "d"), ("t", "c", "d")], "trial string, src string, dst string")
    assert sorted(r.node for r in graph.cycles(df, ["trial"]).collect()) == ["a", "b"]


def test_delays_precedence():
    d = kernels.Delays({"p->FW.a": (-5.0, 1.0)}, computation=(0.0, 3.0), all=(9.0, 1.0))
    assert d.of("p->FW.a") == (-5.0, 1.0) and d.of("p->BW.b") == (0.0, 3.0) and d.of("p->Comm.1.SEND") == (9.0, 1.0)
    g = kernels.Graph.build([("p->FW.a", 2)], [])
    assert kernels.replay(g, d)[1] == 0.0 and kernels.replay(g, steps=3)[1] == 6.0


def test_kernel_device_is_held_by_a_tensor():
    part = lambda t, p: f"r->Comm.{t}.{p}"
    nodes = [(part(t, p), 1) for t in (1, 2) for p in kernels.KERNEL_PARTS]
    edges = [(part(t, a), part(t, b)) for t in (1, 2) for a, b in zip(kernels.KERNEL_PARTS, kernels.KERNEL_PARTS[1:])]
    runs = kernels.replay(kernels.Graph.build(nodes, edges))[0]
    seen = [kernels.Graph.build(nodes, edges).names[r.node].split(".")[1] for r in runs]
    assert seen == ["1"] * 4 + ["2"] * 4


def test_contraction_and_clusters_stay_acyclic():
    rng = random.Random(4)
    for _ in range(30):
        g = kernels.Graph.build(*random_dag(rng, 10))
        for u in range(len(g.names)):
            for v in g.succ[u]:
                assert kernels.contractible(g, u, v) == (not kernels.contract(g, u, v).order()[1])
        groups = kernels.clusters(g, 4)
        assert sorted(x for c in groups for x in c) == list(range(len(g.names))) and max(map(len, groups)) <= 4
        of = {x: i for i, c in enumerate(groups) for x in c}
        quotient = [(str(of[u]), str(of[v])) for u in range(len(g.names)) for v in g.succ[u] if of[u] != of[v]]
        assert not kernels.Graph.build([(str(i), 1) for i in range(len(groups))], quotient).order()[1]


def test_searches_never_get_worse():
    rng = random.Random(7)
    g = kernels.Graph.build(*random_dag(rng, 14))
    base = kernels.replay(g)[1]
    for out in (kernels.mcmc(g, 15), kernels.mcts(g, 15), kernels.greedy_walk(g)):
        assert out.best <= base and out.tried[0] == base
    assert kernels.mcmc(g, 15).tried == kernels.mcmc(g, 15).tried
    assert kernels.accept_probability(10, 1, 10, 10.1) == pytest.approx(0.5)


def test_shape_hash_and_samples():
    a = kernels.Graph.build([("x", 0), ("y", 0), ("z", 0)], [("x", "y"), ("y", "z")])
    b = kernels.Graph.build([("3", 0), ("1", 0), ("2", 0)], [("1", "2"), ("2", "3")])
    assert kernels.shape_hash(a, list("aab")) == kernels.shape_hash(b, list("baa"))
    assert kernels.shape_hash(a, list("aab")) != kernels.shape_hash(b, list("aba"))
    g = kernels.Graph.build(*random_dag(random.Random(2), 12))
    assert kernels.forest_fire(g, 5, 0.5, 1) == kernels.forest_fire(g, 5, 0.5, 1) and len(kernels.random_walk(g, 5, 0.2, 1)) == 5


def test_ring(spark):
    tensors = spark.createDataFrame([("t", "1+2", 1, 1, 1)], "trial string, tensor string, loops int, channels int, slices int")
    ranks = spark.createDataFrame([("t", f"r{i}", i) for i in range(3)], "trial string, pid string, rank int")
    edges = [(r.src, r.dst) for r in graph.ring_edges(tensors, ranks).collect()]
    assert {int(s.split("~>")[1].split("_")[2]) for s, _ in edges if "SEND" in s} == {0, 1, 2, 3}
    assert ("r2->Comm.1+2.SEND~>0_0_3_0", "r0->Comm.1+2.RECV~>0_0_3_0") in edges and ("r0->Comm.1+2.RECV~>0_0_3_0", "r0->Comm.1+2.MEMCPY_OUT_FUSION_BUFFER") in edges
    g = kernels.Graph.build([(n, 1) for n in sorted({x for e in edges for x in e})], edges)
    assert not g.order()[1]


def test_tree(spark):
    tensors = spark.createDataFrame([("t", "1")], "trial string, tensor string")
    tree = spark.createDataFrame([("t", "a", None), ("t", "b", "a"), ("t", "c", "a"), ("t", "d", "b")], "trial string, pid string, parent string")
    edges = [(r.src, r.dst) for r in graph.tree_edges(tensors, tree).collect()]
    g = kernels.Graph.build([(n, 1) for n in sorted({x for e in edges for x in e})], edges)
    assert not g.order()[1]
    at = {n: i for i, n in enumerate(g.names)}
    assert kernels.reaches(g, at["d->Comm.1.MEMCPY_IN_FUSION_BUFFER"], at["c->Comm.1.MEMCPY_OUT_FUSION_BUFFER"])


def test_bypass_reach_hops(spark):
    e = spark.createDataFrame([("t", "a", "v1"), ("t", "v1", "v2"), ("t", "v2", "b"), ("t", "b", "c")], "trial string, src string, dst string")
    gone = spark.createDataFrame([("t", "v1"), ("t", "v2")], "trial string, node string")
    assert {(r.src, r.dst) for r in graph.bypass(e, gone, ["trial"]).collect()} == {("a", "b"), ("b", "c")}
    start = spark.createDataFrame([("t", "v2")], "trial string, node string")
    assert {r.node for r in graph.reachable(e, start, ["trial"]).collect()} == {"v2", "b", "c"}
    assert {r.node: r.hops for r in graph.within_hops(e, start, 1, ["trial"]).collect()} == {"v2": 0, "v1": 1, "b": 1}


def test_shifts():
    s, missed = align.least_shifts([("h1", "h0", 5.0), ("h0", "h1", -2.0)])
    assert missed == 0.0 and align.least_shifts([("h1", "h0", 5.0), ("h0", "h1", -7.0)])[1] > 0.5
    assert s["h0"] == 0 and s["h1"] == pytest.approx(2.0)
    assert align.least_shifts([]) == ({}, 0.0)


def test_host_drift(spark):
    df = spark.createDataFrame([("t", "h0", 90, 10), ("t", "h1", 120, 10)], "trial string, host string, ts_us bigint, dur_us bigint")
    assert {r.host: r.drift_us for r in align.host_drift(df).collect()} == {"h0": 0.0, "h1": -30.0}


def test_costs(spark):
    s = spark.createDataFrame([("k", float(x), 3.0 * x + 2) for x in range(5)] + [("n", float(x), 10.0 - x) for x in range(5)], "k string, x double, y double")
    got = {r.k: (r.slope, r.intercept) for r in costs.fit_lines(s, ["k"], "x", "y").collect()}
    assert got == {"k": (3.0, 2.0), "n": (0.0, 8.0)}
    rng = np.random.default_rng(0)
    x = rng.random((200, 2))
    rows = [("g", float(a), float(b), float(2 * a + 0.5)) for a, b in x]
    c = costs.grouped_fit(spark.createDataFrame(rows, "k string, a double, b double, y double"), ["k"], ["a", "b"], "y").first().coefficients
    assert c == pytest.approx([2.0, 0.0, 0.5], abs=1e-6)
    m = spark.createDataFrame([("r", i, b, True) for i, b in enumerate([10, 20, 30])], "r string, seq int, bytes bigint, keep boolean")
    p = costs.memory_peak(m, ["r"]).first()
    assert (p.forward_peak, p.peak) == (60, 90)
    assert spark.range(1).select(costs.partitions(F.lit(10_000_000))).first()[0] == 3


def test_dispersed(spark):
    pts = np.array([[0.0], [1.0], [2.0], [10.0]])
    assert costs.dispersed(pts, 2) == [0, 3]
    rows = [(1, i, [float(i % 50), 0.0]) for i in range(500)] + [(2, 1, None)]
    got = costs.dispersed_per_key(spark.createDataFrame(rows, "k int, i bigint, v array<double>"), "k", "i", "v", 2, few=4).collect()
    assert sorted(r.i % 50 for r in got) == [0, 49]


def test_simple_paths_layers_and_recompute():
    g = kernels.Graph.build([(x, 1) for x in "abcd"], [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d")])
    assert kernels.simple_paths(g, 0, 3) == [["a", "d"], ["a", "b", "d"], ["a", "c", "d"]]
    g = kernels.Graph.build([("FW.a", 1), ("BW.a", 1), ("BW.b", 1), ("Comm.1", 1), ("Comm.2", 1)], [("FW.a", "BW.a"), ("FW.a", "BW.b"), ("BW.a", "Comm.1"), ("BW.b", "Comm.2")])
    assert kernels.layer_of(g, {"Comm.1": "l1", "Comm.2": "l2"}) == {"BW.a": "l1", "Comm.1": "l1", "BW.b": "l2", "Comm.2": "l2"}
    chain = kernels.Graph.build(
        [(f"p->FW.{i}", 1) for i in range(4)] + [(f"p->BW.{i}", 1) for i in range(4)],
        [(f"p->FW.{i}", f"p->FW.{i + 1}") for i in range(3)] + [("p->FW.3", "p->BW.3")] + [(f"p->BW.{i + 1}", f"p->BW.{i}") for i in range(3)] + [(f"p->FW.{i}", f"p->BW.{i}") for i in range(3)],
    )
    again = kernels.recompute(chain, {"p->FW.1"})
    assert not again.order()[1] and kernels.replay(again)[1] > kernels.replay(chain)[1]
    assert {n for n in again.names if n.endswith("#again")} == {"p->FW.0#again", "p->FW.2#again", "p->FW.3#again"}
    assert kernels.recompute(chain, set(chain.names)).names == chain.names


def test_tensor_fusion_is_optimal():
    rng = random.Random(3)
    for _ in range(20):
        n = 6
        sizes, ready = [(str(i), rng.randrange(1, 9)) for i in range(n)], sorted(rng.random() * 10 for _ in range(n))

        def end(cuts):
            t, lo = 0.0, 0
            for hi in [*cuts, n]:
                t, lo = max(t, max(ready[lo:hi])) + 0.1 * sum(s for _, s in sizes[lo:hi]) + 1.0, hi
            return t

        best = min(end([i for i in range(1, n) if mask >> i & 1]) for mask in range(0, 1 << n, 2))
        groups, got = kernels.fuse_tensors(sizes, ready, 0.1, 1.0)
        assert got == pytest.approx(best) and [t for g in groups for t in g] == [t for t, _ in sizes]


def test_quantise_and_grow():
    g = kernels.Graph.build([("p->FW.a", 4), ("p->FW.b", 4), ("p->BW.b", 4), ("p->Comm.1.SEND", 2)], [("p->FW.a", "p->FW.b"), ("p->FW.b", "p->BW.b"), ("p->BW.b", "p->Comm.1.SEND")])
    q = kernels.quantise(g, {"p->FW.b", "p->BW.b"}, cast_ms=0.5)
    cost = dict(zip(q.names, q.avg))
    assert cost == {"p->FW.a": 4, "p->FW.b": 2, "p->BW.b": 2, "p->Comm.1.SEND": 1, "p->FW.a#half": 0.5} and not q.order()[1]
    assert kernels.quantise(g, set()).avg == g.avg
    assert kernels.replay(kernels.grow_batch(g, 2))[1] == pytest.approx(3 * 4 * 1.6 + 2)


def test_model_functions(spark):
    from tracequarry.operators import models

    arr = lambda *v: F.array(*[F.lit(x).cast("bigint") for x in v])
    r = spark.range(1).select(
        models.conv_shape(arr(8, 28, 28, 3), arr(8, 28, 28, 16), arr(5, 5, 3, 16)).alias("a"),
        models.conv_shape(arr(8, 3, 28, 28), arr(8, 16, 14, 14), arr(5, 5, 3, 16)).alias("b"),
        models.conv_shape(arr(8, 3), arr(8, 16, 14, 14), arr(5, 5, 3, 16)).alias("c"),
        models.intensity(models.dense_features(F.lit(2), F.lit(3), F.lit(5))).alias("i"),
        models.conv_features(F.lit(1), F.lit(2), F.lit(2), F.lit(1), F.lit(1), F.lit(3)).alias("f"),
        models.tf_standard_name(F.lit("^x/GradPushPull_3_4"), F.lit(False), F.lit(False)).alias("n1"),
        models.tf_standard_name(F.lit("gradients/a/_7"), F.lit(False), F.lit(False)).alias("n2"),
        models.tf_standard_name(F.lit("w"), F.lit(True), F.lit(False)).alias("n3"),
        models.mx_standard_name(F.lit("x;name=conv0_backward;y")).alias("n4"),
        models.with_unit(F.lit("1.5k")).alias("u"),
        models.padded(F.array(F.lit(1.0)), 3).alias("p"),
        F.pmod(models.step_of_chunk(F.lit(1), models.chunk_of_step(F.lit(1), F.lit(3), F.lit(4)), F.lit(4)), F.lit(4)).alias("s"),
    ).first()
    assert (r.a.layout, r.a.cin, r.a.cout, r.a.kernel, r.a.stride) == ("NHWC", 3, 16, 5, 1.0)
    assert (r.b.layout, r.b.height, r.b.stride, r.c) == ("NCHW", 28, 2.0, None)
    assert r.i == pytest.approx(30 / (6 + 10 + 15)) and (r.f.s_mul, r.f.s_add) == (36, 32)
    assert (r.n1, r.n2, r.n3, r.n4) == ("Comm.3+4", "BW.gradients/a", "UPDATE_.w", "BW.conv0")
    assert r.u == 1500.0 and r.p == [1.0, 0.0, 0.0] and r.s == 3


@pytest.mark.parametrize("seed,chunks", [(1, 1), (2, 4), (3, 9)])
def test_sequential_gaps(spark, seed, chunks):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), f"FW.{i % 5}", rng.randrange(900), rng.choice([1, 5, 60])) for i in range(200)]
    exp = {}
    for pid in "ab":
        end, name = None, None
        for s, _, n, t, d in sorted((r for r in rows if r[1] == pid), key=lambda r: (r[3], r[0])):
            if end is not None and t < end:
                continue
            if end is not None and t - end < 40:
                exp[s] = (name, t - end)
            end, name = t + d, n
    got = sequences.gap_sequential(events(spark, rows), ["pid"], 40, chunks=chunks).collect()
    assert {r.event_seq: (r.prev_name, r.gap_us) for r in got} == exp


def test_effective_producers(spark):
    e = spark.createDataFrame([("t", "BW.a", "BW.z"), ("t", "BW.z", "Comm.1"), ("t", "BW.b", "Comm.1")], "trial string, src string, dst string")
    c = spark.createDataFrame([("t", "BW.a", 2.0), ("t", "BW.z", 0.0), ("t", "BW.b", 1.0), ("t", "Comm.1", 0.0)], "trial string, node string, avg_ms double")
    target = spark.createDataFrame([("t", "Comm.1")], "trial string, node string")
    assert {r.producer for r in graph.effective_producers(e, c, ["trial"], target).collect()} == {"BW.a", "BW.b"}


def test_server_takes_pushes_as_they_run():
    push = lambda w: f"w{w}::s->Comm.1.PUSH_REQ"
    nodes = [(f"w{w}->BW.a", t) for w, t in ((0, 2), (1, 5), (2, 9))] + [(push(w), 1) for w in range(3)]
    nodes += [("s->1.COPY_FIRST", 1), ("s->1.SUM0", 1), ("s->1.SUM1", 1)]
    edges = [(f"w{w}->BW.a", push(w)) for w in range(3)] + [("s->1.COPY_FIRST", "s->1.SUM0"), ("s->1.SUM0", "s->1.SUM1")]
    g = kernels.Graph.build(nodes, edges)
    runs = kernels.replay(g, arrivals={push(w): "s1" for w in range(3)}, served={"s1": [n for n, _ in nodes[6:]]})[0]
    start = {g.names[r.node]: r.start / 1000 for r in runs}
    assert len(runs) == 9 and (start["s->1.COPY_FIRST"], start["s->1.SUM0"], start["s->1.SUM1"]) == (3.0, 6.0, 10.0)


def test_heat():
    assert kernels.heat_of([], 3) == 0.0 and kernels.heat_of([(3, 0.0)], 3) == 0.0
    assert kernels.heat_of([(1, 1.0), (3, 1.0)], 3) == pytest.approx((np.e - 1) * (1 / 3 + 1) / 2)


def test_transfers_are_aligned(spark):
    """Clocks that run apart by more than any latency: afterwards nothing arrives before it was sent."""
    rng, drift, rows = random.Random(1), {"h0": 0, "h1": 500, "h2": -900}, []
    for i in range(120):
        a, b = rng.sample(sorted(drift), 2)
        t = i * 1000
        rows.append((a, b, t + drift[a], t + rng.randrange(20, 60) + drift[b]))
    df = spark.createDataFrame(rows, "src string, dst string, sent_us bigint, got_us bigint")
    assert any(got < sent for *_, sent, got in rows)
    late = [r.got_us - r.sent_us for r in align.align_transfers(df).collect()]
    assert min(late) >= -1 and max(late) < 160


def test_strategies_replay_and_never_cycle():
    """Random walks over all kinds of steps stay without cycles; what a search records gives the time it tells."""
    rules = kernels.MoveRules(tokens=("+", "++", "--", ">"))
    rng = random.Random(4)
    for seed in range(8):
        kinds = ["FW.m/Conv2D_1", "BW.m/MatMul_2", "BW.m/Relu", "Comm.1.SEND", "Comm.2.SEND", "UPDATE_.x"]
        nodes = [(f"p{rng.randrange(2)}->{rng.choice(kinds)}~>{i}", rng.randrange(1, 9)) for i in range(14)]
        edges = [(nodes[a][0], nodes[b][0]) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.2]
        g = cur = kernels.Graph.build(nodes, edges)
        taken = []
        for _ in range(25):
            moves = kernels.moves_of(cur, rules)
            if not moves:
                break
            taken.append(rng.choice(moves))
            cur = kernels.apply_move(cur, taken[-1], rules)
            assert cur.order()[1] == [] and len(set(cur.names)) == len(cur.names)
        assert kernels.apply_all(g, taken, rules).names == cur.names
        for o in (kernels.mcmc(g, 15, seed=seed, rules=rules), kernels.mcts(g, 15, seed=seed, rules=rules), kernels.greedy_walk(g, rules=rules)):
            assert kernels.replay(kernels.apply_all(g, o.steps, rules))[1] == pytest.approx(o.best) and o.best <= o.tried[0]
    with pytest.raises(ValueError):
        kernels.apply_move(g, ("+", "no", "node"), rules)
    g = kernels.Graph.build([("p->Comm.1.SEND", 4), ("p->UPDATE_.x", 1)], [("p->Comm.1.SEND", "p->UPDATE_.x")])
    halves = kernels.apply_move(g, ("--", "p->Comm.1.SEND"), kernels.MoveRules(tokens=("--",), overhead_ms=1.0))
    assert halves.avg == [2.5, 2.5, 1.0] and halves.succ[0] == halves.succ[1] == [2]


def test_reach_is_pruned_but_whole():
    rng = random.Random(9)
    for _ in range(20):
        g = kernels.Graph.build(*random_dag(rng, 12))
        n = len(g.names)
        far = [[False] * n for _ in range(n)]
        for u in reversed(g.order()[0]):
            for v in g.succ[u]:
                far[u][v] = True
                far[u] = [a or b for a, b in zip(far[u], far[v])]
        assert all(kernels.reaches(g, u, v) == far[u][v] for u in range(n) for v in range(n) if u != v)


def step_like(rng, n):
    """Steps of two devices: chains of computation and of communication, edges between them, barriers and gaps."""
    nodes, edges, gaps = [], [], {}
    for p in ("h0", "h1"):
        last = {}
        for i in range(n):
            kind = rng.choice(["FW.m/a", "BW.m/b", "BW.m/b", "UPDATE_.c", "Comm.1.Sync", "Comm.1.QUEUE", "Comm.2.MEMCPY_OUT_FUSION_BUFFER", "Comm.2.SEND", "I/O.x"])
            name = f"{p}->{kind}~>{rng.randrange(100)}_{i}"
            nodes.append((name, rng.choice([0.0, 0.5, rng.random(), rng.randrange(1, 4)])))
            cat = kernels.coarse(name)
            edges += [(last[c], name) for c in last if c == cat or rng.random() < 0.1]
            last[cat] = name
            if rng.random() < 0.4:
                gaps[name] = {f"{cat}GAP{cat}": rng.choice([0.0, 300.0, 250.5]), "operatorGAPComm": rng.choice([0.0, 200.0])}
    for b in range(2):
        bar = f"all->Barrier.{b}"
        nodes.append((bar, 0.0))
        at = {p: sorted(rng.sample(range(n), 2)) for p in ("h0", "h1")}
        edges += [e for p, (i, j) in at.items() for e in ((nodes[i + n * (p == "h1")][0], bar), (bar, nodes[j + n * (p == "h1")][0]))]
    rng.shuffle(edges)
    return nodes, edges, gaps


def test_fusions_are_searched_without_replaying_whole_graphs(monkeypatch):
    """Carried on from state to state, moves, times and paths are those of graphs made anew; a search makes none of these."""
    rng = random.Random(11)
    rules = kernels.MoveRules()
    tried = 0
    for seed in range(120):
        g = kernels.Graph.build(*step_like(rng, rng.randrange(3, 26))) if seed % 3 else kernels.Graph.build(*random_dag(rng, 12))
        if g.order()[1]:
            continue
        roots = [kernels.PlainState(g, rules), kernels.searched(g, rules)]
        assert isinstance(roots[1], kernels.FusedState)
        n = 2 * len(roots[0].moves())
        plain, fast = ([kernels.mcmc(g, n, seed=seed, root=r), kernels.mcts(g, n, seed=seed, root=r), kernels.greedy_walk(g, root=r)] for r in roots)
        assert plain == fast
        a, b = roots
        while a.moves():
            assert a.moves() == b.moves() and a.moves_on_path() == b.moves_on_path() and a.cost == b.cost
            move = rng.choice(a.moves())
            a, b = a.after(move), b.after(move)
        assert b.moves() == []
        tried += len(fast[1].tried)
    assert tried > 1000
    calls = []
    monkeypatch.setattr(kernels, "replay", lambda *x: calls.append(x))
    assert len(kernels.mcts(g, n).tried) == n + 1 and not calls
