"""Graphs of operations as tables of nodes and edges: building, closure, paths, replay."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.operators import kernels
from tracequarry.session import by_key, cut

# -------------------------------------------------------------- expansion


def ring_edges(tensors: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges of ring all-reduce: (trial, src, dst).

    ``tensors`` has trial, tensor and the numbers loops, channels, slices;
    ``ranks`` has trial, pid and its place rank in the ring of n. Steps are
    ``0 .. 2 (n - 1) - 1``. Each step sends to the next rank in the ring; a
    step's send waits for the receive of the step before, the first for the
    copy into the buffer, which waits for the synchronisation of all ranks
    (through one node ``all->Comm.<tensor>.Sync``, so that n ranks need 2 n
    edges); the last receive leads to the copy out. Repeated tensors and ranks
    count once, which makes every edge unique, so the edges aren't compared.

    Tensors and ranks are short tables and their product is long, so it is
    spread over all tasks before it is written out.
    """
    tensors, ranks = tensors.distinct(), ranks.distinct()
    sizes = ranks.groupBy("trial").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ring = ranks.join(sizes, "trial")
    nxt = ranks.select("trial", F.col("rank").alias("next_rank"), F.col("pid").alias("next_pid"))
    ring = ring.withColumn("next_rank", F.expr("cast(pmod(rank + 1, n) as int)")).join(nxt, ["trial", "next_rank"]).filter("n > 1")
    base = by_key(tensors.join(ring, "trial"), "trial", "tensor", "pid")
    own, other = (F.concat(F.col(p), F.lit("->Comm."), F.col("tensor"), F.lit(".")) for p in ("pid", "next_pid"))
    base = base.withColumns({"own": own, "other": other, "steps": F.expr("2 * (n - 1)")})
    # one running number for loop, channel, slice and step
    lines = base.select("trial", "own", "other", "steps", "channels", "slices", F.explode(F.expr("sequence(0, loops * channels * slices * steps - 1)")).alias("i"))
    lines = lines.selectExpr(
        "trial", "own", "other", "steps", "cast(i % steps as int) as k",
        "concat_ws('_', i div (steps * slices * channels), i div (steps * slices) % channels, '') as head", "concat('_', i div steps % slices) as tail",
    )
    at = lambda step: F.concat("head", step, "tail")
    lines = lines.select(
        "trial", "k", "steps",
        F.concat("own", F.lit("MEMCPY_IN_FUSION_BUFFER")).alias("copy"),
        F.concat("own", F.lit("SEND~>"), at(F.col("k"))).alias("send"),
        F.concat("own", F.lit("RECV~>"), at(F.col("k"))).alias("recv"),
        F.concat("own", F.lit("RECV~>"), at(F.col("k") - 1)).alias("before"),
        F.concat("other", F.lit("RECV~>"), at(F.col("k"))).alias("next_recv"),
        F.concat("other", F.lit("MEMCPY_OUT_FUSION_BUFFER")).alias("next_out"),
    )
    edge = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    always = F.array(edge("copy", "send"), edge("copy", "recv"), edge("send", "next_recv"))
    some = F.array_compact(
        F.array(F.when(F.col("k") > 0, edge("before", "send")), F.when(F.col("k") == F.col("steps") - 1, edge("next_recv", "next_out")))
    )
    fine = lines.select("trial", F.inline(F.concat(always, some)))
    barrier = F.concat(F.lit("all->Comm."), F.col("tensor"), F.lit(".Sync"))
    sub = lambda op: F.concat("own", F.lit(op))
    chain = [(sub("Sync"), barrier), (barrier, sub("QUEUE")), (sub("QUEUE"), sub("MEMCPY_IN_FUSION_BUFFER"))]
    coarse = base.select("trial", F.inline(F.array(*[F.struct(x.alias("src"), y.alias("dst")) for x, y in chain])))
    return fine.unionByName(coarse)


def tree_edges(tensors: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges of tree all-reduce: (trial, src, dst).

    ``tree`` has trial, pid, parent (null at the root). Sums go up: the
    receives of all children lead to a rank's AGGR and that to its send to the
    parent; at the root AGGR leads to the sends down, which pass each rank.
    """
    t = tensors.select("trial", "tensor").distinct().join(tree, "trial")
    comm = F.concat(F.lit("->Comm."), F.col("tensor"))
    node = lambda pid, sub: F.concat(F.col(pid), comm, F.lit(f".{sub}"))
    child = t.filter("parent is not null")
    edge = lambda df, a, b: df.select("trial", a.alias("src"), b.alias("dst"))
    up_send, up_recv = node("pid", "UP_SEND"), F.concat(F.col("parent"), comm, F.lit(".UP_RECV~>"), F.col("pid"))
    down_send = F.concat(F.col("parent"), comm, F.lit(".DOWN_SEND~>"), F.col("pid"))
    down_recv = node("pid", "DOWN_RECV")
    top = t.filter("parent is null").select(F.col("trial"), F.col("tensor"), F.col("pid").alias("root"))
    passed = child.join(top, ["trial", "tensor"])
    return (
        edge(t, node("pid", "MEMCPY_IN_FUSION_BUFFER"), node("pid", "AGGR"))
        .unionByName(edge(child, node("pid", "AGGR"), up_send))
        .unionByName(edge(child, up_send, up_recv))
        .unionByName(edge(child, up_recv, node("parent", "AGGR")))
        .unionByName(edge(passed.filter("parent = root"), node("parent", "AGGR"), down_send))
        .unionByName(edge(passed.filter("parent <> root"), node("parent", "DOWN_RECV"), down_send))
        .unionByName(edge(child, down_send, down_recv))
        .unionByName(edge(child, down_recv, node("pid", "MEMCPY_OUT_FUSION_BUFFER")))
        .distinct()
    )


def ps_edges(parts: DataFrame) -> DataFrame:
    """Edges of a parameter server's exchange: (trial, src, dst).

    ``parts`` has trial, worker, server, tensor, part and workers (how many the
    trial has). Each worker pushes, the server copies the first and sums the others
    up in turn, and every worker pulls the merged result.
    """
    t = F.concat(F.col("tensor"), F.lit("~PART"), F.col("part"))
    out = lambda op: F.concat(F.col("worker"), F.lit("::"), F.col("server"), F.lit("->Comm."), t, F.lit(f".{op}"))
    back = lambda op: F.concat(F.col("server"), F.lit("::"), F.col("worker"), F.lit("->Comm."), t, F.lit(f".{op}"))
    own = lambda op: F.concat(F.col("server"), F.lit("->"), t, F.lit(f".{op}"))
    chain = [
        (out("PUSH_REQ"), back("PUSH_RES")),
        (back("PUSH_RES"), out("PULL_REQ")),
        (out("PULL_REQ"), back("PULL_RES")),
        (own("COPY_MERGED"), back("PULL_RES")),
        (out("PUSH_REQ"), own("COPY_FIRST")),
    ]
    edges = parts.select("trial", F.explode(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in chain])).alias("e")).select("trial", "e.src", "e.dst")
    sums = parts.select("trial", "server", "tensor", "part", "workers").distinct().filter("workers > 1")
    sums = sums.withColumn("i", F.explode(F.expr("sequence(0, workers - 2)")))
    before = F.when(F.col("i") == 0, own("COPY_FIRST")).otherwise(F.concat(own("SUM"), (F.col("i") - 1).cast("string")))
    this = F.concat(own("SUM"), F.col("i").cast("string"))
    summed = sums.select("trial", before.alias("src"), this.alias("dst"))
    merged = sums.filter("i = workers - 2").select("trial", this.alias("src"), own("COPY_MERGED").alias("dst"))
    alone = parts.filter("workers = 1").select("trial", own("COPY_FIRST").alias("src"), own("COPY_MERGED").alias("dst"))
    return edges.unionByName(summed).unionByName(merged).unionByName(alone).distinct()


# ------------------------------------------------------------- graph tables


def step_graph(events: DataFrame, longest_gap_us: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each step's graph over all devices of its trial.

    ``events`` has trial, pid, step, cat, cat_fine, name, ts_us, dur_us,
    event_seq. Nodes are the events, named
    ``pid->name~>number``; on a device an event comes before the next of its
    category, a backward operation before the next communication, a
    communication before the next update. Devices are linked where they
    synchronise: every ``Sync`` of a tensor leads to a node
    ``all->Barrier.<tensor>`` of the step, and that to each
    ``QUEUE`` of the tensor that began after the last of them. All edges lead
    forward in time (a barrier stands at its last Sync), so there is no cycle.

    Nodes are trial, step, pid, node, cat, avg_ms and the gaps in us to the
    next event of the category (gap_same) and, for backward operations, to the
    next communication (gap_comm); gaps below 0 or of ``longest_gap_us`` or
    more are pauses and count as 0. Edges are trial, step, src, dst, gap_us.
    """
    device = ["trial", "pid", "step"]
    node = F.concat(F.col("pid"), F.lit("->"), F.col("name"), F.lit("~>"), F.col("event_seq"))
    part = lambda i: F.get(F.split("name", "[.]"), F.lit(i))
    base = events.withColumns({"node": node, "end_us": F.expr("ts_us + dur_us"), "tensor": part(1), "sub_op": part(2)})
    # what follows in time is the last seen so far in falling order: one pass over a device's step
    back = Window.partitionBy(*device).orderBy(F.desc("ts_us"), F.desc("event_seq")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*device, "cat").orderBy("ts_us", "event_seq")
    at = F.struct("node", "ts_us")
    of = lambda cond: F.last(F.when(F.expr(cond), at), True).over(back)
    rows = base.withColumns(
        {
            "n_same": F.lead(at).over(ahead),
            "n_comm": F.when(F.col("cat_fine") == "operator.BW", of("cat = 'Comm'")),
            "n_update": F.when(F.col("cat") == "Comm", of("cat_fine = 'operator.UPDATE'")),
        }
    )

    def gap(to: str) -> Column:
        us = F.col(f"{to}.ts_us") - F.col("end_us")
        return F.when((us >= 0) & (us < longest_gap_us), us).otherwise(0).cast("bigint")

    rows = rows.withColumns({"gap_same": gap("n_same"), "gap_comm": gap("n_comm")})
    nodes = rows.select("trial", "step", "pid", "node", "cat", F.round(F.col("dur_us") / 1000, 6).alias("avg_ms"), "gap_same", "gap_comm")
    to = lambda n, us: F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.node").alias("dst"), us.alias("gap_us")))
    zero = F.lit(0).cast("bigint")
    targets = F.array_compact(F.array(to("n_same", F.col("gap_same")), to("n_comm", F.col("gap_comm")), to("n_update", zero)))
    edges = rows.select("trial", "step", F.col("node").alias("src"), F.inline(targets))

    key = ["trial", "step", "tensor"]
    comms = base.filter("cat = 'Comm' and sub_op in ('Sync', 'QUEUE')")
    syncs = comms.filter("sub_op = 'Sync'")
    barriers = syncs.groupBy(*key).agg(F.max("ts_us").alias("at"), F.countDistinct("pid").alias("devices")).filter("devices > 1")
    barrier = F.concat(F.lit("all->Barrier."), F.col("tensor"))
    met = comms.join(barriers, key).filter("sub_op = 'Sync' or ts_us > at")
    end = lambda sub: F.when(F.col("sub_op") == sub, F.col("node")).otherwise(barrier)
    links = met.select("trial", "step", end("Sync").alias("src"), end("QUEUE").alias("dst"), zero.alias("gap_us"))
    virtual = barriers.select(
        "trial", "step", F.lit("all").alias("pid"), barrier.alias("node"), F.lit("none").alias("cat"), F.lit(0.0).alias("avg_ms"),
        zero.alias("gap_same"), zero.alias("gap_comm"),
    )
    return nodes.unionByName(virtual), edges.unionByName(links)


def edge_costs(edges: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Edges with their cost in ms: the mean of the node they leave and the gap behind it."""
    costs = nodes.select(*key, F.col("node").alias("src"), "avg_ms")
    rows = edges.join(costs, [*key, "src"])
    return rows.select(*key, "src", "dst", F.round(F.col("avg_ms") + F.col("gap_us") / 1000, 6).alias("cost_ms"))


def bypass(edges: DataFrame, drop: DataFrame, key: list[str]) -> DataFrame:
    """The graph without the nodes of ``drop`` (key, node): their predecessors lead to their successors.

    Chains of dropped nodes are followed until none is left, however long:
    each round halves them, as the dropped nodes' own edges are joined too.
    """
    cur = edges.select(*key, "src", "dst").distinct()
    gone = drop.select(*key, F.col("node").alias("mid"), F.lit(True).alias("out")).distinct()
    while True:
        into = cur.join(gone.withColumnRenamed("mid", "dst"), [*key, "dst"], "left")
        hit = into.filter("out").select(*key, "src", F.col("dst").alias("mid"))
        keep = into.filter("out is null").select(*key, "src", "dst")
        on = cur.select(*key, F.col("src").alias("mid"), F.col("dst").alias("onward"))
        more = hit.filter("src <> mid").join(on, [*key, "mid"]).filter("mid <> onward").select(*key, "src", F.col("onward").alias("dst"))
        cur = cut(keep.unionByName(more).distinct())
        if cur.join(gone.withColumnRenamed("mid", "dst"), [*key, "dst"], "left_semi").isEmpty():
            break
    return cur.join(gone.withColumnRenamed("mid", "src"), [*key, "src"], "left_anti").filter("src <> dst")


def within_hops(edges: DataFrame, starts: DataFrame, hops: int, key: list[str]) -> DataFrame:
    """Nodes within ``hops`` edges of the starts (key, node), either way, and their distance."""
    near = edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("other"))
    both = near.unionByName(near.select(*key, F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    seen = starts.select(*key, "node").distinct().withColumn("hops", F.lit(0))
    for h in range(1, hops + 1):
        front = seen.filter(F.col("hops") == h - 1).join(both, [*key, "node"]).select(*key, F.col("other").alias("node"), F.lit(h).alias("hops"))
        seen = seen.unionByName(front).groupBy(*key, "node").agg(F.min("hops").alias("hops"))
    return seen


def reachable(edges: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """Nodes that a path of edges leads to from the starts, these included: (key, node).

    One round per distance; each adds the new nodes only, and its result is
    written to the shared folder, so lineage stays short.
    """
    onward = edges.select(*key, F.col("src").alias("node"), F.col("dst").alias("other")).distinct()
    seen = cut(starts.select(*key, "node").distinct())
    front = seen
    while True:
        step = front.join(onward, [*key, "node"]).select(*key, F.col("other").alias("node")).distinct()
        front = cut(step.join(seen, [*key, "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def global_edges(ops: DataFrame, comms: DataFrame, updates: DataFrame) -> DataFrame:
    """The data flow of all devices as one graph of names: (trial, src, dst).

    ``ops`` has trial, pid, name and one input i (an operation's output)
    a row, ``comms`` trial, pid, op_name (the tensor group) and inputs,
    ``updates`` trial, pid, name. An input comes from the operation of the
    same phase (for updates of the backward one). A tensor's ``Sync`` waits
    for the operations that feed it, and all devices wait for each other at
    ``all->Comm.<tensor>.Sync``; the copy out leads to the device's updates,
    these to END. Edges from updates to the next forward pass are left away,
    as they would close a cycle.
    """
    at = lambda x: F.concat(F.col("pid"), F.lit("->"), x)
    edge = lambda df, a, b: df.select("trial", a.alias("src"), b.alias("dst"))
    phase = F.substring_index("name", ".", 1)
    before = F.concat(F.when(phase == "UPDATE_", "BW").otherwise(phase), F.lit("."), F.substring_index("i", ":", 1))
    out = edge(ops, at(before), at(F.col("name")))
    fed = comms.select("trial", "pid", "op_name", F.explode("inputs").alias("i"))
    group = F.concat(F.lit("Comm."), "op_name", F.lit("."))
    sub = lambda s: at(F.concat(group, F.lit(s)))
    out = out.unionByName(edge(fed, at(F.concat(F.lit("BW."), F.substring_index("i", ":", 1))), sub("Sync")))
    own = comms.select("trial", "pid", "op_name").distinct()
    barrier = F.concat(F.lit("all->"), group, F.lit("Sync"))
    parts = ["QUEUE", "MEMCPY_IN_FUSION_BUFFER", "NCCL_ALLREDUCE", "MEMCPY_OUT_FUSION_BUFFER"]
    chain = [(sub("Sync"), barrier), (barrier, sub("QUEUE")), *[(sub(a), sub(b)) for a, b in zip(parts, parts[1:])]]
    out = out.unionByName(own.select("trial", F.inline(F.array(*[F.struct(a.alias("src"), b.alias("dst")) for a, b in chain]))))
    out = out.unionByName(edge(own.join(updates, ["trial", "pid"]), sub(parts[-1]), at(F.col("name"))))
    return out.unionByName(edge(updates, at(F.col("name")), F.lit("END"))).filter("src <> dst").distinct()


# ------------------------------------------------------- kernels per graph


def _graphs(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Nodes and edges of each graph as rows of one table, a graph's rows together and in order.

    A node's gaps, where the table has them, come as a JSON text by the pair
    of categories that they lie between.
    """
    gaps = F.lit(None).cast("string")
    if "gap_same" in nodes.columns:
        same = F.map_from_arrays(F.array(F.concat("cat", F.lit("GAP"), "cat"), F.lit("operatorGAPComm")), F.array("gap_same", "gap_comm"))
        gaps = F.when((F.col("gap_same") > 0) | (F.col("gap_comm") > 0), F.to_json(same))
    a = nodes.select(*key, "node", "avg_ms", F.lit(None).cast("string").alias("dst"), gaps.alias("gaps"))
    b = edges.select(*key, F.col("src").alias("node"), F.lit(None).cast("double").alias("avg_ms"), "dst", F.lit(None).cast("string").alias("gaps"))
    return a.unionByName(b)


Body = Callable[[tuple, kernels.Graph], list[tuple]]


def _per_graph(rows: DataFrame, key: list[str], body: Body, out: str) -> DataFrame:
    """``body(key, graph)`` for each graph: its rows, behind the key's columns.

    Graphs are small and many, so a partition's graphs are read in the order
    of the key and cut where it changes, rather than as one group each.
    """
    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in key) + out
    columns = [*key, *[c.strip().split()[0] for c in out.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def solve(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            cols = [pdf[k].tolist() for k in key]
            node, avg, dst, gaps = (pdf[c].tolist() for c in ("node", "avg_ms", "dst", "gaps"))
            found: list[tuple] = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own = [(node[i], avg[i]) for i in range(lo, hi) if dst[i] is None]
                links = [(node[i], dst[i]) for i in range(lo, hi) if dst[i] is not None]
                if own:
                    k = tuple(c[lo] for c in cols)
                    between = {node[i]: json.loads(gaps[i]) for i in range(lo, hi) if gaps[i] is not None}
                    found += [(*k, *r) for r in body(k, kernels.Graph.build(own, links, between))]
            return pd.DataFrame(found, columns=columns)

        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            changed = np.zeros(len(pdf), bool)
            for k in key:
                v = pdf[k].to_numpy(object)
                changed[1:] |= v[1:] != v[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(changed)])
            held = pdf.iloc[cuts[-1] :].reset_index(drop=True)
            if len(cuts) > 1:
                yield solve(pdf, cuts)
        if held is not None and len(held):
            yield solve(held, np.array([0, len(held)]))

    together = by_key(rows, *key).sortWithinPartitions(*key, F.col("dst").isNotNull(), "node", "dst")
    return together.mapInPandas(run, schema)


def critical_paths(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The longest path of each graph: (key, pos, node, cost_ms), cost 0 at its end.

    A graph (one key) has to fit a task; keys run in parallel.
    """

    def path(k: tuple, g: kernels.Graph) -> list[tuple]:
        found = kernels.longest_path(g, lambda u, v: kernels.node_cost(g, u, v))
        return [(i, n, round(c, 6)) for i, (n, c) in enumerate(found)]

    return _per_graph(_graphs(nodes, edges, key), key, path, "pos int, node string, cost_ms double")


def replays(nodes: DataFrame, edges: DataFrame, key: list[str], delays: kernels.Delays | None = None) -> DataFrame:
    """Each graph run on virtual devices: (key, node, device, start_us, end_us, exec_seq, queue_len)."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        runs, _, _ = kernels.replay(g, delays)
        return [(g.names[r.node], r.device, round(r.start, 3), round(r.end, 3), r.seq, r.queue) for r in runs]

    out = "node string, device string, start_us double, end_us double, exec_seq int, queue_len int"
    return _per_graph(_graphs(nodes, edges, key), key, run, out)


def execution_edges(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges that the order of execution on the devices adds: (key, src, dst)."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        return [(g.names[u], g.names[v]) for u, v in kernels.replay(g)[2]]

    return _per_graph(_graphs(nodes, edges, key), key, run, "src string, dst string")


def scenarios(nodes: DataFrame, edges: DataFrame, key: list[str], cases: dict[str, kernels.Delays]) -> DataFrame:
    """Time of each graph under each case: (key, scenario, time_ms), all in one pass over the graphs."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        return [(name, round(kernels.replay(g, case)[1], 6)) for name, case in cases.items()]

    return _per_graph(_graphs(nodes, edges, key), key, run, "scenario string, time_ms double")


def bottlenecks(nodes: DataFrame, edges: DataFrame, key: list[str], shorten_ms: float = 5.0) -> DataFrame:
    """Gain of shortening each node of the critical path: (key, node, gain_ms)."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        base = kernels.replay(g)[1]
        path = [n for n, _ in kernels.longest_path(g, lambda u, v: kernels.node_cost(g, u, v))]
        return [(n, round(base - kernels.replay(g, kernels.Delays({n: (-shorten_ms, 1.0)}))[1], 6)) for n in path]

    return _per_graph(_graphs(nodes, edges, key), key, run, "node string, gain_ms double")


def searches(
    nodes: DataFrame, edges: DataFrame, key: list[str], rounds: int | None = 10, seed: int = 0, rules: kernels.MoveRules = kernels.MoveRules()
) -> DataFrame:
    """Strategy found by each search: (key, method, base_ms, best_ms, replayed_ms, fused, tried, steps).

    ``steps`` are the strategy's steps in their order (token and nodes);
    ``replayed_ms`` is the time of the graph after them, run anew. Without
    ``rounds`` a graph gets twice as many as it has moves, so that the tree
    search has tried each first move and goes on below.
    """
    methods = {
        "mcmc": lambda g, n, root: kernels.mcmc(g, n, seed=seed, rules=rules, root=root),
        "mcts": lambda g, n, root: kernels.mcts(g, n, seed=seed, rules=rules, root=root),
        "walk": lambda g, n, root: kernels.greedy_walk(g, rules=rules, root=root),
    }

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        found = []
        root = kernels.searched(g, rules)
        n = 2 * len(root.moves()) if rounds is None else rounds
        for m, f in methods.items():
            o = f(g, n, root)
            again = kernels.replay(kernels.apply_all(g, o.steps, rules))[1]
            found.append((m, round(o.tried[0], 6), round(o.best, 6), round(again, 6), len(o.steps), len(o.tried), kernels.written(o.steps)))
        return found

    out = "method string, base_ms double, best_ms double, replayed_ms double, fused int, tried int, steps array<string>"
    return _per_graph(_graphs(nodes, edges, key), key, run, out)


def cycles(edges: DataFrame, key: list[str]) -> DataFrame:
    """Nodes that lie on or behind a cycle, per graph: (key, node)."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links = list(zip(pdf["src"], pdf["dst"]))
        g = kernels.Graph.build([(n, 0.0) for n in sorted({x for e in links for x in e})], links)
        return pd.DataFrame([(*k, g.names[i]) for i in g.order()[1]], columns=[*key, "node"])

    return edges.select(*key, "src", "dst").distinct().groupBy(*key).applyInPandas(run, _key_schema(edges, key) + "node string")


def samples(edges: DataFrame, key: list[str], size: int, replicas: int, seed: int = 0) -> DataFrame:
    """Sampled sub-graphs of each graph, repeats by shape left out: (key, method, replica, node, shape)."""
    rows = edges.select(*key, "src", "dst").distinct().withColumn("method", F.explode(F.array(F.lit("fire"), F.lit("walk"))))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links = sorted(zip(pdf["src"], pdf["dst"]))
        g = kernels.Graph.build([(n, 0.0) for n in sorted({x for e in links for x in e})], links)
        seen, out = set(), []
        for r in range(replicas):
            nodes = kernels.forest_fire(g, size, 0.5, seed + r) if k[-1] == "fire" else kernels.random_walk(g, size, 0.15, seed + r)
            inside = set(nodes)
            own = [(a, b) for a, b in links if a in {g.names[i] for i in inside} and b in {g.names[i] for i in inside}]
            sub = kernels.Graph.build([(g.names[i], 0.0) for i in nodes], own)
            shape = kernels.shape_hash(sub, [n.split("/")[-1] for n in sub.names])
            if shape not in seen:
                seen.add(shape)
                out += [(*k, r, g.names[i], shape) for i in nodes]
        return pd.DataFrame(out, columns=[*key, "method", "replica", "node", "shape"])

    schema = _key_schema(edges, key) + "method string, replica int, node string, shape string"
    return rows.groupBy(*key, "method").applyInPandas(run, schema)


def fusion_groups(nodes: DataFrame, edges: DataFrame, key: list[str], most: int) -> DataFrame:
    """Clusters of operations that may be compiled together: (key, node, cluster)."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        found = kernels.clusters(g, most, lambda i: kernels.coarse(g.names[i]) == "operator")
        return [(g.names[i], c) for c, group in enumerate(found) for i in group]

    return _per_graph(_graphs(nodes, edges, key), key, run, "node string, cluster int")


def _key_schema(df: DataFrame, key: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in key)


def recomputed(nodes: DataFrame, edges: DataFrame, key: list[str], share: float = 0.1) -> DataFrame:
    """Time of each graph as it is and with all but the slowest ``share`` of forward nodes run again: (key, kept, base_ms, again_ms)."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        forward = sorted((i for i, n in enumerate(g.names) if "->FW" in n), key=lambda i: (-g.avg[i], g.names[i]))
        keep = {g.names[i] for i in forward[: int(len(forward) * share)]}
        return [(len(keep), round(kernels.replay(g)[1], 6), round(kernels.replay(kernels.recompute(g, keep))[1], 6))]

    return _per_graph(_graphs(nodes, edges, key), key, run, "kept int, base_ms double, again_ms double")


def tensor_fusions(nodes: DataFrame, edges: DataFrame, key: list[str], slope: float = 1e-3, base: float = 0.5) -> DataFrame:
    """Best groups of each graph's communications by dynamic programming: (key, groups, tensors, apart_ms, fused_ms).

    Sizes are the measured times less the base; readiness is that of a replay.
    """

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        comm = [r for r in sorted(kernels.replay(g)[0], key=lambda r: (r.start, r.node)) if kernels.coarse(g.names[r.node]) == "Comm"]
        if not comm:
            return []
        sizes = [(g.names[r.node], max(g.avg[r.node] - base, 0.0) / slope) for r in comm]
        ready = [r.start / 1000 for r in comm]
        apart = 0.0
        for (_, s), at in zip(sizes, ready):
            apart = max(apart, at) + slope * s + base
        groups, end = kernels.fuse_tensors(sizes, ready, slope, base)
        return [(len(groups), len(comm), round(apart, 6), round(end, 6))]

    return _per_graph(_graphs(nodes, edges, key), key, run, "groups int, tensors int, apart_ms double, fused_ms double")


def layers(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Layer of each operation by the one communication behind it: (key, node, layer)."""

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        targets = {n: n.split("->")[-1].split("~>")[0] for n in g.names if kernels.coarse(n) == "Comm"}
        return sorted(kernels.layer_of(g, targets).items())

    return _per_graph(_graphs(nodes, edges, key), key, run, "node string, layer string")


def rewrites(nodes: DataFrame, edges: DataFrame, key: list[str], half: str) -> DataFrame:
    """Time of each graph under the rewrites of precision and batch: (key, rewrite, time_ms).

    ``half`` is a regular expression of the operations in half precision.
    """
    import re

    low = re.compile(half)

    def run(k: tuple, g: kernels.Graph) -> list[tuple]:
        chosen = {n for n in g.names if low.search(n) and kernels.coarse(n) == "operator"}
        cases = {"base": g, "half precision": kernels.quantise(g, chosen), "batch x 2": kernels.grow_batch(g, 2)}
        return [(name, round(kernels.replay(x)[1], 6)) for name, x in cases.items()]

    return _per_graph(_graphs(nodes, edges, key), key, run, "rewrite string, time_ms double")


def coarse_chain(parts: DataFrame, order: list[str]) -> DataFrame:
    """Edges between the successive parts of a tensor's synchronisation that took time: (trial, pid, tensor, src, dst).

    ``parts`` has trial, pid, tensor, sub_op and avg_us; parts without time or
    outside ``order`` are passed over.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("sub_op"))
    rows = parts.filter("avg_us > 0").withColumn("place", place).filter("place > 0")
    ahead = Window.partitionBy("trial", "pid", "tensor").orderBy("place")  # as many rows as there are parts
    rows = rows.withColumn("dst", F.lead("sub_op").over(ahead)).filter("dst is not null")
    return rows.select("trial", "pid", "tensor", F.col("sub_op").alias("src"), "dst")


def effective_producers(edges: DataFrame, costs: DataFrame, key: list[str], targets: DataFrame) -> DataFrame:
    """Predecessors of ``targets`` (key, node) that take time, found through those that take none: (key, node, producer)."""
    free = costs.filter("avg_ms = 0").select(*key, "node")
    kept = bypass(edges, free.join(targets, [*key, "node"], "left_anti"), key)
    return kept.join(targets.select(*key, F.col("node").alias("dst")), [*key, "dst"], "left_semi").select(*key, F.col("dst").alias("node"), F.col("src").alias("producer"))
