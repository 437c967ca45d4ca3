"""Queries of graphs, replay, cost models and memory, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import align, costs, graph, kernels, matching
from tracequarry.operators import nested
from tracequarry.operators import statistics as st
from tracequarry.plans.sequence_queries import _EDGES, _PAIRS, dfg_edges
from tracequarry.plans.sql import NESTED, SIZES, colour_case, text, typed, with_comm, with_trace
from tracequarry.plans.statistics_queries import comm, silver
from tracequarry.session import table

KEY = ["trial", "step"]

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_RANKS = """ranks as (select trial, pid, row_number() over (partition by trial order by pid) - 1 as rank, count(*) over (partition by trial) as n
  from (select distinct trial, pid from comm_ok where trial is not null))"""
_TENSORS = (
    r"""tensors as (select trial, regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) tensor,
  coalesce(max(args.loop_id) + 1, 1) as loops, coalesce(max(args.channel_id) + 1, 1) as channels, coalesce(max(args.slice_id) + 1, 1) as slices
  from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.](SEND|RECV)$') and trial is not null group by all),
"""
    + _RANKS
)


def _ring(spark, d):
    """Tensors with their loops, channels and slices (one where no event tells), and the devices of each trial by place."""
    rows = comm(spark, d, "trial", "args").filter("trial is not null")
    tensors = rows.filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'").groupBy("trial", F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1).alias("tensor"))
    ids = {"loops": "loop_id", "channels": "channel_id", "slices": "slice_id"}
    tensors = tensors.agg(*[F.coalesce(F.max(f"args.{v}") + 1, F.lit(1)).alias(k) for k, v in ids.items()])
    from pyspark.sql import Window

    ranks = rows.select("trial", "pid").distinct()
    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("trial").orderBy("pid")) - 1)
    return tensors, ranks


@query(
    "ring_expand",
    with_comm(
        """
select distinct trial, src, dst from (
  select trial, r.pid || '->' || c || '.MEMCPY_IN_FUSION_BUFFER' as src, r.pid || '->' || c || '.SEND~>' || sfx as dst from st join r using (trial, pid)
  union all select trial, r.pid || '->' || c || '.MEMCPY_IN_FUSION_BUFFER', r.pid || '->' || c || '.RECV~>' || sfx from st join r using (trial, pid)
  union all select trial, pid || '->' || c || '.RECV~>' || prv, pid || '->' || c || '.SEND~>' || sfx from st where k > 0
  union all select trial, pid || '->' || c || '.SEND~>' || sfx, nxt || '->' || c || '.RECV~>' || sfx from st
  union all select trial, nxt || '->' || c || '.RECV~>' || sfx, nxt || '->' || c || '.MEMCPY_OUT_FUSION_BUFFER' from st where k = 2 * (n - 1) - 1
  union all select trial, pid || '->' || c || '.QUEUE', pid || '->' || c || '.MEMCPY_IN_FUSION_BUFFER' from (select distinct trial, pid, c from st)
  union all select trial, pid || '->' || c || '.Sync', 'all->' || c || '.Sync' from (select distinct trial, pid, c from st)
  union all select trial, 'all->' || c || '.Sync', pid || '->' || c || '.QUEUE' from (select distinct trial, pid, c from st))""",
        _TENSORS
        + """,
r as (select trial, pid from ranks),
st as (select t.trial, a.pid, b.pid as nxt, a.n, 'Comm.' || t.tensor as c, k, concat_ws('_', l, ch, k, s) as sfx, concat_ws('_', l, ch, k - 1, s) as prv
  from tensors t join ranks a on a.trial = t.trial join ranks b on b.trial = a.trial and b.rank = (a.rank + 1) % a.n,
  unnest(range(t.loops)) x(l), unnest(range(t.channels)) y(ch), unnest(range(t.slices)) z(s), unnest(range(2 * (a.n - 1))) w(k) where a.n > 1)""",
    ),
)
def ring_expand(spark, d):
    """Ring all-reduce of every tensor group among its trial's devices, over the loops, channels and slices that its events have."""
    return graph.ring_edges(*_ring(spark, d))


@query(
    "tree_expand",
    with_comm(
        """
select distinct trial, src, dst from (
  select trial, p || '.MEMCPY_IN_FUSION_BUFFER' as src, p || '.AGGR' as dst from x
  union all select trial, p || '.AGGR', p || '.UP_SEND' from x where up is not null
  union all select trial, p || '.UP_SEND', up || '.UP_RECV~>' || pid from x where up is not null
  union all select trial, up || '.UP_RECV~>' || pid, up || '.AGGR' from x where up is not null
  union all select trial, up || case when rank <= 2 then '.AGGR' else '.DOWN_RECV' end, up || '.DOWN_SEND~>' || pid from x where up is not null
  union all select trial, up || '.DOWN_SEND~>' || pid, p || '.DOWN_RECV' from x where up is not null
  union all select trial, p || '.DOWN_RECV', p || '.MEMCPY_OUT_FUSION_BUFFER' from x where up is not null)""",
        _TENSORS
        + """,
  x as (select t.trial, r.rank, r.pid, r.pid || '->Comm.' || t.tensor as p, u.pid || '->Comm.' || t.tensor as up
    from tensors t join ranks r on r.trial = t.trial left join ranks u on u.trial = r.trial and r.rank > 0 and u.rank = (r.rank - 1) // 2)""",
    ),
)
def tree_expand(spark, d):
    """Tree all-reduce of the same tensors; the device at place i has the one at (i - 1) / 2 above it."""
    tensors, ranks = _ring(spark, d)
    above = ranks.select("trial", F.col("rank").alias("up"), F.col("pid").alias("parent"))
    tree = ranks.withColumn("up", F.expr("if(rank = 0, null, cast(floor((rank - 1) / 2) as int))")).join(above, ["trial", "up"], "left")
    return graph.tree_edges(tensors, tree.select("trial", "pid", "parent"))


_PARTS = f"""{_RANKS},
ops as (select distinct trial, pid as server, regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) as tensor from server_events
  where event_seq is not null and trial is not null and pid is not null and name is not null),
x as (select o.trial, r.pid as worker, o.server, o.tensor || '~PART0' as t, r.n as workers from ops o join ranks r on r.trial = o.trial),
i as (select distinct trial, server, t, workers, k from x, unnest(range(workers - 1)) v(k))"""


@query(
    "ps_edges",
    with_comm(
        """
select distinct trial, src, dst from (
  select trial, worker || '::' || server || '->Comm.' || t || '.PUSH_REQ' as src, server || '::' || worker || '->Comm.' || t || '.PUSH_RES' as dst from x
  union all select trial, server || '::' || worker || '->Comm.' || t || '.PUSH_RES', worker || '::' || server || '->Comm.' || t || '.PULL_REQ' from x
  union all select trial, worker || '::' || server || '->Comm.' || t || '.PULL_REQ', server || '::' || worker || '->Comm.' || t || '.PULL_RES' from x
  union all select trial, server || '->' || t || '.COPY_MERGED', server || '::' || worker || '->Comm.' || t || '.PULL_RES' from x
  union all select trial, worker || '::' || server || '->Comm.' || t || '.PUSH_REQ', server || '->' || t || '.COPY_FIRST' from x
  union all select trial, server || '->' || t || case when k = 0 then '.COPY_FIRST' else '.SUM' || (k - 1) end, server || '->' || t || '.SUM' || k from i
  union all select trial, server || '->' || t || '.SUM' || k, server || '->' || t || '.COPY_MERGED' from i where k = workers - 2
  union all select trial, server || '->' || t || '.COPY_FIRST', server || '->' || t || '.COPY_MERGED' from x where workers = 1)""",
        _PARTS,
    ),
)
def ps_edges(spark, d):
    """Push and pull of every tensor of every server, for the devices of its trial."""
    rows = st.distinct_events(table(spark, d, "server_events"), "trial", "pid", "name").filter("trial is not null and pid is not null and name is not null")
    parts = rows.select("trial", F.col("pid").alias("server"), F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1).alias("tensor"), F.lit(0).alias("part")).distinct()
    ranks = _ring(spark, d)[1]
    workers = ranks.join(ranks.groupBy("trial").agg(F.count(F.lit(1)).cast("int").alias("workers")), "trial")
    return graph.ps_edges(parts.join(workers.select("trial", F.col("pid").alias("worker"), "workers"), "trial"))


_STEP = """ev as (select * replace (string_split(name, '.')[2] as op_name, string_split(name, '.')[3] as sub_op), pid || '->' || name || '~>' || event_seq as node, ts_us + dur_us as end_us from silver where step is not null and trial is not null and cat is not null),
nx as (select *, lead(node) over c n1, lead(ts_us) over c t1,
  case when cat_fine = 'operator.BW' then first(case when cat = 'Comm' then node end ignore nulls) over w end n2,
  case when cat_fine = 'operator.BW' then first(case when cat = 'Comm' then ts_us end ignore nulls) over w end t2,
  case when cat = 'Comm' then first(case when cat_fine = 'operator.UPDATE' then node end ignore nulls) over w end n3
  from ev window w as (partition by trial, pid, step order by ts_us, event_seq rows between 1 following and unbounded following),
    c as (partition by trial, pid, step, cat order by ts_us, event_seq)),
gp as (select *, case when t1 - end_us between 0 and 999 then t1 - end_us else 0 end g1, case when t2 - end_us between 0 and 999 then t2 - end_us else 0 end g2 from nx),
bars as (select trial, step, op_name, max(ts_us) as at_us, 'all->Barrier.' || op_name as bar from gp
  where cat = 'Comm' and sub_op = 'Sync' group by trial, step, op_name having count(distinct pid) > 1),
sedges as (select trial, step, node as src, n1 as dst, dur_us, g1 as gap_us from gp where n1 is not null
  union all select trial, step, node, n2, dur_us, g2 from gp where n2 is not null
  union all select trial, step, node, n3, dur_us, 0 from gp where n3 is not null
  union all select trial, step, node, bar, dur_us, 0 from gp join bars using (trial, step, op_name) where cat = 'Comm' and sub_op = 'Sync'
  union all select trial, step, bar, node, 0, 0 from gp join bars using (trial, step, op_name) where cat = 'Comm' and sub_op = 'QUEUE' and ts_us > at_us)"""


def _steps(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "step", "cat", "cat_fine")
    return graph.step_graph(rows.filter("step is not null and trial is not null and cat is not null"))


@query("step_edges", with_trace("select trial, step, src, dst, gap_us::bigint as gap_us from sedges", _STEP))
def step_edges(spark, d):
    """The graph of each step over all devices of its trial."""
    return _steps(spark, d)[1]


@query(
    "edge_cost",
    with_trace("select trial, step, src, dst, round(round(dur_us / 1000, 6) + gap_us / 1000, 6) as cost_ms from sedges", _STEP),
)
def edge_cost(spark, d):
    nodes, edges = _steps(spark, d)
    return graph.edge_costs(edges, nodes, ["trial", "step"])


@query(
    "critical_length",
    "with recursive"
    + with_trace(
        "select trial, step, round(max(dist), 3) as length_ms from dist group by trial, step",
        _STEP
        + """,
ce as (select trial, step, src, dst, round(dur_us / 1000, 6) + gap_us / 1000 as cost from sedges),
dist(trial, step, node, dist) using key (trial, step, node) as (
  select trial, step, node, 0.0::double from (select trial, step, node from ev union select trial, step, bar from bars)
  union
  select e.trial, e.step, e.dst, max(d.dist + e.cost) from dist d join ce e on e.trial = d.trial and e.step = d.step and e.src = d.node
    join recurring.dist o on o.trial = e.trial and o.step = e.step and o.node = e.dst
  where d.dist + e.cost > o.dist + 1e-9 group by e.trial, e.step, e.dst)""",
    )[4:],
)
def critical_length(spark, d):
    """Length of each step's critical path over all devices of its trial."""
    paths = graph.critical_paths(*_steps(spark, d), KEY)
    return paths.groupBy(*KEY).agg(F.round(F.sum("cost_ms"), 3).alias("length_ms"))


@query("critical_path")
def critical_path(spark, d):
    return graph.critical_paths(*_steps(spark, d), KEY)


@query("event_replay")
def event_replay(spark, d):
    return graph.replays(*_steps(spark, d), KEY)


@query("execution_graph")
def execution_graph(spark, d):
    return graph.execution_edges(*_steps(spark, d), KEY)


@query("delay_scenarios")
def delay_scenarios(spark, d):
    cases = {
        "base": kernels.Delays(),
        "computation x 1.1": kernels.Delays(computation=(0.0, 1.1)),
        "communication x 1.1": kernels.Delays(communication=(0.0, 1.1)),
        "all + 1 ms": kernels.Delays(all=(1.0, 1.0)),
    }
    return graph.scenarios(*_steps(spark, d), KEY, cases)


@query("bottleneck")
def bottleneck(spark, d):
    return graph.bottlenecks(*_steps(spark, d), KEY)


@query("fusion_search")
def fusion_search(spark, d):
    """Fusions by three searches on the graph of each step, with rounds by its size."""
    return graph.searches(*_steps(spark, d), KEY, rounds=None)


ALL_MOVES = kernels.MoveRules(tokens=("+", "++", "--", ">"))


@query("strategy")
def strategy(spark, d):
    """The best strategy found for each step's graph over fusions, joined and split transfers and precision, with its steps."""
    return graph.searches(*_steps(spark, d), KEY, rounds=20, rules=ALL_MOVES)


@query(
    "strategy_replay",
    with_trace(
        "select trial, step, method, true as same, true as no_worse from (select distinct trial, step from ev), unnest(['mcmc', 'mcts', 'walk']) m(method)", _STEP
    ),
)
def strategy_replay(spark, d):
    """Whether the recorded steps, run anew, give the time that each search has told, and no worse a time than without them."""
    found = graph.searches(*_steps(spark, d), KEY, rounds=5, rules=ALL_MOVES)
    return found.select(*KEY, "method", (F.col("best_ms") == F.col("replayed_ms")).alias("same"), (F.col("best_ms") <= F.col("base_ms")).alias("no_worse"))


@query("fusion_clusters")
def fusion_clusters(spark, d):
    return graph.fusion_groups(*_steps(spark, d), KEY, 8)


@query(
    "dfg_cycles",
    "with recursive"
    + with_trace(
        """select distinct c.trial, c.b as node from (select trial, a as b from clo where a = b union all select y.trial, y.b from clo x join clo y on y.trial = x.trial and y.a = x.a where x.a = x.b) c""",
        _EDGES + """, clo as (select trial, src as a, dst as b from edges union select c.trial, c.a, e.dst from clo c join edges e on e.trial = c.trial and e.src = c.b)""",
    )[4:],
)
def dfg_cycles(spark, d):
    return graph.cycles(dfg_edges(spark, d), ["trial"])


@query("graph_samples")
def graph_samples(spark, d):
    return graph.samples(dfg_edges(spark, d), ["trial"], 6, 20)


_STARTS = "starts as (select trial, min(src) as node from edges group by trial)"


def _starts(edges):
    return edges.groupBy("trial").agg(F.min("src").alias("node"))


@query(
    "khop_subgraph",
    with_trace(
        "select trial, node, min(hops) as hops from hop group by trial, node",
        _EDGES + ", " + _STARTS + """, both_ways as (select trial, src u, dst v from edges union select trial, dst, src from edges),
h1 as (select s.trial, b.v as node from starts s join both_ways b on b.trial = s.trial and b.u = s.node),
h2 as (select h.trial, b.v as node from h1 h join both_ways b on b.trial = h.trial and b.u = h.node),
hop as (select trial, node, 0 as hops from starts union all select trial, node, 1 from h1 union all select trial, node, 2 from h2)""",
    ),
)
def khop_subgraph(spark, d):
    edges = dfg_edges(spark, d)
    return graph.within_hops(edges, _starts(edges), 2, ["trial"])


@query(
    "reachability",
    "with recursive" + with_trace("select * from reach", _EDGES + ", " + _STARTS + """,
reach as (select trial, node from starts union select r.trial, e.dst from reach r join edges e on e.trial = r.trial and e.src = r.node)""")[4:],
)
def reachability(spark, d):
    edges = dfg_edges(spark, d)
    return graph.reachable(edges, _starts(edges), ["trial"])


@query(
    "node_bypass",
    with_trace(
        """select distinct trial, src, dst from (
  select trial, src, dst from edges where not regexp_matches(src, 'BiasAdd$') and not regexp_matches(dst, 'BiasAdd$')
  union all select a.trial, a.src, b.dst from cl b join edges a on a.trial = b.trial and a.dst = b.src where not regexp_matches(a.src, 'BiasAdd$')) where src <> dst""",
        _EDGES + """, mids as (select distinct trial, src, dst from edges where regexp_matches(src, 'BiasAdd$')),
cl0 as (select trial, src, dst from mids),
cl1 as (select trial, src, dst from cl0 union select a.trial, a.src, b.dst from cl0 a join cl0 b on a.trial = b.trial and a.dst = b.src),
cl2 as (select trial, src, dst from cl1 union select a.trial, a.src, b.dst from cl1 a join cl1 b on a.trial = b.trial and a.dst = b.src),
cl3 as (select trial, src, dst from cl2 union select a.trial, a.src, b.dst from cl2 a join cl2 b on a.trial = b.trial and a.dst = b.src),
cl as (select * from cl3 where not regexp_matches(dst, 'BiasAdd$'))""",
    ),
)
def node_bypass(spark, d):
    """The data flow graph without its BiasAdd operations."""
    edges = dfg_edges(spark, d)
    ends = edges.select("trial", F.col("src").alias("node")).union(edges.select("trial", "dst")).distinct()
    return graph.bypass(edges, ends.filter("node rlike 'BiasAdd$'"), ["trial"])


# ------------------------------------------------------------------- clocks

_TRANS = """tr as (select a.pid src, b.pid dst, a.ts_us sent_us, b.ts_us + b.dur_us got_us from num a join num b
  on a.trial = b.trial and a.t = b.t and a.occ = b.occ and a.side = 'SEND' and b.side = 'RECV' and a.pid <> b.pid)"""


def _transfers(spark, d):
    rows = comm(spark, d, "trial", "event_seq").filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'")
    rows = rows.withColumn("tensor", F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1))
    n = [matching.numbered(rows.filter(f"name like '%.{s}'"), ["trial", "pid", "tensor"]) for s in ("SEND", "RECV")]
    sent = n[0].select("trial", "tensor", "occurrence", F.col("pid").alias("src"), F.col("ts_us").alias("sent_us"))
    got = n[1].select("trial", "tensor", "occurrence", F.col("pid").alias("dst"), F.expr("ts_us + dur_us").alias("got_us"))
    return sent.join(got, ["trial", "tensor", "occurrence"]).filter("src <> dst")


@query("drift_bounds", with_comm("select src as a, dst as b, min(got_us - sent_us) as bound_us from tr group by all", _PAIRS + ", " + _TRANS))
def drift_bounds(spark, d):
    return align.drift_bounds(_transfers(spark, d))


@query("clock_shifts")
def clock_shifts(spark, d):
    """Least shifts under the bounds (which may contradict each other; then the nearest to meeting them)."""
    return align.solve_shifts(align.drift_bounds(_transfers(spark, d)))


@query(
    "link_delay",
    with_comm("select src, dst, count(*) as n, round(avg(got_us - sent_us), 6) as avg_us, min(got_us - sent_us) as min_us from tr where got_us >= sent_us group by all", _PAIRS + ", " + _TRANS),
)
def link_delay(spark, d):
    return align.link_delays(_transfers(spark, d).withColumn("queued", F.expr("got_us < sent_us")))


# -------------------------------------------------------------- cost models

_LINE = r"""smp as (select pid, string_split(name, '.')[3] as sub_op, len(string_split(regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1), '+'))::double x, dur_us::double y
  from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.](SEND|RECV)$')),
s as (select pid, sub_op, count(*) n, avg(x) mx, avg(y) my, avg(x * x) xx, avg(x * y) xy from smp group by all),
k as (select *, case when xx - mx * mx > 0 then (xy - mx * my) / (xx - mx * mx) else 0 end k from s)"""


@query(
    "comm_linear_fit",
    with_comm(
        """select pid, sub_op, n, round(case when k < 0 then 0 when my - k * mx < 0 then greatest(xy / xx, 0) else k end, 6) as slope,
  round(case when k < 0 then greatest(my, 0) when my - k * mx < 0 then 0 else my - k * mx end, 3) as intercept from k""",
        _LINE,
    ),
)
def comm_linear_fit(spark, d):
    """Transfer time by number of tensors, per device and direction."""
    rows = comm(spark, d).filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'").select(
        "pid",
        F.element_at(F.split("name", "[.]"), 3).alias("sub_op"),
        F.size(names.tensor_ids(F.col("name"))).cast("double").alias("x"),
        F.col("dur_us").cast("double").alias("y"),
    )
    return costs.fit_lines(rows, ["pid", "sub_op"], "x", "y")


@query(
    "interpolate",
    with_comm(
        """
select sub_op, "at", round(y0 + case when x1 > x0 then (y1 - y0) / (x1 - x0) else 0 end * ("at" - x0), 6) as value
from (select distinct sub_op, unnest([0.5, 1.5, 2.5, 7.5])::double as "at" from tb) p join seg using (sub_op)
where (x1 is not null or nr = 1) and ("at" >= x0 or pos = 1) and ("at" < x1 or pos >= nr - 1 or x1 is null)""",
        _LINE
        + """, tb as (select sub_op, x, floor(avg(y)) y from smp group by all),
seg as (select sub_op, x x0, y y0, lead(x) over w x1, lead(y) over w y1, row_number() over w pos, count(*) over (partition by sub_op) nr from tb window w as (partition by sub_op order by x))""",
    ),
)
def interpolate(spark, d):
    rows = comm(spark, d).filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'").select(
        F.element_at(F.split("name", "[.]"), 3).alias("sub_op"), F.size(names.tensor_ids(F.col("name"))).cast("double").alias("x"), "dur_us"
    )
    known = rows.groupBy("sub_op", "x").agg(F.floor(F.avg("dur_us")).cast("double").alias("y"))
    points = known.select("sub_op").distinct().withColumn("at", F.explode(F.array(*[F.lit(v) for v in (0.5, 1.5, 2.5, 7.5)])))
    return costs.interpolate(points, known, ["sub_op"], "x", "y")


@query("grouped_fit")
def grouped_fit(spark, d):
    """Non-negative fit of operation times by the number of inputs and the step, per category."""
    rows = silver(spark, d, "event_seq", "cat_fine", "inputs", "step").filter("step is not null")
    rows = rows.select("cat_fine", F.coalesce(F.size("inputs"), F.lit(0)).cast("double").alias("n_inputs"), F.col("step").cast("double").alias("at"), F.col("dur_us").cast("double").alias("y"))
    return costs.grouped_fit(rows, ["cat_fine"], ["n_inputs", "at"], "y")


def _sizes(spark, d):
    """Tensors of the metadata records with their size in bytes."""
    meta = table(spark, d, "op_metadata")
    tensors, dims = nested.flat_table(meta, "tensors"), nested.flat_table(meta, "dims")
    shapes = dims.groupBy("record_id", "node", "side", "pos").agg(F.array_sort(F.collect_list(F.struct("dim", "size"))).alias("s"))
    rows = tensors.join(shapes, ["record_id", "node", "side", "pos"])
    return rows.withColumn("bytes", names.tensor_bytes(F.transform("s", lambda x: x["size"]), F.col("dtype"))).filter("bytes is not null")


@query(
    "tensor_sizes",
    f"with recursive {NESTED}, {SIZES} select record_id, node, side, pos, name, dtype, bytes::bigint as bytes, ceil(bytes / 4096000)::bigint as parts from szs",
)
def tensor_sizes(spark, d):
    return _sizes(spark, d).select("record_id", "node", "side", "pos", "name", "dtype", "bytes", costs.partitions(F.col("bytes")).alias("parts"))


@query(
    "memory_peak",
    f"""with recursive {NESTED}, {SIZES},
h as (select *, bytes >= 1024 as keep, sum(case when bytes >= 1024 then bytes else 0 end) over (partition by record_id order by node, pos, name rows between unbounded preceding and current row) as held
  from szs where side = 'output')
select record_id, count(*) as ops, max(held + case when keep then 0 else bytes end)::bigint as forward_peak, max(held + bytes)::bigint as peak,
  max(held + bytes) * 64 / 32 as batch_64 from h group by record_id""",
)
def memory_peak(spark, d):
    """Peak of each record's operations in the order of their nodes; outputs of at least 1 kB are kept."""
    rows = _sizes(spark, d).filter("side = 'output'")
    schedule = rows.select("record_id", F.struct("node", "pos", "name").alias("seq"), "bytes", F.expr("bytes >= 1024").alias("keep"))
    peaks = costs.memory_peak(schedule, ["record_id"])
    return peaks.withColumn("batch_64", costs.training_memory(F.col("peak"), F.lit(0), 64))


@query(
    "op_features",
    f"""with recursive {NESTED}, {SIZES},
io as (select record_id, node, sum(case when side = 'input' then bytes else 0 end)::bigint as s_in, sum(case when side = 'output' then bytes else 0 end)::bigint as s_out
  from szs where side <> 'args' group by all),
kinds as (select record_id, node, {text("j -> '$.op'")} as kind from ops)
select record_id, node, kind, s_in, s_out, round(s_out / greatest(s_in + s_out, 1), 6) as intensity, {colour_case("kind")} as amp_colour from io join kinds using (record_id, node)""",
)
def op_features(spark, d):
    """Bytes in and out, elements and intensity of each operation of the metadata records."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("bytes")).otherwise(0))
    rows = _sizes(spark, d).filter("side <> 'args'").groupBy("record_id", "node").agg(side("input").alias("s_in"), side("output").alias("s_out"))
    kind = nested.flat_table(table(spark, d, "op_metadata"), "operations").select("record_id", "node", "kind")
    return rows.join(kind, ["record_id", "node"]).select(
        "record_id", "node", "kind", "s_in", "s_out",
        F.round(F.col("s_out") / F.greatest(F.col("s_in") + F.col("s_out"), F.lit(1)), 6).alias("intensity"),
        names.amp_colour(F.col("kind")).alias("amp_colour"),
    )


@query(
    "amp_colour",
    with_trace(
        f"select op_name, op_type, {colour_case('op_type')} as colour from t",
        "t as (select distinct op_name, regexp_replace(string_split(op_name, '/')[-1], '(_[0-9]+)$', '') as op_type from silver where op_name is not null and cat = 'operator')",
    ),
)
def amp_colour(spark, d):
    rows = silver(spark, d, "op_name", "cat").filter("op_name is not null and cat = 'operator'").select("op_name").distinct()
    kind = names.op_type(F.col("op_name"))
    return rows.select("op_name", kind.alias("op_type"), names.amp_colour(kind).alias("colour"))


@query(
    "checkpoint_topk",
    with_trace(
        """select trial, name, avg_ms, place from (
  select *, row_number() over (partition by trial order by avg_ms desc, name) place, count(*) over (partition by trial) n
  from (select trial, name, round(sum(dur_us) / count(*) / 1000, 9) avg_ms from silver where trial is not null group by all)) where place <= floor(n * 0.1)"""
    ),
)
def checkpoint_topk(spark, d):
    rows = silver(spark, d, "trial").filter("trial is not null")
    means = rows.groupBy("trial", "name").agg(st.ms(F.sum("dur_us") / F.count(F.lit(1))).alias("avg_ms"))
    return costs.checkpoints(means, ["trial"])


_GROUPS = r"""g as (select distinct regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) as tensor from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.]'))"""


def _groups(spark, d):
    return comm(spark, d).filter("name rlike '^Comm[.][0-9+]+[.]'").select(F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1).alias("tensor")).distinct()


@query("regroup_n", with_comm("select tensor, floor((row_number() over (order by tensor) - 1) * 5 / count(*) over ())::int as group_id from g", _GROUPS))
def regroup_n(spark, d):
    return costs.regroup(_groups(spark, d), 5, "tensor")


@query("round_robin_servers", with_comm("select tensor, (row_number() over (order by tensor) - 1) % 4 as server from g", _GROUPS))
def round_robin_servers(spark, d):
    return costs.round_robin(_groups(spark, d), "tensor", 4)


@query(
    "server_load",
    r"""with o as (select distinct on (event_seq) * from server_events where event_seq is not null),
c as (select trial, pid as server, count(*) as ops, count(distinct name) as tensors from o where pid is not null group by all)
select trial, server, ops, tensors, server = arg_min(server, {'o': ops, 's': server}) over (partition by trial) as least from c""",
)
def server_load(spark, d):
    rows = st.distinct_events(table(spark, d, "server_events"), "trial", "pid", "name").filter("pid is not null")
    loads = rows.groupBy("trial", F.col("pid").alias("server")).agg(F.count(F.lit(1)).alias("ops"), F.countDistinct("name").alias("tensors"))
    least = loads.groupBy("trial").agg(F.min_by("server", F.struct("ops", "server")).alias("first"))
    return loads.join(least, "trial").select("trial", "server", "ops", "tensors", (F.col("server") == F.col("first")).alias("least"))


@query("dispersion")
def dispersion(spark, d):
    """Per label, eight vectors far from each other, chosen from all of them."""
    return costs.dispersed_per_key(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 8)


@query(
    "coarse_chain",
    with_trace(
        """
select trial, pid, tensor, src, dst from (
  select trial, pid, tensor, sub_op as src, lead(sub_op) over (partition by trial, pid, tensor order by list_position(ord, sub_op)) as dst from (
    select trial, pid, op_name as tensor, sub_op, avg(dur_us) a, ['Sync', 'QUEUE', 'MEMCPY_IN_FUSION_BUFFER', 'NCCL_ALLREDUCE', 'MEMCPY_OUT_FUSION_BUFFER'] as ord
    from silver where cat = 'Comm' and trial is not null and op_name is not null and sub_op is not null group by all)
  where a > 0 and list_contains(ord, sub_op)) where dst is not null"""
    ),
)
def coarse_chain(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "cat", "op_name", "sub_op").filter("cat = 'Comm' and trial is not null and op_name is not null and sub_op is not null")
    parts = rows.groupBy("trial", "pid", F.col("op_name").alias("tensor"), "sub_op").agg(F.avg("dur_us").alias("avg_us"))
    return graph.coarse_chain(parts, names.RING_FINE)


typed(ORACLES, {"checkpoint_topk": {"place": "integer"}})
