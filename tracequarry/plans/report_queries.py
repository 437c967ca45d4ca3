"""Queries of reports over traces, graphs and metadata, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import costs, graph, kernels, matching, nested, reports
from tracequarry.operators import statistics as st
from tracequarry.plans.graph_queries import _STEP, KEY, _sizes, _steps
from tracequarry.plans.model_queries import _AMP, _KERNELS, _SIZED, _half, _kernels, _sized
from tracequarry.plans.sequence_queries import _EDGES, dfg_edges
from tracequarry.plans.sql import NESTED, SIZES, text, with_comm, with_trace
from tracequarry.plans.statistics_queries import _ITER, comm, silver
from tracequarry.session import stored, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def recursive(sql: str) -> str:
    return "with recursive" + sql[4:]


_CHOSEN = (
    _ITER
    + """,
per as (select *, row_number() over (partition by trial, pid order by step) - 1 k from iters),
fewest as (select trial, min(n) f from (select trial, pid, count(*) n from per group by all) group by trial),
ksteps as (select trial, k, avg(iter_ms) x from per join fewest using (trial) where k < f group by trial, k),
whole as (select trial, case when avg(x) <> 0 and stddev_pop(x) / avg(x) > 0.1 then median(x) else avg(x) end iter from ksteps group by trial),
chosen as (select trial, arg_min(k, {'d': round(abs(x - iter), 6), 'k': k}) as opt_step from whole join ksteps using (trial) group by trial),
hits as (select trial, pid, step from per join chosen using (trial) where k = opt_step)"""
)


def _chosen(spark, d):
    events = silver(spark, d, "event_seq", "cat", "cat_fine", "step", "trial")
    trials = events.filter("step is not null and cat = 'operator'").groupBy("pid", "step").agg(F.min("trial").alias("trial"))
    iters = st.iterations(events).join(trials, ["pid", "step"])
    return reports.at_chosen_step(events, iters, st.overall_iteration(iters))


@query(
    "chosen_step_timeline",
    with_trace(
        """select s.event_seq, s.pid, s.step, s.ts_us - min(s.ts_us) over (partition by s.trial) as ts_us, s.dur_us,
  case when s.cat_fine = 'operator.BW' then 'BW' when s.cat = 'Comm' then 'Comm' else 'N' end as name
from silver s join hits h on h.trial = s.trial and h.pid = s.pid and h.step = s.step""",
        _CHOSEN,
    ),
)
def chosen_step_timeline(spark, d):
    """Each trial's chosen step, its times from its first event on, painted by backward operations and communication."""
    label = F.when(F.col("cat_fine") == "operator.BW", "BW").when(F.col("cat") == "Comm", "Comm").otherwise("N")
    return reports.rebased(_chosen(spark, d), ["trial"]).select("event_seq", "pid", "step", "ts_us", "dur_us", label.alias("name"))


@query(
    "backward_to_comm",
    with_trace(
        """select trial, host, count(*) as steps, round(avg(d), 6) as avg_us from (
  select trial, host, step, min(d) as d from (
    select c.trial, c.host, c.pid, c.step, min(c.ts_us - b.done) as d from silver c join (
      select trial, host, pid, step, max(ts_us + dur_us) done from silver where cat_fine = 'operator.BW' group by all) b
    on b.trial = c.trial and b.host = c.host and b.pid = c.pid and b.step = c.step where c.cat = 'Comm' and c.ts_us >= b.done group by all)
  group by all) group by trial, host"""
    ),
)
def backward_to_comm(spark, d):
    return reports.backward_to_comm(silver(spark, d, "event_seq", "trial", "host", "step", "cat", "cat_fine"))


@query("first_events", with_trace("select pid, name, arg_min(event_seq, {'t': ts_us, 'e': event_seq}) as event_seq, min(ts_us) as ts_us from silver group by pid, name"))
def first_events(spark, d):
    return reports.first_event(silver(spark, d, "event_seq"))


@query(
    "kind_spread",
    with_trace("select cat, count(*) as ops, round(avg(a), 6) as avg_us, round(stddev_pop(a) / avg(a), 6) as spread from (select cat, pid, name, avg(dur_us) a from silver group by all) group by cat"),
)
def kind_spread(spark, d):
    return reports.kind_spread(silver(spark, d, "event_seq", "cat"))


@query(
    "stream_kernels",
    with_trace("select tid, count(distinct name) filter (not contains(name, 'MEMCPY')) as compute, count(distinct name) filter (contains(name, 'MEMCPY')) as memory from silver where tid is not null group by tid"),
)
def stream_kernels(spark, d):
    """Different kernels of computation and of memory copies on each stream."""
    rows = silver(spark, d, "tid").filter("tid is not null").select("tid", "name").distinct()
    copies = F.col("name").contains("MEMCPY")
    return rows.groupBy("tid").agg(F.count(F.when(~copies, 1)).alias("compute"), F.count(F.when(copies, 1)).alias("memory"))


@query("plausible_labels", with_trace("select op_name, round(avg(y), 6) as label from k group by op_name having avg(y) <= 100000", _KERNELS))
def plausible_labels(spark, d):
    """Mean times of operations without those above 100 ms."""
    return _kernels(spark, d).groupBy("op_name").agg(F.round(F.avg("y"), 6).alias("label")).filter("label <= 100000")


@query(
    "start_bias",
    with_trace(
        """select o.pid, count(*) as n, round(avg(k.ts_us - o.ts_us), 6) as bias_us from silver o join silver k on o.pid = k.pid and k.ts_us >= o.ts_us and k.ts_us < o.ts_us + o.dur_us
where o.cat_fine = 'operator.BW' and k.cat = 'Comm' group by o.pid"""
    ),
)
def start_bias(spark, d):
    """How long after the start of the operation around it a communication starts, by device."""
    rows = silver(spark, d, "event_seq", "cat", "cat_fine")
    ops = rows.filter("cat_fine = 'operator.BW'").select(F.col("event_seq").alias("span_id"), "pid", F.col("ts_us").alias("start_us"), F.expr("ts_us + dur_us").alias("end_us"))
    inner = rows.filter("cat = 'Comm'").select(F.col("event_seq").alias("id"), "pid", F.col("ts_us").alias("at_us"))
    pairs = matching.within_spans(inner, ops, ["pid"], 12)
    timed = pairs.join(ops.select("span_id", "pid", "start_us"), "span_id").join(inner.select("id", "at_us"), "id")
    return timed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("at_us") - F.col("start_us")), 6).alias("bias_us"))


@query(
    "edge_gaps",
    with_trace("select trial, regexp_replace(src, '~>.*$', '') as src, regexp_replace(dst, '~>.*$', '') as dst, count(*) as n, round(avg(gap_us), 6) as gap_us from sedges group by all", _STEP),
)
def edge_gaps(spark, d):
    """Mean gap behind each pair of operations that follow each other, over all steps."""
    plain = lambda c: F.regexp_replace(c, "~>.*$", "").alias(c)
    rows = _steps(spark, d)[1].select("trial", plain("src"), plain("dst"), F.col("gap_us").alias("g"))
    return rows.groupBy("trial", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g"), 6).alias("gap_us"))


_UPDATES = """picked as (select trial, step, node from ev where cat_fine = 'operator.UPDATE'),
near as (select trial, step, node from picked union select e.trial, e.step, e.dst from sedges e join picked p on p.trial = e.trial and p.step = e.step and p.node = e.src
  union select e.trial, e.step, e.src from sedges e join picked p on p.trial = e.trial and p.step = e.step and p.node = e.dst)"""


def _updates(nodes):
    return nodes.filter("node like '%->UPDATE_%'").select(*KEY, "node")


@query(
    "induced_edges",
    with_trace(
        """select e.trial, e.step, e.src, e.dst from sedges e join near a on a.trial = e.trial and a.step = e.step and a.node = e.src join near b on b.trial = e.trial and b.step = e.step and b.node = e.dst""",
        _STEP + ", " + _UPDATES,
    ),
)
def induced_edges(spark, d):
    """The part of each step's graph around its updates."""
    nodes, edges = _steps(spark, d)
    return reports.induced(edges.drop("gap_us"), _updates(nodes), KEY)


@query(
    "partial_replay",
    with_trace(
        """select trial, step, count(distinct node) as nodes from (
  select e.trial, e.step, unnest([e.src, e.dst]) as node from sedges e join near a on a.trial = e.trial and a.step = e.step and a.node = e.src join near b on b.trial = e.trial and b.step = e.step and b.node = e.dst)
group by trial, step""",
        _STEP + ", " + _UPDATES,
    ),
)
def partial_replay(spark, d):
    """Size of the part around the updates of each step, as its replay has run it."""
    nodes, edges = _steps(spark, d)
    return reports.partial_times(nodes, edges, _updates(nodes), KEY).filter("time_ms >= 0").select(*KEY, F.col("nodes").cast("bigint").alias("nodes"))


@query(
    "replay_check",
    with_trace(
        """select trial, step, count(*) as nodes, sum(us)::double as busy_us, true as in_order, true as apart from (
  select trial, step, dur_us as us from ev union all select trial, step, 0 from bars) group by trial, step""",
        _STEP,
    ),
)
def replay_check(spark, d):
    """What each step's replay has run: its nodes, their time, whether all edges are kept and no device runs two at once."""
    nodes, edges = _steps(spark, d)
    runs = stored(graph.replays(nodes, edges, KEY))
    end = lambda side, at: runs.select(*KEY, F.col("node").alias(side), F.col(f"{at}_us").alias(f"{side}_at"))
    kept = edges.select(*KEY, "src", "dst").join(end("src", "end"), [*KEY, "src"]).join(end("dst", "start"), [*KEY, "dst"])
    kept = kept.groupBy(*KEY).agg(F.bool_and(F.col("dst_at") >= F.col("src_at") - 0.01).alias("in_order"))
    before = F.lag("end_us").over(Window.partitionBy(*KEY, "device").orderBy("exec_seq"))  # a device's part of one step
    apart = runs.withColumn("ok", F.coalesce(F.col("start_us") >= before - 0.01, F.lit(True))).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("nodes"), F.round(F.sum(F.col("end_us") - F.col("start_us")), 0).alias("busy_us"), F.bool_and("ok").alias("apart")
    )
    return apart.join(kept, KEY, "left").select(*KEY, "nodes", "busy_us", F.coalesce("in_order", F.lit(True)).alias("in_order"), "apart")


@query("replay_compare")
def replay_compare(spark, d):
    """Replays under delays beside the plain one."""
    cases = {"base": kernels.Delays(), "computation x 1.1": kernels.Delays(computation=(0.0, 1.1)), "communication x 1.1": kernels.Delays(communication=(0.0, 1.1))}
    return reports.side_by_side(*_steps(spark, d), KEY, cases, "base")


@query("comm_only_replay")
def comm_only_replay(spark, d):
    """Time of each step less that of its backward operations on the busiest device."""
    nodes, edges = _steps(spark, d)
    whole = graph.scenarios(nodes, edges, KEY, {"base": kernels.Delays()}).select(*KEY, "time_ms")
    back = nodes.filter("node like '%->BW.%'").groupBy(*KEY, "pid").agg(F.sum("avg_ms").alias("b")).groupBy(*KEY).agg(F.max("b").alias("backward_ms"))
    rows = whole.join(back, KEY, "left").withColumn("backward_ms", F.round(F.coalesce("backward_ms", F.lit(0.0)), 6))
    return rows.withColumn("rest_ms", F.round(F.col("time_ms") - F.col("backward_ms"), 6))


@query(
    "forward_schedule",
    with_trace("select trial, step, count(*) as n, 0 as least, count(*) - 1 as most from ev where contains(name, 'FW') group by trial, step", _STEP),
)
def forward_schedule(spark, d):
    """Forward operations of each step in a topological order; number, first and last place."""
    rows = reports.schedule(*_steps(spark, d), KEY, "->FW")
    return rows.groupBy(*KEY).agg(F.countDistinct("node").alias("n"), F.min("place").alias("least"), F.max("place").cast("bigint").alias("most"))


@query(
    "graph_total",
    with_trace("select trial, count(*) as ops, round(sum(a), 3) as total_us from (select trial, op_name, avg(dur_us) a from silver s where op_name in (select src from edges e where e.trial = s.trial union select dst from edges e where e.trial = s.trial) group by all) group by trial", _EDGES),
)
def graph_total(spark, d):
    """Sum of the mean times of the operations of each data flow graph."""
    edges = dfg_edges(spark, d)
    ends = edges.select("trial", F.col("src").alias("op_name")).union(edges.select("trial", "dst")).distinct()
    means = silver(spark, d, "event_seq", "trial", "op_name").groupBy("trial", "op_name").agg(F.avg("dur_us").alias("a"))
    return means.join(ends, ["trial", "op_name"], "left_semi").groupBy("trial").agg(F.count(F.lit(1)).alias("ops"), F.round(F.sum("a"), 3).alias("total_us"))


@query(
    "amp_difference",
    recursive(
        with_trace(
            "select coalesce(a.trial, b.trial) as trial, coalesce(a.op, b.op) as op, case when a.op is null then 'right' when b.op is null then 'left' else 'both' end as found from half a full join white b on a.trial = b.trial and a.op = b.op",
            _EDGES + ", " + _AMP + f", white as (select trial, op from kinds where k in ({', '.join(repr(x) for x in names.AMP_WHITE + names.AMP_GREY)}))",
        )
    ),
)
def amp_difference(spark, d):
    """Operations in half precision by propagation against those by their type alone (white or grey)."""
    edges, half = _half(spark, d)
    ops = edges.select("trial", F.col("src").alias("op")).union(edges.select("trial", "dst")).distinct()
    by_type = ops.filter(names.amp_colour(names.op_type(F.col("op"))).isin("white", "grey"))
    return reports.compared_sets(half, by_type, ["trial", "op"])


_FEEDS = """feeds as (select distinct trial, op_name as tensor, string_split(i, ':')[1] as op from (select trial, op_name, unnest(inputs) i from silver where cat = 'Comm' and trial is not null and op_name is not null)),
ctime as (select trial, op_name as tensor, sum(a) as us from (select trial, op_name, sub_op, avg(dur_us) a from silver where cat = 'Comm' and trial is not null and op_name is not null group by all) group by all)"""


def _feeds(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "cat", "op_name", "sub_op", "inputs").filter("cat = 'Comm' and trial is not null and op_name is not null")
    feeds = rows.select("trial", F.col("op_name").alias("tensor"), F.explode("inputs").alias("i")).select("trial", "tensor", F.substring_index("i", ":", 1).alias("op")).distinct()
    means = rows.groupBy("trial", F.col("op_name").alias("tensor"), "sub_op").agg(F.avg("dur_us").alias("a"))
    return feeds, means.groupBy("trial", "tensor").agg(F.sum("a").alias("us"))


@query(
    "bandwidth",
    "with recursive"
    + with_trace(
        """select trial, op_name, bytes as size_bytes, round(bytes * 8 / (b - a), 9) as bits_per_us from (
  select trial, op_name, min(ts_us) a, max(ts_us + dur_us) b from silver where cat = 'Comm' and op_name is not null group by all) join z on z.tensor = op_name where b > a""",
        "g as (select distinct op_name as tensor from silver where cat = 'Comm' and regexp_matches(op_name, '^[0-9+]+$')), " + _SIZED,
    )[4:],
)
def bandwidth(spark, d):
    """Bits per microsecond of each tensor group, over the time from its first start to its last end."""
    events = silver(spark, d, "event_seq", "trial", "cat", "op_name").filter("cat = 'Comm' and op_name is not null")
    groups = events.filter("op_name rlike '^[0-9+]+$'").select(F.col("op_name").alias("tensor")).distinct()
    return st.bandwidth(events, _sized(spark, d, groups).select(F.col("tensor").alias("op_name"), F.col("bytes").alias("size_bytes")))


@query(
    "server_relabel",
    r"""with o as (select distinct pid, regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) as tensor, string_split(name, '.')[3] as op from server_events
  where event_seq is not null and pid is not null and name is not null),
m as (select tensor, (row_number() over (order by tensor) - 1) % 4 as k from (select distinct tensor from o))
select pid || '->' || tensor || '.' || op as node, 'server' || k || '->' || tensor || '.' || op as relabelled from o join m using (tensor)""",
)
def server_relabel(spark, d):
    """Server operations moved to the server that a map of partitions gives their tensor."""
    rows = st.distinct_events(table(spark, d, "server_events"), "pid", "name").filter("pid is not null and name is not null")
    rows = rows.select("pid", F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1).alias("tensor"), F.element_at(F.split("name", "[.]"), 3).alias("op")).distinct()
    placed = costs.round_robin(rows.select("tensor").distinct(), "tensor", 4).select("tensor", F.concat(F.lit("server"), "server").alias("to"))
    node = F.concat("pid", F.lit("->"), "tensor", F.lit("."), "op")
    return reports.relabelled(rows.withColumn("node", node), placed, "tensor").select("node", "relabelled")


@query("comm_behind", with_trace("select trial, op, count(*) as tensors, round(sum(us), 3) as comm_us from feeds join ctime using (trial, tensor) group by trial, op", _FEEDS))
def comm_behind(spark, d):
    """Coarse time of the communications that an operation feeds."""
    feeds, times = _feeds(spark, d)
    return feeds.join(times, ["trial", "tensor"]).groupBy("trial", "op").agg(F.count(F.lit(1)).alias("tensors"), F.round(F.sum("us"), 3).alias("comm_us"))


@query(
    "groups_of_clusters",
    with_trace("select trial, regexp_replace(string_split(op, '/')[-1], '(_[0-9]+)$', '') as cluster, array_to_string(list_sort(list_distinct(list(tensor))), ' ') as tensors from feeds group by all", _FEEDS),
)
def groups_of_clusters(spark, d):
    """The tensors that each cluster of operations (by type) feeds, as groups to fuse."""
    feeds, _ = _feeds(spark, d)
    return feeds.groupBy("trial", names.op_type(F.col("op")).alias("cluster")).agg(F.array_join(F.array_sort(F.collect_set("tensor")), " ").alias("tensors"))


_LOCAL = """loc as (select distinct trial, pid, name as dst, split_part(name, '.', 1) as phase, string_split(i, ':')[1] as op from (
  select trial, pid, name, unnest(inputs) i from silver where trial is not null and cat = 'operator' and op_name is not null)),
com as (select distinct trial, pid, 'Comm.' || op_name as c from silver where cat = 'Comm' and trial is not null and op_name is not null),
upd as (select distinct trial, pid, name from silver where cat_fine = 'operator.UPDATE' and trial is not null)"""


@query(
    "global_edges",
    with_trace(
        """
select distinct trial, src, dst from (
  select trial, pid || '->' || case when phase = 'UPDATE_' then 'BW' else phase end || '.' || op as src, pid || '->' || dst as dst from loc
  union all select trial, pid || '->BW.' || string_split(i, ':')[1], pid || '->Comm.' || op_name || '.Sync' from (select trial, pid, op_name, unnest(inputs) i from silver where cat = 'Comm' and trial is not null and op_name is not null)
  union all select trial, pid || '->' || c || '.Sync', 'all->' || c || '.Sync' from com
  union all select trial, 'all->' || c || '.Sync', pid || '->' || c || '.QUEUE' from com
  union all select trial, pid || '->' || c || '.QUEUE', pid || '->' || c || '.MEMCPY_IN_FUSION_BUFFER' from com
  union all select trial, pid || '->' || c || '.MEMCPY_IN_FUSION_BUFFER', pid || '->' || c || '.NCCL_ALLREDUCE' from com
  union all select trial, pid || '->' || c || '.NCCL_ALLREDUCE', pid || '->' || c || '.MEMCPY_OUT_FUSION_BUFFER' from com
  union all select trial, com.pid || '->' || c || '.MEMCPY_OUT_FUSION_BUFFER', upd.pid || '->' || upd.name from com join upd using (trial, pid)
  union all select trial, pid || '->' || name, 'END' from upd) where src <> dst""",
        _LOCAL,
    ),
)
def global_edges(spark, d):
    """The data flow of all devices as one graph: local operations, synchronisations of all devices, updates and the end."""
    rows = silver(spark, d, "event_seq", "trial", "cat", "cat_fine", "op_name", "inputs").filter("trial is not null")
    ops = rows.filter("cat = 'operator' and op_name is not null").select("trial", "pid", "name", F.explode("inputs").alias("i"))
    comms = rows.filter("cat = 'Comm' and op_name is not null")
    updates = rows.filter("cat_fine = 'operator.UPDATE'").select("trial", "pid", "name").distinct()
    return graph.global_edges(ops, comms.select("trial", "pid", "op_name", "inputs"), updates)


@query(
    "in_place",
    f"""with recursive {NESTED}, {SIZES}, kinds as (select record_id, node, {text("j -> '$.op'")} as kind from ops)
select distinct o.record_id, o.node, o.pos, o.bytes::bigint as bytes from szs o join kinds k using (record_id, node)
where o.side = 'output' and k.kind in ({', '.join(repr(x) for x in reports.ELEMENTWISE)})
  and exists (select 1 from szs i where i.side = 'input' and i.record_id = o.record_id and i.node = o.node and i.dtype = o.dtype and i.bytes = o.bytes)""",
)
def in_place(spark, d):
    """Outputs that may take the memory of an input of their operation."""
    kinds = nested.flat_table(table(spark, d, "op_metadata"), "operations").select("record_id", "node", "kind")
    return reports.in_place(_sizes(spark, d), kinds).distinct()


@query(
    "usable_outputs",
    f"""with recursive {NESTED}, {SIZES}, kinds as (select record_id, node, {text("j -> '$.op'")} as kind from ops)
select record_id, node, pos, name, bytes::bigint as bytes from szs o where side = 'output'
  and exists (select 1 from kinds k where k.record_id = o.record_id and k.node = o.node and k.kind <> 'NoOp')
  and not exists (select 1 from dims x where x.record_id = o.record_id and x.node = o.node and x.side = o.side and x.pos = o.pos and x.dim = 0 and x.size = -1)""",
)
def usable_outputs(spark, d):
    """Outputs that count in an estimate of memory."""
    meta = table(spark, d, "op_metadata")
    kinds = nested.flat_table(meta, "operations").select("record_id", "node", "kind")
    leading = nested.flat_table(meta, "dims").filter("dim = 0")
    return reports.usable(_sizes(spark, d), kinds, leading).select("record_id", "node", "pos", "name", "bytes")


@query(
    "memory_budget",
    f"""with recursive {NESTED}, {SIZES},
h as (select *, sum(case when bytes >= 1024 then bytes else 0 end) over (partition by record_id order by node, pos, name rows between unbounded preceding and current row) as held from szs where side = 'output')
select record_id, peak, case when peak <= 4000000 then 'fits' when peak / 2 <= 4000000 then 'accumulate' else 'recompute' end as asks
from (select record_id, max(held + bytes)::bigint as peak from h group by record_id)""",
)
def memory_budget(spark, d):
    """What a budget of 4 MB asks of each record's step."""
    rows = _sizes(spark, d).filter("side = 'output'")
    order = rows.select("record_id", F.struct("node", "pos", "name").alias("seq"), "bytes", F.expr("bytes >= 1024").alias("keep"))
    peaks = costs.memory_peak(order, ["record_id"]).select("record_id", "peak")
    return reports.within_budget(peaks, F.col("peak"), 4_000_000)


@query(
    "sample_split",
    with_trace("select op_name, round(avg(y), 6) as label, case when ('0x' || substr(md5(op_name), 1, 6))::bigint % 10 < 9 then 'train' else 'test' end as part from k group by op_name", _KERNELS),
)
def sample_split(spark, d):
    rows = _kernels(spark, d).groupBy("op_name").agg(F.round(F.avg("y"), 6).alias("label"))
    return reports.split_samples(rows, F.col("op_name"))


_TESTED = r"""smp as (select string_split(name, '.')[3] as sub_op, event_seq, len(string_split(regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1), '+'))::double x, dur_us::double y,
  case when ('0x' || substr(md5(event_seq::varchar), 1, 6))::bigint % 10 < 9 then 'train' else 'test' end as part
  from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.](SEND|RECV)$')),
s as (select sub_op, count(*) n_train, avg(x) mx, avg(y) my, avg(x * x) xx, avg(x * y) xy from smp where part = 'train' group by all),
k as (select *, case when xx - mx * mx > 0 then (xy - mx * my) / (xx - mx * mx) else 0 end k from s),
f as (select sub_op, n_train, round(case when k < 0 then 0 when my - k * mx < 0 then greatest(xy / xx, 0) else k end, 6) as slope,
  round(case when k < 0 then greatest(my, 0) when my - k * mx < 0 then 0 else my - k * mx end, 3) as intercept from k),
t as (select sub_op, count(*) n_test, round(avg(abs(slope * x + intercept - y) / y), 6) mape from smp join f using (sub_op) where part = 'test' and y > 0 group by all)"""


@query("tested_fit", with_comm("select sub_op, n_train, slope, intercept, coalesce(n_test, 0) as n_test, mape, coalesce(mape < 0.6, false) as kept from f left join t using (sub_op)", _TESTED))
def tested_fit(spark, d):
    """Transfer time by the number of tensors, fitted on nine tenths of the events and tested on the rest."""
    rows = comm(spark, d, "event_seq").filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'").select(
        F.element_at(F.split("name", "[.]"), 3).alias("sub_op"), "event_seq",
        F.size(names.tensor_ids(F.col("name"))).cast("double").alias("x"), F.col("dur_us").cast("double").alias("y"),
    )
    return reports.tested_line(reports.split_samples(rows, F.col("event_seq").cast("string")), ["sub_op"], "x", "y")


@query("curve_fit")
def curve_fit(spark, d):
    """The best of several curves of an operation's time over the step, per category."""
    rows = silver(spark, d, "event_seq", "cat_fine", "step").filter("step is not null and dur_us > 0")
    return costs.fit_curves(rows.select("cat_fine", F.col("step").cast("double").alias("x"), F.col("dur_us").cast("double").alias("y")), ["cat_fine"], "x", "y")
