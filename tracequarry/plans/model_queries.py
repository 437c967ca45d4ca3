"""Queries of derived views and what-if models, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import costs, graph, models, nested
from tracequarry.operators import statistics as st
from tracequarry.operators.chunks import global_number
from tracequarry.plans.graph_queries import _GROUPS, _RANKS, _TENSORS, KEY, _groups, _ring, _sizes, _steps
from tracequarry.plans.sequence_queries import _EDGES, dfg_edges
from tracequarry.plans.sql import COMM, NESTED, SIZES, quoted, text, typed, with_comm, with_trace
from tracequarry.plans.statistics_queries import _ITER, comm, silver
from tracequarry.session import table
from tracequarry.sources.sinks import painted

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "phase_islands",
    with_trace(
        """
select pid, island, phase, min(ts_us) as start_us, max(ts_us + dur_us) as end_us, count(*) as ops from (
  select *, sum(b) over (partition by pid order by ts_us, event_seq) as island from (
    select *, case when lag(phase) over (partition by pid order by ts_us, event_seq) = phase then 0 else 1 end b from (
      select *, case cat_fine when 'operator.FW' then 'FW' when 'operator.BW' then 'BW' end as phase from silver) where phase is not null))
group by pid, island, phase"""
    ),
)
def phase_islands(spark, d):
    return models.phases(silver(spark, d, "event_seq", "cat_fine"))


@query(
    "comm_wait",
    with_trace(
        """
select event_seq, pid, name, greatest(ts_us - e, 0) as wait_us from (
  select *, last_value(case when cat_fine = 'operator.BW' then ts_us + dur_us end ignore nulls) over (partition by pid order by ts_us, event_seq rows between unbounded preceding and current row) e
  from silver) where cat = 'Comm' and e is not null"""
    ),
)
def comm_wait(spark, d):
    return models.after_last_backward(silver(spark, d, "event_seq", "cat", "cat_fine"))


@query(
    "marker_iterations",
    with_trace(
        """
select pid, iteration, min(ts_us) as start_us, max(ts_us + dur_us) as end_us, count(*) as n from (
  select *, sum(case when cat_fine = 'operator.UPDATE' then 1 else 0 end) over (partition by pid order by ts_us, event_seq) as iteration from silver) group by pid, iteration"""
    ),
)
def marker_iterations(spark, d):
    return models.between_marks(silver(spark, d, "event_seq", "cat_fine"), F.col("cat_fine") == "operator.UPDATE")


@query(
    "node_heat",
    with_trace(
        """
select pid, step, gain, round(list_sum(list_transform(l, lambda x: (exp(x.h) - 1) / (step + 1 - x.t))) / len(l), 9) as heat from (
  select *, list({'t': step, 'h': gain}) over (partition by pid order by step rows between 4 preceding and current row) l from (
    select pid, step, round(greatest(-5, least(5, (before - iter_ms) / before)), 6) + 0.0 as gain from (
      select pid, step, iter_ms, lag(iter_ms) over (partition by pid order by step) as before from iters) where before > 0))""",
        _ITER,
    ),
)
def node_heat(spark, d):
    """Heat of each device from its gain in each step: how much shorter the iteration was than the one before."""
    iters = st.iterations(silver(spark, d, "event_seq", "cat", "cat_fine", "step"))
    before = F.lag("iter_ms").over(Window.partitionBy("pid").orderBy("step"))  # a row per step of a device
    rows = iters.withColumn("before", before).filter("before > 0")
    gain = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("before") - F.col("iter_ms")) / F.col("before")))
    return models.heat(rows.select("pid", "step", (F.round(gain, 6) + 0.0).alias("gain")), ["pid"], "step", "gain")


@query(
    "symmetric_ops",
    with_trace(
        """
select trial, name, count(*) as devices, round(min(a), 6) as least_us, round(max(a), 6) as most_us, round(max(a) / greatest(min(a), 1), 6) as spread
from (select trial, pid, name, avg(dur_us) a from silver group by all) group by trial, name having count(*) > 1"""
    ),
)
def symmetric_ops(spark, d):
    return models.symmetric(silver(spark, d, "event_seq", "trial"))


_KERNELS = "k as (select op_name, regexp_replace(string_split(op_name, '/')[-1], '(_[0-9]+)$', '') as kind, dur_us::double y from silver where op_name is not null and cat = 'operator')"


def _kernels(spark, d):
    rows = silver(spark, d, "event_seq", "op_name", "cat").filter("op_name is not null and cat = 'operator'")
    return rows.select("op_name", names.op_type(F.col("op_name")).alias("kind"), F.col("dur_us").cast("double").alias("y"))


@query(
    "kernel_dedupe",
    with_trace("select op_name, count(*) as n, round(avg(y), 6) as label, round(stddev_pop(y) / greatest(avg(y), 1e-9) * 100, 3) as deviation from k group by op_name", _KERNELS),
)
def kernel_dedupe(spark, d):
    return models.deduped_kernels(_kernels(spark, d), "op_name", "y")


@query(
    "elementary_fallback",
    "with recursive"
    + with_trace(
        """
select op_name, kind, coalesce(e, f, 0) as estimate, case when e is not null then 'exact' when f is not null then 'kind' else 'none' end as source
from (select op_name, kind from k union select n, regexp_replace(string_split(n, '/')[-1], '(_[0-9]+)$', '') from named where n is not null)
left join (select op_name, round(avg(y), 6) e from k group by op_name) using (op_name)
left join (select kind, round(avg(y), 6) f from k group by kind) using (kind)""",
        _KERNELS + f", {NESTED}, named as (select coalesce(nullif({text("j -> '$.name'")}, ''), key) as n from ops)",
    )[4:],
)
def elementary_fallback(spark, d):
    """Times of all operations: measured ones by their own mean, those that op_metadata alone names by their kind's."""
    rows = _kernels(spark, d)
    exact, kind = (rows.groupBy(c).agg(F.round(F.avg("y"), 6).alias("label")) for c in ("op_name", "kind"))
    captured = nested.flat_table(table(spark, d, "op_metadata"), "operations").select(F.col("name").alias("op_name")).filter("op_name is not null")
    ops = rows.select("op_name", "kind").union(captured.withColumn("kind", names.op_type(F.col("op_name")))).distinct()
    return models.with_fallback(ops, exact, kind, "op_name", "kind").select("op_name", "kind", "estimate", "source")


@query(
    "replicated_sums",
    with_comm(
        """
select event_seq, pid, op, unnest(case when op = 'SUM' then range(w - 1) else range(1) end)::int as copy
from (select event_seq, o.pid, op, coalesce(n, 2) as w from o left join (select distinct trial, n from ranks) using (trial))""",
        _RANKS
        + """, o as (select distinct event_seq, trial, pid, name, string_split(name, '.')[3] as op from server_events
  where event_seq is not null and pid is not null and name is not null)""",
    ),
)
def replicated_sums(spark, d):
    """Server operations for the devices of their trial; a sum of a trial without known devices stays as it is."""
    rows = st.distinct_events(table(spark, d, "server_events"), "trial", "pid", "name").filter("pid is not null and name is not null")
    rows = rows.select("event_seq", "trial", "pid", F.element_at(F.split("name", "[.]"), 3).alias("op"))
    workers = _ring(spark, d)[1].groupBy("trial").agg(F.count(F.lit(1)).cast("int").alias("workers"))
    rows = rows.join(workers, "trial", "left")
    return models.replicated_sums(rows, F.coalesce("workers", F.lit(2))).select("event_seq", "pid", "op", "copy")


@query(
    "max_normalised",
    with_trace(
        """
select name, case when mx <> 0 then cnt / mx else 0.0 end as cnt, case when my <> 0 then avg_us / my else 0.0 end as avg_us
from (select name, cnt, avg_us, max(cnt) over () mx, max(avg_us) over () my from (select name, count(*)::double cnt, round(avg(dur_us), 6) avg_us from silver group by name))"""
    ),
)
def max_normalised(spark, d):
    rows = silver(spark, d).groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("cnt"), F.round(F.avg("dur_us"), 6).alias("avg_us"))
    return models.max_normalised(rows, ["cnt", "avg_us"])


_AMP = f"""kinds as (select distinct trial, op, regexp_replace(string_split(op, '/')[-1], '(_[0-9]+)$', '') k from (select trial, src op from edges union select trial, dst from edges)),
half as (select trial, op from kinds where k in ({quoted(names.AMP_WHITE)})
  union select h.trial, e.dst from half h join edges e on e.trial = h.trial and e.src = h.op
  join kinds x on x.trial = e.trial and x.op = e.dst where x.k in ({quoted(names.AMP_GREY + names.AMP_CLEAR)}))"""


def _half(spark, d):
    edges = dfg_edges(spark, d)
    ops = edges.select("trial", F.col("src").alias("op")).union(edges.select("trial", "dst")).distinct()
    return edges, models.amp_nodes(edges, ops.withColumn("op_type", names.op_type(F.col("op"))))


@query("amp_nodes", "with recursive" + with_trace("select * from half", _EDGES + ", " + _AMP)[4:])
def amp_nodes(spark, d):
    return _half(spark, d)[1]


@query(
    "amp_casts",
    "with recursive"
    + with_trace(
        """
select e.trial, e.src, e.dst, case when a.op is null then 'to half' else 'to full' end as cast from edges e
left join half a on a.trial = e.trial and a.op = e.src left join half b on b.trial = e.trial and b.op = e.dst where (a.op is null) <> (b.op is null)""",
        _EDGES + ", " + _AMP,
    )[4:],
)
def amp_casts(spark, d):
    return models.casts(*_half(spark, d))


@query(
    "half_precision",
    with_trace(
        f"""select name, kind, round(a, 6) as avg_ms, round(case when kind in ({quoted(names.AMP_WHITE)}) then a * 7.4 / 29.7 else a / 2 end, 6) as half_ms
from (select name, regexp_replace(string_split(name, '/')[-1], '(_[0-9]+)$', '') as kind, avg(dur_us) / 1000 as a from silver where cat = 'operator' group by name)"""
    ),
)
def half_precision(spark, d):
    """Operations in half precision: matrix operations by the throughput of a V100, others in half the time."""
    rows = silver(spark, d, "cat").filter("cat = 'operator'").groupBy("name").agg((F.avg("dur_us") / 1000).alias("a"))
    rows = rows.withColumn("kind", names.op_type(F.col("name")))
    full, half = (F.when(F.col("kind").isin(names.AMP_WHITE), F.lit(1 / x)) for x in models.GPU_TFLOPS["v100"])
    return rows.select("name", "kind", F.round("a", 6).alias("avg_ms"), F.round(models.half_precision_ms(F.col("a"), full, half), 6).alias("half_ms"))


_SIZED = f"""{NESTED}, {SIZES},
grads as (select row_number() over (order by name) - 1 as id, bytes from (select name, max(bytes)::bigint as bytes from szs where side = 'output' and name <> '' group by name)),
z as (select tensor, sum(bytes)::bigint as bytes from (select tensor, unnest(string_split(tensor, '+'))::bigint as id from g) join grads using (id) group by tensor)"""


def _sized(spark, d, groups=None):
    """Tensor groups (those of comm_events unless given) with their size: an id is the place of a tensor among the named outputs of the metadata, by name.

    Ids beyond the list add nothing; groups without any known tensor are left out.
    """
    outputs = _sizes(spark, d).filter("side = 'output' and name <> ''").groupBy("name").agg(F.max("bytes").alias("bytes"))
    sizes = global_number(outputs, "name", "id").select("id", "bytes")
    groups = _groups(spark, d) if groups is None else groups
    ids = groups.select("tensor", F.explode(F.split("tensor", "[+]")).alias("id")).withColumn("id", F.col("id").cast("bigint"))
    return ids.join(sizes, "id").groupBy("tensor").agg(F.sum("bytes").alias("bytes"))


def sized(body: str, more: str = _GROUPS) -> str:
    return "with recursive" + with_comm(body, more + ", " + _SIZED)[4:]


@query("tensor_group_sizes", sized("select tensor, bytes, ceil(bytes / 4096000)::bigint as parts from z"))
def tensor_group_sizes(spark, d):
    return _sized(spark, d).withColumn("parts", costs.partitions(F.col("bytes")))


@query(
    "fuse_neighbours",
    sized("select tensor, bytes, floor((sum(bytes) over (order by tensor rows between unbounded preceding and current row) - bytes) / 4096000)::int as group_id from z"),
)
def fuse_neighbours(spark, d):
    return models.fuse_neighbours(_sized(spark, d), "tensor", "bytes", costs.PARTITION_BYTES)


@query(
    "split_groups",
    with_comm(
        """
select tensor, half, array_to_string(case when half = 0 then ids[1:c] else ids[c + 1:] end, '+') as members
from (select tensor, list_sort(list_transform(string_split(tensor, '+'), lambda x: x::bigint)) ids, ceil(len(string_split(tensor, '+')) / 2)::int c from g where contains(tensor, '+')), unnest([0, 1]) u(half)""",
        _GROUPS,
    ),
)
def split_groups(spark, d):
    return models.split_groups(_groups(spark, d))


@query(
    "tensor_to_group",
    with_comm("select t as tensor, list_min(list(g)) as first_group, count(*) as groups from (select tensor g, unnest(string_split(tensor, '+')) t from g) group by t", _GROUPS),
)
def tensor_to_group(spark, d):
    rows = _groups(spark, d).select(F.col("tensor").alias("g"), F.explode(F.split("tensor", "[+]")).alias("tensor"))
    return rows.groupBy("tensor").agg(F.min("g").alias("first_group"), F.count(F.lit(1)).alias("groups"))


@query(
    "best_partitions",
    sized("select tensor, bytes, greatest(1, round(sqrt(bytes * 0.002 / 300.0)))::bigint as k from z"),
)
def best_partitions(spark, d):
    return _sized(spark, d).withColumn("k", costs.best_parts(F.col("bytes"), F.lit(0.002), F.lit(300.0)))


@query(
    "piecewise_time",
    sized(
        """select tensor, bytes, round(1.8 * pow(10.0, case when x <= 4.70781790174102 then -1.7521176854008658
    when x > 626.2991919900213 then x - 626.2991919900213 + 619.9289905166377 else 1.0343874361266248 * (x - 4.70781790174102) - 1.7521176854008658 end), 6) as push_ms,
  round(1.8 * pow(10.0, case when x <= 4.7581024691199625 then -1.6513319055201428
    when x > 626.2641292852817 then x - 626.2641292852817 + 619.9640547461936 else 1.063909142047732 * (x - 4.7581024691199625) - 1.6513319055201428 end), 6) as pull_ms
from (select *, log10(bytes) as x from z where bytes > 0)"""
    ),
)
def piecewise_time(spark, d):
    """Time of pushing and pulling each tensor group, by the fixed curve of parameter servers."""
    rows = _sized(spark, d).filter("bytes > 0")
    return rows.select("tensor", "bytes", *[F.round(costs.server_time(F.col("bytes"), way), 6).alias(f"{way}_ms") for way in ("push", "pull")])


@query(
    "projected_trace",
    "with recursive"
    + with_trace(
        """
select name, round(avg(dur_us) / 1000, 6) as avg_ms from silver where cat <> 'Comm' group by name
union all select 'Comm.' || tensor, round(bytes / (100.0 * 0.85 * 1e6), 9) from z""",
        COMM.strip() + ", " + _GROUPS + ", " + _SIZED,
    )[4:],
)
def projected_trace(spark, d):
    return models.projected(silver(spark, d, "cat"), _sized(spark, d))


@query("painted_timeline", with_trace("select event_seq, pid, ts_us, dur_us, case when cat_fine = 'operator.BW' then 'BW' when cat = 'Comm' then 'Comm' else 'N' end as name from silver"))
def painted_timeline(spark, d):
    rows = silver(spark, d, "event_seq", "cat", "cat_fine")
    label = F.when(F.col("cat_fine") == "operator.BW", "BW").when(F.col("cat") == "Comm", "Comm").otherwise("N")
    return painted(rows, label).select("event_seq", "pid", "ts_us", "dur_us", "name")


@query("accumulated_replay")
def accumulated_replay(spark, d):
    """Time of each step's graph with the batch worked on in two parts."""
    from tracequarry.operators import kernels

    nodes, edges = _steps(spark, d)
    return graph.scenarios(*models.accumulated(nodes, edges, KEY), KEY, {"accumulated": kernels.Delays()})


@query(
    "kernel_features",
    with_trace(
        """
select op_name, md5(kind || ',' || len(kind) || ':' || len(op_name)) as op_hash, dense_rank() over (order by kind) - 1 as code, list_slice(list_concat([n::double, a], [0.0, 0.0, 0.0, 0.0]), 1, 4) as features
from (select op_name, kind, count(*) n, floor(avg(y)) a from k group by all)""",
        _KERNELS,
    ),
)
def kernel_features(spark, d):
    """Feature vectors of operations: hash, dense code of the type, padded features."""
    rows = _kernels(spark, d).groupBy("op_name", "kind").agg(F.count(F.lit(1)).cast("double").alias("n"), F.floor(F.avg("y")).cast("double").alias("a"))
    from tracequarry.operators.chunks import global_number

    codes = global_number(rows.select("kind").distinct(), "kind", "code")
    return rows.join(codes, "kind").select(
        "op_name", models.op_hash(F.col("kind"), F.array(F.length("kind"), F.length("op_name"))).alias("op_hash"), "code", models.padded(F.array("n", "a"), 4).alias("features")
    )


@query(
    "ring_chunks",
    with_comm("select trial, pid, rank::int as rank, s::int as step, ((rank - s + n) % n)::int as chunk from ranks, unnest(range(n)) x(s)", _RANKS),
)
def ring_chunks(spark, d):
    """The chunk that each device of a trial sends in each step of a round of its ring."""
    ranks = _ring(spark, d)[1]
    rows = ranks.join(ranks.groupBy("trial").agg(F.count(F.lit(1)).cast("int").alias("n")), "trial")
    rows = rows.withColumn("step", F.explode(F.expr("sequence(0, n - 1)")))
    return rows.select("trial", "pid", "rank", "step", models.chunk_of_step(F.col("rank"), F.col("step"), F.col("n")).alias("chunk"))


@query("recompute_replay")
def recompute_replay(spark, d):
    return graph.recomputed(*_steps(spark, d), KEY)


@query("tensor_fusion_search")
def tensor_fusion_search(spark, d):
    return graph.tensor_fusions(*_steps(spark, d), KEY)


@query("op_layers")
def op_layers(spark, d):
    return graph.layers(*_steps(spark, d), KEY)


@query(
    "larger_cluster",
    with_comm(
        """
select p.trial, 'Comm.' || p.tensor as tensor, p.l::int as loop, p.c::int as channel, p.z::int as slice, 'r' || a.i as pid, 'r' || ((a.i + 1) % 6) as next_pid,
  k::int as step, ((a.i - k + 12) % 6)::int as chunk, round(scale * coalesce(f.send, q.send), 6) as send_us, round(scale * coalesce(f.recv, q.recv), 6) as recv_us
from (select t.*, (n - 1) / 5.0 as scale, l, c, z from tensors t join (select distinct trial, n from ranks) using (trial),
    unnest(range(loops)) x(l), unnest(range(channels)) y(c), unnest(range(slices)) w(z)) p
left join fine f on f.trial = p.trial and f.tensor = p.tensor and f.l = p.l and f.c = p.c and f.z = p.z
left join allof q on q.trial = p.trial and q.tensor = p.tensor, unnest(range(6)) a(i), unnest(range(10)) b(k)""",
        _TENSORS
        + r""", sr as (select trial, regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) tensor, string_split(name, '.')[3] op, args.loop_id l, args.channel_id c, args.slice_id z, dur_us
  from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.](SEND|RECV)$') and trial is not null),
fine as (select trial, tensor, l, c, z, avg(dur_us) filter (op = 'SEND') send, avg(dur_us) filter (op = 'RECV') recv from sr group by all),
allof as (select trial, tensor, avg(dur_us) filter (op = 'SEND') send, avg(dur_us) filter (op = 'RECV') recv from sr group by all)""",
    ),
)
def larger_cluster(spark, d):
    """All tensors on a ring of six devices, projected from each trial's profile."""
    tensors, ranks = _ring(spark, d)
    rows = comm(spark, d, "event_seq", "trial", "args").filter("trial is not null and name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'")
    at = F.split("name", "[.]")
    ids = [F.col(f"args.{x}_id").alias(x) for x in ("loop", "channel", "slice")]
    events = rows.select("trial", F.element_at(at, 2).alias("tensor"), F.element_at(at, 3).alias("op"), "dur_us", *ids)
    return models.larger_ring(events, tensors, ranks.groupBy("trial").agg(F.count(F.lit(1)).alias("devices")), 6)


@query(
    "device_pairs",
    with_trace("select a.trial, a.pid as a, b.pid as b from (select distinct trial, pid from silver) a join (select distinct trial, pid from silver) b on a.trial = b.trial and a.pid < b.pid where a.trial is not null"),
)
def device_pairs(spark, d):
    """All pairs of devices of a trial (one row per pair of devices, not of events)."""
    devices = silver(spark, d, "trial").select("trial", "pid").distinct()
    other = devices.select("trial", F.col("pid").alias("b"))
    return devices.withColumnRenamed("pid", "a").join(other, "trial").filter("a < b")


@query(
    "sample_matrix",
    with_trace(
        """select kind, batch, precision, round(a * batch / 32 * case when precision = 'half' then 0.5 else 1.0 end, 6) as predicted_us
from (select kind, round(avg(y), 6) a from k group by kind), unnest([4, 32, 256]) b(batch), unnest(['full', 'half']) p(precision)""",
        _KERNELS,
    ),
)
def sample_matrix(spark, d):
    """Operation types by batch size and precision, times scaled from the measured ones."""
    rows = _kernels(spark, d).groupBy("kind").agg(F.round(F.avg("y"), 6).alias("a"))
    rows = rows.withColumn("batch", F.explode(F.array(*[F.lit(b) for b in (4, 32, 256)])))
    rows = rows.withColumn("precision", F.explode(F.array(F.lit("full"), F.lit("half"))))
    scale = F.when(F.col("precision") == "half", 0.5).otherwise(1.0)
    return rows.select("kind", "batch", "precision", F.round(F.col("a") * F.col("batch") / 32 * scale, 6).alias("predicted_us"))


@query("graph_rewrites")
def graph_rewrites(spark, d):
    """Each step's graph as it is, with matrix operations in half precision, and with twice the batch."""
    return graph.rewrites(*_steps(spark, d), KEY, "/(Conv2D|MatMul)(_[0-9]+)?~>")


typed(
    ORACLES,
    {
        "phase_islands": {"island": "bigint"},
        "marker_iterations": {"iteration": "bigint"},
        "tensor_group_sizes": {"bytes": "bigint"},
        "fuse_neighbours": {"bytes": "bigint"},
        "best_partitions": {"bytes": "bigint"},
        "ring_chunks": {"chunk": "integer"},
    },
)
