"""Queries that write the tables in the formats of traces, logs and graphs and read them back.

Files go to the folder that the cluster shares; the results have to equal the
tables that were written, which SQL says from the tables alone.
"""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import costs
from tracequarry.operators.chunks import global_number
from tracequarry.operators import statistics as st
from tracequarry.plans.graph_queries import _GROUPS, _RANKS, _groups, _ring
from tracequarry.plans.model_queries import _KERNELS, _kernels
from tracequarry.plans.sequence_queries import _EDGES, _NODES, dfg_edges, dfg_nodes
from tracequarry.plans.sql import with_comm, with_trace
from tracequarry.plans.statistics_queries import _ITER, comm, silver
from tracequarry.session import checkpoint_dir, stored, table
from tracequarry.sources import chrome, logs, metadata, sinks

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def local(path: str) -> str:
    """The same as a path of the driver's file system, made ready for a file."""
    plain = re.sub("^file:(//)?", "", path)
    Path(plain).parent.mkdir(parents=True, exist_ok=True)
    return plain


def text_file(df: DataFrame, *value: Column | str) -> str:
    """Lines of text in the shared folder; their path."""
    path = folder(df.sparkSession)
    df.select(F.concat(*value).alias("value")).write.text(path)
    return path


def one_text(df: DataFrame, value: Column) -> str:
    """One text of a short table as one file; its path."""
    path = folder(df.sparkSession)
    df.agg(value.alias("value")).write.text(path)
    return path


# ------------------------------------------------------------------- traces


@query("trace_lines", with_trace("select ph, name, pid, tid, ts_us, dur_us, cat from silver"))
def trace_lines(spark, d):
    """The timeline written one event a line and read by lines."""
    path = folder(spark)
    sinks.write_chrome_lines(silver(spark, d, "tid", "cat", "event_seq"), path)
    return chrome.read_trace_lines(spark, path).select("ph", "name", "pid", "tid", "ts_us", "dur_us", "cat")


@query(
    "trace_objects",
    with_trace("select 'X' as ph, name, pid, min(ts_us) as ts_us, sum(dur_us)::bigint as dur_us from silver where step is not null group by pid, name"),
)
def trace_objects(spark, d):
    """A file for viewers, an object with traceEvents, of each operation's total; read as a whole file."""
    rows = silver(spark, d, "step").filter("step is not null").groupBy("pid", "name").agg(F.min("ts_us").alias("ts_us"), F.sum("dur_us").alias("dur_us"))
    path = folder(spark) + "/trial/host0/0/trace.json"
    sinks.write_chrome_file(rows, local(path))
    events, _ = chrome.split_valid(chrome.read_traces(spark, path))
    return events.select("ph", "name", "pid", "ts_us", "dur_us")


@query(
    "unreadable_files",
    with_trace("select count(*) as files, count(*) filter (min_ts is null) as unreadable from (select pid, min(ts_us) as min_ts from trace where pid is not null group by pid)"),
)
def unreadable_files(spark, d):
    """One file per device with its first time, or without events where it has none; counts of files and of unreadable ones."""
    rows = st.distinct_events(table(spark, d, "trace_events"), "pid", "ts_us").filter("pid is not null").groupBy("pid").agg(F.min("ts_us").alias("t"))
    doc = F.when(F.col("t").isNotNull(), F.format_string('[{"ph": "X", "name": "a", "pid": "%s", "ts": %d}]', "pid", "t")).otherwise(F.lit('{"other": 1}'))
    path = folder(spark)
    rows.withColumn("value", doc).select(F.md5("pid").alias("device"), "value").write.partitionBy("device").text(path)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("source")).distinct()
    bad = chrome.unreadable(spark, f"{path}/*/*").select("source", F.lit(1).alias("bad"))
    return files.join(bad, "source", "left").agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("unreadable"))


@query(
    "tf_computation",
    with_trace(
        """
select e.pid, e.name, e.ts_us, e.dur_us, 'operator' || (n.k - 1) as tid from ev e join (
  select trial, host, rank, tid, row_number() over (partition by trial, host, rank order by t, tid) k from (
    select trial, host, rank, tid, min(ts_us) t from ev group by all)) n using (trial, host, rank, tid)""",
        _NODES
        + """, ev as (select trial, host, rank, host || '.rank' || rank as pid, tid, ts_us, dur_us, case when op_name like 'gradients%' then 'BW.' else 'FW.' end || replace(op_name, '.', '_') as name
  from silver s where cat = 'operator' and host is not null and rank is not null and tid is not null and op_name is not null and not contains(op_name, 'Comm')
    and not contains(op_name, '/_') and exists (select 1 from nodes n where n.trial = s.trial and n.op = s.op_name))""",
    ),
)
def tf_computation(spark, d):
    """The operations as a TensorFlow profiler writes them, with process and thread names, cleaned again."""
    rows = silver(spark, d, "event_seq", "trial", "host", "rank", "tid", "cat", "op_name")
    rows = rows.filter("cat = 'operator' and host is not null and rank is not null and tid is not null and op_name is not null and not contains(op_name, '/_')")
    where = ["trial", "host", "rank", F.concat_ws("/", "trial", "host", F.col("rank").cast("string")).alias("path"), F.lit("1").alias("pid")]
    ops = rows.select(
        *where, "tid", F.lit("X").alias("ph"), F.lit("kernel").alias("name"), "ts_us", "dur_us",
        F.create_map(F.lit("long_name"), F.concat(F.lit("StatefulPartitionedCall/"), "op_name", F.lit(":x"))).alias("args"),
    )
    no = lambda t: F.lit(None).cast(t)
    label = lambda name, text, tid: rows.select(
        *where, tid.alias("tid"), F.lit("M").alias("ph"), F.lit(name).alias("name"), no("bigint").alias("ts_us"), no("bigint").alias("dur_us"),
        F.create_map(F.lit("name"), F.lit(text)).alias("args"),
    ).dropDuplicates(["path", "tid"])
    events = ops.unionByName(label("process_name", "/job:w/device:GPU:0 Compute", no("string"))).unionByName(label("thread_name", "TensorFlow Ops", F.col("tid")))
    return chrome.computation(events, dfg_nodes(spark, d)).select("pid", "name", "ts_us", "dur_us", "tid")


@query(
    "io_within",
    with_trace(
        """select s.event_seq, s.name, coalesce(s.tid, 'I/O') as tid from silver s join (
  select trial, host, rank, min(ts_us) a, max(ts_us + dur_us) b from silver where cat = 'operator' group by all) w
  on w.trial = s.trial and w.host = s.host and w.rank = s.rank where s.cat = 'I/O' and s.ts_us >= a and s.ts_us < b"""
    ),
)
def io_within(spark, d):
    """Reads and writes within the span of each device's computation."""
    rows = silver(spark, d, "event_seq", "trial", "host", "rank", "tid", "cat", "ph")
    span = st.spans(rows.filter("cat = 'operator'"), "trial", "host", "rank")
    return chrome.io_events(rows.filter("cat = 'I/O'"), span).select("event_seq", "name", "tid")


@query(
    "comm_detail_read",
    with_comm(
        r"""select 'Comm.' || array_to_string(list_sort(list_transform(string_split(regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1), '+'), lambda x: x::bigint)), '+') || '.' || string_split(name, '.')[3] as name,
  concat_ws('_', args.loop_id, args.channel_id, args.chunk_id, args.slice_id) as suffix, ts_us, dur_us
from comm_ok where regexp_matches(name, '^Comm[.][0-9]+([+][0-9]+)*[.](SEND|RECV)$')"""
    ),
)
def comm_detail_read(spark, d):
    """Detailed transfers written as a profiler does (with marks in their names) and read again."""
    rows = comm(spark, d, "event_seq", "args").filter("name rlike '^Comm[.][0-9]+([+][0-9]+)*[.](SEND|RECV)$'")
    ids = {"loopId": "loop_id", "channelId": "channel_id", "chunkId": "chunk_id", "sliceId": "slice_id"}
    args = F.struct(*[F.col(f"args.{v}").alias(k) for k, v in ids.items()])
    e = F.struct(F.lit("X").alias("ph"), F.concat(F.lit("rank<<7>>"), "name").alias("name"), F.col("ts_us").alias("ts"), F.col("dur_us").alias("dur"), args.alias("args"))
    read = chrome.read_trace_lines(spark, text_file(rows, F.to_json(e), F.lit(",")))
    return chrome.comm_detail(read.withColumn("name", F.regexp_replace("name", "^rank<<7>>", "<<7>>"))).select("name", "suffix", "ts_us", "dur_us")


@query(
    "horovod_read",
    with_trace(
        """select case when sub = 'Sync' then 'Comm.' || t || '.Sync' else 'Comm.' || t || '.' || sub end as name, ts_us, dur_us from (
  select string_split(name, '.')[3] sub, array_to_string(list_sort(list_transform(string_split(string_split(name, '.')[2], '+'), lambda x: x::bigint)), '+') t, ts_us, dur_us
  from (select name, pid, ts_us, max(dur_us) dur_us from silver where regexp_matches(name, '^Comm[.][0-9+]+[.](QUEUE)$') and dur_us > 0 group by all))"""
    ),
)
def horovod_read(spark, d):
    """Queue marks of tensors as begin and end marks of one process per event, paired again."""
    rows = silver(spark, d, "event_seq").filter("name rlike '^Comm[.][0-9+]+[.]QUEUE$' and dur_us > 0")
    rows = rows.groupBy("name", "pid", "ts_us").agg(F.max("dur_us").alias("dur_us"), F.min("event_seq").alias("event_seq"))
    tensor = F.concat(F.lit("allreduce."), F.translate(F.element_at(F.split("name", "[.]"), 2), "+", "_"))
    pid = F.col("event_seq").cast("string")
    marks = F.array(
        F.struct(F.lit("M").alias("ph"), F.lit("process_name").alias("name"), F.lit(None).cast("bigint").alias("ts"), F.struct(tensor.alias("name")).alias("args")),
        F.struct(F.lit("B").alias("ph"), F.lit("QUEUE").alias("name"), F.col("ts_us").alias("ts"), F.struct(F.lit(None).cast("string").alias("name")).alias("args")),
        F.struct(F.lit("E").alias("ph"), F.lit(None).cast("string").alias("name"), F.expr("ts_us + dur_us").alias("ts"), F.struct(F.lit(None).cast("string").alias("name")).alias("args")),
    )
    lines = rows.select(pid.alias("pid"), F.explode(marks).alias("m")).select(F.struct("pid", "m.*").alias("e"))
    events = chrome.read_trace_lines(spark, text_file(lines, F.to_json("e"))).withColumn("path", F.lit("all"))
    return chrome.horovod(events).select("name", "ts_us", "dur_us")


# --------------------------------------------------------------------- logs


@query(
    "server_log_read",
    r"""with o as (select distinct on (event_seq) * from server_events where event_seq is not null),
k as (select *, regexp_extract(name, '^Comm[.]([0-9]+)', 1)::bigint as key, string_split(name, '.')[3] as op from o
  where pid is not null and ts_us > 0 and dur_us > 0 and regexp_matches(name, '^Comm[.][0-9+]+[.]'))
select ts_us, 'B' as ph, key, op, coalesce(tid, 0) as tid from k union all select ts_us + dur_us, 'E', key, op, coalesce(tid, 0) from k""",
)
def server_log_read(spark, d):
    """Server operations as the text log of a parameter server, read again."""
    rows = st.distinct_events(table(spark, d, "server_events"), "pid", "name", "tid", "ts_us", "dur_us")
    rows = rows.filter("pid is not null and ts_us > 0 and dur_us > 0 and name rlike '^Comm[.][0-9+]+[.]'")
    rows = rows.select("ts_us", "dur_us", "tid", F.regexp_extract("name", "^Comm[.]([0-9]+)", 1).alias("key"), F.element_at(F.split("name", "[.]"), 3).alias("op"))
    marks = F.explode(F.array(F.struct(F.lit("start").alias("ph"), F.col("ts_us").alias("at")), F.struct(F.lit("stop").alias("ph"), F.expr("ts_us + dur_us").alias("at"))))
    lines = rows.withColumn("m", marks)
    tid = F.when(F.col("tid").isNotNull(), F.concat(F.lit(", "), "tid")).otherwise("")
    path = text_file(lines, F.col("m.at"), F.lit(": "), F.col("m.ph"), F.lit(", "), F.col("key"), F.lit(", "), F.col("op"), tid)
    return logs.server_log(spark, path)[0].select("ts_us", "ph", "key", "op", "tid")


@query(
    "transfer_log_read",
    with_comm("select ts_us, true as is_start, event_seq as key, name like '%.SEND' as is_push from comm_ok union all select ts_us + dur_us, false, event_seq, name like '%.SEND' from comm_ok"),
)
def transfer_log_read(spark, d):
    """Transfers as the time log of a worker (start and end, push and pull), read again."""
    rows = comm(spark, d, "event_seq").withColumn("push", F.col("name").endswith(".SEND"))
    marks = F.explode(F.array(F.struct(F.lit(True).alias("s"), F.col("ts_us").alias("at")), F.struct(F.lit(False).alias("s"), F.expr("ts_us + dur_us").alias("at"))))
    lines = rows.withColumn("m", marks)
    blank = F.lit(" ")
    path = text_file(lines, F.col("m.at"), blank, F.col("m.s"), blank, F.col("push"), F.lit(" true "), F.col("event_seq"), F.lit(" 1 2"))
    return logs.transfer_log(spark, path)[0].select("ts_us", "is_start", "key", "is_push")


@query(
    "key_table_read",
    with_comm("select key::bigint as key, 'g' || replace(tensor, '+', '_') || case when n > 1 then '~PART' || (i - 1) else '' end as tensor from (select tensor, len(l) n, unnest(l) key, generate_subscripts(l, 1) i from (select tensor, string_split(tensor, '+') l from g))", _GROUPS),
)
def key_table_read(spark, d):
    """Tensor groups with their keys as the key table of a parameter server, read again."""
    path = text_file(_groups(spark, d), F.lit("g"), F.translate("tensor", "+", "_"), F.lit(": "), F.translate("tensor", "+", " "))
    return logs.key_table(spark, path)


@query("kernel_labels_read", with_trace("select op_name as sample, round(avg(y), 3) as label from k group by op_name", _KERNELS))
def kernel_labels_read(spark, d):
    """Measured times as a label file, read again."""
    rows = _kernels(spark, d).groupBy("op_name").agg(F.round(F.avg("y"), 3).alias("label"))
    return logs.kernel_labels(spark, text_file(rows, "op_name", F.lit(": "), "label"))


@query("candidate_ops_read", with_trace("select src, dst from edges where not regexp_matches(src || dst, '\\s')", _EDGES))
def candidate_ops_read(spark, d):
    """The data flow graph's operations as a compiler's list of candidates with dependencies, read again."""
    edges = dfg_edges(spark, d).filter(r"not concat(src, dst) rlike '\\s'").select("src", "dst").distinct()
    ends = edges.select(F.col("src").alias("op")).union(edges.select("dst")).distinct()
    ids = stored(global_number(ends, "op", "id"))
    id_of = lambda side: ids.select(F.col("op").alias(side), F.col("id").alias(f"{side}_id"))
    listed = lambda *c: F.array_join(F.collect_list(F.concat_ws(" ", *c)), "\n")
    linked = edges.join(id_of("src"), "src").join(id_of("dst"), "dst").agg(listed("src_id", "dst_id").alias("x"))
    doc = ids.agg(listed("op", "id").alias("ops")).select(F.concat("ops", F.lit("\nunsafe_resource_deps_:\n"), linked.scalar()).alias("value"))
    path = folder(spark)
    doc.coalesce(1).write.text(path)
    return logs.candidate_ops(spark, path)[1]


@query(
    "average_blocks_read",
    with_trace(
        """select 'fp32' as precision, 8 as batch, count(*) as n, round(sum(avg), 3) as total from (select round(avg(y), 3) as avg from k group by kind) having count(*) > 0""", _KERNELS
    ),
)
def average_blocks_read(spark, d):
    """Means and variances of operation types as a block of measurements, read again and summed up."""
    rows = _kernels(spark, d).groupBy("kind").agg(F.round(F.avg("y"), 3).alias("avg"), F.round(F.var_pop("y"), 3).alias("var"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", c))), lambda x: x[c].cast("string")), ", ")
    path = one_text(rows, F.concat(F.lit("tool fp32 BS=8: ["), joined("avg"), F.lit("] ["), joined("var"), F.lit("]")))
    return logs.average_blocks(spark, path).groupBy("precision", "batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("avg"), 3).alias("total"))


@query(
    "gpu_trace_read",
    with_trace("select step as stream, name as kernel, count(*) as n from silver where cat = 'operator' and step between 0 and 999999 and length(name) < 200 group by all"),
)
def gpu_trace_read(spark, d):
    """Operations as the fixed columns of a GPU profiler's text, read again and counted by stream."""
    rows = silver(spark, d, "event_seq", "cat", "step").filter("cat = 'operator' and step between 0 and 999999 and length(name) < 200")
    path = text_file(rows, F.rpad(F.lit("0.0ms"), 162, " "), F.lpad(F.col("step").cast("string"), 7, " "), F.lit(" "), F.rpad("name", 200, " "))
    return logs.gpu_trace_text(spark, path).groupBy("stream", "kernel").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------ metadata and graphs


@query("gml_round_trip", with_trace("select distinct src, dst from edges", _EDGES))
def gml_round_trip(spark, d):
    """The data flow graph as GML text, read again."""
    path = folder(spark) + ".gml"
    sinks.write_gml(dfg_edges(spark, d), local(path))
    return metadata.gml_edges(spark, path).select("src", "dst")


@query("dot_round_trip", with_trace("select distinct src, dst from edges", _EDGES))
def dot_round_trip(spark, d):
    path = folder(spark) + ".dot"
    sinks.write_dot(dfg_edges(spark, d), local(path))
    end = lambda i: F.regexp_extract("value", r'^\s*"(.*)" -> "(.*)";$', i)
    return spark.read.text(path).filter("value like '%->%'").select(end(1).alias("src"), end(2).alias("dst"))


@query("graph_def_read", with_trace("select distinct src, dst from edges", _EDGES))
def graph_def_read(spark, d):
    """The data flow graph as a graph definition in JSON, read again."""
    nodes = dfg_edges(spark, d).groupBy(F.col("dst").alias("name")).agg(F.collect_set("src").alias("input"))
    return metadata.graph_def(spark, one_text(nodes, F.to_json(F.struct(F.collect_list(F.struct("name", F.lit("x").alias("op"), "input")).alias("node")))))


@query(
    "ring_topology_read",
    with_comm("select 0 as channel, a.rank::int as rank, b.rank::int as next_rank, 'network' as transport from r a join r b on b.rank = (a.rank + 1) % a.n", _RANKS + ", r as (select * from ranks where trial = (select min(trial) from ranks))"),
)
def ring_topology_read(spark, d):
    """The ring of the first trial's devices as a topology file, read again."""
    ranks = _ring(spark, d)[1]
    ranks = ranks.join(ranks.agg(F.min("trial").alias("trial")), "trial")
    n = F.size(F.collect_list("rank"))
    links = F.transform(
        F.array_sort(F.collect_list("rank")),
        lambda r: F.concat(r.cast("string"), F.lit("["), (r * 1000).cast("string"), F.lit("] -> "), F.pmod(r + 1, n).cast("string"), F.lit("[0] via NET/Socket/0")),
    )
    return metadata.rings(spark, one_text(ranks, F.to_json(F.struct(F.create_map(F.lit("0"), F.array_join(links, ",")).alias("RealRing")))))


@query(
    "gradients_read",
    with_comm("select (row_number() over (order by tensor) - 1)::int as pos, 'grad' || tensor as name, [len(tensor), 2]::bigint[] as shape, 'float32' as dtype from g", _GROUPS),
)
def gradients_read(spark, d):
    """Tensor groups as a gradient list, read again."""
    rows = _groups(spark, d).withColumn("g", F.concat(F.lit("grad"), "tensor", F.lit(";shape=("), F.length("tensor").cast("string"), F.lit(",2);dtype=float32")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("tensor", "g"))), lambda x: x["g"])
    return metadata.gradients(spark, one_text(rows, F.to_json(F.struct(listed.alias("gradient_name_list")))))


@query("variable_graph_read", with_trace("select distinct replace(src, '.', '_') as src, replace(dst, '.', '_') as dst from edges where replace(src, '.', '_') <> replace(dst, '.', '_')", _EDGES))
def variable_graph_read(spark, d):
    """Operations with their inputs as captured metadata in JSON, and the graph that follows from them."""
    shape = F.array(F.lit(2).cast("bigint"))
    tensor = F.struct(F.concat("src", F.lit(":0")).alias("name"), shape.alias("shape"), F.lit("float32").alias("dtype"))
    ops = dfg_edges(spark, d).select("src", "dst").distinct().groupBy("dst").agg(F.collect_list(tensor).alias("input"))
    entries = F.map_from_entries(F.collect_list(F.struct("dst", F.struct(F.lit("x").alias("op"), "input").alias("v"))))
    return metadata.variable_graph(metadata.op_metadata(spark, one_text(ops, F.to_json(entries))))


# ------------------------------------------------------------------ reports


@query(
    "sheets_round_trip",
    with_trace("select pid, name, count(*) as cnt, sum(dur_us)::bigint as sum_us from silver group by pid, name, cat_fine"),
)
def sheets_round_trip(spark, d):
    """Counts and sums of operations as a CSV sheet, read again."""
    path = folder(spark)
    sinks.write_sheets({"statistic": st.op_means(silver(spark, d, "cat_fine")).select("pid", "name", "cnt", "sum_us")}, path)
    return spark.read.option("header", True).schema("pid string, name string, cnt bigint, sum_us bigint").csv(f"{path}/statistic")


@query(
    "run_record",
    with_trace(
        """select trial, max_step, opt_step, round(iter, 4) as iter_ms from (
  select trial, max(step) as max_step from silver where step is not null and trial is not null group by trial)
join (select trial, iter, arg_min(k, {'d': round(abs(x - iter), 6), 'k': k})::int as opt_step from whole join steps using (trial) group by all) using (trial)""",
        _ITER
        + """,
per as (select *, row_number() over (partition by trial, pid order by step) - 1 k from iters),
fewest as (select trial, min(n) f from (select trial, pid, count(*) n from per group by all) group by trial),
steps as (select trial, k, avg(iter_ms) x from per join fewest using (trial) where k < f group by trial, k),
whole as (select trial, case when avg(x) <> 0 and stddev_pop(x) / avg(x) > 0.1 then median(x) else avg(x) end iter from steps group by trial)""",
    ),
)
def run_record(spark, d):
    """Each trial's last step, chosen step and iteration time, stored as a table and read again."""
    events = silver(spark, d, "event_seq", "cat", "cat_fine", "step", "trial")
    trials = events.filter("step is not null and cat = 'operator'").groupBy("pid", "step").agg(F.min("trial").alias("trial"))
    whole = st.overall_iteration(st.iterations(events).join(trials, ["pid", "step"])).select("trial", "opt_step", "iter_ms")
    last = events.filter("step is not null and trial is not null").groupBy("trial").agg(F.max("step").alias("max_step"))
    path = folder(spark)
    sinks.write_table(last.join(whole, "trial"), path, ["trial"])
    return spark.read.parquet(path).select("trial", "max_step", "opt_step", "iter_ms")


@query(
    "group_specs",
    with_comm("""select tensor, '{"members":[' || array_to_string(list_transform(string_split(tensor, '+'), lambda x: '"' || x || '"'), ',') || ']}' as value from (select tensor from g)""", _GROUPS),
)
def group_specs(spark, d):
    """Tensor groups as the JSON of a fusion plan."""
    rows = _groups(spark, d).select("tensor", F.posexplode(F.split("tensor", "[+]")).alias("i", "member"))
    parts = rows.groupBy("tensor").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "member"))), lambda x: x["member"]).alias("members"))
    return parts.select("tensor", F.to_json(F.struct("members")).alias("value"))


@query(
    "cluster_lines",
    with_trace("select op_name || ' ' || (dense_rank() over (order by kind) - 1) as value from (select distinct op_name, kind from k)", _KERNELS),
)
def cluster_lines(spark, d):
    """Operations with the number of their type as lines of a cluster mapping."""
    ops = _kernels(spark, d).select("op_name", "kind").distinct()
    codes = global_number(ops.select("kind").distinct(), "kind", "cluster")
    return sinks.cluster_lines(ops.join(codes, "kind").select(F.col("op_name").alias("node"), "cluster"))


@query(
    "size_to_time",
    with_comm(
        """select sub_op, count(*) as n, array_to_string(list(x || ':' || y order by x), ' ') as pairs from (
  select string_split(name, '.')[3] sub_op, len(string_split(regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1), '+')) x, floor(avg(dur_us))::bigint y
  from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.](SEND|RECV)$') group by all) group by sub_op"""
    ),
)
def size_to_time(spark, d):
    """Mean time by the number of a group's tensors, a list per kind of transfer."""
    rows = comm(spark, d).filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'")
    size = F.size(F.split(F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1), "[+]"))
    means = rows.groupBy(F.element_at(F.split("name", "[.]"), 3).alias("sub_op"), size.alias("x")).agg(F.floor(F.avg("dur_us")).alias("y"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("x", "y"))), lambda p: F.concat(p["x"].cast("string"), F.lit(":"), p["y"].cast("string")))
    return means.groupBy("sub_op").agg(F.count(F.lit(1)).alias("n"), F.array_join(pairs, " ").alias("pairs"))


@query("fit_data", with_trace("select op_name, kind, round(avg(y), 3) as label, count(*) as n from k group by all", _KERNELS))
def fit_data(spark, d):
    """Samples for fits (name, type, mean, count) as CSV, read again."""
    path = folder(spark)
    _kernels(spark, d).groupBy("op_name", "kind").agg(F.round(F.avg("y"), 3).alias("label"), F.count(F.lit(1)).alias("n")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("op_name string, kind string, label double, n bigint").csv(path)


@query(
    "amp_samples",
    with_trace("select op_name as name, round(avg(y) / 1000, 6) as avg_ms from k where regexp_matches(kind, 'Conv2D|MatMul|Mul') group by op_name", _KERNELS),
)
def amp_samples(spark, d):
    """Operations of the types that a precision model is made for, with their mean."""
    return costs.of_types(_kernels(spark, d), "kind", ["Conv2D", "MatMul", "Mul"]).groupBy(F.col("op_name").alias("name")).agg(F.round(F.avg("y") / 1000, 6).alias("avg_ms"))


@query(
    "critical_painted",
    with_trace("select count(*) as events from silver where step is not null and trial is not null and cat is not null"),
)
def critical_painted(spark, d):
    """The steps' timeline with Y for events on the critical path and N for others; counts all of them."""
    from tracequarry.operators import graph
    from tracequarry.plans.graph_queries import KEY, _steps

    nodes, edges = _steps(spark, d)
    path = graph.critical_paths(nodes, edges, KEY).select(*KEY, "node", F.lit("Y").alias("on"))
    shown = sinks.painted(nodes.filter("pid <> 'all'").join(path, [*KEY, "node"], "left"), F.coalesce("on", F.lit("N")))
    return shown.filter("name in ('Y', 'N')").agg(F.count(F.lit(1)).alias("events"))
