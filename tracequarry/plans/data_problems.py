"""Queries of the data problems of the core, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import intervals, nested, schema_drift, sessions, spikes
from tracequarry.plans.sql import NESTED, opened, text
from tracequarry.session import table

SESSION_GAP_US = 5_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "raw_events"), table(spark, d, "trace_files"))


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    events = schema_drift.consistent_events(table(spark, d, "raw_events"), table(spark, d, "trace_files"))
    return events.withColumn("args", F.to_json("args"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Events of each file and the members of their args that aren't null, counted in the consistent table."""
    events = schema_drift.consistent_events(table(spark, d, "raw_events"), table(spark, d, "trace_files"))
    held = F.coalesce(F.size(F.json_object_keys(F.to_json("args"))), F.lit(0))
    left = F.coalesce(F.size(F.json_object_keys(F.get_json_object("rest", "$.args"))), F.lit(0))
    return events.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(held + left).cast("bigint").alias("n_members"))


def p1_schema(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.union_schema(table(spark, d, "raw_events"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "comm_events").select("pid", "ts_us", F.expr("ts_us + dur_us").alias("end_us"))
    return intervals.merge_intervals(events, "pid", "ts_us", "end_us").withColumnRenamed("entity", "pid")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    flags = spikes.flag_implausible(table(spark, d, "trace_events"), "name", "pid", "ts_us", "dur_us", "event_seq")
    return flags.select(F.col("event_id").alias("event_seq")).distinct()


def p5_certain(spark: SparkSession, d: str) -> DataFrame:
    """The events to distrust whatever is usual: impossible durations and stuck runs."""
    flags = spikes.flag_implausible(table(spark, d, "trace_events"), "name", "pid", "ts_us", "dur_us", "event_seq")
    return flags.filter("reason <> 'spike'").select(F.col("event_id").alias("event_seq"), "reason").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.sessionize(
        table(spark, d, "trace_events"), "pid", "ts_us", "event_seq", sessions.step_number(), SESSION_GAP_US
    )
    return found.withColumnRenamed("entity", "pid").withColumnRenamed("n_labels", "n_steps")


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """p6_found with each session's duration."""
    return p6_found(spark, d).withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.flat_table(table(spark, d, "op_metadata"), "tensors")
    return rows.select("record_id", "node", "side", "pos", F.col("name").alias("tensor"))


def _flat(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.flat_table(table(spark, d, "op_metadata"), name)

    return query


QUERIES = {
    "p1_found": p1_found,
    "p1_events": p1_events,
    "p1_schema": p1_schema,
    "p1_kept": p1_kept,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_certain": p5_certain,
    "p6_found": p6_found,
    "p6_sessions": p6_sessions,
    "p7_found": p7_found,
    "p7_operations": _flat("operations"),
    "p7_dims": _flat("dims"),
    "p7_events": _flat("events"),
    "p7_arguments": _flat("arguments"),
}

_P6 = f"""
with e as (select distinct pid, ts_us, event_seq, try_cast(trim(args['step']) as double) st
           from trace_events where pid is not null and ts_us is not null and event_seq is not null),
m as (select *, case when ts_us - lag(ts_us) over (partition by pid order by ts_us, event_seq) <= {SESSION_GAP_US}
                     then 0 else 1 end b from e),
g as (select *, sum(b) over (partition by pid order by ts_us, event_seq) k from m)
select pid, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as n_events, count(distinct st) as n_steps{{more}}
from g group by pid, k"""

ORACLES = {
    "p5_certain": """
with e as (select distinct event_seq, pid, name, ts_us, dur_us from trace_events where event_seq is not null and dur_us is not null),
t as (select *, case when lag(dur_us) over w = dur_us then 0 else 1 end b from e where pid is not null and name is not null and ts_us is not null
      window w as (partition by name, pid order by ts_us, event_seq)),
g as (select *, sum(b) over (partition by name, pid order by ts_us, event_seq) k from t)
select event_seq, 'impossible' as reason from e where dur_us not between 1 and 86400000000
union all select event_seq, 'stuck' from (select event_seq, count(*) over (partition by name, pid, k) n from g) where n >= 8""",
    "p7_found": f"with recursive {NESTED} select distinct record_id, node, side, pos, name as tensor from tens",
    "p7_operations": f"""with recursive {NESTED}
select record_id, node, parent, coalesce(nullif({text("j -> '$.name'")}, ''), key) as name, {text("j -> '$.op'")} as kind,
  case when json_type(f) in ('OBJECT', 'ARRAY') and json_array_length(case when json_type(f) = 'ARRAY' then f else json_keys(f)::json end) > 0
         or json_type(f) = 'VARCHAR' and f ->> '$' <> '' or json_type(f) = 'BOOLEAN' and f::varchar = 'true'
         or json_type(f) in ('UBIGINT', 'BIGINT', 'DOUBLE') and f::double <> 0 then 'fused' else 'plain' end as variant
from (select *, {opened("j -> '$.fused'")} as f from ops)""",
    "p7_events": f"""with recursive {NESTED}
select record_id, node, {text("j -> '$.name'")} as name, {text("j -> '$.ph'")} as kind,
  case when json_type(j -> '$.ts') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (j -> '$.ts')::double end as ts,
  case when json_type(j -> '$.dur') in ('UBIGINT', 'BIGINT', 'DOUBLE') then (j -> '$.dur')::double end as dur,
  case coalesce(json_type(args), 'NULL') when 'NULL' then 'null' when 'BOOLEAN' then 'bool' when 'VARCHAR' then 'text' when 'OBJECT' then 'object' when 'ARRAY' then 'array'
    else 'number' end as variant from evs""",
    "p7_arguments": f"""with recursive {NESTED}
select record_id, node, e.key as name, {text("e.value")} as value,
  case json_type(e.value) when 'NULL' then 'null' when 'BOOLEAN' then 'bool' when 'VARCHAR' then 'text' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as variant
from (select * from evs where json_type(args) = 'OBJECT') t, json_each(t.args) e""",
    "p7_dims": f"with recursive {NESTED} select record_id, node, side, pos, dim, size from dims",
    "p1_kept": r"""
with t as (select file_id, trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(65279)) a from raw_events where raw is not null and file_id is not null),
u as (select *, rtrim(a, ', ]' || chr(9)) b, ltrim(rtrim(a, ', ]' || chr(9)), '[, ' || chr(9)) c from t),
l as (select file_id, case when json_valid(a) then a when json_valid(b) then b when json_valid(c) then c end j from u),
o as (select file_id, json_extract(j, '$.args') x from l where json_type(j) = 'OBJECT'),
p as (select file_id, case when json_type(x) = 'OBJECT' then x
                           when json_type(x) = 'VARCHAR' and json_valid(json_extract_string(x, '$')) then json_extract_string(x, '$')::json end m from o),
k as (select file_id, case when json_type(m) = 'OBJECT'
        then (select count(*) from (select unnest(json_keys(m)) q) where json_type(json_extract(m, '$."' || replace(q, '"', '\"') || '"')) <> 'NULL') else 0 end n from p)
select file_id, count(*) as n_events, sum(n)::bigint as n_members from k group by file_id""",
    "p3_found": """
with e as (select distinct pid, ts_us s, ts_us + dur_us e from comm_events
           where pid is not null and ts_us is not null and dur_us > 0),
m as (select *, max(e) over (partition by pid order by s, e rows between unbounded preceding and 1 preceding) pe from e),
g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by pid order by s, e) k from m),
b as (select pid, min(s) s, max(e) e from g group by pid, k)
select pid, 'busy' as kind, s as start_us, e as end_us from b
union all
select pid, kind, start_us, end_us from (
  select pid, 'gap' as kind, lag(e) over (partition by pid order by s) as start_us, s as end_us from b)
where start_us is not null""",
    "p6_found": _P6.format(more=""),
    "p6_sessions": _P6.format(more=", max(ts_us) - min(ts_us) as duration_us"),
}
