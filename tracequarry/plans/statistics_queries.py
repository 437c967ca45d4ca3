"""Queries of names and statistics, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import statistics as st
from tracequarry.plans.sql import typed, with_comm, with_trace
from tracequarry.session import table


def silver(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return st.timed_events(table(spark, d, "trace_events"), *cols)


def comm(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    rows = table(spark, d, "comm_events").withColumn("cat", F.lit("Comm"))
    return st.timed_events(rows, *cols)


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
    "op_stats",
    with_trace("""
select pid, name, cat_fine, count(*) as cnt, round(min(dur_us) / 1000, 9) as min_ms, round(max(dur_us) / 1000, 9) as max_ms,
       round(sum(dur_us) / count(*) / 1000, 9) as avg_ms,
       round(sqrt(greatest(sum(dur_us::hugeint * dur_us)::double / count(*) - pow(sum(dur_us)::double / count(*), 2), 0) / 1e6), 3) as std_ms,
       round(list_sort(list(dur_us))[count(*) // 2 + 1] / 1000, 9) as median_hi_ms
from silver group by pid, name, cat_fine"""),
)
def op_stats(spark, d):
    return st.op_stats(silver(spark, d, "cat_fine"))


@query(
    "category_stats",
    with_trace(
        """
select cat_fine, round(max(avg_us) / 1000, 9) as max_ms, arg_max(full_name, {'a': avg_us, 'n': full_name}) as max_name,
       round(sum(us) / 1000, 9) as time_ms, sum(cnt) as cnt, count(*) as op_cnt, round(sum(us) / sum(cnt) / 1000, 9) as avg_ms
from ops group by cat_fine""",
        "ops as (select pid || '->' || name as full_name, cat_fine, count(*) cnt, sum(dur_us) us, sum(dur_us) / count(*) avg_us from silver group by pid, name, cat_fine)",
    ),
)
def category_stats(spark, d):
    return st.category_stats(silver(spark, d, "cat_fine"))


@query(
    "top_ops",
    with_trace("""
select pid, name, count(*) as cnt, round(sum(dur_us) / count(*) / 1000, 9) as avg_ms
from silver group by pid, name, cat_fine order by avg_ms desc, pid, name limit 20"""),
)
def top_ops(spark, d):
    return st.top_ops(silver(spark, d, "cat_fine"))


_ITER = """iters as (
select pid, step, min(ts_us) as start_us, arg_max(ts_us + dur_us, {'t': ts_us, 'n': name, 'e': event_seq}) as end_us,
       round(sum(case when cat_fine = 'operator.FW' then dur_us else 0 end) / 1000, 9) as fw_ms,
       round(sum(case when cat_fine = 'operator.BW' then dur_us else 0 end) / 1000, 9) as bw_ms,
       round(sum(case when cat_fine = 'operator.UPDATE' then dur_us else 0 end) / 1000, 9) as update_ms,
       round((arg_max(ts_us + dur_us, {'t': ts_us, 'n': name, 'e': event_seq}) - min(ts_us)) / 1000, 9) as iter_ms, min(trial) as trial
from silver where step is not null and cat = 'operator' group by pid, step)"""


def _iterations(spark, d):
    return st.iterations(silver(spark, d, "event_seq", "cat", "cat_fine", "step"))


@query("iteration_time", with_trace("select pid, step, start_us, end_us, fw_ms, bw_ms, update_ms, iter_ms from iters", _ITER))
def iteration_time(spark, d):
    return _iterations(spark, d)


@query(
    "device_iterations",
    with_trace(
        """
select pid, count(*) as steps, round(avg(iter_ms), 4) as avg_ms, round(stddev_pop(iter_ms), 3) as std_ms,
       round(avg(fw_ms), 4) as fw_ms, round(avg(bw_ms), 4) as bw_ms, round(avg(update_ms), 4) as update_ms
from iters group by pid""",
        _ITER,
    ),
)
def device_iterations(spark, d):
    return st.device_iterations(_iterations(spark, d))


@query(
    "overall_iter_time",
    with_trace(
        """
select trial, steps, round(mean, 4) as mean_ms, round(dev, 3) as std_ms, round(iter, 4) as iter_ms,
       arg_min(k, {'d': round(abs(x - iter), 6), 'k': k}) as opt_step
from whole join steps using (trial) group by all""",
        _ITER
        + """,
per as (select *, row_number() over (partition by trial, pid order by step) - 1 k from iters),
fewest as (select trial, min(n) f from (select trial, pid, count(*) n from per group by all) group by trial),
steps as (select trial, k, avg(iter_ms) x from per join fewest using (trial) where k < f group by trial, k),
whole as (select trial, count(*) steps, avg(x) mean, stddev_pop(x) dev,
                 case when avg(x) <> 0 and stddev_pop(x) / avg(x) > 0.1 then median(x) else avg(x) end iter from steps group by trial)""",
    ),
)
def overall_iter_time(spark, d):
    """Per trial, from its devices' steps; a device belongs to one trial."""
    events = silver(spark, d, "event_seq", "cat", "cat_fine", "step", "trial")
    trials = events.filter("step is not null and cat = 'operator'").groupBy("pid", "step").agg(F.min("trial").alias("trial"))
    return st.overall_iteration(st.iterations(events).join(trials, ["pid", "step"]))


@query(
    "straggler",
    with_trace(
        """
select pid, cat_fine, cnt, round(us / 1000, 9) as time_ms, round(us / sum(us) over (partition by cat_fine), 6) as share
from (select pid, cat_fine, count(*) cnt, sum(dur_us) us from silver group by all)"""
    ),
)
def straggler(spark, d):
    return st.straggler(silver(spark, d, "cat_fine"))


@query("host_span", with_trace("select trial, host, min(ts_us) as start_us, max(ts_us + dur_us) as end_us from silver where host is not null group by all"))
def host_span(spark, d):
    return st.spans(silver(spark, d, "trial", "host").filter("host is not null"), "trial", "host")


@query(
    "compare_trials",
    with_trace(
        """
select name, round(va, 6) as avg_a, round(vb, 6) as avg_b, round(vb - va, 6) as absolute, round(case when va <> 0 then (vb - va) / va end, 6) as relative
from (select name, sum(dur_us) / count(*) / 1000 va from silver where trial = 't000000' group by name)
join (select name, sum(dur_us) / count(*) / 1000 vb from silver where trial <> 't000000' group by name) using (name)"""
    ),
)
def compare_trials(spark, d):
    """The first trial against all others (where there is one trial only, it gives no rows)."""
    events = silver(spark, d, "trial")
    return st.compare(events.filter("trial = 't000000'"), events.filter("trial <> 't000000'"))


@query(
    "compare_devices",
    with_trace(
        """
select name, round(va, 6) as avg_a, round(vb, 6) as avg_b, round(vb - va, 6) as absolute, round(case when va <> 0 then (vb - va) / va end, 6) as relative
from (select name, sum(dur_us) / count(*) / 1000 va from silver where pid in (select pid from firsts) group by name)
join (select name, sum(dur_us) / count(*) / 1000 vb from silver where trial is not null and pid not in (select pid from firsts) group by name) using (name)""",
        "firsts as (select min(pid) as pid from silver where trial is not null group by trial)",
    ),
)
def compare_devices(spark, d):
    """The first device of each trial against the others, as ``compare_trials`` does for trials."""
    events = silver(spark, d, "trial").filter("trial is not null")
    first = events.groupBy("trial").agg(F.min("pid").alias("pid")).select("pid").distinct()
    return st.compare(events.join(first, "pid", "left_semi"), events.join(first, "pid", "left_anti"))


@query(
    "mode_count_filter",
    with_comm(
        """
select pid, name, cnt, mode from counts join
  (select pid, arg_max(cnt, {'k': k, 'c': -cnt}) as mode from (select pid, cnt, count(*) k from counts group by all) group by pid) using (pid)
where abs(cnt - mode) > 2""",
        "counts as (select pid, name, count(*) cnt from comm_ok group by all)",
    ),
)
def mode_count_filter(spark, d):
    return st.modal_counts(comm(spark, d), 2)


@query(
    "trim_samples",
    with_trace(
        """
select pid, name, count(*) as kept, round(avg(dur_us) / 1000, 9) as avg_ms from ranked
where rn <= n - 10 and rn > case when n > 100 then n - 100 else 10 end group by all""",
        "ranked as (select *, row_number() over (partition by pid, name order by ts_us, event_seq) rn, count(*) over (partition by pid, name) n from silver)",
    ),
)
def trim_samples(spark, d):
    return st.trimmed_means(silver(spark, d, "event_seq"))


@query(
    "comm_id_counts",
    with_comm("""
select name, max(args.loop_id) + 1 as loops, max(args.channel_id) + 1 as channels, max(args.chunk_id) + 1 as chunks, max(args.slice_id) + 1 as slices
from comm_ok group by name"""),
)
def comm_id_counts(spark, d):
    ids = {"loops": "loop_id", "channels": "channel_id", "chunks": "chunk_id", "slices": "slice_id"}
    return comm(spark, d, "args").groupBy("name").agg(*[(F.max(f"args.{v}") + 1).alias(k) for k, v in ids.items()])


_IDS = r"regexp_extract(name, '^Comm[.]([0-9]+(?:[+][0-9]+)*)[.]', 1)"


@query(
    "name_parse",
    with_trace(r"""
select event_seq, full_name, string_split(full_name, '->')[1] as pid, op_cat, op_name, sub_op, suffix, valid from (
  select event_seq, full_name, std[1] as op_cat, std[2] as op_name, std[3] as sub_op, len(std) between 2 and 3 as valid,
         case when contains(full_name, '~>') then string_split(full_name, '~>')[2] end as suffix
  from (select event_seq, full_name, string_split(string_split(regexp_replace(full_name, '^.*?->', ''), '~>')[1], '.') std
        from (select event_seq, pid || '->' || name || coalesce('~>' || suffix, '') full_name from silver)))"""),
)
def name_parse(spark, d):
    """Composite names built from their parts and taken apart again."""
    rows = silver(spark, d, "suffix").select("event_seq", names.long_name(F.col("pid"), F.col("name"), F.col("suffix")).alias("full_name"))
    parts = names.parsed(F.col("full_name"))
    return rows.withColumn("x", parts).select("event_seq", "full_name", *[f"x.{c}" for c in ("pid", "op_cat", "op_name", "sub_op", "suffix", "valid")])


_CAT = """case when contains(n, 'I/O') then 'I/O' when contains(n, 'COPY_FIRST') or contains(n, 'SUM') or contains(n, 'COPY_MERGED') then 'ServerOp'
 when contains(n, 'Comm') or contains(n, 'PUSH') or contains(n, 'PULL') then 'Comm'
 when contains(n, 'FW') or contains(n, 'BW') or contains(n, 'COMP') or contains(n, 'UPDATE') or contains(n, 'OUTPUT') then 'operator'
 when n = 'END' then 'virtual' end"""
_FINE = """case when contains(n, 'COPY_FIRST') or contains(n, 'SUM') or contains(n, 'COPY_MERGED') then 'ServerOp'
 when contains(n, 'PUSH_REQ') then 'Comm.PUSH_REQ' when contains(n, 'PUSH_RES') then 'Comm.PUSH_RES'
 when contains(n, 'PULL_REQ') then 'Comm.PULL_REQ' when contains(n, 'PULL_RES') then 'Comm.PULL_RES'
 when contains(n, 'Comm') then case when contains(n, 'SEND') then 'Comm.SEND' when contains(n, 'RECV') then 'Comm.RECV' else 'Comm.other' end
 when contains(n, 'BW') and contains(n, 'FW') then 'operator.FW+BW' when contains(n, 'BW') then 'operator.BW' when contains(n, 'FW') then 'operator.FW'
 when contains(n, 'COMM') then 'operator.COMM' when contains(n, 'COMP') then 'operator.COMP' when contains(n, 'I/O') then 'I/O' when contains(n, 'UPDATE_') then 'operator.UPDATE'
 when contains(n, 'OUTPUT') then 'operator.OUTPUT' when n = 'END' then 'virtual' end"""
_PRIO = "case when contains(n, 'FW') then 0 when contains(n, 'OUTPUT') then 1 when contains(n, 'BW') then 2 when contains(n, 'UPDATE_') then 3 else 100 end"
_ALL_NAMES = "all_names as (select name n from trace_events union select name from comm_events union select name from server_events)"


@query("category_rules", f"with {_ALL_NAMES} select n as name, {_CAT} as cat, {_FINE} as cat_fine, {_PRIO} as priority from all_names where n is not null")
def category_rules(spark, d):
    """Categories and replay priority of every name."""
    all_names = None
    for t in ("trace_events", "comm_events", "server_events"):
        rows = table(spark, d, t).select("name")
        all_names = rows if all_names is None else all_names.union(rows)
    n = F.col("name")
    return all_names.filter("name is not null").distinct().select(
        "name", names.category(n).alias("cat"), names.fine_category(n).alias("cat_fine"), names.priority(n).alias("priority")
    )


@query(
    "fused_names",
    with_comm(rf"""
select event_seq, 'Comm.' || array_to_string(list_sort(list_transform(string_split({_IDS}, '+'), lambda x: x::bigint)), '+') || '.' || string_split(name, '.')[3] as std_name,
       pid || '->' || name || case when args.chunk_id is not null then '~>' || concat_ws('_', args.loop_id, args.channel_id, args.chunk_id, args.slice_id) else '' end as full_name,
       list_min(list_transform(string_split({_IDS}, '+'), lambda x: x::bigint)) as first_id
from comm_ok where regexp_matches(name, '^Comm[.][0-9]+([+][0-9]+)*[.](SEND|RECV)$')"""),
)
def fused_names(spark, d):
    """Names of communication events with their tensor ids in order, and with the ids of the transfer."""
    rows = comm(spark, d, "args").filter("name rlike '^Comm[.][0-9]+([+][0-9]+)*[.](SEND|RECV)$'")
    n = F.col("name")
    ids = F.regexp_extract(n, r"^Comm[.]([0-9]+(?:[+][0-9]+)*)[.]", 1)
    return rows.select(
        "event_seq",
        F.concat(F.lit("Comm."), names.sorted_tensors(ids), F.lit("."), F.element_at(F.split(n, "[.]"), 3)).alias("std_name"),
        names.unique_name(F.col("pid"), n, *[F.col(f"args.{c}") for c in ("loop_id", "channel_id", "chunk_id", "slice_id")]).alias("full_name"),
        F.array_min(names.tensor_ids(n)).alias("first_id"),
    )


@query(
    "occurrence_index",
    with_trace("select event_seq, pid, name, row_number() over (partition by pid, name order by ts_us, event_seq) - 1 as cnt from silver"),
)
def occurrence_index(spark, d):
    """Running number of each operation's events, over slots of time."""
    from tracequarry.operators.ordered import running

    rows = silver(spark, d, "event_seq")
    out = running(rows, ["pid", "name"], "ts_us", ["event_seq"], {"cnt": ("sum", F.lit(1).cast("bigint"))})
    return out.select("event_seq", "pid", "name", (F.col("cnt") - 1).alias("cnt"))


@query(
    "mape_report",
    with_trace(
        """
select count(*) as n, round(avg(ape), 6) as mape, round(median(ape), 6) as median_ape, round(avg(ape) filter (dur_us >= 500), 6) as mape_large,
       round(avg(ape) filter (dur_us < 500), 6) as mape_small, count(*) filter (p > dur_us) as over, count(*) filter (p < dur_us) as under
from (select *, round(abs(p - dur_us) / dur_us, 9) ape from (select dur_us, floor(avg(dur_us) over (partition by name)) p from silver where dur_us > 0))"""
    ),
)
def mape_report(spark, d):
    """Error of predicting each duration by its name's mean, split at 500 us."""
    rows = silver(spark, d).filter("dur_us > 0")
    means = rows.groupBy("name").agg(F.floor(F.avg("dur_us")).cast("double").alias("p"))
    return st.error_report(rows.join(means, "name"), "dur_us", "p", 500)


typed(ORACLES, {"category_stats": {"cnt": "bigint"}, "overall_iter_time": {"opt_step": "integer"}})
