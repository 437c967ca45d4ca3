"""Queries of operators in time order and of joins, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import matching, sequences
from tracequarry.operators import statistics as st
from tracequarry.plans.sql import typed, with_comm, with_trace
from tracequarry.plans.statistics_queries import comm, silver
from tracequarry.session import table

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
    "current_step",
    with_trace("""
select event_seq, pid, step, last_value(step ignore nulls) over (partition by pid order by ts_us, event_seq rows between unbounded preceding and current row) as current_step
from silver"""),
)
def current_step(spark, d):
    rows = silver(spark, d, "event_seq", "step")
    return sequences.current_step(rows).select("event_seq", "pid", "step", "current_step")


_MARKS = """marks as (
select pid, tid, name, 'B' as ph, ts_us as t, event_seq * 2 + 1 as seq from silver where dur_us > 0 and tid is not null
union all select pid, tid, name, 'E', ts_us + dur_us, -event_seq * 2 from silver where dur_us > 0 and tid is not null)"""


def _marks(spark, d):
    return sequences.marks_of(silver(spark, d, "event_seq", "tid").filter("tid is not null"), ["pid", "tid"])


@query(
    "be_pairing",
    with_trace(
        """
select pid, tid, name, bt as start_us, t - bt as dur_us from (
  select *, lag(ph) over w bp, lag(name) over w bn, lag(t) over w bt from marks window w as (partition by pid, tid order by t, seq))
where ph = 'E' and bp = 'B' and bn = name""",
        _MARKS,
    ),
)
def be_pairing(spark, d):
    return sequences.pair_adjacent(_marks(spark, d), ["pid", "tid"])


@query(
    "stack_pairing",
    with_trace(
        """
select pid, tid, bn as name, bt as start_us, t - bt as dur_us, lv as depth from (
  select *, lag(ph) over w bp, lag(name) over w bn, lag(t) over w bt from lev where lv > 0 window w as (partition by pid, tid, lv order by t, seq))
where ph = 'E' and bp = 'B'""",
        _MARKS
        + """,
s1 as (select *, sum(case when ph = 'B' then 1 else -1 end) over (partition by pid, tid order by t, seq rows between unbounded preceding and current row) s from marks),
s2 as (select *, s - least(0, min(s) over (partition by pid, tid order by t, seq rows between unbounded preceding and current row)) dep from s1),
lev as (select *, case when ph = 'B' then dep else coalesce(lag(dep) over (partition by pid, tid order by t, seq), 0) end lv from s2)""",
    ),
)
def stack_pairing(spark, d):
    return sequences.pair_nested(_marks(spark, d), ["pid", "tid"])


@query(
    "merge_consecutive",
    with_trace(
        """
select pid, name, min(ts_us) as start_us, max(ts_us + dur_us) as end_us, count(*) as merged from (
  select *, sum(b) over (partition by pid order by ts_us, event_seq) k from (
    select *, case when lag(name) over (partition by pid order by ts_us, event_seq) = name then 0 else 1 end b from silver))
group by pid, name, k"""
    ),
)
def merge_consecutive(spark, d):
    return sequences.merge_same_name(silver(spark, d, "event_seq"), ["pid"])


@query(
    "overlap_clip",
    with_trace(
        """
select pid, event_seq, greatest(ts_us, coalesce(lag(e) over (partition by pid order by e, ts_us, event_seq), ts_us)) as start_us, e as end_us
from (select *, ts_us + dur_us e from silver where cat_fine = 'operator.UPDATE')"""
    ),
)
def overlap_clip(spark, d):
    rows = silver(spark, d, "event_seq", "cat_fine").filter("cat_fine = 'operator.UPDATE'")
    return sequences.clip_overlaps(rows, ["pid"])


_GAPS = """gaps as (select * from (
select pid, cat, event_seq, name, bn as prev_name, case when ts_us - bt - bd > bd then 10 else ts_us - bt - bd end as gap_us from (
  select *, lag(name) over w bn, lag(ts_us) over w bt, lag(dur_us) over w bd from silver where cat is not null window w as (partition by pid, cat order by ts_us, event_seq))
where bn is not null) where gap_us >= 0 and gap_us < 1000)"""


def _gaps(spark, d):
    rows = silver(spark, d, "event_seq", "cat").filter("cat is not null")
    return sequences.gap_to_previous(rows, ["pid", "cat"], 1000, F.lit(True))


@query("prev_gap", with_trace("select * from gaps", _GAPS))
def prev_gap(spark, d):
    return _gaps(spark, d)


@query("prev_gap_sequential")
def prev_gap_sequential(spark, d):
    """As prev_gap, but events that overlap the one before precede nothing."""
    rows = silver(spark, d, "event_seq", "cat").filter("cat is not null")
    return sequences.gap_sequential(rows, ["pid", "cat"], 1000, cap=True)


@query(
    "min_gap",
    with_trace(
        """
select pid, name, round(min(a), 6) as min_gap_us, arg_min(prev_name, {'a': a, 'p': prev_name}) as prev_name, count(*) as preds
from (select pid, name, prev_name, avg(gap_us) a from gaps group by all) group by pid, name""",
        _GAPS,
    ),
)
def min_gap(spark, d):
    return sequences.min_gaps(_gaps(spark, d))


@query(
    "sync_coalesce",
    with_trace(
        r"""
select pid, ts_us, array_to_string(list_sort(list_distinct(flatten(list(ids)))), '+') as ids, count(*) as merged, max(dur_us) as dur_us
from (select *, list_transform(string_split(regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1), '+'), lambda x: x::bigint) ids from silver where name like 'Comm.%.Sync')
group by pid, ts_us"""
    ),
)
def sync_coalesce(spark, d):
    rows = silver(spark, d).filter("name like 'Comm.%.Sync'")
    return sequences.coalesce_equal_times(rows, ["pid"], names.tensor_ids(F.col("name")))


_BUSY = "busy as (select pid, t, seq, sum(case when ph = 'B' then 1 else -1 end) over (partition by pid order by t, seq) busy from (select pid, ph, t, seq from marks))"
_PIDMARKS = """marks as (
select pid, name, 'B' as ph, ts_us as t, event_seq * 2 + 1 as seq from silver where dur_us > 0
union all select pid, name, 'E', ts_us + dur_us, -event_seq * 2 from silver where dur_us > 0)"""


@query("queue_length", with_trace("select pid, t as ts_us, seq, busy from busy", _PIDMARKS + ", " + _BUSY))
def queue_length(spark, d):
    return sequences.levels_in_use(silver(spark, d, "event_seq"), ["pid"])


@query("max_parallelism", with_trace("select pid, max(busy) as most from busy group by pid", _PIDMARKS + ", " + _BUSY))
def max_parallelism(spark, d):
    return sequences.most_parallel(silver(spark, d, "event_seq"), ["pid"])


@query(
    "fifo_replay",
    with_trace(
        """
select pid, event_seq, ts_us as ready_us, s + max(ts_us - (s - dur_us)) over (partition by pid order by ts_us, event_seq rows between unbounded preceding and current row) as end_us
from (select *, sum(dur_us) over (partition by pid order by ts_us, event_seq rows between unbounded preceding and current row) s from silver)"""
    ),
)
def fifo_replay(spark, d):
    return sequences.fifo_replay(silver(spark, d, "event_seq"), ["pid"])


_SPAN = "span as (select trial, min(ts_us) start_us, max(ts_us + dur_us) end_us from silver where cat = 'operator' group by trial)"


@query(
    "span_clip",
    with_trace("select event_seq, trial, name, ts_us from silver join span using (trial) where cat = 'I/O' and ts_us >= start_us and ts_us < end_us", _SPAN),
)
def span_clip(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "cat")
    span = st.spans(rows.filter("cat = 'operator'"), "trial")
    out = sequences.clip_to_span(rows.filter("cat = 'I/O'"), span, "trial")
    return out.select("event_seq", "trial", "name", "ts_us")


@query(
    "first_comm",
    with_trace(
        """
select pid, step, name, event_seq, ts_us from (
  select *, row_number() over (partition by pid, step order by ts_us, event_seq) r from silver where cat = 'Comm' and step is not null) where r = 1"""
    ),
)
def first_comm(spark, d):
    rows = silver(spark, d, "event_seq", "cat", "step").filter("cat = 'Comm' and step is not null")
    return sequences.first_after(rows.select("pid", "step", "name", "event_seq", "ts_us"), ["pid", "step"])


@query(
    "thread_numbers",
    with_trace(
        """
select pid, tid, row_number() over (partition by pid order by t, e) - 1 as number
from (select pid, tid, arg_min(ts_us, {'t': ts_us, 'e': event_seq}) t, arg_min(event_seq, {'t': ts_us, 'e': event_seq}) e from silver where tid is not null group by pid, tid)"""
    ),
)
def thread_numbers(spark, d):
    rows = silver(spark, d, "event_seq", "tid").filter("tid is not null")
    return sequences.dense_number(rows, ["pid"], "tid")


# ------------------------------------------------------------------ joins

_NODES = "nodes as (select distinct trial, string_split(i, ':')[1] as op from (select trial, unnest(inputs) i from trace))"


def dfg_nodes(spark, d):
    """Operations that some event names as its input: (trial, op)."""
    rows = st.distinct_events(table(spark, d, "trace_events"), "trial", "inputs")
    return rows.select("trial", F.explode("inputs").alias("i")).select("trial", F.substring_index("i", ":", 1).alias("op")).distinct()


@query("dfg_semi", with_trace("select event_seq, name from silver s where exists (select 1 from nodes n where n.trial = s.trial and n.op = s.op_name)", _NODES))
def dfg_semi(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "op_name").withColumnRenamed("op_name", "op")
    return rows.join(dfg_nodes(spark, d), ["trial", "op"], "left_semi").select("event_seq", "name")


@query("dfg_anti", with_trace("select event_seq, name from silver s where not exists (select 1 from nodes n where n.trial = s.trial and n.op = s.op_name)", _NODES))
def dfg_anti(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "op_name").withColumnRenamed("op_name", "op")
    return rows.join(dfg_nodes(spark, d), ["trial", "op"], "left_anti").select("event_seq", "name")


_EDGES = """edges as (select distinct trial, string_split(i, ':')[1] as src, op_name as dst
from (select trial, op_name, unnest(inputs) i from silver) where op_name is not null and string_split(i, ':')[1] <> op_name)"""


def dfg_edges(spark, d):
    """Data flow between operations: (trial, src, dst), each edge once."""
    rows = silver(spark, d, "event_seq", "trial", "op_name", "inputs").filter("op_name is not null")
    return (
        rows.select("trial", F.explode("inputs").alias("i"), F.col("op_name").alias("dst"))
        .select("trial", F.substring_index("i", ":", 1).alias("src"), "dst")
        .filter("src <> dst")
        .distinct()
    )


@query("dfg_edges", with_trace("select * from edges", _EDGES))
def edges(spark, d):
    return dfg_edges(spark, d)


@query(
    "op_inputs",
    with_trace("select trial, dst, count(*) as n, array_to_string(list_sort(list(src)), ',') as preds from edges group by trial, dst", _EDGES),
)
def op_inputs(spark, d):
    """Each operation with its predecessors."""
    return dfg_edges(spark, d).groupBy("trial", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("preds")
    )


_PAIRS = """num as (select *, row_number() over (partition by trial, pid, t, side order by ts_us, event_seq) - 1 occ from (
  select *, regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) t, string_split(name, '.')[3] side from comm_ok where regexp_matches(name, '^Comm[.][0-9+]+[.](SEND|RECV)$'))),
pairs as (select a.trial, a.pid, a.t as tensor, a.occ as occurrence, a.event_seq a_seq, a.ts_us a_us, a.dur_us a_dur, b.event_seq b_seq, b.ts_us b_us, b.dur_us b_dur
  from num a join num b on a.trial = b.trial and a.pid = b.pid and a.t = b.t and a.occ = b.occ and a.side = 'SEND' and b.side = 'RECV')"""


def _pairs(spark, d):
    rows = comm(spark, d, "trial", "event_seq").filter("name rlike '^Comm[.][0-9+]+[.](SEND|RECV)$'")
    rows = rows.withColumn("tensor", F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1))
    sends, receives = rows.filter("name like '%.SEND'"), rows.filter("name like '%.RECV'")
    return matching.same_occurrence(sends, receives, ["trial", "pid", "tensor"])


@query("send_recv_pairs", with_comm("select * from pairs", _PAIRS))
def send_recv_pairs(spark, d):
    return _pairs(spark, d)


@query(
    "recv_clip",
    with_comm(
        """select trial, pid, tensor, occurrence, a_seq, a_us, a_dur, b_seq, b_us + greatest(a_us - b_us, 0) as b_us,
  greatest(b_dur - greatest(a_us - b_us, 0), 0) as b_dur from pairs""",
        _PAIRS,
    ),
)
def recv_clip(spark, d):
    return matching.clip_receives(_pairs(spark, d))


_KERNELS = """ops as (select event_seq, pid, ts_us s, ts_us + dur_us e from silver where cat_fine = 'operator.BW' and dur_us > 0),
kernels as (select event_seq, pid, ts_us t from silver where cat = 'Comm')"""


@query(
    "kernel_map_range",
    with_trace("select o.event_seq as span_id, k.event_seq as id from ops o join kernels k on o.pid = k.pid and k.t >= o.s and k.t < o.e", _KERNELS),
)
def kernel_map_range(spark, d):
    """Communication events that start while a backward operation of their device runs."""
    rows = silver(spark, d, "event_seq", "cat", "cat_fine")
    ops = rows.filter("cat_fine = 'operator.BW'").select(
        F.col("event_seq").alias("span_id"), "pid", F.col("ts_us").alias("start_us"), F.expr("ts_us + dur_us").alias("end_us")
    )
    kernels = rows.filter("cat = 'Comm'").select(F.col("event_seq").alias("id"), "pid", F.col("ts_us").alias("at_us"))
    # a span of a day is some 5000 blocks of 2**24 us
    return matching.within_spans(kernels, ops, ["pid"], 24)


_LINK = """probe as (select event_seq as id, trial, pid, ts_us from comm_ok where name like '%.RECV'),
busy as (select trial, pid, ts_us s, ts_us + dur_us e from comm_ok where name like '%.SEND' and dur_us > 0)"""


def _link(spark, d):
    rows = comm(spark, d, "trial", "event_seq")
    probes = rows.filter("name like '%.RECV'").select(F.col("event_seq").alias("id"), "trial", "pid", "ts_us")
    spans = rows.filter("name like '%.SEND'").select("trial", "pid", F.col("ts_us").alias("start_us"), F.expr("ts_us + dur_us").alias("end_us"))
    return probes, spans


@query(
    "link_busy_antijoin",
    with_comm(
        "select id, pid from probe p where not exists (select 1 from busy b where b.trial = p.trial and b.pid = p.pid and p.ts_us - 500 < b.e and p.ts_us - 1 >= b.s)",
        _LINK,
    ),
)
def link_busy_antijoin(spark, d):
    """Receives before which nothing was sent on the device for 500 us."""
    probes, spans = _link(spark, d)
    out = matching.not_touching(probes, spans, ["trial", "pid"], F.col("ts_us") - 500, F.col("ts_us") - 1, 13)
    return out.select("id", "pid")


@query(
    "lookup_stat",
    with_trace(
        """
select n.trial, n.op, coalesce(round(s.a / 1000, 9), 0) as avg_ms from nodes n
left join (select trial, op_name, sum(dur_us) / count(*) a from silver where op_name is not null group by all) s on s.trial = n.trial and s.op_name = n.op""",
        _NODES,
    ),
)
def lookup_stat(spark, d):
    rows = silver(spark, d, "event_seq", "trial", "op_name").filter("op_name is not null")
    stats = rows.groupBy("trial", F.col("op_name").alias("op")).agg(st.ms(F.sum("dur_us") / F.count(F.lit(1))).alias("avg_ms"))
    return matching.lookup(dfg_nodes(spark, d), stats, ["trial", "op"])


@query(
    "fused_member_stats",
    with_trace(
        r"""
select g as group_name, count(*) as members, count(a) as known, round(avg(coalesce(a, 0)), 6) as avg_us from (
  select distinct g, unnest(string_split(g, '+')) m from comms where contains(g, '+'))
left join (select g as m, avg(dur_us) a from comms where not contains(g, '+') group by g) using (m) group by g""",
        "comms as (select regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1) g, dur_us from silver where regexp_matches(name, '^Comm[.][0-9+]+[.]'))",
    ),
)
def fused_member_stats(spark, d):
    """Mean of the members' own durations for each fused tensor group; unknown members count as 0."""
    rows = silver(spark, d).filter("name rlike '^Comm[.][0-9+]+[.]'").select(F.regexp_extract("name", "^Comm[.]([0-9+]+)[.]", 1).alias("g"), "dur_us")
    single = rows.filter("not contains(g, '+')").groupBy(F.col("g").alias("m")).agg(F.avg("dur_us").alias("a"))
    fused = rows.filter("contains(g, '+')").select("g").distinct().select("g", F.explode(F.split("g", "[+]")).alias("m")).distinct()
    return fused.join(single, "m", "left").groupBy(F.col("g").alias("group_name")).agg(
        F.count(F.lit(1)).alias("members"), F.count("a").alias("known"), F.round(F.avg(F.coalesce("a", F.lit(0.0))), 6).alias("avg_us")
    )


@query(
    "host_drift",
    with_trace(
        """
select trial, host, round(first(m order by host) over (partition by trial order by host rows between unbounded preceding and unbounded following) - m, 6) as drift_us
from (select trial, host, avg(ts_us + dur_us - base) m from (select *, min(ts_us) over (partition by trial) base from silver where name like 'Comm.%.Sync' and host is not null) group by trial, host)"""
    ),
)
def host_drift(spark, d):
    """Drift of each host's synchronisation times against the first host of its trial."""
    from tracequarry.operators.align import host_drift as drift

    rows = silver(spark, d, "event_seq", "trial", "host").filter("name like 'Comm.%.Sync' and host is not null")
    return drift(rows)


@query(
    "combine_trials",
    with_trace("select trial || '.' || pid as pid, name, ts_us - min(ts_us) over (partition by trial) as ts_us, dur_us, event_seq from silver where trial is not null"),
)
def combine_trials(spark, d):
    """All trials in one trace: devices prefixed, times from each trial's start."""
    rows = silver(spark, d, "event_seq", "trial").filter("trial is not null")
    start = rows.groupBy("trial").agg(F.min("ts_us").alias("t0"))
    return rows.join(start, "trial").select(F.concat_ws(".", "trial", "pid").alias("pid"), "name", (F.col("ts_us") - F.col("t0")).alias("ts_us"), "dur_us", "event_seq")


@query(
    "set_diff",
    """with t as (select distinct name from trace_events where name is not null), c as (select distinct name from comm_events where name is not null)
select name, 'trace' as only_in from (select name from t except select name from c) union all select name, 'comm' from (select name from c except select name from t)
union all select name, 'both' from (select name from t intersect select name from c)""",
)
def set_diff(spark, d):
    """Names of one table only, and of both."""
    t, c = (table(spark, d, x).select("name").filter("name is not null") for x in ("trace_events", "comm_events"))
    return (
        t.subtract(c).withColumn("only_in", F.lit("trace"))
        .union(c.subtract(t).withColumn("only_in", F.lit("comm")))
        .union(t.intersect(c).withColumn("only_in", F.lit("both")))
    )


@query(
    "longest_per_device",
    with_trace("select pid, event_seq, name, dur_us, rnk from (select pid, event_seq, name, dur_us, row_number() over (partition by pid order by dur_us desc, event_seq) as rnk from silver) where rnk <= 10"),
)
def longest_per_device(spark, d):
    rows = silver(spark, d, "event_seq")
    return matching.share_ranked(rows, ["pid"], 10).select("pid", "event_seq", "name", "dur_us", "rnk")


typed(
    ORACLES,
    {
        "stack_pairing": {"depth": "bigint"},
        "queue_length": {"busy": "bigint"},
        "max_parallelism": {"most": "bigint"},
        "fifo_replay": {"end_us": "bigint"},
        "thread_numbers": {"number": "integer"},
        "longest_per_device": {"rnk": "integer"},
    },
)
