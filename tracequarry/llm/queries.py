"""Queries of the text and matching problems, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import encode, nearest_time, packing, percentiles, quality
from tracequarry.session import cut, table

TOLERANCE_US = 400
STATE_BITS = 11


def _rounded(df: DataFrame) -> DataFrame:
    cols = [F.round(c, 3).alias(c) if c.startswith("p") else F.col(c) for c in df.columns]
    return df.select(*cols).withColumnRenamed("grp", "name")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per name and per name and day."""
    states = percentiles.value_states(table(spark, d, "trace_events"), "name", "dur_us", "event_seq", "ts_us")
    return _rounded(percentiles.percentiles(states))


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per name and day from compact states, those of all days combined from the days' states."""
    states = percentiles.value_states(
        table(spark, d, "trace_events"), "name", "dur_us", "event_seq", "ts_us", STATE_BITS
    )
    return _rounded(percentiles.percentiles(states, bits=STATE_BITS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    entity = F.expr(f"concat(trial, '/', {nearest_time.tensor_set()})")
    sends = (
        table(spark, d, "comm_events")
        .filter("name like '%.SEND' and dur_us >= 0")
        .select("event_seq", F.expr("try_add(ts_us, dur_us)").alias("ended"), entity.alias("entity"))
    )
    served = table(spark, d, "server_events").select("event_seq", "ts_us", entity.alias("entity"))
    found = nearest_time.match_nearest(sends, served, "entity", "ended", "ts_us", "event_seq", "event_seq", TOLERANCE_US)
    return found.select(F.col("left_id").alias("comm_seq"), F.col("right_id").alias("server_seq"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), vocabulary=encode.vocabulary_from_env())


def _packed(spark: SparkSession, d: str, report: bool = False) -> DataFrame:
    sizes = cut(p8_ids(spark, d).select("doc_id", F.size("ids").cast("bigint").alias("n")))
    return packing.pack_items(sizes, table(spark, d, "pack_bins"), "doc_id", "n", report=report)


def p9_bins(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item_id", "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are, and what the search has saved."""
    return packing.fill_report(cut(_packed(spark, d, True)))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    words = quality.word_list(table(spark, d, "common_words"))
    return quality.text_quality(table(spark, d, "documents"), words)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).filter("not is_prose").select("doc_id")


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_combined": p2_combined,
    "p4_found": p4_found,
    "p8_ids": p8_ids,
    "p9_bins": p9_bins,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_quality": p10_quality,
}

_P2 = """
with e as (select distinct on (event_seq) name, {value} as v,
                  date '1970-01-01' + cast(floor(ts_us / 86400000000) as integer) as d
           from trace_events where name is not null and dur_us is not null and event_seq is not null),
l as (select name, 'all' as level, null::date as day, v from e
      union all select name, 'day', d, v from e where d is not null)
select name, level, day, count(*) as n,
       round(quantile_cont(v, 0.5), 3) as p50, round(quantile_cont(v, 0.9), 3) as p90,
       round(quantile_cont(v, 0.99), 3) as p99, round(quantile_cont(v, 0.999), 3) as p999,
       {error} as error_bound
from l group by name, level, day"""

_WIDTH = f"greatest(length(bin(abs(dur_us))) - {STATE_BITS}, 0)"
_MIDDLE = (
    f"case when {_WIDTH} = 0 then dur_us else sign(dur_us)::bigint * "
    f"((((abs(dur_us) >> {_WIDTH})) << {_WIDTH}) + (1::bigint << greatest({_WIDTH} - 1, 0))) end"
)

_TENSORS = "array_to_string(list_sort(list_distinct(string_split(regexp_extract(name, '^Comm[.]([0-9+]+)[.]', 1), '+'))), '+')"

ORACLES = {
    "p2_percentiles": _P2.format(value="dur_us", error="0.0::double"),
    "p2_combined": _P2.format(value=_MIDDLE, error=f"{2.0**-STATE_BITS}::double"),
    "p4_found": f"""
with s as (select distinct event_seq, trial, ts_us + dur_us t, {_TENSORS} k from comm_events
           where name like '%.SEND' and dur_us >= 0 and ts_us is not null),
o as (select distinct event_seq, trial, ts_us t, {_TENSORS} k from server_events where ts_us is not null),
j as (select s.event_seq cs, o.event_seq os, abs(s.t - o.t) d from s join o
      on s.trial = o.trial and s.k = o.k and s.t between o.t - {TOLERANCE_US} and o.t + {TOLERANCE_US})
select cs as comm_seq, os as server_seq
from (select *, row_number() over (partition by os order by d, cs) r from j) where r = 1""",
}
