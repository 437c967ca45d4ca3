"""Chrome trace files: readers, and the cleaning of computation, I/O and communication events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import names

EVENT = (
    "ph string, name string, pid string, tid string, ts double, dur double, cat string, args map<string,string>"
)
#: Bronze columns: one row per event with the file and its place in the hierarchy.
COLUMNS = ["trial", "host", "rank", "path", "pos", "ph", "name", "pid", "tid", "ts_us", "dur_us", "cat", "args"]


def hierarchy(path: Column) -> tuple[Column, Column, Column]:
    """Trial, host and rank from ``…/trial/host/rank/file``; rank null where it is no number."""
    parts = F.split(path, "/")
    at = lambda i: F.get(parts, F.size(parts) - i)
    return at(4), at(3), at(2).try_cast("int")


def _events(df: DataFrame) -> DataFrame:
    path = F.col("path")
    trial, host, rank = hierarchy(path)
    us = lambda c: F.round(F.col(f"e.{c}")).try_cast("bigint")
    return df.select(
        trial.alias("trial"), host.alias("host"), rank.alias("rank"), path, "pos", "e.ph", "e.name", "e.pid", "e.tid",
        us("ts").alias("ts_us"), us("dur").alias("dur_us"), "e.cat", "e.args",
    )


def read_traces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of trace files: an object with ``traceEvents`` or a bare list, plain or compressed.

    Whole files are read as text, so both forms go through one plan; files
    are the unit of parallelism. Files that are neither give no rows (see
    ``unreadable``). Member values of args are kept as text.
    """
    text = spark.read.text(paths, wholetext=True).select(F.col("value").alias("raw"), F.input_file_name().alias("path"))
    as_object = F.from_json("raw", f"traceEvents array<struct<{_struct()}>>")["traceEvents"]
    as_list = F.from_json("raw", f"array<struct<{_struct()}>>")
    listed = F.ltrim("raw").startswith("[")
    return _events(text.select("path", F.posexplode(F.when(listed, as_list).otherwise(as_object)).alias("pos", "e")))


def read_trace_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of trace files that hold one event a line, bare or framed as a list or as ``traceEvents``.

    Files of any size are split over tasks, which whole files can't be; ``pos``
    is then a number that rises within a file's lines, not the place. Lines
    that hold no event (brackets, the frame, cut-off ones) give no rows.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("raw"))
    head = F.regexp_replace("raw", r"^(\{\s*\"traceEvents\"\s*:\s*)?\[|^,", "")
    body = F.regexp_replace(head, r"[,\]\s]+$", "")
    rows = lines.select("path", "pos", F.from_json(body, f"struct<{_struct()}>").alias("e"))
    return _events(rows.filter("e.ph is not null or e.name is not null"))


def _struct() -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in EVENT.split(", ")))


def unreadable(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files without a list of events: (source, reason)."""
    text = spark.read.text(paths, wholetext=True).select(F.col("value").alias("raw"), F.input_file_name().alias("source"))
    found = F.coalesce(
        F.from_json("raw", f"traceEvents array<struct<{_struct()}>>")["traceEvents"].isNotNull(), F.lit(False)
    ) | (F.ltrim("raw").startswith("[") & F.from_json("raw", f"array<struct<{_struct()}>>").isNotNull())
    return text.filter(~found).select("source", F.lit("no trace events").alias("reason"))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a name and a time (metadata needs no time), and the others with the reason."""
    bad = F.when(F.col("name").isNull(), "no name").when(F.col("ts_us").isNull() & (F.col("ph") != "M"), "no time")
    rows = events.withColumn("reason", bad)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def resolve_names(events: DataFrame) -> DataFrame:
    """Complete events with the names of their process and thread from the metadata rows."""
    key = ["path", "pid"]
    meta = events.filter("ph = 'M'")
    label = F.col("args")["name"]
    process = meta.filter("name = 'process_name'").groupBy(*key).agg(F.max(label).alias("process"))
    thread = meta.filter("name = 'thread_name'").groupBy(*key, "tid").agg(F.max(label).alias("thread"))
    return events.filter("ph = 'X'").join(process, key, "left").join(thread, [*key, "tid"], "left")


def computation(events: DataFrame, dfg: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """GPU operations of a TensorFlow trace, named and numbered: trial, host, rank, pid, tid, name, ts_us, dur_us, step, cat.

    Kept are events of GPU processes on operation threads whose standard name
    is a node of ``dfg`` (trial, op); with ``keep_unknown`` the others stay as
    category ``debug``. Threads are numbered by their first event.
    """
    from pyspark.sql import Window

    from tracequarry.operators.models import tf_standard_name

    rows = resolve_names(events).filter("process like '%/device:GPU%' and thread like '%TensorFlow Ops%'")
    long = F.regexp_replace(F.substring_index(F.col("args")["long_name"], ":", 1), "^StatefulPartitionedCall/", "")
    op = F.coalesce(long, F.col("name"))
    rows = rows.withColumn("op", op).withColumn("step", F.col("args")["group_id"].try_cast("int"))
    known = dfg.select("trial", F.col("op").alias("op")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, ["trial", "op"], "left").filter("not contains(op, 'Comm')")
    if not keep_unknown:
        rows = rows.filter("known")
    first = rows.groupBy("path", "pid", "tid").agg(F.min("ts_us").alias("t"))
    number = F.row_number().over(Window.partitionBy("path", "pid").orderBy("t", "tid")) - 1
    tid = first.withColumn("thread_no", number).drop("t")
    standard = tf_standard_name(F.col("op"), F.lit(False), F.lit(False))
    return rows.join(tid, ["path", "pid", "tid"]).select(
        "trial", "host", "rank", F.concat_ws(".", "host", F.concat(F.lit("rank"), "rank")).alias("pid"),
        F.concat(F.lit("operator"), "thread_no").alias("tid"), standard.alias("name"),
        "ts_us", "dur_us", "step", F.when(F.col("known"), "operator").otherwise("debug").alias("cat"),
    )


def io_events(events: DataFrame, span: DataFrame) -> DataFrame:
    """I/O events within the computation's span (trial, host, rank, start_us, end_us); the thread is ``I/O`` unless given."""
    rows = events.filter("ph = 'X'").join(span, ["trial", "host", "rank"]).filter("ts_us >= start_us and ts_us < end_us")
    return rows.withColumn("tid", F.coalesce("tid", F.lit("I/O"))).drop("start_us", "end_us")


def comm_detail(events: DataFrame) -> DataFrame:
    """SEND and RECV events with sorted tensor ids and the suffix loop_channel_chunk_slice."""
    plain = F.regexp_replace("name", "<<[0-9]+>>", "")
    found = F.regexp_extract(plain, "([^.]+[.][0-9+]+[.](?:SEND|RECV))", 1)
    rows = events.filter("lower(ph) <> 'i'").withColumn("std", found).filter("std <> ''")
    arg = lambda k: F.col("args")[k].try_cast("int")
    ids = names.sorted_tensors(F.element_at(F.split("std", "[.]"), 2))
    return rows.select(
        "trial", "host", "rank", F.concat(F.lit("Comm."), ids, F.lit("."), F.element_at(F.split("std", "[.]"), 3)).alias("name"),
        F.concat_ws("_", arg("loopId"), arg("channelId"), arg("chunkId"), arg("sliceId")).alias("suffix"), "ts_us", "dur_us",
    )


def horovod(events: DataFrame) -> DataFrame:
    """Spans of a Horovod timeline, begin and end paired last in first out per process.

    Metadata rows name each process by its tensor; synchronisations of one
    time become one event of all their tensors.
    """
    from tracequarry.operators.sequences import coalesce_equal_times, pair_nested

    meta = events.filter("ph = 'M' and name = 'process_name'").groupBy("path", "pid").agg(F.max(F.col("args")["name"]).alias("process"))
    marks = events.filter("ph in ('B', 'E')").withColumn("name", F.coalesce("name", F.lit(""))).withColumnRenamed("pos", "seq")
    spans = pair_nested(marks, ["path", "pid"]).join(meta, ["path", "pid"], "left").filter("name <> 'input_barrier'")
    spans = spans.withColumn("tensor", F.regexp_extract("process", "([0-9]+(?:[_+][0-9]+)*)$", 1))
    ids = F.transform(F.split(F.translate("tensor", "_", "+"), "[+]"), lambda x: x.try_cast("bigint"))
    sync = F.col("name").contains("NEGOTIATE") | F.col("process").contains("Sync")
    merged = coalesce_equal_times(
        spans.filter(sync).withColumnRenamed("start_us", "ts_us"), ["path"], F.filter(ids, lambda x: x.isNotNull())
    )
    others = spans.filter(~sync).select(
        "path", F.concat(F.lit("Comm."), names.sorted_tensors(F.translate("tensor", "_", "+")), F.lit("."), "name").alias("name"), F.col("start_us").alias("ts_us"), "dur_us"
    )
    return others.unionByName(merged.select("path", F.concat(F.lit("Comm."), "ids", F.lit(".Sync")).alias("name"), "ts_us", "dur_us"))


def nearest_file(spark: SparkSession, root: str, name: str) -> str | None:
    """Path of the file of that name that lies least deep below ``root``; null if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    first = found.select("path").orderBy(F.size(F.split("path", "/")), "path").limit(1).collect()
    return first[0]["path"] if first else None


def mxnet_computation(events: DataFrame) -> DataFrame:
    """Operations of an MXNet trace: (path, pid, cycle, name, start_us, dur_us).

    Of the first process of each file, begins directly followed by their end
    are paired; operations named ``…_fwd`` and ``…_backward`` are forward and
    backward. What runs after forward operations is the output (one span per
    cycle), what runs after backward ones is an update, numbered in its cycle;
    a cycle starts with the first forward operation after backward ones.
    """
    from tracequarry.operators.models import mx_standard_name
    from tracequarry.operators.ordered import running
    from tracequarry.operators.sequences import pair_adjacent

    key = ["path", "pid"]
    first = events.groupBy("path").agg(F.min("pid").alias("pid"))
    marks = events.join(first, key).filter("ph in ('B', 'E') and name is not null").withColumnRenamed("pos", "seq")
    spans = pair_adjacent(marks, key).withColumn("kind", F.when(F.col("name").contains("_backward"), "BW").when(F.col("name").contains("_fwd"), "FW"))
    spans = running(spans, key, "start_us", ["name"], {"phase": ("last", F.col("kind")), "before": ("lag", F.col("kind"))})
    spans = running(spans, key, "start_us", ["name"], {"was": ("lag", F.col("phase"))})
    turn = F.when((F.col("kind") == "FW") & (F.col("was") == "BW"), 1).otherwise(0).cast("bigint")
    spans = running(spans, key, "start_us", ["name"], {"cycle": ("sum", turn)})
    update = F.when(F.col("kind").isNull() & (F.col("phase") == "BW"), 1).otherwise(0).cast("bigint")
    spans = running(spans, [*key, "cycle"], "start_us", ["name"], {"n": ("sum", update)})
    cols = [*key, "cycle", "name", "start_us", "dur_us"]
    named = spans.filter("kind is not null").withColumn("name", mx_standard_name(F.col("name"))).select(*cols)
    updates = spans.filter("kind is null and phase = 'BW'").withColumn("name", F.concat(F.lit("UPDATE_."), F.col("n") - 1)).select(*cols)
    out = spans.filter("kind is null and phase = 'FW'").groupBy(*key, "cycle").agg(
        F.min("start_us").alias("start_us"), F.max(F.expr("start_us + dur_us")).alias("end_us")
    )
    out = out.select(*key, "cycle", F.lit("OUTPUT0").alias("name"), "start_us", (F.col("end_us") - F.col("start_us")).alias("dur_us"))
    return named.unionByName(updates).unionByName(out)
