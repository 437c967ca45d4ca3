"""Text logs of parameter servers, key tables, compiler candidates and kernel data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators.ordered import running


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.trim("value").alias("line"), F.input_file_name().alias("path")).filter("line <> ''")


def _flag(c: Column) -> Column:
    return F.lower(c) == "true"


def transfer_log(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows ``ts is_start is_push is_req key sender receiver`` of transfer logs, and the malformed ones.

    Header lines (``role=…, id=…``) give the file's node id; a row must have
    seven parts and numbers where numbers belong.
    """
    lines = _lines(spark, paths)
    header = lines.filter("line rlike '^role='").groupBy("path").agg(
        F.max(F.regexp_extract("line", r"role=\s*([^,\s]+)", 1)).alias("role"), F.max(F.regexp_extract("line", r"id=\s*(\d+)", 1).try_cast("int")).alias("node_id")
    )
    parts = F.split("line", r"\s+")
    p = lambda i: F.get(parts, F.lit(i))
    rows = lines.filter("not line rlike '^role='").select(
        "path", "line", F.size(parts).alias("n"), p(0).try_cast("bigint").alias("ts_us"), _flag(p(1)).alias("is_start"), _flag(p(2)).alias("is_push"),
        _flag(p(3)).alias("is_req"), p(4).try_cast("bigint").alias("key"), p(5).try_cast("int").alias("sender"), p(6).try_cast("int").alias("receiver"),
    )
    ok = "n = 7 and ts_us is not null and key is not null and sender is not null and receiver is not null"
    bad = rows.filter(f"not coalesce({ok}, false)").select(F.col("path").alias("source"), F.col("line").alias("raw"), F.lit("malformed").alias("reason"))
    return rows.filter(ok).drop("n", "line").join(header, "path", "left"), bad


def server_log(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows ``ts: start|stop, key, op[, tid]`` of server logs (thread 0 unless given, INIT left out), and the malformed ones."""
    head = r"^(\d+)\s*:\s*(start|stop|B|E)\s*,\s*(\d+)\s*,\s*(\w+)(?:\s*,\s*(\d+))?\s*$"
    lines = _lines(spark, paths)
    x = lambda i: F.regexp_extract("line", head, i)
    ok = lines.filter(F.col("line").rlike(head)).select(
        "path", x(1).cast("bigint").alias("ts_us"), F.when(x(2).isin("start", "B"), "B").otherwise("E").alias("ph"), x(3).cast("bigint").alias("key"),
        x(4).alias("op"), F.coalesce(x(5).try_cast("int"), F.lit(0)).alias("tid"),
    )
    bad = lines.filter(~F.col("line").rlike(head)).select(F.col("path").alias("source"), F.col("line").alias("raw"), F.lit("malformed").alias("reason"))
    return ok.filter("op not like '%INIT%'"), bad


def key_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tensors by key from ``name: key key …``; several keys are the parts of one tensor (``name~PARTi``)."""
    lines = _lines(spark, paths).filter("line rlike ':'")
    keys = F.filter(F.transform(F.split(F.substring_index("line", ":", -1), r"\s+"), lambda k: k.try_cast("bigint")), lambda k: k.isNotNull())
    name = F.regexp_extract("line", r"^(.*):[^:]*$", 1)
    rows = lines.select(F.trim(name).alias("name"), keys.alias("keys")).select("name", F.size("keys").alias("n"), F.posexplode("keys").alias("part", "key"))
    return rows.select("key", F.when(F.col("n") > 1, F.concat("name", F.lit("~PART"), "part")).otherwise(F.col("name")).alias("tensor"))


def pair_by_number(marks: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th start of a key with its n-th end, each in order of time: (keys, iter, start_us, end_us)."""
    rows = running(marks, [*keys, "ph"], "ts_us", [], {"iter": ("sum", F.lit(1).cast("bigint"))})
    rows = rows.withColumn("iter", F.col("iter") - 1)
    begin = rows.filter("ph = 'B'").select(*keys, "iter", F.col("ts_us").alias("start_us"))
    end = rows.filter("ph = 'E'").select(*keys, "iter", F.col("ts_us").alias("end_us"))
    return begin.join(end, [*keys, "iter"])


def profile_window(rows: DataFrame, keys: list[str], start: int = 10, duration: int = 10, shifted: str = "false") -> DataFrame:
    """Occurrences ``start … start + duration - 1`` of each key; one later where ``shifted`` holds."""
    at = F.expr(f"iter - if({shifted}, 1, 0)")
    return rows.filter((at >= start) & (at < start + duration))


def candidate_ops(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Compiler candidates: (id, op) before the marker line, dependencies (src, dst) behind it."""
    text = spark.read.text(path, wholetext=True).select("value")
    half = lambda i: F.explode(F.split(F.get(F.split("value", "unsafe_resource_deps_[^\n]*\n?"), F.lit(i)), "\n")).alias("line")
    ops = text.select(half(0)).filter("trim(line) <> ''").select(F.regexp_extract("line", r"\s(\d+)\s*$", 1).try_cast("int").alias("id"), F.substring_index(F.trim("line"), " ", 1).alias("op"))
    deps = text.select(half(1)).filter(r"line rlike '^\\s*\\d+\\s+\\d+'").select(F.split(F.trim("line"), r"\s+").alias("x"))
    deps = deps.select(F.col("x")[0].cast("int").alias("a"), F.col("x")[1].cast("int").alias("b"))
    name = lambda side, out: ops.select(F.col("id").alias(side), F.col("op").alias(out))
    return ops, deps.join(name("a", "src"), "a").join(name("b", "dst"), "b").select("src", "dst")


def kernel_labels(spark: SparkSession, path: str) -> DataFrame:
    """Measured kernel times ``id: time``."""
    lines = _lines(spark, path).select(F.split("line", r"\s*:\s*").alias("x"))
    return lines.select(F.col("x")[0].alias("sample"), F.try_element_at("x", F.lit(2)).try_cast("double").alias("label")).filter("label is not null")


def kernel_features(spark: SparkSession, path: str) -> DataFrame:
    """Operations of fused kernels: first line ``fusion_type,hash``, then one operation a line.

    (path, kernel_type, kernel_hash, pos, op, opcode, out_type, out_dims, op_hash)
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim("value"), "\n").alias("l"))
    rows = text.select("path", F.split(F.col("l")[0], ",").alias("h"), F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("pos", "line"))
    x = F.split("line", ",")
    last = lambda i: F.get(x, F.size(x) - i)
    return rows.select(
        "path", F.col("h")[0].alias("kernel_type"), F.col("h")[1].alias("kernel_hash"), "pos", F.get(x, F.lit(0)).alias("op"), F.get(x, F.lit(1)).alias("opcode"),
        last(3).alias("out_type"), F.transform(F.split(last(2), ":"), lambda d: d.try_cast("bigint")).alias("out_dims"), F.trim(last(1)).alias("op_hash"),
    )


def average_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks ``<tool> <precision> BS=<n>:`` with a list of means and one of variances: (precision, batch, pos, avg, var)."""
    text = spark.read.text(path, wholetext=True).select("value")
    block = F.explode(F.regexp_extract_all("value", F.lit(r"(\w+\s+\w+\s+BS=\d+:\s*\[[^\]]*\]\s*\[[^\]]*\])"), 1)).alias("b")
    lists = F.regexp_extract_all("b", F.lit(r"\[([^\]]*)\]"), 1)
    numbers = lambda i: F.transform(F.split(F.get(lists, F.lit(i)), r"[,\s]+"), lambda v: v.try_cast("double"))
    rows = text.select(block).select(
        F.regexp_extract("b", r"\w+\s+(\w+)\s+BS", 1).alias("precision"), F.regexp_extract("b", r"BS=(\d+)", 1).cast("int").alias("batch"),
        F.arrays_zip(numbers(0).alias("avg"), numbers(1).alias("var")).alias("z"),
    )
    return rows.select("precision", "batch", F.posexplode("z").alias("pos", "z")).select("precision", "batch", "pos", "z.avg", "z.var").filter("avg is not null")


def stable(blocks: DataFrame, least_batch: int = 4, spread: float = 0.2) -> DataFrame:
    """Measurements of larger batches with a small relative deviation."""
    return blocks.filter(f"batch > {least_batch} and avg > 0 and sqrt(var) / avg <= {spread}")


def gpu_trace_text(spark: SparkSession, path: str) -> DataFrame:
    """Stream and kernel of the fixed-width lines of a GPU profiler's text output."""
    lines = spark.read.text(path).select(F.col("value").alias("v")).filter("length(v) > 170")
    return lines.select(F.substring("v", 163, 7).try_cast("int").alias("stream"), F.trim(F.substring("v", 171, 10_000)).alias("kernel")).filter("stream is not null")
