"""Operation metadata, gradient lists, topologies and graph files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TENSOR = "array<struct<name: string, shape: array<bigint>, dtype: string>>"


def op_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Operations of a metadata.json: (op, type, input, output); dots in names become underscores."""
    text = spark.read.text(path, wholetext=True).select(F.translate("value", ".", "_").alias("v"))
    ops = F.from_json("v", f"map<string, struct<op: string, input: {_TENSOR}, output: {_TENSOR}>>")
    return text.select(F.explode(ops).alias("op", "x")).select("op", F.col("x.op").alias("type"), "x.input", "x.output")


def variable_graph(ops: DataFrame) -> DataFrame:
    """Edges from variables to the operations that read them and from operations to those they write: (src, dst)."""
    reads = ops.select(F.explode("input").alias("t"), F.col("op").alias("dst")).select(F.substring_index("t.name", ":", 1).alias("src"), "dst")
    writes = ops.select(F.col("op").alias("src"), F.explode("output").alias("t")).select("src", F.substring_index("t.name", ":", 1).alias("dst"))
    return reads.unionByName(writes).filter("src <> dst").distinct()


def graph_def(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a graph definition in JSON: (src, dst)."""
    text = spark.read.text(path, wholetext=True)
    nodes = F.from_json("value", "node array<struct<name: string, op: string, input: array<string>>>")["node"]
    rows = text.select(F.explode(nodes).alias("n")).select(F.col("n.name").alias("dst"), F.explode("n.input").alias("i"))
    return rows.select(F.regexp_replace(F.substring_index("i", ":", 1), "^[\\^]", "").alias("src"), "dst").distinct()


def symbol_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a symbol listing whose blocks start with ``Op:`` and list ``arg[i]=name`` inputs: (src, dst)."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.split("value", r"-{5,}\s*\n?")).alias("b"))
    name = F.regexp_extract("b", r"Name=(\S+)", 1)
    inputs = F.regexp_extract_all("b", F.lit(r"arg\[\d+\]=([^\s(]+)"), 1)
    return blocks.select(name.alias("dst"), F.explode(inputs).alias("src")).filter("dst <> ''").select("src", "dst")


def gradients(spark: SparkSession, path: str) -> DataFrame:
    """Gradients ``name;shape=(…);dtype=…`` of a gradient list: (pos, name, shape, dtype)."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "gradient_name_list array<string>")["gradient_name_list"]
    rows = text.select(F.posexplode(listed).alias("pos", "g"))
    dims = F.regexp_extract_all(F.regexp_extract("g", r"shape=\(([^)]*)\)", 1), F.lit(r"(-?\d+)"), 1)
    return rows.select(
        "pos", F.substring_index("g", ";", 1).alias("name"), F.transform(dims, lambda d: d.cast("bigint")).alias("shape"), F.regexp_extract("g", r"dtype=([^;]+)", 1).alias("dtype")
    )


def _topology(spark: SparkSession, path: str, member: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"{member} map<string, string>")[member]).alias("channel", "text"))


def transport(text: Column) -> Column:
    return (
        F.when(text.contains("NET"), "network").when(text.contains("direct shared memory"), "shared memory").when(text.contains("P2P"), "peer").otherwise("other")
    )


def rings(spark: SparkSession, path: str) -> DataFrame:
    """Links of the rings ``3[3000] -> 0[2000] … via …``: (channel, rank, next_rank, transport)."""
    link = F.explode(F.split("text", r",(?=\s*\d+\[)")).alias("l")
    rows = _topology(spark, path, "RealRing").select("channel", link)
    end = lambda i: F.regexp_extract("l", r"(\d+)\[\d+\]\s*->\s*(\d+)\[\d+\]", i).try_cast("int")
    return rows.select(F.col("channel").try_cast("int").alias("channel"), end(1).alias("rank"), end(2).alias("next_rank"), transport(F.col("l")).alias("transport")).filter("rank is not null")


def trees(spark: SparkSession, path: str) -> DataFrame:
    """Places in the trees ``[c] d/d/d->r->u|…``: (channel, rank, parent, children); -1 stands for none.

    The first half of each entry names the children below, the rank and the
    parent above it.
    """
    entries = F.regexp_extract_all("text", F.lit(r"(\[\d+\]\s*[-\d/]+->-?\d+->[-\d/]+)"), 1)
    rows = _topology(spark, path, "Tree").select(F.explode(entries).alias("e"))
    x = lambda i: F.regexp_extract("e", r"\[(\d+)\]\s*([-\d/]+)->(-?\d+)->(-?\d+)", i)
    children = F.filter(F.transform(F.split(x(2), "/"), lambda d: d.try_cast("int")), lambda d: d >= 0)
    return rows.select(
        x(1).cast("int").alias("channel"), x(3).cast("int").alias("rank"), F.nullif(x(4).try_cast("int"), F.lit(-1)).alias("parent"), children.alias("children")
    )


def _gml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["value"]):
            label = {}
            for block in re.findall(r"node\s*\[(.*?)\]", text, re.S):
                ident, name = re.search(r"\bid\s+(\d+)", block), re.search(r'\blabel\s+"([^"]*)"', block)
                if ident:
                    label[ident[1]] = name[1] if name else ident[1]
            for block in re.findall(r"edge\s*\[(.*?)\]", text, re.S):
                a, b = re.search(r'\bsource\s+"?([^"\s]+)', block), re.search(r'\btarget\s+"?([^"\s]+)', block)
                weight = re.search(r"\bweight\s+([-\d.eE+]+)", block)
                if a and b:
                    rows.append((path, label.get(a[1], a[1]), label.get(b[1], b[1]), float(weight[1]) if weight else None))
        yield pd.DataFrame(rows, columns=["path", "src", "dst", "weight_ms"])


def gml_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of GML graphs by the labels of their nodes: (path, src, dst, weight_ms)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.mapInPandas(_gml, "path string, src string, dst string, weight_ms double")
