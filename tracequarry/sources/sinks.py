"""Writers of traces, statistics and graphs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.chunks import global_number
from tracequarry.session import stored


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, partitioned by the given columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def chrome_events(events: DataFrame) -> DataFrame:
    """Events in the form of a Chrome trace, one JSON text each, ordered by device and thread."""
    e = F.struct(
        F.lit("X").alias("ph"), "name", F.col("ts_us").alias("ts"), F.col("dur_us").alias("dur"), "pid",
        *[F.col(c) for c in ("tid", "cat", "args") if c in events.columns],
    )
    order = [c for c in ("pid", "tid", "ts_us") if c in events.columns]
    return events.orderBy(*order).select(F.to_json(e).alias("value"))


def write_chrome_lines(events: DataFrame, path: str) -> None:
    """One event a line, in parallel; readers of traces take it as a list framed by line."""
    chrome_events(events).write.mode("overwrite").text(path)


def write_chrome_file(events: DataFrame, path: str, unit: str = "ms") -> int:
    """One file for a trace viewer; rows stream through the driver partition by partition."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"traceEvents": [\n')
        for row in chrome_events(events).toLocalIterator():
            f.write((",\n" if n else "") + row["value"])
            n += 1
        f.write(f'\n], "displayTimeUnit": {json.dumps(unit)}}}\n')
    return n


def painted(events: DataFrame, label: Column) -> DataFrame:
    """The timeline with each event's name replaced by a label."""
    return events.withColumn("name", label)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per sheet, sorted by its first column over its files."""
    for name, df in sheets.items():
        df.orderBy(df.columns[0]).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_gml(edges: DataFrame, path: str) -> None:
    """A graph as GML text; nodes and edges are numbered where they are and stream through the driver."""
    links = edges.select("src", "dst").distinct()
    ends = links.select(F.col("src").alias("name")).union(links.select("dst")).distinct()
    ids = stored(global_number(ends, "name", "id"))
    of = lambda side: ids.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id"))
    numbered = links.join(of("src"), "src").join(of("dst"), "dst").orderBy("src", "dst")
    with open(path, "w", encoding="utf-8") as f:
        f.write("graph [\n  directed 1\n")
        for r in ids.orderBy("id").toLocalIterator():
            f.write(f'  node [ id {r["id"]} label "{r["name"]}" ]\n')
        for r in numbered.toLocalIterator():
            f.write(f"  edge [ source {r['src_id']} target {r['dst_id']} ]\n")
        f.write("]\n")


def write_dot(edges: DataFrame, path: str) -> None:
    """A graph as DOT text; edges stream through the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("digraph {\n")
        for r in edges.select("src", "dst").distinct().orderBy("src", "dst").toLocalIterator():
            f.write(f'  "{r["src"]}" -> "{r["dst"]}";\n')
        f.write("}\n")


def cluster_lines(groups: DataFrame) -> DataFrame:
    """``operation cluster`` lines of a fusion plan."""
    return groups.select(F.concat_ws(" ", "node", "cluster").alias("value"))


def group_json(groups: DataFrame) -> DataFrame:
    """Tensor groups as one JSON text per group: members in order."""
    return groups.groupBy("group_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("tensor")).alias("members"))).alias("value"))


def print_stats(stats: DataFrame, head: int = 20) -> None:
    """The slowest operations first, as a table on the console."""
    stats.orderBy(F.desc("avg_ms")).limit(head).show(head, truncate=60)
