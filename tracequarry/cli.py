"""Command line: ``python -m tracequarry.cli OPTION PATH [--option value …]`` or ``--config FILE``.

PATH is a folder of the trace tables (Parquet) or of raw trace files
(``trial/host/rank/*.json[.gz]``). A YAML file may hold the same options; in
it ``{{path}}`` stands for PATH.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import graph, kernels, models, reports, sequences
from tracequarry.operators import statistics as st
from tracequarry.sources import chrome, sinks

OPTIONS = [
    "statistic", "iterations", "straggler", "gap", "compare", "combine", "collect", "critical", "replay", "delays",
    "bottleneck", "topo_sort", "optimize", "phases", "timeline", "graph", "mapping",
]
#: Other results of an option.
SUB_OPTIONS = {
    "statistic": ["category", "top", "sheets", "first"],
    "replay": ["computation", "communication", "compare", "partial"],
    "optimize": ["fusion", "all"],
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tracequarry", description="Analyses traces of distributed training jobs.")
    p.add_argument("option", nargs="?", choices=OPTIONS)
    p.add_argument("path", nargs="?")
    p.add_argument("--sub", default=None, help="another result of the option: " + "; ".join(f"{k}: {', '.join(v)}" for k, v in SUB_OPTIONS.items()))
    p.add_argument("--config", help="YAML file with the same options")
    p.add_argument("--head", type=int, default=20, help="rows to show")
    p.add_argument("--filter", default=None, help="keep operations whose name contains this")
    p.add_argument("--trials", default=None, help="two trials to compare, as a,b")
    p.add_argument("--output", default=None, help="folder for the result (Parquet), or file for timeline")
    p.add_argument("--rounds", type=int, default=10, help="rounds of the search")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--full-trace", action="store_true", help="keep events without a duration in replays")
    p.add_argument("--longest-gap", type=int, default=1000, help="gaps of so many us and more are pauses")
    p.add_argument("--delay-ratio", type=float, default=1.1)
    return p


def settings(argv: list[str]) -> argparse.Namespace:
    """Options of the command line over those of the configuration file."""
    args = parser().parse_args(argv)
    if args.config:
        import yaml

        text = Path(args.config).read_text(encoding="utf-8").replace("{{path}}", args.path or "")
        given = {str(k).replace("-", "_"): v for k, v in (yaml.safe_load(text) or {}).items()}
        unknown = sorted(set(given) - set(vars(args)))
        if unknown:
            raise SystemExit(f"unknown options in {args.config}: {', '.join(unknown)}")
        defaults = vars(parser().parse_args([]))
        for k, v in given.items():
            if getattr(args, k) == defaults[k]:
                setattr(args, k, v)
    if not args.option or not args.path:
        raise SystemExit("an option and a path are needed")
    if args.option not in OPTIONS:
        raise SystemExit(f"unknown option {args.option}")
    if args.sub and args.sub not in SUB_OPTIONS.get(args.option, []):
        raise SystemExit(f"{args.option} has no {args.sub}")
    return args


def load(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder: the trace_events table if it is there, else raw trace files."""
    if (Path(path) / "trace_events.parquet").exists():
        return spark.read.parquet(f"{path}/trace_events.parquet")
    files = [str(p) for g in ("*.json", "*.json.gz") for p in Path(path).rglob(g)]
    if not files:
        raise SystemExit(f"no traces in {path}")
    events, _ = chrome.split_valid(chrome.read_traces(spark, sorted(files)))
    n = F.col("name")
    return events.select(
        F.xxhash64("path", "pos").alias("event_seq"), "trial", "host", "rank",
        F.concat_ws(".", "host", F.concat(F.lit("rank"), "rank")).alias("pid"), "tid", "ph", "name",
        F.coalesce(names.category(n), F.lit("operator")).alias("cat"), F.coalesce(names.fine_category(n), F.lit("operator")).alias("cat_fine"),
        "ts_us", "dur_us", F.col("args")["step"].try_cast("int").alias("step"), F.array().cast("array<string>").alias("inputs"),
    )


def result(args: argparse.Namespace, events: DataFrame) -> DataFrame:
    """The table that an option stands for."""
    need = ("event_seq", "trial", "step", "cat", "cat_fine")
    rows = st.timed_events(events, *need)
    if args.filter:
        rows = rows.filter(F.col("name").contains(args.filter))
    if args.option == "statistic":
        if args.sub == "category":
            return st.category_stats(rows).orderBy("cat_fine")
        if args.sub == "top":
            return st.top_ops(rows, args.head)
        if args.sub == "first":
            return reports.first_event(rows).orderBy("pid", "ts_us")
        return st.op_stats(rows).orderBy(F.desc("avg_ms"), "pid", "name")
    if args.option == "collect":  # one record per trial: its steps, the chosen one and its time
        return st.overall_iteration(_trial_iterations(rows)).orderBy("trial")
    if args.option == "iterations":
        return st.iterations(rows).orderBy("pid", "step")
    if args.option == "straggler":
        return st.straggler(rows).orderBy("cat_fine", F.desc("time_ms"))
    if args.option == "gap":
        return sequences.min_gaps(sequences.gap_to_previous(rows, ["pid", "cat"], args.longest_gap)).orderBy(F.desc("min_gap_us"))
    if args.option == "compare":
        a, _, b = (args.trials or "").partition(",")
        if not b:
            raise SystemExit("compare needs --trials a,b")
        return st.compare(rows.filter(F.col("trial") == a), rows.filter(F.col("trial") == b)).orderBy(F.desc("relative"), "name")
    if args.option == "timeline":
        return rows.withColumn("pid", F.concat_ws(".", "trial", "pid"))
    if args.option == "combine":  # trials beside each other, each from its own first event on
        chosen = rows.filter(F.col("trial").isin(args.trials.split(","))) if args.trials else rows
        return reports.rebased(chosen, ["trial"]).withColumn("pid", F.concat_ws(".", "trial", "pid"))
    if args.option == "phases":
        return models.phases(rows).orderBy("pid", "start_us")
    key = ["trial", "step"]
    nodes, edges = graph.step_graph(rows.filter("step is not null and trial is not null and cat is not null"))
    if args.option == "critical":
        return graph.critical_paths(nodes, edges, key).orderBy(*key, "pos")
    if args.option == "graph":
        return graph.edge_costs(edges, nodes, key).orderBy(*key, "src", "dst")
    if args.option == "mapping":
        return graph.fusion_groups(nodes, edges, key, 8).orderBy(*key, "cluster", "node")
    if args.option == "topo_sort":
        return reports.schedule(nodes, edges, key, "").orderBy(*key, "place")
    r = args.delay_ratio
    cases = {"base": kernels.Delays(), "computation": kernels.Delays(computation=(0.0, r)), "communication": kernels.Delays(communication=(0.0, r))}
    if args.option == "replay":
        if args.sub == "compare":
            return reports.side_by_side(nodes, edges, key, cases, "base").orderBy(*key, "scenario")
        if args.sub == "partial":
            around = nodes.filter(F.col("node").contains(args.filter or "UPDATE_")).select(*key, "node")
            return reports.partial_times(nodes, edges, around, key).orderBy(*key)
        runs = graph.replays(nodes, edges, key, cases.get(args.sub))
        return (runs if args.full_trace else runs.filter("end_us > start_us")).orderBy(*key, "exec_seq")
    if args.option == "delays":
        return graph.scenarios(nodes, edges, key, cases).orderBy(*key, "scenario")
    if args.option == "bottleneck":
        return graph.bottlenecks(nodes, edges, key).orderBy(F.desc("gain_ms"))
    rules = kernels.MoveRules(tokens=("+", "++", "--", ">")) if args.sub == "all" else kernels.MoveRules()
    return graph.searches(nodes, edges, key, args.rounds, args.seed, rules).orderBy(*key, "method")


def _trial_iterations(rows: DataFrame) -> DataFrame:
    trials = rows.filter("step is not null and cat = 'operator'").groupBy("pid", "step").agg(F.min("trial").alias("trial"))
    return st.iterations(rows).join(trials, ["pid", "step"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = settings(sys.argv[1:] if argv is None else argv)
    session = spark or SparkSession.builder.appName("tracequarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = result(args, load(session, args.path))
    if args.output and args.option == "timeline":
        sinks.write_chrome_file(df, args.output)
    elif args.output and args.sub == "sheets":
        sinks.write_sheets({args.option: df}, args.output)
    elif args.output:
        sinks.write_table(df, args.output)
    else:
        df.show(args.head, truncate=60)
    return df


if __name__ == "__main__":
    main()
