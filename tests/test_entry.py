"""The contract's functions, the command line, and that nothing but the optional package needs it."""

import ast
import datetime as dt
import json
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tracequarry import cli

ROOT = Path(entry.__file__).resolve().parent


def test_contract():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(oracle) <= set(queries)
    for n in (1, 3, 5, 6, 7):
        assert f"p{n}_found" in queries


def test_core_does_not_import_the_optional_package():
    for path in (ROOT / "tracequarry").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in x for x in found), path


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder with the trace table: two devices of two trials, three steps."""
    folder, rows, seq = tmp_path_factory.mktemp("sf"), [], 0
    for trial, pid in (("t0", "host0.rank0"), ("t1", "host1.rank0")):
        for step in range(3):
            t = 1_736_000_000_000_000 + step * 1_000_000
            for name, cat, fine in (("FW.a", "operator", "operator.FW"), ("BW.a", "operator", "operator.BW"), ("Comm.1.Sync", "Comm", "Comm.Sync"), ("UPDATE_.a", "operator", "operator.UPDATE")):
                rows.append((seq, trial, pid.split(".")[0], 0, pid, "operator0", "X", name, cat, fine, t, 1000 * (seq % 4 + 1), step, [], dt.datetime(2025, 1, 1)))
                t, seq = t + 5000, seq + 1
    schema = "event_seq bigint, trial string, host string, rank int, pid string, tid string, ph string, name string, cat string, cat_fine string, ts_us bigint, dur_us bigint, step int, inputs array<string>, loaded_at timestamp"
    spark.createDataFrame(rows + rows[:5], schema).write.parquet(str(folder / "trace_events.parquet"))
    return str(folder)


@pytest.mark.parametrize("option", [o for o in cli.OPTIONS if o not in ("compare", "timeline")])
def test_cli_options(spark, tables, option, capsys):
    assert cli.main([option, tables, "--rounds", "2", "--longest-gap", "10000000"], spark).count() > 0
    capsys.readouterr()


@pytest.mark.parametrize("option,sub", [(k, v) for k, vs in cli.SUB_OPTIONS.items() for v in vs if v != "sheets"])
def test_cli_sub_options(spark, tables, option, sub, capsys):
    assert cli.main([option, tables, "--sub", sub, "--rounds", "2"], spark).count() > 0
    capsys.readouterr()


def test_cli_sheets_and_unknown_sub(spark, tables, tmp_path):
    cli.main(["statistic", tables, "--sub", "sheets", "--output", str(tmp_path / "s")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "statistic")).count() == 8
    with pytest.raises(SystemExit):
        cli.main(["gap", tables, "--sub", "top"], spark)


def test_cli_compare_timeline_config(spark, tables, tmp_path, capsys):
    assert cli.main(["compare", tables, "--trials", "t0,t1"], spark).count() == 4
    out = tmp_path / "x.json"
    cli.main(["timeline", tables, "--output", str(out)], spark)
    assert len(json.loads(out.read_text())["traceEvents"]) == 24
    conf = tmp_path / "c.yaml"
    conf.write_text(f"option: statistic\npath: {tables}\nfilter: BW\n")
    pytest.importorskip("yaml")
    args = cli.settings(["--config", str(conf)])
    assert (args.option, args.filter) == ("statistic", "BW")
    conf.write_text("nothing: 1\n")
    with pytest.raises(SystemExit):
        cli.settings(["statistic", tables, "--config", str(conf)])
    with pytest.raises(SystemExit):
        cli.main(["compare", tables], spark)
    capsys.readouterr()


def test_cli_reads_raw_files(spark, tmp_path, capsys):
    p = tmp_path / "job" / "host0" / "0"
    p.mkdir(parents=True)
    (p / "trace.json").write_text(json.dumps([{"ph": "X", "name": "FW.a", "pid": 0, "tid": 1, "ts": 5, "dur": 2, "args": {"step": 1}}]))
    r = cli.main(["statistic", str(tmp_path)], spark).collect()
    assert [(x.pid, x.name, x.cnt) for x in r] == [("host0.rank0", "FW.a", 1)]
    capsys.readouterr()
