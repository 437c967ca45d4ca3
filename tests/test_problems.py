"""Operators of the data problems against brute force, and their edge cases."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.operators import nested, schema_drift, spikes
from tracequarry.operators.intervals import DisjointIntervals, merge_intervals
from tracequarry.operators.sessions import sessionize, step_number

IV = "pid string, s bigint, e bigint, entity string, chunk int, carry string"


def brute_intervals(rows):
    out, by = [], {}
    for pid, s, e in rows:
        if pid is not None and s is not None and e is not None and e > s:
            by.setdefault(pid, []).append((s, e))
    for pid, iv in by.items():
        cur = None
        for s, e in sorted(iv):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    out += [(pid, "busy", *cur), (pid, "gap", cur[1], s)]
                cur = [s, e]
        out.append((pid, "busy", *cur))
    return sorted(out)


@pytest.mark.parametrize("seed,n,span,chunks", [(1, 300, 2000, 7), (2, 200, 100000, 5), (3, 60, 50, 9), (4, 1, 10, 4)])
def test_intervals_random(spark, seed, n, span, chunks):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randrange(span)
        e = s + rng.choice([1, 5, 20, 20, span // 2 if rng.random() < 0.05 else 3])
        rows.append((rng.choice(["a", "a", "a", "b", None]), s, e if rng.random() > 0.05 else None))
    rows += rows[: n // 5] + [("a", None, 5), ("b", 7, 7), ("b", 9, 3)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], IV)
    got = merge_intervals(df, "pid", "s", "e", chunks=chunks).collect()
    assert sorted(map(tuple, got)) == brute_intervals(rows)


def test_intervals_long_over_many_chunks(spark):
    """One interval covers all others of its entity, over every chunk."""
    rows = [("a", 0, 10_000)] + [("a", i, i + 1) for i in range(0, 10_050, 10)] + [("a", 9_999, 10_020)]
    df = spark.createDataFrame([(*r, "", 0, "") for r in rows], IV)
    got = merge_intervals(df, "pid", "s", "e", chunks=6).collect()
    assert sorted(map(tuple, got)) == brute_intervals(rows)


def test_intervals_empty(spark):
    assert merge_intervals(spark.createDataFrame([], IV), "pid", "s", "e").collect() == []


def test_disjoint_map_any_order():
    rng = random.Random(5)
    iv = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(200) for _ in range(80))]
    m = DisjointIntervals()
    for s, e in iv:
        m.insert(s, e)
    exp = [(s, e) for _, k, s, e in brute_intervals([("a", s, e) for s, e in iv]) if k == "busy"]
    assert list(zip(m.starts, m.ends)) == exp
    assert m.gaps() == [(a[1], b[0]) for a, b in zip(exp, exp[1:])]


EV = "event_seq bigint, pid string, ts_us bigint, args map<string,string>, label double, part int"


def brute_sessions(rows, gap):
    seen, by = set(), {}
    for seq, pid, ts, args in rows:
        if None in (seq, pid, ts) or seq in seen:
            continue
        seen.add(seq)
        raw = (args or {}).get("step")
        try:
            step = float(raw.strip()) if raw is not None else None
        except ValueError:
            step = None
        by.setdefault(pid, []).append((ts, step))
    out = []
    for pid, evs in by.items():
        cur = None
        for ts, step in sorted(evs, key=lambda x: x[0]):
            if cur is None or ts - cur[1] > gap:
                if cur:
                    out.append((pid, cur[0], cur[1], cur[2], len(cur[3])))
                cur = [ts, ts, 0, set()]
            cur[1] = ts
            cur[2] += 1
            if step is not None:
                cur[3].add(step)
        out.append((pid, cur[0], cur[1], cur[2], len(cur[3])))
    return sorted(out)


@pytest.mark.parametrize("seed,n,chunks", [(1, 400, 6), (2, 50, 8), (3, 3, 5)])
def test_sessions_random(spark, seed, n, chunks):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        step = rng.choice([None, "", " 7", "7.0", "7", "8", "x", str(i % 11)])
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randrange(3000), rng.randrange(3000)]), {"step": step} if step is not None else None))
    rows += rows[::7]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], EV)
    got = sessionize(df, "pid", "ts_us", "event_seq", step_number(), 20, chunks=chunks).collect()
    assert sorted(map(tuple, got)) == brute_sessions(rows, 20)


def test_sessions_one_over_all_chunks_and_empty(spark):
    rows = [(i, "a", i, {"step": str(i // 10)}) for i in range(500)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], EV)
    got = sessionize(df, "pid", "ts_us", "event_seq", step_number(), 5, chunks=9).collect()
    assert list(map(tuple, got)) == [("a", 0, 499, 500, 50)]
    assert sessionize(spark.createDataFrame([], EV), "pid", "ts_us", "event_seq", step_number(), 5).collect() == []


SP = "event_seq bigint, name string, pid string, ts_us bigint, dur_us bigint, kind string, source string"


def test_spikes_planted(spark):
    rng = np.random.default_rng(3)
    rows, bad, seq = [], {}, 0
    for name, level, spread, second in (("n", 1000, 0.03, None), ("w", 9000, 0.5, None), ("two", 500, 0.03, 2500)):
        for i in range(900):
            v = int(level * np.exp(np.clip(rng.normal(0, spread), -3 * spread, 3 * spread)))
            if second and i % 3 == 0:
                v = int(second * np.exp(np.clip(rng.normal(0, spread), -3 * spread, 3 * spread)))
            if i in (100, 500, 890):
                v, bad[seq] = int(v * 60), "spike"
            if i == 300:
                v, bad[seq] = 3, "spike"
            if i == 301:
                v, bad[seq] = -5, "impossible"
            rows.append((seq, name, f"d{i % 2}", i * 10, v))
            seq += 1
    for i in range(12):  # a stuck run, its value usual
        rows.append((seq, "n", "d0", 20_000 + i, 1000))
        bad[seq] = "stuck"
        seq += 1
    rows += rows[:50] + [(seq, None, "d0", 1, 5), (seq + 1, "n", None, None, 1001), (seq + 2, "n", "d0", 7, None), (seq + 3, "rare", "d0", 1, 10), (seq + 4, "rare", "d0", 2, 10**9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SP)
    for chunks in (1, 5):
        got = {r.event_id: r.reason for r in spikes.flag_implausible(df, "name", "pid", "ts_us", "dur_us", "event_seq", chunks=chunks).collect()}
        assert got == bad


def test_spikes_in_long_stretches_and_few_rows(spark):
    """A slow device's 60 values in 10,000 and the one odd value of a name of 30 rows."""
    rng = np.random.default_rng(5)
    rows = [(i, "n", "d0", i, int(1000 * np.exp(rng.normal(0, 0.1)))) for i in range(9940)]
    rows += [(10_000 + i, "n", "slow", i, int(20_000 * np.exp(rng.normal(0, 0.1)))) for i in range(60)]
    rows += [(20_000 + i, "few", "d0", i, 100_000 if i == 7 else 490 + i) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", "y") for r in [*rows, *rows[-100:]]], SP)
    for chunks in (1, 5, 40):
        got = spikes.flag_implausible(df, "name", "pid", "ts_us", "dur_us", "event_seq", chunks=chunks).filter("reason = 'spike'").collect()
        assert sorted(r.event_id for r in got) == [*range(10_000, 10_060), 20_007]


@pytest.mark.parametrize("chunks", [2, 5, 11])
def test_stuck_runs_across_chunks(spark, chunks):
    rng = random.Random(chunks)
    rows, seq = [], 0
    for _ in range(40):
        v = rng.randrange(100, 140)
        for _ in range(rng.choice([1, 2, 7, 8, 9, 30])):
            rows.append((seq, "n", "d", seq, v))
            seq += 1
    exp, run = set(), []
    for r in rows:
        if run and run[-1][4] != r[4]:
            run = []
        run.append(r)
        if len(run) >= 8:
            exp |= {x[0] for x in run}
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SP)
    got = spikes.flag_implausible(df, "name", "pid", "ts_us", "dur_us", "event_seq", chunks=chunks).filter("reason = 'stuck'").collect()
    assert {r.event_id for r in got} == exp
    assert spikes.flag_implausible(spark.createDataFrame([], SP), "name", "pid", "ts_us", "dur_us", "event_seq").collect() == []


def _raw(file_id, n, make, start=1):
    return [(file_id, start + i, json.dumps(make(i)), "x") for i in range(n)]


RAW, FILES = "file_id bigint, line_no int, raw string, profile string", "file_id bigint, trial string, host string, rank int, started_at timestamp, before int"


def test_schema_changes(spark):
    import datetime as dt

    def base(i, **more):
        return {"ph": "X", "name": "op", "ts": i, "args": {"step": 100 + i // 20, "mem": 1024 * (i + 5000), "on": i % 2 == 0, **more}}

    def second(i):
        r = base(i)
        r["phase"] = r.pop("ph")
        r["args"]["memBytes"] = r["args"].pop("mem")
        r["args"]["hash"] = f"{i * 7919:016x}"
        return r

    def third(i):
        r = second(i)
        r["args"]["step"] = str(r["args"]["step"])
        del r["args"]["on"]
        r["args"] = json.dumps(r["args"])
        return r

    rows = _raw(1, 60, base) + _raw(2, 60, second) + _raw(3, 60, third) + _raw(4, 60, base)
    rows += [(2, 90, "[", ""), (2, 91, None, ""), (2, 92, '{"cut": ', ""), (2, 93, "", ""), (2, 94, '{"odd": 1, "args": {"odd": null}},', ""), (99, 1, '{"ph": "X"}', ""), (None, 1, "{}", "")]
    t = dt.datetime(2025, 1, 1)
    files = [(1, "t", "h", 0, t, 1), (2, "t", "h", 0, t + dt.timedelta(1), 1), (3, "t", "h", 0, t + dt.timedelta(2), 1), (4, "t", "h", None, t, 1), (5, "t", "h", 0, t, 1)]
    got = schema_drift.schema_changes(spark.createDataFrame(rows, RAW), spark.createDataFrame(files, FILES)).collect()
    assert sorted(map(tuple, got)) == [
        (2, "added", "args.hash", ""),
        (2, "renamed", "args.mem", "args.memBytes"),
        (2, "renamed", "ph", "phase"),
        (3, "removed", "args.on", ""),
        (3, "retyped", "args", ""),
        (3, "retyped", "args.step", ""),
    ]
    events = schema_drift.consistent_events(spark.createDataFrame(rows, RAW), spark.createDataFrame(files, FILES))
    last = events.filter("file_id = 3 and line_no = 1").first()
    assert last.ph == "X" and last.args["mem"] == 5000 * 1024 and last.args["step"] == "100"
    assert schema_drift.schema_changes(spark.createDataFrame([], RAW), spark.createDataFrame([], FILES)).collect() == []


def test_retyped_in_few_files_loses_nothing(spark):
    """One file of thirty holds objects where the others hold numbers; odd values and members stay too."""
    import datetime as dt

    t, rows, files = dt.datetime(2025, 1, 1), [], []
    for f in range(30):
        files.append((f, "t", f"h{f // 2}", 0, t + dt.timedelta(f), 1))
        rows += _raw(f, 40, lambda i, f=f: {"ph": "X", "ts": i, "args": {"mem": {"bytes": i} if f == 29 else i, "n": i, "on": True}})
    rows += [
        (0, 90, json.dumps({"ph": "X", "ts": "soon", "cat": "op", "args": {"n": "many", "on": 7, "odd": [1], "mem": 5}}), ""),
        (0, 91, json.dumps({"ph": "X", "ts": 1, "args": {"n": 2**70}}), ""),
        (0, 94, json.dumps({"ph": "X", "ts": 10**400, "args": {"n": 10**400}}), ""),
        (0, 92, json.dumps({"ph": "X", "ts": 1, "args": [1, 2]}), ""),
        (0, 93, json.dumps({"ph": "X", "ts": 1, "args": {"n": 2**63 - 1}}), ""),
    ]
    raw = spark.createDataFrame(rows, RAW)
    assert {r.field: r.type for r in schema_drift.union_schema(raw).collect()} == {"args.mem": "string", "args.n": "bigint", "args.on": "boolean"}
    events = {(r.file_id, r.line_no): r for r in schema_drift.consistent_events(raw, spark.createDataFrame(files, FILES)).collect()}
    assert all(json.loads(events[29, i + 1].args["mem"]) == {"bytes": i} and events[29, i + 1].rest is None for i in range(40))
    odd = events[0, 90]
    assert odd.args["mem"] == "5" and odd.args["n"] is None and odd.args["on"] is None
    assert json.loads(odd.rest) == {"ts": "soon", "cat": "op", "args": {"n": "many", "on": 7, "odd": [1]}}
    assert json.loads(events[0, 91].rest) == {"args": {"n": 2**70}} and json.loads(events[0, 92].rest) == {"args": [1, 2]}
    assert json.loads(events[0, 94].rest) == {"ts": 10**400, "args": {"n": 10**400}} and events[0, 94].ts is None
    assert events[0, 93].args["n"] == 2**63 - 1 and events[0, 93].rest is None


def test_lattice_is_a_join():
    kinds = list(schema_drift.LATTICE)
    for a in kinds:
        assert schema_drift.promote(a, a) == a and schema_drift.promote("null", a) == a
        for b in kinds:
            assert schema_drift.promote(a, b) == schema_drift.promote(b, a)
            for c in kinds:
                assert schema_drift.promote(schema_drift.promote(a, b), c) == schema_drift.promote(a, schema_drift.promote(b, c))


META = "record_id bigint, raw string, node string"


def test_nested_records(spark):
    op = {"op": "Conv", "input": ["x:0;shape=(2,3);dtype=float32", None, {"shape": [4]}], "output": {"name": "y", "shape": [2, -1], "dtype": "bool", "producer": {"inputs": [{"name": "no"}]}}}
    fused = {"op": "Fused", "fused": json.dumps({"a/b": op}), "attrs": {"input": [{"name": "no"}]}}
    record = {"metadata": json.dumps([fused, {"op": "Id", "input": [], "output": None}]), "traceEvents": [None, {"name": "e", "args": json.dumps({"input3": "z", "inputs": ["p", None, {"name": "q"}], "step": 1})}]}
    rows = [(1, json.dumps(record), "c"), (1, json.dumps(record), "d"), (2, "", "c"), (3, None, "c"), (4, '{"cut', "c"), (5, "[1]", "c"), (6, "null", "c"), (7, json.dumps(json.dumps({"metadata": {"o": {"input": "w"}}})), "c")]
    df = spark.createDataFrame(rows, META)
    got = {(r.record_id, r.node, r.side, r.pos, r.name) for r in nested.flat_table(df, "tensors").collect()}
    assert got == {
        (1, "metadata>0>fused>a/b", "input", 0, "x:0"),
        (1, "metadata>0>fused>a/b", "input", 2, ""),
        (1, "metadata>0>fused>a/b", "output", 0, "y"),
        (1, "traceEvents>1", "args", 3, "z"),
        (1, "traceEvents>1", "args", 0, "p"),
        (1, "traceEvents>1", "args", 2, "q"),
        (7, "metadata>o", "input", 0, "w"),
    }
    ops = {(r.node, r.parent, r.variant) for r in nested.flat_table(df, "operations").filter("record_id = 1").collect()}
    assert ops == {("metadata>0", None, "fused"), ("metadata>0>fused>a/b", "metadata>0", "plain"), ("metadata>1", None, "plain")}
    dims = {(r.side, r.pos, r.dim, r.size) for r in nested.flat_table(df, "dims").collect()}
    assert dims == {("input", 0, 0, 2), ("input", 0, 1, 3), ("input", 2, 0, 4), ("output", 0, 0, 2), ("output", 0, 1, -1)}
    for t in nested.SUPERTYPES:
        assert nested.flat_table(spark.createDataFrame([], META), t).collect() == []


def test_nested_subtypes(spark):
    """Each structural variant in its typed table; supertypes are their unions."""
    op = {"op": "F", "fused": [{"op": "a"}, {"op": "b", "name": "B"}], "input": [{"name": "t", "producer": "p"}, "u;shape=(2,);dtype=int8", 7, True]}
    args = {"n": 1.5, "b": False, "t": "x", "a": [1, 2], "o": {"k": 1}, "z": None, "input2": "w", "input" + "9" * 30: "far"}
    record = {"metadata": {"top": op, "bad": 5}, "traceEvents": {"e": {"name": "e", "args": args}, "f": {"args": 3}, "g": None}}
    df = spark.createDataFrame([(1, json.dumps(record), "x")], META)
    got = {k: [tuple(r) for r in t.collect()] for k, t in nested.subtype_tables(df).items()}
    assert got["operations", "fused"] == [(1, "metadata>top", None, "top", "F", 2)]
    assert sorted(got["operations", "plain"]) == [(1, "metadata>top>fused>0", "metadata>top", "0", "a"), (1, "metadata>top>fused>1", "metadata>top", "B", "b")]
    assert got["tensors", "object"] == [(1, "metadata>top", "input", 0, "t", None, "p")]
    assert {r[3:] for r in got["tensors", "text"]} == {(1, "u", "int8", "shape=(2,);dtype=int8"), (2, "7", None, None), (3, "true", None, None), (2, "w", None, None), (None, "far", None, None)}
    assert got["dims", "size"] == [(1, "metadata>top", "input", 1, 0, 2)]
    assert got["events", "object"] == [(1, "traceEvents>e", "e", None, None, None, 8)] and len(got["events", "number"]) == 1 and got["events", "null"] == []
    assert got["arguments", "number"] == [(1, "traceEvents>e", "n", "1.5", 1.5)] and got["arguments", "bool"][0][3:] == ("false", False)
    assert got["arguments", "array"][0][4] == 2 and got["arguments", "object"][0][4] == 1 and got["arguments", "null"][0][3] is None
    for t in nested.SUPERTYPES:
        assert nested.flat_table(df, t).count() == sum(len(v) for k, v in got.items() if k[0] == t)
    assert set(nested.productive(frozenset({"events"}))) == {("record", "object"), ("event list", "array"), ("event list", "object"), ("event", "object")}


def test_nested_depth(spark):
    """Operations nested far deeper than Python's recursion limit of the walker."""
    text = '{"op": "x", "input": "t"}'
    for _ in range(300):
        text = '{"op": "f", "fused": {"k": ' + text + "}}"
    df = spark.createDataFrame([(1, '{"metadata": {"r": ' + text + "}}", "")], META)
    rows = nested.flat_table(df, "tensors").collect()
    assert len(rows) == 1 and rows[0].node == "metadata>r" + ">fused>k" * 300


def test_wavelet_details():
    x = np.array([1.0, 1.0, 9.0, 1.0, 1.0, 1.0])
    d = spikes.details(x, 2)
    assert d[0][2] == 8 and d[1][2] == 8 and (spikes.details(np.ones(5), 3) == 0).all()
    assert spikes.details(np.array([4.0]), 3).shape == (6, 1)


def test_global_number(spark):
    from tracequarry.operators.chunks import global_number

    df = spark.range(100).select(F.expr("(id * 37) % 100").alias("k"))
    assert all(r.k == r.n for r in global_number(df, "k", "n").collect())
