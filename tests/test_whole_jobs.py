"""Registered queries over small tables: each takes all of its input."""

import json

import pytest

import __spark_entry__ as entry

EVENT = "event_seq bigint, trial string, pid string, tid string, ph string, name string, ts_us bigint, dur_us bigint"


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(folder / f"{name}.parquet"))


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_fallback_takes_all_measured_operations(spark, folder):
    ops = ["m/a/Relu", "m/ab/Relu", "m/abc/Relu"]  # one of three successive lengths is a multiple of 3
    rows = [(i, "t", "p", "0", "X", f"FW.{o}", 1000 + i, 10 * (i + 1), "operator", o) for i, o in enumerate(ops)]
    _write(spark, folder, "trace_events", rows, EVENT + ", cat string, op_name string")
    raw = json.dumps({"metadata": {"m/never/Relu_1": {"op": "Relu"}, "m/never/Other": {"op": "Other"}, ops[0]: {"op": "Relu"}}})
    _write(spark, folder, "op_metadata", [(1, "t", raw)], "record_id bigint, trial string, raw string")
    got = {r.op_name: (r.kind, r.estimate, r.source) for r in entry.queries()["elementary_fallback"](spark, str(folder)).collect()}
    assert got == {o: ("Relu", 10.0 * (i + 1), "exact") for i, o in enumerate(ops)} | {"m/never/Relu_1": ("Relu", 20.0, "kind"), "m/never/Other": ("Other", 0.0, "none")}


ARGS = ", args struct<loop_id:int,channel_id:int,chunk_id:int,slice_id:int>"


def _cluster(spark, folder):
    """Two trials of two and four devices; a tensor of three loops, one channel, two slices, and one without ids."""
    rows, seq = [], 0
    for trial, n in (("t2", 2), ("t4", 4)):
        for r in range(n):
            for ids in ((0, 0, 0, 0), (2, 0, 1, 1), None):
                for op, us in (("SEND", 100), ("RECV", 200)):
                    tensor = "7" if ids else "8+9"
                    rows.append((seq, trial, f"{trial}.r{r}", "0", "X", f"Comm.{tensor}.{op}", 1000 + seq, us + r, ids))
                    seq += 1
    _write(spark, folder, "comm_events", rows, EVENT + ARGS)
    rows = [(1000 + i, t, "server0", "0", "X", f"Comm.7.{op}", 5, 5) for i, (t, op) in enumerate((t, op) for t in ("t2", "t4", "t?") for op in ("COPY_FIRST", "SUM", "COPY_MERGED"))]
    _write(spark, folder, "server_events", rows, EVENT)


def test_rings_take_ids_and_servers_take_devices(spark, folder):
    _cluster(spark, folder)
    q = entry.queries()
    ring = q["ring_expand"](spark, str(folder)).collect()
    sends = {(r.trial, r.dst) for r in ring if ".SEND~>" in r.dst and r.dst.startswith(f"{r.trial}.r0->Comm.7.")}
    for trial, n in (("t2", 2), ("t4", 4)):
        got = {tuple(map(int, s.split("~>")[1].split("_"))) for t, s in sends if t == trial}
        assert got == {(l, 0, k, s) for l in range(3) for k in range(2 * (n - 1)) for s in range(2)}
    assert {r.dst.split("~>")[1] for r in ring if r.dst.startswith("t2.r0->Comm.8+9.SEND")} == {"0_0_0_0", "0_0_1_0"}
    edges = q["ps_edges"](spark, str(folder)).collect()
    assert {(r.trial, r.src.split("::")[0]) for r in edges if r.src.endswith("PUSH_REQ")} == {("t2", "t2.r0"), ("t2", "t2.r1"), *(("t4", f"t4.r{i}") for i in range(4))}
    assert {(r.trial, r.src) for r in edges if r.dst.endswith("COPY_MERGED")} == {("t2", "server0->7~PART0.SUM0"), ("t4", "server0->7~PART0.SUM2")}
    copies = q["replicated_sums"](spark, str(folder)).filter("op = 'SUM'").groupBy("event_seq").count().collect()
    assert {r.event_seq: r["count"] for r in copies} == {1001: 1, 1004: 3, 1007: 1}


def test_larger_cluster_is_scaled_from_the_profile(spark, folder):
    _cluster(spark, folder)
    q = entry.queries()
    rows = q["larger_cluster"](spark, str(folder)).collect()
    assert len(rows) == 2 * (3 * 2 + 1) * 6 * 10  # trials, parts of both tensors, devices, steps
    got = {(r.trial, r.tensor): (r.send_us, r.recv_us) for r in rows}
    assert got["t2", "Comm.7"] == (20.1, 40.1) and got["t4", "Comm.8+9"] == (60.9, 120.9)
    assert all(r.chunk == (int(r.pid[1:]) - r.step) % 6 and int(r.next_pid[1:]) == (int(r.pid[1:]) + 1) % 6 for r in rows)
    chunks = q["ring_chunks"](spark, str(folder)).collect()
    assert len(chunks) == 2 * 2 + 4 * 4 and {(r.pid, r.step, r.chunk) for r in chunks if r.trial == "t2"} == {("t2.r0", 0, 0), ("t2.r0", 1, 1), ("t2.r1", 0, 1), ("t2.r1", 1, 0)}


def test_search_has_rounds_by_the_size_of_the_graph(spark, folder):
    rows = [(i, "t", "p", "0", "X", f"FW.m/op{i}", 1000 * i, 500, "operator", "operator.FW", 1) for i in range(12)]
    _write(spark, folder, "trace_events", rows, EVENT + ", cat string, cat_fine string, step int")
    got = {r.method: r for r in entry.queries()["fusion_search"](spark, str(folder)).collect()}
    assert got["mcts"].tried == 1 + 2 * 11  # a chain of 12 has 11 moves
    assert got["mcmc"].fused > 5
