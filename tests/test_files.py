"""Readers and writers on small files, and streams against batches."""

import gzip
import json

from pyspark.sql import functions as F

from tracequarry.operators.intervals import merge_intervals
from tracequarry.sources import chrome, logs, metadata, sinks
from tracequarry.streaming import live


def put(tmp_path, rel, text, zipped=False):
    p = tmp_path / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    if zipped:
        with gzip.open(p, "wt") as f:
            f.write(text)
    else:
        p.write_text(text)
    return str(p)


TRACE = [
    {"ph": "M", "name": "process_name", "pid": 1, "args": {"name": "/job:x/device:GPU:0"}},
    {"ph": "M", "name": "thread_name", "pid": 1, "tid": 7, "args": {"name": "TensorFlow Ops"}},
    {"ph": "M", "name": "thread_name", "pid": 1, "tid": 8, "args": {"name": "other"}},
    {"ph": "X", "name": "Conv2D", "pid": 1, "tid": 7, "ts": 100, "dur": 10, "args": {"group_id": "0", "long_name": "StatefulPartitionedCall/conv1/Conv2D:Conv2D"}},
    {"ph": "X", "name": "k", "pid": 1, "tid": 8, "ts": 101, "dur": 1, "args": {}},
]


def test_chrome_files(spark, tmp_path):
    a = put(tmp_path, "job/host0/0/trace.json.gz", json.dumps({"traceEvents": TRACE}), zipped=True)
    b = put(tmp_path, "job/host0/1/trace.json", json.dumps(TRACE[3:]))
    c = put(tmp_path, "job/host0/2/trace.json", '{"other": 1}')
    rows = chrome.read_traces(spark, [a, b, c])
    assert rows.columns == chrome.COLUMNS and rows.count() == 7
    assert {(r.trial, r.host, r["rank"]) for r in rows.collect()} == {("job", "host0", 0), ("job", "host0", 1)}
    assert [r.source.rsplit("/", 2)[1] for r in chrome.unreadable(spark, [a, b, c]).collect()] == ["2"]
    dfg = spark.createDataFrame([("job", "conv1/Conv2D")], "trial string, op string")
    ops = chrome.computation(rows, dfg).collect()
    assert [(r.name, r.tid, r.step, r.pid) for r in ops] == [("FW.conv1/Conv2D", "operator0", 0, "host0.rank0")]
    assert chrome.nearest_file(spark, str(tmp_path), "trace.json").endswith("trace.json") and chrome.nearest_file(spark, str(tmp_path), "none") is None
    good, bad = chrome.split_valid(rows)
    assert good.count() == 7 and bad.count() == 0


def test_comm_detail_and_horovod(spark, tmp_path):
    p = put(tmp_path, "j/h/0/comm_detail.json", json.dumps([{"ph": "X", "name": "x<<9>>.10+2.SEND", "ts": 1, "dur": 2, "args": {"loopId": 0, "channelId": 1, "chunkId": 2, "sliceId": 3}}, {"ph": "i", "name": "y.1.SEND", "ts": 1}]))
    r = chrome.comm_detail(chrome.read_traces(spark, p)).collect()
    assert [(x.name, x.suffix) for x in r] == [("Comm.2+10.SEND", "0_1_2_3")]
    ev = [{"ph": "M", "name": "process_name", "pid": i, "args": {"name": f"horovod_allreduce.{i}"}} for i in (0, 2)]
    ev += [{"ph": "E", "pid": 0, "ts": 1}, {"ph": "B", "name": "QUEUE", "pid": 0, "ts": 3}, {"ph": "B", "name": "MEMCPY", "pid": 0, "ts": 4}, {"ph": "E", "pid": 0, "ts": 6}, {"ph": "E", "pid": 0, "ts": 9}]
    ev += [x for i in (0, 2) for x in ({"ph": "B", "name": "NEGOTIATE_ALLREDUCE", "pid": i, "ts": 20}, {"ph": "E", "pid": i, "ts": 25})]
    got = {(x.name, x.ts_us, x.dur_us) for x in chrome.horovod(chrome.read_traces(spark, put(tmp_path, "j/h/0/comm.json", json.dumps(ev)))).collect()}
    assert got == {("Comm.0.QUEUE", 3, 6), ("Comm.0.MEMCPY", 4, 2), ("Comm.0+2.Sync", 20, 5)}


def test_server_logs(spark, tmp_path):
    p = put(tmp_path, "t.txt", "role=worker, id=9\n10 true True false 7 1 2\nbroken row\n20 False true FALSE 7 1 2\n")
    rows, bad = logs.transfer_log(spark, p)
    assert sorted((r.ts_us, r.is_start, r.is_req, r.node_id) for r in rows.collect()) == [(10, True, False, 9), (20, False, False, 9)]
    assert [r.raw for r in bad.collect()] == ["broken row"]
    p = put(tmp_path, "s.txt", "1: start, 7, SUM\n4: stop, 7, SUM, 2\n5: start, 7, INIT\n?\n9: stop, 7, SUM\n")
    rows, bad = logs.server_log(spark, p)
    assert rows.count() == 3 and bad.count() == 1
    paired = logs.pair_by_number(rows.select("key", "ph", "ts_us"), ["key"]).collect()
    assert [(r.start_us, r.end_us) for r in paired] == [(1, 4)]
    keys = logs.key_table(spark, put(tmp_path, "k.txt", "a.b: 1 2\nc: 3\n"))
    assert {r.key: r.tensor for r in keys.collect()} == {1: "a.b~PART0", 2: "a.b~PART1", 3: "c"}
    rows = spark.range(30).select(F.lit("k").alias("k"), F.col("id").alias("iter"))
    assert [r.iter for r in logs.profile_window(rows, ["k"]).orderBy("iter").collect()] == list(range(10, 20))
    assert logs.profile_window(rows, ["k"], shifted="true").agg(F.min("iter")).first()[0] == 11


def test_data_sets(spark, tmp_path):
    ops, deps = logs.candidate_ops(spark, put(tmp_path, "c.txt", "conv 1\nrelu 2\nunsafe_resource_deps_:\n1 2\n"))
    assert {r.op for r in ops.collect()} == {"conv", "relu"} and [(r.src, r.dst) for r in deps.collect()] == [("conv", "relu")]
    assert [(r.sample, r.label) for r in logs.kernel_labels(spark, put(tmp_path, "l.txt", "3: 1.5\nx\n")).collect()] == [("3", 1.5)]
    f = logs.kernel_features(spark, put(tmp_path, "f.txt", "loop,h1\nadd.1,add,1,0,f32,2:3,oh\n")).first()
    assert (f.kernel_type, f.op, f.out_dims, f.op_hash) == ("loop", "add.1", [2, 3], "oh")
    b = logs.average_blocks(spark, put(tmp_path, "a.txt", "tool fp32 BS=8:\n[1.0, 2.0]\n[0.01, 9.0]\n"))
    assert [(r.batch, r.avg) for r in logs.stable(b).collect()] == [(8, 1.0)]


def test_metadata_files(spark, tmp_path):
    meta = {"conv": {"op": "Conv", "input": [{"name": "w:0", "shape": [2], "dtype": "float32"}], "output": [{"name": "v.1:0"}]}}
    ops = metadata.op_metadata(spark, put(tmp_path, "m.json", json.dumps(meta)))
    assert {(r.src, r.dst) for r in metadata.variable_graph(ops).collect()} == {("w", "conv"), ("conv", "v_1")}
    g = metadata.graph_def(spark, put(tmp_path, "g.json", json.dumps({"node": [{"name": "b", "input": ["a:1", "^c"]}]})))
    assert {(r.src, r.dst) for r in g.collect()} == {("a", "b"), ("c", "b")}
    grads = metadata.gradients(spark, put(tmp_path, "gr.json", json.dumps({"gradient_name_list": ["x;shape=(2,3);dtype=float32"]}))).first()
    assert (grads.name, grads.shape, grads.dtype) == ("x", [2, 3], "float32")
    sym = metadata.symbol_blocks(spark, put(tmp_path, "s.txt", "Variable:w\n-----\nOp:Conv, Name=conv\nInputs:\n\targ[0]=data(0) version=0\n\targ[1]=w(0)\n"))
    assert {(r.src, r.dst) for r in sym.collect()} == {("data", "conv"), ("w", "conv")}
    ring = {"RealRing": {"0": "3[3000] -> 0[2000] [receive] via NET/Socket/0,0[2000] -> 1[3000] via direct shared memory"}, "Tree": {"-1": "[0] 1/-1/-1->0->-1|-1->0->1/-1/-1 [1] -1/-1/-1->0->1|1->0->-1/-1/-1"}}
    p = put(tmp_path, "n.json", json.dumps(ring))
    assert {(r["rank"], r.next_rank, r.transport) for r in metadata.rings(spark, p).collect()} == {(3, 0, "network"), (0, 1, "shared memory")}
    assert {(r.channel, r["rank"], r.parent, tuple(r.children)) for r in metadata.trees(spark, p).collect()} == {(0, 0, None, (1,)), (1, 0, 1, ())}


def test_sinks_round_trip(spark, tmp_path):
    ev = spark.createDataFrame([("FW.a", 5, 2, "p", "t"), ("BW.b", 1, 2, "p", "t")], "name string, ts_us bigint, dur_us bigint, pid string, tid string")
    out = str(tmp_path / "j" / "h" / "0")
    (tmp_path / "j" / "h" / "0").mkdir(parents=True)
    assert sinks.write_chrome_file(ev, out + "/x.json") == 2
    back = chrome.read_traces(spark, out + "/x.json").select("name", "ts_us", "dur_us", "pid", "tid")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ev.collect()))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b")], "src string, dst string")
    sinks.write_gml(edges, str(tmp_path / "g.gml"))
    assert {(r.src, r.dst) for r in metadata.gml_edges(spark, str(tmp_path / "g.gml")).collect()} == {("a", "b"), ("b", "c")}
    sinks.write_dot(edges, str(tmp_path / "g.dot"))
    assert '"a" -> "b"' in (tmp_path / "g.dot").read_text()
    sinks.write_sheets({"s": edges}, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets" / "s")).count() == 3
    assert sinks.painted(ev, F.when(F.col("name").startswith("BW"), "Y").otherwise("N")).filter("name = 'Y'").count() == 1


EVENT = "event_seq bigint, pid string, name string, ts_us bigint, dur_us bigint"


def stream(spark, tmp_path, rows, build, mode="append"):
    """Runs a stream over one file per row group, then a late file that moves the watermark on."""
    src = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(src / f"p={i}"))
    df = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(src) + "/*")
    q = build(df).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table("out").collect()


def test_stream_sessions_and_windows(spark, tmp_path):
    base = 1_700_000_000_000_000
    first = [(i, "d", "n", base + t, 10) for i, t in enumerate([0, 1_000_000, 9_000_000, 10_000_000])]
    end = [(99, "z", "n", base + 10**10, 1)]
    rows = stream(spark, tmp_path, [first, first[:2], end, [(100, "z", "n", base + 10**10 + 1, 1)]], live.live_sessions)
    assert sorted((r.start_us - base, r.end_us - base, r.n_events) for r in rows if r.pid == "d") == [(0, 1_000_000, 2), (9_000_000, 10_000_000, 2)]
    rows = stream(spark, tmp_path / "w", [first, first, end, [(100, "z", "n", base + 10**10 + 1, 1)]], live.windowed_stats)
    assert sum(r.cnt for r in rows if r.pid == "d") == 4


def test_stream_busy_equals_batch(spark, tmp_path):
    base = 1_700_000_000_000_000
    ev = [(i, "d", "n", base + s * 1000, d * 1000) for i, (s, d) in enumerate([(0, 10), (5, 10), (40, 5), (45, 3), (100, 1)])]
    end = [(99, "z", "n", base + 10**10, 1)]
    rows = stream(spark, tmp_path, [ev[3:], ev[:3], end, [(100, "z", "n", base + 10**10 + 1, 1)]], live.live_busy)
    batch = spark.createDataFrame(ev, EVENT).withColumn("e", F.expr("ts_us + dur_us"))
    exp = {(r.start_us, r.end_us) for r in merge_intervals(batch, "pid", "ts_us", "e").collect() if r.kind == "busy"}
    assert {(r.start_us, r.end_us) for r in rows if r.pid == "d"} == exp


def test_mxnet_trace(spark, tmp_path):
    names = ["conv_fwd", "softmax", "loss", "conv_backward", "adam", "adam", "conv_fwd", "conv_backward"]
    ev = [{"ph": "B", "name": "other", "pid": 9, "ts": 0}]
    for i, n in enumerate(names):
        ev += [{"ph": "B", "name": n, "pid": 1, "ts": 10 * i}, {"ph": "E", "name": n, "pid": 1, "ts": 10 * i + 4}]
    rows = chrome.mxnet_computation(chrome.read_traces(spark, put(tmp_path, "j/h/0/trace.json", json.dumps(ev)))).collect()
    assert sorted((r.start_us, r.name, r.dur_us, r.cycle) for r in rows) == [
        (0, "FW.conv", 4, 0), (10, "OUTPUT0", 14, 0), (30, "BW.conv", 4, 0), (40, "UPDATE_.0", 4, 0), (50, "UPDATE_.1", 4, 0), (60, "FW.conv", 4, 1), (70, "BW.conv", 4, 1),
    ]
