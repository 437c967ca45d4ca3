"""Derived views of traces and graphs: phases, symmetry, precision, fusion of tensors, what-if projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import names
from tracequarry.operators import graph
from tracequarry.operators.chunks import global_number
from tracequarry.operators.ordered import running

# Assumed throughput of devices in TFLOPS, single and half precision.
GPU_TFLOPS = {"v100": (7.4, 29.7), "a100": (9.7, 78.0), "p100": (5.0, 19.95), "1080ti": (0.355, 0.177), "t4": (0.25, 16.2)}


# ------------------------------------------------------------------ scalars


def tf_standard_name(op: Column, is_update: Column, is_gradient: Column) -> Column:
    """Standard name of a TensorFlow operation.

    Known prefixes stay; a leading ``^`` and a last part that begins with
    ``_`` go. Push-pull operations become ``Comm.`` with their ids,
    ``input_barrier`` is forward. An all-reduce with a dot in its name is the
    communication of the tensor behind it (a ``Switch`` a backward operation),
    one without is update or backward. The rest is update, backward (a known
    gradient, or by its name) or forward. But for updates that are no
    all-reduce, dots become ``_``.
    """
    bare = F.regexp_replace(op, "^[\\^]", "")
    plain = F.regexp_replace(bare, "/_[^/]*$", "")
    raw = F.translate(plain, ".", "_")
    ids = F.regexp_extract(plain, "PushPull[_.]([0-9_]+)$", 1)
    reduce_ = F.lower(plain).contains("allreduce")
    tensor = F.split(F.get(F.split(plain, "[.]"), F.lit(1)), "_")[0]
    tape = plain.startswith("gradient_tape") & ~plain.endswith("ShapeN") & ~plain.contains("LayoutOptimizer")
    named = lambda kind, x: F.concat(F.lit(f"{kind}."), x)
    return (
        F.when(op.rlike("^(Comm|Comp|BW|FW|UPDATE_)[.]"), op)
        .when(ids != "", named("Comm", F.translate(ids, "_", "+")))
        .when(plain.contains("input_barrier"), named("FW", raw))
        .when(reduce_ & plain.contains(".") & plain.contains("Switch"), named("BW", F.concat(tensor, F.lit("_Switch"))))
        .when(reduce_ & plain.contains("."), named("Comm", tensor))
        .when(reduce_ & is_update, named("UPDATE_", raw))
        .when(reduce_, named("BW", raw))
        .when(is_update, named("UPDATE_", plain))
        .when(is_gradient | plain.startswith("gradients") | tape, named("BW", raw))
        .otherwise(named("FW", raw))
    )


def mx_standard_name(name: Column) -> Column:
    """Standard name of an MXNet operation: what follows ``name=``; ``_backward`` and ``_fwd`` tell the phase."""
    plain = F.regexp_replace(F.regexp_replace(name, "^.*name=", ""), ";.*$", "")
    back = plain.contains("_backward")
    return F.when(back, F.concat(F.lit("BW."), F.regexp_replace(plain, "_backward.*$", ""))).otherwise(
        F.concat(F.lit("FW."), F.regexp_replace(plain, "_fwd$", ""))
    )


def conv_features(batch: Column, h: Column, w: Column, cin: Column, cout: Column, kernel: Column) -> Column:
    """Multiplications, additions, sizes and weights of a convolution with stride 1 and padding."""
    mul = batch * h * w * cout * kernel * kernel * cin
    return F.struct(
        mul.alias("s_mul"), (mul - batch * h * w * cout).alias("s_add"), (batch * h * w * cin).alias("s_in"),
        (batch * h * w * cout).alias("s_out"), (kernel * kernel * cin * cout).alias("s_wei"),
    )


def dense_features(batch: Column, cin: Column, cout: Column) -> Column:
    """The same of a dense layer."""
    mul = batch * cin * cout
    return F.struct(mul.alias("s_mul"), (mul - batch * cout).alias("s_add"), (batch * cin).alias("s_in"), (batch * cout).alias("s_out"), (cin * cout).alias("s_wei"))


def conv_shape(image: Column, output: Column, weights: Column) -> Column:
    """Layout and sizes of a convolution from the shapes of its input, output and weights (height, width, in, out).

    Channels come last or second, as the shapes tell; null where neither fits
    (rows for the quarantine).
    """
    at = lambda a, i: F.get(a, F.lit(i))
    four = (F.size(image) == 4) & (F.size(output) == 4) & (F.size(weights) == 4) & (at(image, 0) == at(output, 0))

    def fields(layout: str, h: int, w: int, c: int) -> Column:
        return F.struct(
            F.lit(layout).alias("layout"), at(image, 0).alias("batch"), at(image, h).alias("height"), at(image, w).alias("width"), at(image, c).alias("cin"),
            at(output, c).alias("cout"), at(weights, 0).alias("kernel"), (at(image, h) / at(output, h)).alias("stride"),
        )

    fits = lambda c: four & (at(image, c) == at(weights, 2)) & (at(output, c) == at(weights, 3))
    return F.when(fits(3), fields("NHWC", 1, 2, 3)).when(fits(1), fields("NCHW", 2, 3, 1))


def intensity(f: Column) -> Column:
    return f["s_mul"] / (f["s_in"] + f["s_out"] + f["s_wei"])


def chunk_of_step(rank: Column, step: Column, n: Column) -> Column:
    """Part of a tensor that a rank sends in a step of a ring of ``n``."""
    return F.pmod(rank - step, n)


def step_of_chunk(rank: Column, chunk: Column, n: Column) -> Column:
    """First step in which a rank sends a part."""
    return F.pmod(rank - chunk, n)


def padded(features: Column, width: int) -> Column:
    """An array cut or filled with zeros to ``width``."""
    return F.slice(F.concat(features, F.array_repeat(F.lit(0.0), width)), 1, width)


def op_hash(kind: Column, dims: Column) -> Column:
    return F.md5(F.concat(kind, F.lit(","), F.array_join(F.transform(dims, lambda x: x.cast("string")), ":")))


def with_unit(text: Column) -> Column:
    """A number with the suffix k, m, b or p."""
    unit = F.lower(F.regexp_extract(text, r"^([-\d.]+)\s*([kmbp]?)", 2))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit == "p", 1e15).otherwise(1.0)
    return F.regexp_extract(text, r"^([-\d.]+)\s*([kmbp]?)", 1).try_cast("double") * factor


def half_precision_ms(avg_ms: Column, predicted_full: Column, predicted_half: Column) -> Column:
    """Time in half precision by the ratio of predictions; half the time where there are none."""
    return F.when(predicted_full > 0, avg_ms * predicted_half / predicted_full).otherwise(avg_ms / 2)


# ------------------------------------------------------------------ windows


def phases(events: DataFrame) -> DataFrame:
    """Stretches of forward and backward operations of each device: (pid, island, phase, start_us, end_us, ops)."""
    rows = events.withColumn("phase", F.when(F.col("cat_fine") == "operator.FW", "FW").when(F.col("cat_fine") == "operator.BW", "BW"))
    rows = rows.filter("phase is not null")
    rows = running(rows, ["pid"], "ts_us", ["event_seq"], {"before": ("lag", F.col("phase"))})
    turn = F.when(F.col("before").isNull() | (F.col("before") != F.col("phase")), 1).otherwise(0).cast("bigint")
    rows = running(rows, ["pid"], "ts_us", ["event_seq"], {"island": ("sum", turn)})
    return rows.groupBy("pid", "island", "phase").agg(
        F.min("ts_us").alias("start_us"), F.max(F.expr("ts_us + dur_us")).alias("end_us"), F.count(F.lit(1)).alias("ops")
    )


def after_last_backward(events: DataFrame) -> DataFrame:
    """Each communication's wait since the end of the last backward operation that had begun, not below 0."""
    end = F.when(F.col("cat_fine") == "operator.BW", F.expr("ts_us + dur_us"))
    rows = running(events, ["pid"], "ts_us", ["event_seq"], {"bw_end": ("last", end)})
    return rows.filter("cat = 'Comm' and bw_end is not null").select(
        "event_seq", "pid", "name", F.greatest(F.col("ts_us") - F.col("bw_end"), F.lit(0)).alias("wait_us")
    )


def between_marks(events: DataFrame, mark: Column) -> DataFrame:
    """Iterations between marks: first and last event of each stretch per device: (pid, iteration, start_us, end_us, n)."""
    flag = F.when(mark, 1).otherwise(0).cast("bigint")
    rows = running(events, ["pid"], "ts_us", ["event_seq"], {"iteration": ("sum", flag)})
    return rows.groupBy("pid", "iteration").agg(
        F.min("ts_us").alias("start_us"), F.max(F.expr("ts_us + dur_us")).alias("end_us"), F.count(F.lit(1)).alias("n")
    )


def heat(history: DataFrame, key: list[str], step: str, gain: str, window: int = 5) -> DataFrame:
    """Heat of each node at each step: its last gains, the later the more: sum (e^h - 1) / age / count."""
    w = Window.partitionBy(*key).orderBy(step)
    last = F.collect_list(F.struct(F.col(step).alias("t"), F.col(gain).alias("h"))).over(w.rowsBetween(-(window - 1), 0))
    rows = history.withColumn("_last", last)
    total = F.aggregate("_last", F.lit(0.0), lambda a, x: a + F.expm1(x["h"]) / (F.col(step) + 1 - x["t"]))
    return rows.select(*history.columns, F.round(total / F.size("_last"), 9).alias("heat"))


def max_normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns divided by their largest value (0 where that is 0)."""
    tops = df.agg(F.struct(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).alias("tops")).scalar()  # one row, in the same plan
    return df.withColumn("_tops", tops).withColumns(
        {c: F.when(F.col("_tops")[c] != 0, F.col(c) / F.col("_tops")[c]).otherwise(0.0) for c in columns}
    ).drop("_tops")


# -------------------------------------------------------------------- joins


def symmetric(events: DataFrame) -> DataFrame:
    """The same operation on the other devices of its trial: (trial, name, devices, least_us, most_us, spread)."""
    per = events.groupBy("trial", "pid", "name").agg(F.avg("dur_us").alias("a"))
    return per.groupBy("trial", "name").agg(
        F.count(F.lit(1)).alias("devices"), F.round(F.min("a"), 6).alias("least_us"), F.round(F.max("a"), 6).alias("most_us"),
        F.round(F.max("a") / F.greatest(F.min("a"), F.lit(1)), 6).alias("spread"),
    ).filter("devices > 1")


def deduped_kernels(samples: DataFrame, key: str, label: str) -> DataFrame:
    """Samples of one kernel as one: (key, n, label, deviation in per cent of the mean)."""
    mean = F.avg(label)
    return samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(mean, 6).alias("label"), F.round(F.stddev_pop(label) / F.greatest(mean, F.lit(1e-9)) * 100, 3).alias("deviation")
    )


def with_fallback(ops: DataFrame, exact: DataFrame, coarse: DataFrame, key: str, kind: str) -> DataFrame:
    """Mean of an operation by its key, else by its kind, else 0: adds ``estimate`` and ``source``."""
    rows = ops.join(exact.select(key, F.col("label").alias("_e")), key, "left").join(coarse.select(kind, F.col("label").alias("_k")), kind, "left")
    source = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_k").isNotNull(), "kind").otherwise("none")
    return rows.withColumn("estimate", F.coalesce("_e", "_k", F.lit(0.0))).withColumn("source", source).drop("_e", "_k")


def larger_ring(events: DataFrame, tensors: DataFrame, profiled: DataFrame, n: int) -> DataFrame:
    """The steps of a ring of ``n`` devices, from the profile of another number of devices.

    ``events`` has trial, tensor, op (SEND or RECV), loop, channel, slice and
    dur_us; ``tensors`` has trial, tensor, loops, channels, slices;
    ``profiled`` has trial and devices. Comes out a row per trial, tensor,
    loop, channel, slice, device of the ring (``r0`` on) and step, with the
    next device, the chunk that is sent and the mean times of sending and
    receiving, scaled by (devices - 1) / (n - 1), as a ring of more devices
    moves smaller chunks. Parts without a time of their own get the tensor's.
    """
    if n < 2:
        raise ValueError("a ring has at least two devices")
    part = ["trial", "tensor", "l", "c", "s"]
    mean = lambda op, name: F.avg(F.when(F.col("op") == op, F.col("dur_us"))).alias(name)
    events = events.select("trial", "tensor", "op", "dur_us", F.col("loop").alias("l"), F.col("channel").alias("c"), F.col("slice").alias("s"))
    fine = events.groupBy(*part).agg(mean("SEND", "send"), mean("RECV", "recv"))
    coarse = events.groupBy("trial", "tensor").agg(mean("SEND", "send_all"), mean("RECV", "recv_all"))
    parts = tensors.join(profiled, "trial")
    for c, of in (("l", "loops"), ("c", "channels"), ("s", "slices")):
        parts = parts.withColumn(c, F.explode(F.expr(f"sequence(0, {of} - 1)")))
    scale = (F.col("devices") - 1) / F.lit(n - 1)
    rows = parts.join(fine, part, "left").join(coarse, ["trial", "tensor"], "left")
    rows = rows.select(*part, *[F.round(scale * F.coalesce(x, f"{x}_all"), 6).alias(f"{x}_us") for x in ("send", "recv")])
    rows = rows.withColumn("rank", F.explode(F.expr(f"sequence(0, {n - 1})"))).withColumn("step", F.explode(F.expr(f"sequence(0, {2 * (n - 1) - 1})")))
    name = lambda c: F.concat(F.lit("r"), c)
    return rows.select(
        "trial", F.concat(F.lit("Comm."), "tensor").alias("tensor"), F.col("l").alias("loop"), F.col("c").alias("channel"), F.col("s").alias("slice"),
        name(F.col("rank")).alias("pid"), name(F.pmod(F.col("rank") + 1, F.lit(n))).alias("next_pid"), "step",
        chunk_of_step(F.col("rank"), F.col("step"), F.lit(n)).alias("chunk"), "send_us", "recv_us",
    )


def replicated_sums(intervals: DataFrame, workers: int | Column) -> DataFrame:
    """Server operations as events; a sum comes once per worker but one, numbered."""
    n = F.lit(workers) if isinstance(workers, int) else workers
    times = F.when(F.col("op") == "SUM", F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array(F.lit(0)))
    return intervals.filter((n >= 2) | (F.col("op") != "SUM")).withColumn("copy", F.explode(times))


def projected(events: DataFrame, sizes: DataFrame, gbps: float = 100.0, efficiency: float = 0.85) -> DataFrame:
    """The trace of one device with each tensor's transfer as one operation that its size determines, in ms."""
    own = events.filter("cat <> 'Comm'").groupBy("name").agg(F.round(F.avg("dur_us") / 1000, 6).alias("avg_ms"))
    sent = sizes.select(F.concat(F.lit("Comm."), "tensor").alias("name"), F.round(F.col("bytes") / (gbps * efficiency * 1e6), 9).alias("avg_ms"))
    return own.unionByName(sent)


# --------------------------------------------------------------- precision


def amp_nodes(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Operations that may run in half precision: (trial, op).

    White ones, and grey or clear ones that a path without black ones leads
    to from a white one.
    """
    colours = kinds.withColumn("colour", names.amp_colour(F.col("op_type")))
    soft = colours.filter("colour in ('grey', 'clear')").select("trial", F.col("op").alias("dst"))
    white = colours.filter("colour = 'white'").select("trial", F.col("op").alias("node"))
    return graph.reachable(edges.join(soft, ["trial", "dst"], "left_semi"), white, ["trial"]).withColumnRenamed("node", "op")


def casts(edges: DataFrame, half: DataFrame) -> DataFrame:
    """Edges between the precisions, where a cast is needed: (trial, src, dst, cast)."""
    mark = lambda side, out: half.select("trial", F.col("op").alias(side), F.lit(True).alias(out))
    rows = edges.join(mark("src", "a"), ["trial", "src"], "left").join(mark("dst", "b"), ["trial", "dst"], "left")
    kind = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "to half").when(F.col("a").isNotNull() & F.col("b").isNull(), "to full")
    return rows.select("trial", "src", "dst", kind.alias("cast")).filter("cast is not null")


# ------------------------------------------------------------------ tensors


def fuse_neighbours(tensors: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """Neighbouring tensors put together until a group would pass ``most`` bytes: (…, group_id).

    Groups are cut at multiples of ``most`` of the running size, so a group
    holds at most that and one tensor more.
    """
    rows = global_number(tensors, order, "_no").withColumn("_part", F.floor(F.col("_no") / 10_000))
    w = Window.partitionBy("_part").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.groupBy("_part").agg(F.sum(size).alias("_sum"))  # a row per ten thousand
    before = whole.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum(size).over(w) - F.col(size)
    out = rows.withColumn("_upto", upto).join(before, "_part")
    return out.withColumn("group_id", F.floor((F.col("_upto") + F.col("_before")) / most).cast("int")).drop("_no", "_part", "_upto", "_before")


def split_groups(groups: DataFrame) -> DataFrame:
    """Each group's members in two halves by order: (group, half, members)."""
    ids = F.array_sort(F.transform(F.split("tensor", "[+]"), lambda x: x.cast("bigint")))
    rows = groups.filter("contains(tensor, '+')").select("tensor", ids.alias("ids"))
    cut_at = F.ceil(F.size("ids") / 2).cast("int")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), "+")
    halves = F.array(F.struct(F.lit(0).alias("half"), text(F.slice("ids", 1, cut_at)).alias("members")),
                     F.struct(F.lit(1).alias("half"), text(F.slice("ids", cut_at + 1, F.size("ids"))).alias("members")))
    return rows.select("tensor", F.explode(halves).alias("h")).select("tensor", "h.half", "h.members")


def accumulated(nodes: DataFrame, edges: DataFrame, key: list[str], scale: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The graph with the batch worked on in two parts: forward and backward operations twice, each ``scale`` of the time.

    The second copy (``#1``) follows the first; updates wait for it alone.
    """
    edges = edges.select(*key, "src", "dst")
    once = "node rlike '->(FW|BW)[.]'"
    a = nodes.withColumn("avg_ms", F.when(F.expr(once), F.col("avg_ms") * scale).otherwise(F.col("avg_ms")))
    b = nodes.filter(once).withColumn("node", F.concat("node", F.lit("#1"))).withColumn("avg_ms", F.col("avg_ms") * scale)
    both = "src rlike '->(FW|BW)[.]' and dst rlike '->(FW|BW)[.]'"
    leaves = "src rlike '->(FW|BW)[.]' and not dst rlike '->(FW|BW)[.]'"
    tag = lambda c: F.concat(F.col(c), F.lit("#1"))
    second = edges.filter(both).withColumns({"src": tag("src"), "dst": tag("dst")})
    moved = edges.filter(leaves).withColumn("src", tag("src"))
    chain = b.select(*key, F.regexp_replace("node", "#1$", "").alias("src"), F.col("node").alias("dst"))
    return a.unionByName(b), edges.filter(f"not ({leaves})").unionByName(second).unionByName(moved).unionByName(chain).distinct()
