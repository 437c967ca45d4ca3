"""Names of operations: ``pid->op_cat.op_name.sub_op~>suffix``, and what follows from them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW, TAIL = "->", "~>"

# Vocabularies of the trace format.
SERVER_OPS = ["COPY_FIRST", "SUM", "COPY_MERGED"]
PS_COMM_OPS = ["PUSH_REQ", "PUSH_RES", "PULL_REQ", "PULL_RES"]
RING_FINE = ["Sync", "QUEUE", "MEMCPY_IN_FUSION_BUFFER", "NCCL_ALLREDUCE", "MEMCPY_OUT_FUSION_BUFFER"]
GAP_KEYS = [
    "operatorGAPoperator", "CommGAPComm", "operatorGAPComm", "CommGAPoperator",
    "CommGAPServerOp", "ServerOpGAPComm", "INTERNODEGAP",
]
DTYPE_BYTES = {
    "float16": 2, "float32": 4, "float64": 8, "int8": 1, "int16": 2, "int32": 4, "int64": 8,
    "bool": 1, "string": 1, "resource": 1,
}
# Replay priority of the kinds of operations, by a part of their name; all others come last.
PRIORITIES = [("FW", 0), ("OUTPUT", 1), ("BW", 2), ("UPDATE_", 3)]
LAST_PRIORITY = 100
# Coarse categories by parts of the name, in the order of the rules; a node named END is virtual.
CATEGORIES = [
    ("I/O", ["I/O"]),
    ("ServerOp", SERVER_OPS),
    ("Comm", ["Comm", "PUSH", "PULL"]),
    ("operator", ["FW", "BW", "COMP", "UPDATE", "OUTPUT"]),
]
# Colours of operation types for mixed precision, the published lists.
AMP_WHITE = [
    "BatchMatMul", "BlockLSTM", "BlockLSTMGrad", "Conv2D", "Conv2DBackpropFilter", "Conv2DBackpropInput", "MatMul",
]
AMP_GREY = [
    "Add", "AddN", "AddV2", "AvgPool", "AvgPool3D", "AvgPool3DGrad", "AvgPoolGrad", "BiasAdd", "BiasAddGrad",
    "BiasAddV1", "Elu", "EluGrad", "Erf", "Erfc", "FloorDiv", "FusedBatchNormV2", "FusedBatchNormGradV2",
    "FusedBatchNormV3", "FusedBatchNormGradV3", "Inv", "LeakyRelu", "LeakyReluGrad", "Mul", "Prod", "RealDiv",
    "Reciprocal", "Sigmoid", "SigmoidGrad", "Softplus", "SoftplusGrad", "Sqrt", "Sub", "Tanh", "TanhGrad",
]
AMP_BLACK = [
    "Exp", "Expm1", "L2Loss", "Log", "Log1p", "LogSoftmax", "Mean", "Pow", "SaveV2", "Softmax",
    "SoftmaxCrossEntropyWithLogits", "SparseSoftmaxCrossEntropyWithLogits", "Sum",
]
AMP_CLEAR = [
    "Abs", "ArgMax", "ArgMin", "BatchToSpace", "BatchToSpaceND", "BroadcastTo", "Ceil", "CheckNumerics",
    "ClipByValue", "Concat", "ConcatV2", "DepthToSpace", "DynamicPartition", "DynamicStitch", "Enter", "EnsureShape",
    "Equal", "Exit", "ExpandDims", "Fill", "Floor", "Gather", "GatherNd", "GatherV2", "Greater", "GreaterEqual",
    "Identity", "IdentityN", "IsFinite", "IsInf", "IsNan", "Less", "LessEqual", "Max", "MaxPool", "MaxPool3D",
    "MaxPool3DGrad", "MaxPool3DGradGrad", "MaxPoolGrad", "MaxPoolGradGrad", "MaxPoolGradGradV2", "MaxPoolGradV2",
    "MaxPoolV2", "Maximum", "Merge", "Min", "Minimum", "MirrorPad", "MirrorPadGrad", "Neg", "NextIteration",
    "NotEqual", "OneHot", "OnesLike", "Pack", "Pad", "PadV2", "PreventGradient", "Rank", "Relu", "Relu6",
    "Relu6Grad", "ReluGrad", "Reshape", "ResizeNearestNeighbor", "ResizeNearestNeighborGrad", "Reverse",
    "ReverseSequence", "ReverseV2", "Round", "Select", "Shape", "ShapeN", "Sign", "Size", "Slice", "Snapshot",
    "SpaceToBatch", "SpaceToBatchND", "SpaceToDepth", "Split", "SplitV", "Squeeze", "StackPopV2", "StackPushV2",
    "StopGradient", "StridedSlice", "StridedSliceGrad", "Switch", "TensorArrayConcatV3", "TensorArrayGatherV3",
    "TensorArrayReadV3", "TensorArrayScatterV3", "TensorArraySplitV3", "TensorArrayWriteV3", "Tile", "TopK",
    "TopKV2", "Transpose", "Where", "ZerosLike",
]


def long_name(pid: Column, raw: Column, suffix: Column) -> Column:
    """The composite name; a null pid or suffix is left away."""
    head = F.when(pid.isNotNull(), F.concat(pid, F.lit(ARROW))).otherwise("")
    tail = F.when(suffix.isNotNull(), F.concat(F.lit(TAIL), suffix)).otherwise("")
    return F.concat(head, raw, tail)


def parsed(name: Column) -> Column:
    """Parts of a composite name: struct pid, std_name, op_cat, op_name, sub_op, suffix, valid.

    The part in the middle has two or three parts between dots; other names
    aren't valid (their parts are null where they are missing).
    """
    pid = F.when(name.contains(ARROW), F.substring_index(name, ARROW, 1))
    rest = F.when(name.contains(ARROW), _after(name, ARROW)).otherwise(name)
    suffix = F.when(rest.contains(TAIL), _after(rest, TAIL))
    std = F.when(rest.contains(TAIL), F.substring_index(rest, TAIL, 1)).otherwise(rest)
    parts = F.split(std, "[.]")
    return F.struct(
        pid.alias("pid"),
        std.alias("std_name"),
        F.get(parts, F.lit(0)).alias("op_cat"),
        F.get(parts, F.lit(1)).alias("op_name"),
        F.get(parts, F.lit(2)).alias("sub_op"),
        suffix.alias("suffix"),
        F.size(parts).between(2, 3).alias("valid"),
    )


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.regexp_replace(text, f"^.*?{mark}", "")


def category(name: Column) -> Column:
    """Coarse category by the first rule that fits, null if none does."""
    out = F
    for cat, parts in CATEGORIES:
        out = out.when(reduce(or_, [name.contains(x) for x in parts]), cat)
    return out.when(name == "END", "virtual")


def fine_category(name: Column) -> Column:
    """Fine category by the first rule that fits, null if none does."""
    has = name.contains
    out = F.when(reduce(or_, [has(x) for x in SERVER_OPS]), "ServerOp")
    for op in PS_COMM_OPS:
        out = out.when(has(op), f"Comm.{op}")
    comm = F.when(has("SEND"), "Comm.SEND").when(has("RECV"), "Comm.RECV").otherwise("Comm.other")
    return (
        out.when(has("Comm"), comm)
        .when(has("BW") & has("FW"), "operator.FW+BW")
        .when(has("BW"), "operator.BW")
        .when(has("FW"), "operator.FW")
        .when(has("COMM"), "operator.COMM")
        .when(has("COMP"), "operator.COMP")
        .when(has("I/O"), "I/O")
        .when(has("UPDATE_"), "operator.UPDATE")
        .when(has("OUTPUT"), "operator.OUTPUT")
        .when(name == "END", "virtual")
    )


def unique_name(pid: Column, name: Column, loop: Column, channel: Column, chunk: Column, slice_: Column) -> Column:
    """pid->name, with the four ids as suffix where there is a chunk id."""
    ids = F.when(chunk.isNotNull(), F.concat_ws("_", loop, channel, chunk, slice_))
    return long_name(pid, name, ids)


def is_standard_pid(pid: Column) -> Column:
    return pid.rlike("^(host|traces_|default)")


def sorted_tensors(ids: Column) -> Column:
    """Ids joined by ``+`` in the order of their numbers."""
    numbers = F.array_sort(F.transform(F.split(ids, "[+]"), lambda x: x.cast("bigint")))
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "+")


def tensor_ids(name: Column) -> Column:
    """The ids between ``Comm.`` and the next dot, as an array of numbers; empty if there are none."""
    text = F.regexp_extract(name, r"^Comm[.]([0-9]+(?:[+][0-9]+)*)[.]", 1)
    return F.filter(F.transform(F.split(text, "[+]"), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def op_type(name: Column) -> Column:
    """Type of an operation from the last part of its name, numbering removed."""
    return F.regexp_replace(F.element_at(F.split(name, "[/]"), -1), "(_[0-9]+)$", "")


def op_layer(name: Column) -> Column:
    """The part before the operation's own name, if the name has parts."""
    parts = F.split(F.regexp_replace(name, "^[A-Z_/]+[.]", ""), "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1)))


def dtype_bytes(dtype: Column) -> Column:
    """Bytes per element, null for an unknown type."""
    pairs = [x for k, v in DTYPE_BYTES.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]
    return F.try_element_at(F.create_map(*pairs), dtype)


def tensor_bytes(shape: Column, dtype: Column) -> Column:
    """Size of a tensor; null where a dimension or the type is unknown, or the size no bigint."""
    elements = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: F.when(x >= 0, F.try_multiply(a, x)))
    return F.try_multiply(elements, dtype_bytes(dtype))


def priority(name: Column) -> Column:
    out = F.lit(LAST_PRIORITY)
    for part, rank in reversed(PRIORITIES):
        out = F.when(name.contains(part), rank).otherwise(out)
    return out


def amp_colour(type_: Column) -> Column:
    return (
        F.when(type_.isin(AMP_WHITE), "white")
        .when(type_.isin(AMP_GREY), "grey")
        .when(type_.isin(AMP_BLACK), "black")
        .when(type_.isin(AMP_CLEAR), "clear")
    )


def bias_both(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Intersection of two ranges; null ends are unbounded."""
    return F.struct(F.greatest(left_a, left_b).alias("l"), F.least(right_a, right_b).alias("r"))


def bias_sum(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Sum of two ranges; an unbounded end stays unbounded."""
    return F.struct((left_a + left_b).alias("l"), (right_a + right_b).alias("r"))
