"""Deeply nested metadata records as related flat tables.

A record is walked once by a tree automaton: what a JSON node is follows from
the state of its parent, the key that leads to it and its own shape. The
shapes of a kind are its structural variants; each variant has a subtype table
with its own typed columns, and all of a kind share the supertype's columns:
``record_id``, ``node`` (path from the record's root to the operation or event)
and, below these, ``side`` and ``pos`` of the parent link.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import stored

_LINK = {"record_id": "bigint", "node": "string"}
_HELD = {**_LINK, "side": "string", "pos": "bigint"}
_OPERATION = {**_LINK, "parent": "string", "name": "string", "kind": "string"}
_TENSOR = {**_HELD, "name": "string", "dtype": "string"}
_EVENT = {**_LINK, "name": "string", "kind": "string", "ts": "double", "dur": "double"}
_ARGUMENT = {**_LINK, "name": "string"}

#: Supertypes with the columns that all of their variants have.
SUPERTYPES: dict[str, dict[str, str]] = {
    "operations": _OPERATION,
    "tensors": _TENSOR,
    "dims": {**_HELD, "dim": "bigint", "size": "bigint"},
    "events": _EVENT,
    "arguments": {**_ARGUMENT, "value": "string"},
}

#: Subtype tables: (supertype, variant) -> columns.
SUBTYPES: dict[tuple[str, str], dict[str, str]] = {
    ("operations", "plain"): _OPERATION,
    ("operations", "fused"): {**_OPERATION, "members": "bigint"},
    ("tensors", "object"): {**_TENSOR, "producer": "string"},
    ("tensors", "text"): {**_TENSOR, "spec": "string"},
    ("dims", "size"): {**_HELD, "dim": "bigint", "size": "bigint"},
    **{("events", v): _EVENT for v in ("null", "bool", "number", "text", "array")},
    ("events", "object"): {**_EVENT, "n_args": "bigint"},
    ("arguments", "null"): {**_ARGUMENT, "value": "string"},
    ("arguments", "bool"): {**_ARGUMENT, "value": "string", "flag": "boolean"},
    ("arguments", "number"): {**_ARGUMENT, "value": "string", "number": "double"},
    ("arguments", "text"): {**_ARGUMENT, "value": "string"},
    ("arguments", "array"): {**_ARGUMENT, "value": "string", "items": "bigint"},
    ("arguments", "object"): {**_ARGUMENT, "value": "string", "members": "bigint"},
}

_INPUT = re.compile(r"input([0-9]+)\Z")


def shape_of(v: Any) -> str:
    """Leaf and shape alphabet of the automaton."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "text"
    return "array" if isinstance(v, list) else "object"


def opened(v: Any) -> Any:
    """A JSON text in place of an object or array counts as what it holds."""
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        try:
            got = json.loads(v)
        except (ValueError, RecursionError):
            return v
        return got if isinstance(got, (dict, list)) else v
    return v


def record_of(raw: Any) -> dict | None:
    """The object of a readable record, else null."""
    if not isinstance(raw, str):
        return None
    try:
        got = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    got = opened(got)
    return got if isinstance(got, dict) else None


@dataclass(frozen=True)
class Step:
    """What the automaton does at a node: the table it fills and the states of its children."""

    emit: str | None = None
    keys: dict[str, str] = field(default_factory=dict)  # single members
    numbered: str | None = None  # members ``input<number>``
    each: str | None = None  # every member or item
    same: str | None = None  # the node itself, in another state


_SCALARS = ("text", "number", "bool")

#: Transitions: (state, shape of the node) -> step. Without one a node leads nowhere, as in
#: ``attrs`` or inside a tensor. A JSON text has the shape of what it holds, but for arguments.
AUTOMATON: dict[tuple[str, str], Step] = {
    ("record", "object"): Step(keys={"metadata": "operations", "traceEvents": "event list"}),
    ("operations", "object"): Step(each="operation"),
    ("operations", "array"): Step(each="operation"),
    ("operation", "object"): Step("operations", {"input": "tensors", "output": "tensors", "fused": "operations"}),
    ("tensors", "array"): Step(each="tensor"),
    ("tensors", "object"): Step(same="tensor"),
    **{("tensors", v): Step(same="tensor") for v in _SCALARS},
    ("tensor", "object"): Step("tensors", {"shape": "shape"}),
    ("tensor", "array"): Step("tensors"),
    **{("tensor", v): Step("tensors", {"shape": "shape"}) for v in _SCALARS},
    ("shape", "array"): Step("dims"),
    ("shape", "text"): Step("dims"),
    ("event list", "array"): Step(each="event"),
    ("event list", "object"): Step(each="event"),
    ("event", "object"): Step("events", {"args": "arguments"}),
    ("arguments", "object"): Step("arguments", {"inputs": "tensors"}, numbered="tensor"),
}


def productive(tables: frozenset[str]) -> dict[tuple[str, str], Step]:
    """The automaton without the states that lead to none of the tables."""
    alive: set[str] = set()
    while True:
        more = {
            state
            for (state, _), step in AUTOMATON.items()
            if step.emit in tables or alive & {*step.keys.values(), step.numbered, step.each, step.same}
        }
        if more == alive:
            break
        alive = more
    out = {}
    for (state, shape), step in AUTOMATON.items():
        if state in alive:
            keep = lambda to: to if to in alive else None
            out[state, shape] = Step(
                step.emit if step.emit in tables else None,
                {k: to for k, to in step.keys.items() if to in alive},
                *(keep(to) for to in (step.numbered, step.each, step.same)),
            )
    return out


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _number(v: Any) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


_SPEC = re.compile(r";\s*(shape|dtype)\s*=\s*(\([^)]*\)|[^;]*)")


def _dims(shape: Any) -> list[int | None]:
    if isinstance(shape, str):
        shape = re.findall(r"-?\d+", shape)
    if not isinstance(shape, list):
        return []
    out = []
    for x in shape:
        try:
            out.append(int(x))
        except (TypeError, ValueError, OverflowError):
            out.append(None)
    return out


class _Walk:
    """Walks records by the automaton; a stack instead of recursion, as operations may nest at any depth."""

    def __init__(self, tables: frozenset[str]) -> None:
        self.steps = productive(tables)
        self.rows: dict[tuple[str, str], list[tuple]] = {k: [] for k in SUBTYPES if k[0] in tables}
        self.tables = {
            "operations": self._operation, "tensors": self._tensor, "dims": self._dims, "events": self._event, "arguments": self._arguments,
        }

    def run(self, record_id: Any, root: dict) -> None:
        # state, node, its key, path of the operation or event that holds it, operation around, side and place of the link
        stack: list[tuple] = [("record", root, "", "", None, None, 0)]
        while stack:
            state, v, key, path, parent, side, pos = stack.pop()
            v = opened(v)
            shape = shape_of(v)
            step = self.steps.get((state, shape))
            while step is not None and step.same:
                state = step.same
                step = self.steps.get((state, shape))
            if step is None:
                continue
            if step.emit:
                self.tables[step.emit](record_id, v, shape, key, path, parent, side, pos)
            below = []
            if step.each:
                nodes = step.each != "tensor"  # operations and events have paths of their own, tensors a place
                items = v.items() if shape == "object" else enumerate(v)
                below = [(step.each, x, k, f"{path}>{k}" if nodes else path, parent, side, pos if nodes else k) for k, x in items]
            elif shape == "object":
                if state == "operation":
                    parent = path
                for k, to in step.keys.items():
                    if k not in v:
                        continue
                    if to == "tensors":
                        below.append((to, v[k], k, path, parent, k if state == "operation" else "args", 0))
                    elif to in ("operations", "event list"):
                        below.append((to, v[k], k, f"{path}>{k}" if path else k, parent, side, pos))
                    else:
                        below.append((to, v[k], k, path, parent, side, pos))
                if step.numbered:
                    for k, x in v.items():
                        number = _INPUT.match(k)
                        if number:
                            n = int(number[1]) if len(number[1]) < 4000 else 2**63
                            below.append((step.numbered, x, k, path, parent, "args", n if n < 2**63 else None))
            elif step.keys:  # a text ``name;shape=...;dtype=...``
                spec = dict(_SPEC.findall(_text(v)))
                below = [(to, spec[k], k, path, parent, side, pos) for k, to in step.keys.items() if k in spec]
            stack.extend(reversed(below))

    def _operation(self, record_id, v, shape, key, path, parent, side, pos) -> None:  # noqa: ANN001
        row = (record_id, path, parent, _text(v.get("name")) or str(key), _text(v.get("op")))
        fused = opened(v.get("fused"))
        if fused:
            self.rows["operations", "fused"].append((*row, len(fused) if isinstance(fused, (list, dict)) else None))
        else:
            self.rows["operations", "plain"].append(row)

    def _tensor(self, record_id, v, shape, key, path, parent, side, pos) -> None:  # noqa: ANN001
        if shape == "object":
            row = (record_id, path, side, pos, _text(v.get("name")) or "", _text(v.get("dtype")), _text(v.get("producer")))
            self.rows["tensors", "object"].append(row)
        else:
            name, mark, spec = _text(v).partition(";")
            dtype = dict(_SPEC.findall(mark + spec)).get("dtype")
            self.rows["tensors", "text"].append((record_id, path, side, pos, name, dtype, spec if mark else None))

    def _dims(self, record_id, v, shape, key, path, parent, side, pos) -> None:  # noqa: ANN001
        self.rows["dims", "size"] += [(record_id, path, side, pos, i, n) for i, n in enumerate(_dims(v))]

    def _event(self, record_id, v, shape, key, path, parent, side, pos) -> None:  # noqa: ANN001
        args = opened(v.get("args"))
        row = (record_id, path, _text(v.get("name")), _text(v.get("ph")), _number(v.get("ts")), _number(v.get("dur")))
        variant = shape_of(args)
        self.rows["events", variant].append((*row, len(args)) if variant == "object" else row)

    def _arguments(self, record_id, v, shape, key, path, parent, side, pos) -> None:  # noqa: ANN001
        for k, x in v.items():
            variant = shape_of(x)
            row = (record_id, path, k, _text(x))
            if variant == "number":
                row = (*row, _number(x))
            elif variant == "bool":
                row = (*row, x)
            elif variant in ("array", "object"):
                row = (*row, len(x))
            self.rows["arguments", variant].append(row)


def _flatten(tables: frozenset[str], columns: dict[str, str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def frames(walk: _Walk, least: int) -> Iterator[pd.DataFrame]:
        for (table, variant), rows in walk.rows.items():
            if len(rows) > least:
                own = list(SUBTYPES[table, variant])
                pdf = pd.DataFrame(rows, columns=own).reindex(columns=list(columns)).assign(tbl=table, variant=variant)
                for c, kind in columns.items():
                    pdf[c] = pdf[c].astype(_KINDS.get(kind, object))
                rows.clear()
                yield pdf

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = _Walk(tables)
        for pdf in batches:
            for record_id, raw in zip(pdf["record_id"].tolist(), pdf["raw"].tolist()):
                record = record_of(raw)
                if record is not None:
                    walk.run(record_id, record)
                    yield from frames(walk, 20_000)  # keeps a batch of large records small
        yield from frames(walk, 0)

    return body


_KINDS = {"bigint": "Int64", "double": "float64", "boolean": "boolean"}


def flat_nodes(df: DataFrame, record_id: str = "record_id", raw: str = "raw", tables: tuple[str, ...] = tuple(SUPERTYPES)) -> DataFrame:
    """Rows of all variants of ``tables`` in one pass, told apart by ``tbl`` and ``variant``.

    Has the columns of all of their subtype tables. Deliveries of a record
    with the same id and text count once; a null id is an id of its own. Null,
    empty, cut-off texts and texts that aren't an object give no rows. Other
    columns are ignored.
    """
    rows = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(raw).alias("raw"))
    rows = rows.filter("raw is not null and length(trim(raw)) > 0").dropDuplicates(["record_id", "raw"])
    columns = reduce(lambda a, b: {**a, **b}, [c for (t, _), c in SUBTYPES.items() if t in tables])
    schema = ", ".join(f"{c} {k}" for c, k in {"tbl": "string", "variant": "string", **columns}.items())
    return rows.mapInPandas(_flatten(frozenset(tables), {"tbl": "string", "variant": "string", **columns}), schema)


def subtype_tables(df: DataFrame, record_id: str = "record_id", raw: str = "raw") -> dict[tuple[str, str], DataFrame]:
    """Every variant's table with its own typed columns, from one pass whose result is kept in the shared folder."""
    rows = stored(flat_nodes(df, record_id, raw))
    return {k: rows.filter((F.col("tbl") == k[0]) & (F.col("variant") == k[1])).select(*c) for k, c in SUBTYPES.items()}


def flat_table(df: DataFrame, name: str, record_id: str = "record_id", raw: str = "raw") -> DataFrame:
    """A supertype's table: the union of its variants over the columns that all have, and ``variant``.

    * operations: ``parent`` is the node of the operation that it is fused
      into, null at the top; ``variant`` is ``fused`` or ``plain``;
    * tensors: one row per tensor of an operation's input or output or of an
      event's args; a tensor object without a name has the empty name, a null
      entry gives no row, ``variant`` tells object from text; ``pos`` is null
      where the number in ``input<number>`` is no bigint;
    * dims: one row per dimension of a tensor (``node, side, pos`` lead back);
    * events and arguments: the trace events and each member of their args,
      by the shape of the args and of the member.

    Nothing inside attrs or inside a tensor (its producer, say) counts. A
    record delivered again with another text under the same id gives the rows
    of both texts, each once.
    """
    several = sum(t == name for t, _ in SUBTYPES) > 1
    rows = flat_nodes(df, record_id, raw, (name,)).select(*SUPERTYPES[name], *(["variant"] if several else []))
    return rows.distinct() if name == "tensors" else rows
