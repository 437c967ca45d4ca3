"""Event files whose fields change over time, read as one consistent table."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.session import spread, stored

FIXED = ("name", "pid", "tid", "ts", "dur")
#: Lines of a file that stay together where small inputs are spread over all cores.
LINES_TOGETHER = 2000
#: Classes by hash in which the texts of a field are counted, a sketch of which texts it holds.
TEXT_CLASSES = 512
#: The one-letter phases of the trace event format.
PHASES = "BEXiICbnestfPNODMVvRca()"


@dataclass(frozen=True)
class DriftRules:
    share: float = 0.05  # of a file's readable records that must have a field
    alike: float = 0.6  # least likeness of two fields that hold the same quantity
    devices: tuple[str, ...] = ("trial", "host", "rank")


# ---------------------------------------------------------------- reading


def read_line(raw: Any) -> dict | None:
    """The JSON object of one line, framing of an array removed; null if there is none."""
    if not isinstance(raw, str):
        return None
    text = raw.strip().lstrip("﻿")
    for cand in (text, text.rstrip(", \t]"), text.lstrip("[, \t").rstrip(", \t]")):
        try:
            got = json.loads(cand)
        except (ValueError, RecursionError):
            continue
        return got if isinstance(got, dict) else None
    return None


def members(args: Any) -> dict:
    """The members of ``args``; a JSON text counts as the object it holds."""
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except (ValueError, RecursionError):
            return {}
    return args if isinstance(args, dict) else {}


#: JSON types by the class that a value is read as.
_TYPES = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def json_type(v: Any) -> str:
    return _TYPES[type(v)]


def json_types(values: list) -> dict[str, int]:
    """How many of the values have each type."""
    out: dict[str, int] = {}
    for kind, n in Counter(map(type, values)).items():
        out[_TYPES[kind]] = out.get(_TYPES[kind], 0) + n
    return out


def is_phase(v: Any) -> bool:
    if isinstance(v, str):
        return len(v) == 1 and v in PHASES
    return isinstance(v, int) and not isinstance(v, bool) and 0 < v < 128 and chr(v) in PHASES


_NUMBER = re.compile(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*\Z")


def _classes(text: str) -> Counter:
    """Kinds of characters of a text, the letters of hexadecimal numbers apart."""
    out: Counter = Counter()
    for ch, n in Counter(text).items():
        if ch.isdigit():
            k = "9"
        elif ch.islower():
            k = "f" if ch in "abcdef" else "z"
        elif ch.isupper():
            k = "A"
        else:
            k = ch if ord(ch) < 128 else "?"
        out[k] += n
    return out


def traits(values: list, at: str = "") -> Counter:
    """What a field's values tell about its quantity, all of it as counts that can be summed.

    k: kind of value; n: whole or not; b: size in quarter octaves; v: small
    whole numbers, or texts by hash; c: characters by kind; o: keys. Elements
    of arrays and members of objects are counted under ``e``.
    """
    out: Counter = Counter()
    by: dict[type, list] = defaultdict(list)
    for v in values:
        by[type(v)].append(v)
    numbers, texts, below = by[int] + by[float], by[str], []
    for kind, name in ((bool, "bool"), (list, "list"), (dict, "object")):
        if by[kind]:
            out[f"{at}k:{name}"] += len(by[kind])
    for v in by[list]:
        below += v
    for v in by[dict]:
        below += v.values()
        for k in v:
            out[f"{at}o:{k}"] += 1
    for text, n in Counter(texts).items():
        if _NUMBER.match(text):
            numbers += [float(text)] * n
        elif text.strip().lower() in ("true", "false"):
            out[at + "k:bool"] += n
        else:
            out[at + "k:text"] += n
            out[at + "t:length"] += n * len(text)
            out[f"{at}v:{zlib.crc32(text.encode('utf-8', 'replace')) % TEXT_CLASSES}"] += n
            for k, m in _classes(text).items():
                out[f"{at}c:{k}"] += n * m
    if numbers:
        try:
            x = np.array(numbers, float)
        except OverflowError:  # whole numbers of any length
            x = np.array([v if abs(v) < 1e300 else math.inf for v in numbers], float)
        x = x[np.isfinite(x)]
        whole = x == np.floor(x)
        out[at + "k:num"] += len(x)
        out[at + "n:whole"] += int(whole.sum())
        out[at + "n:part"] += len(x) - int(whole.sum())
        for prefix, found in (("b", np.round(4 * np.log2(1 + np.abs(x)))), ("v", x[whole & (np.abs(x) < 128)])):
            for k, n in zip(*np.unique(found, return_counts=True)):
                out[f"{at}{prefix}:{int(k)}"] += int(n)
    if below:
        out.update(traits(below, "e"))
    return +out


_TRAITS = "file_id bigint, field string, trait string, n bigint"


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of each file's fields, types and traits, per batch of lines."""
    for pdf in batches:
        records: Counter = Counter()
        tops: dict[tuple[int, str], list] = defaultdict(list)
        inner: dict[tuple[int, str], list] = defaultdict(list)
        for file_id, raw in zip(pdf["file_id"].tolist(), pdf["raw"].tolist()):
            record = read_line(raw)
            if record is None:
                continue
            records[file_id] += 1
            for key, v in record.items():
                if key not in FIXED:
                    tops[file_id, key].append(v)
            for key, v in members(record.get("args")).items():
                inner[file_id, key].append(v)
        rows = [(f, "", "records", n) for f, n in records.items()]
        for level, found in (("top.", tops), ("args.", inner)):
            for (f, key), values in found.items():
                field = key if level == "top." and key == "args" else level + key
                counts = Counter({f"type:{t}": n for t, n in json_types(values).items()})
                counts["present"] = len(values)
                if level == "args.":
                    counts.update(traits(values))
                elif key != "args":
                    counts["phase"] = sum(map(is_phase, values))
                rows += [(f, field, t, n) for t, n in counts.items()]
        yield pd.DataFrame(rows, columns=["file_id", "field", "trait", "n"])


# ------------------------------------------------------------- comparing


def file_fields(counts: dict[str, dict[str, int]], rules: DriftRules) -> dict[str, dict]:
    """The fields that belong to a file: name -> {type, share, phase, traits}."""
    records = counts.get("", {}).get("records", 0)
    found: dict[str, dict] = {}
    phase: tuple[float, str] | None = None
    for name, c in counts.items():
        if not name or c["present"] < rules.share * records:
            continue
        types = {k[5:]: n for k, n in c.items() if k.startswith("type:") and k != "type:null"}
        kind = min(types, key=lambda k: (-types[k], k)) if types else "null"
        if name.startswith("top."):
            if name == "top.ph" or 2 * c.get("phase", 0) > sum(types.values()):
                rank = (c.get("phase", 0), name)
                phase = max(phase, rank) if phase else rank
            found[name] = {"type": kind}
            continue
        own = {k: n for k, n in c.items() if k != "present" and not k.startswith("type:")}
        found[name] = {"type": kind, "share": c["present"] / records, "traits": own}
    out = {k: v for k, v in found.items() if not k.startswith("top.")}
    if phase:
        out[phase[1][4:]] = {"type": found[phase[1]]["type"], "phase": True}
    return out


def _mix(traits: dict[str, int], prefix: str) -> dict[str, float]:
    own = {k[len(prefix) :]: n for k, n in traits.items() if k.startswith(prefix)}
    total = sum(own.values())
    return {k: n / total for k, n in own.items()} if total else {}


def _overlap(a: dict[str, float], b: dict[str, float]) -> float:
    return sum(min(v, b.get(k, 0.0)) for k, v in a.items())


def _shift(a: dict[str, float], b: dict[str, float]) -> float:
    """Mean distance, in octaves, that turns one distribution of sizes into the other.

    Differences of a twentieth of the values are let pass, so odd values and
    marks such as -1 don't count.
    """
    keys = sorted({int(k) for k in (*a, *b)})
    moved = ahead = 0.0
    for lo, hi in zip(keys, keys[1:]):
        ahead += a.get(str(lo), 0.0) - b.get(str(lo), 0.0)
        moved += max(0.0, abs(ahead) - 0.05) * (hi - lo)
    return moved / 4


def _small(traits: dict[str, int], at: str) -> dict[int, float]:
    """Small whole numbers from 0 on with their share of all numbers, odd ones left out."""
    total = traits[at + "k:num"]
    found = {int(k[len(at) + 2 :]): n / total for k, n in traits.items() if k.startswith(at + "v:")}
    return {k: v for k, v in found.items() if k >= 0}


def _beyond(a: dict[int, float], b: dict[int, float]) -> float:
    """Share of the small numbers of one that lie beyond the range of the other.

    Only for numbers that start at 0 to 2, as counts and places do; others
    (steps, say) move on from file to file.
    """
    if not a or not b or sum(a.values()) < 0.5 or sum(b.values()) < 0.5 or min(a) > 2 or min(b) > 2:
        return 0.0
    return max(sum(v for k, v in x.items() if not min(y) <= k <= max(y)) for x, y in ((a, b), (b, a)))


def _scalar_likeness(a: dict[str, int], b: dict[str, int], at: str) -> float:
    kinds_a, kinds_b = _mix(a, at + "k:"), _mix(b, at + "k:")
    if not kinds_a or not kinds_b:
        return 1.0 if kinds_a == kinds_b else 0.5
    main_a, main_b = max(kinds_a, key=kinds_a.get), max(kinds_b, key=kinds_b.get)
    if main_a != main_b:
        return 0.0
    if main_a == "num":
        parts = abs(_mix(a, at + "n:").get("part", 0.0) - _mix(b, at + "n:").get("part", 0.0))
        few = math.sqrt(sum(1 / x[at + "k:num"] for x in (a, b)))  # what chance alone moves
        near = math.exp(-max(0.0, _shift(_mix(a, at + "b:"), _mix(b, at + "b:")) - few))
        beyond = _beyond(_small(a, at), _small(b, at))
        return (1 - parts) * near * (1 - min(1.0, 3 * max(0.0, beyond - 0.12)))
    if main_a == "text":
        classes = _overlap(_mix(a, at + "c:"), _mix(b, at + "c:"))
        long_a, long_b = (x.get(at + "t:length", 0) / x[at + "k:text"] for x in (a, b))
        lengths = min(long_a, long_b) / max(long_a, long_b, 1e-9)
        return max(classes * (0.5 + 0.5 * lengths), 0.9 * _overlap(_mix(a, at + "v:"), _mix(b, at + "v:")))
    return 1.0


def _words(name: str) -> set[str]:
    return set(re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name[5:]).lower()))


def likeness(old: str, a: dict, new: str, b: dict) -> float:
    """How far two fields hold the same quantity, from 0 to about 1."""
    s = _scalar_likeness(a["traits"], b["traits"], "")
    kinds = _mix(a["traits"], "k:")
    if s > 0 and kinds and max(kinds, key=kinds.get) in ("list", "object"):
        s *= _scalar_likeness(a["traits"], b["traits"], "e")
        if kinds.get("object", 0) > 0.5:
            s *= _overlap(_mix(a["traits"], "o:"), _mix(b["traits"], "o:"))
    s *= 1 - min(1.0, 2 * max(0.0, abs(a["share"] - b["share"]) - 0.25))
    x, y = _words(old), _words(new)
    return s + 0.05 * len(x & y) / max(1, len(x | y))


def compare(prev: dict[str, dict], cur: dict[str, dict], rules: DriftRules) -> list[tuple[str, str, str]]:
    """Ordered changes (change, field, new_field) from one file's fields to the next's."""
    out: list[tuple[str, str, str]] = []
    gone = [f for f in prev if f not in cur]
    come = [f for f in cur if f not in prev]
    pairs = []
    for o in gone:
        for n in come:
            if prev[o].get("phase") or cur[n].get("phase"):
                if prev[o].get("phase") and cur[n].get("phase"):
                    pairs.append((2.0, o, n))
            elif o != "args" and n != "args":
                pairs.append((likeness(o, prev[o], n, cur[n]), o, n))
    used: set[str] = set()
    for score, o, n in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if score < rules.alike or o in used or n in used:
            continue
        used |= {o, n}
        out.append(("renamed", o, n))
        if "null" not in (prev[o]["type"], cur[n]["type"]) and prev[o]["type"] != cur[n]["type"]:
            out.append(("retyped", o, ""))
    out += [("removed", f, "") for f in gone if f not in used]
    out += [("added", f, "") for f in come if f not in used]
    for f in cur:
        if f in prev and "null" not in (prev[f]["type"], cur[f]["type"]) and prev[f]["type"] != cur[f]["type"]:
            out.append(("retyped", f, ""))
    return sorted(out)


# -------------------------------------------------------------- operators


def file_headers(raw_events: DataFrame) -> DataFrame:
    """Traits of each file's fields: (file_id, field, trait, n), summed over all its lines."""
    rows = raw_events.select(F.col("file_id").cast("bigint").alias("file_id"), "line_no", "raw").filter("file_id is not null")
    stretch = F.floor(F.col("line_no") / LINES_TOGETHER)
    rows = spread(rows, 2, F.col("file_id"), stretch).select("file_id", "raw")
    return rows.mapInPandas(_headers, _TRAITS).groupBy("file_id", "field", "trait").agg(F.sum("n").alias("n"))


def _file_profiles(counts: DataFrame, rules: DriftRules) -> DataFrame:
    """(file_id, profile) from headers: one JSON text per file with a readable record.

    Fields below the share are dropped before a file's rows come together, so
    a file's profile stays small however many odd keys its records have.
    """
    records = counts.filter("field = '' and trait = 'records'").select("file_id", F.col("n").alias("records"))
    per_field = counts.groupBy("file_id", "field").agg(
        F.map_from_entries(F.collect_list(F.struct("trait", "n"))).alias("traits"),
        F.max(F.expr("if(trait = 'present', n, 0)")).alias("present"),
    )
    kept = per_field.join(records, "file_id").filter(f"field = '' or present >= {rules.share} * records")
    grouped = kept.groupBy("file_id").agg(F.collect_list(F.struct("field", "traits")).alias("fields"))
    as_json = F.to_json(F.map_from_entries("fields"))
    return grouped.select("file_id", as_json.alias("profile"))


def _sequence(trace_files: DataFrame, with_records: DataFrame, rules: DriftRules) -> DataFrame:
    """The file before each file of its device: (file_id, seq, before, device columns)."""
    files = trace_files.select("file_id", *rules.devices, "started_at").filter("file_id is not null")
    files = files.dropDuplicates(["file_id"]).join(with_records.select("file_id"), "file_id", "left_semi")
    in_order = Window.partitionBy(*rules.devices).orderBy("started_at", "file_id")
    return files.select(
        "file_id", *rules.devices, F.row_number().over(in_order).alias("seq"), F.lag("file_id").over(in_order).alias("before")
    )


_CHANGES = "file_id bigint, change string, field string, new_field string"


def schema_changes(
    raw_events: DataFrame, trace_files: DataFrame, rules: DriftRules = DriftRules(), headers: DataFrame | None = None
) -> DataFrame:
    """Each change with the file where it first shows: (file_id, change, field, new_field).

    The files of a device are ordered by ``started_at``, then ``file_id``, and
    each is compared with the one before. ``change`` is ``added``,
    ``removed``, ``renamed`` or ``retyped``; ``field`` is the old name (for
    ``added`` the new one), ``new_field`` the new name of a rename and else
    the empty text. Fields are the one that holds the phase, ``args`` and the
    members of args as ``args.<key>``; a field belongs to a file if at least
    ``share`` of its readable records have it, and its type is that of most
    of its non-null values (a field of nulls alone has no type and isn't
    retyped). A rename is told by the values: a field that ends and one that
    begins in the same file match if their kinds, sizes, characters and
    shares are alike. If it changes its type too, it is also ``retyped``.

    Null, empty, cut-off lines and lines that aren't objects are ignored.
    Files without a readable record say nothing about fields and are passed
    over; lines of files that ``trace_files`` lacks give no changes. Repeated
    lines count as often as they come. Devices with null parts are devices of
    their own. Other columns are ignored; empty tables give no rows.

    Method: header counts are taken from all lines in parallel (per batch,
    then summed, so a file with most of the lines is no single task) and
    folded per file; each file then meets its predecessor's profile in a join.
    ``headers`` are the ``file_headers`` of the same lines, if they were taken
    before.
    """
    counts = stored(file_headers(raw_events)) if headers is None else headers  # read for the records and for the fields
    profiles = stored(_file_profiles(counts, rules))
    pairs = (
        _sequence(trace_files, profiles, rules)
        .filter("before is not null")
        .select("file_id", "before")
        .join(profiles, "file_id")
        .join(profiles.select(F.col("file_id").alias("before"), F.col("profile").alias("old")), "before")
    )

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, old, new in zip(pdf["file_id"].tolist(), pdf["old"].tolist(), pdf["profile"].tolist()):
                prev, cur = (file_fields(json.loads(x), rules) for x in (old, new))
                rows += [(file_id, *c) for c in compare(prev, cur, rules)]
            yield pd.DataFrame(rows, columns=["file_id", "change", "field", "new_field"])

    return pairs.select("file_id", "old", "profile").mapInPandas(diff, _CHANGES)


#: The lattice of types, from the narrowest: a pair joins in the first type that holds both.
LATTICE = {
    "null": (),
    "boolean": ("null",),
    "bigint": ("null",),
    "double": ("null", "bigint"),
    "array": ("null",),
    "object": ("null",),
    "string": ("null", "boolean", "bigint", "double", "array", "object"),
}


def promote(a: str, b: str) -> str:
    """The narrowest type that holds values of both."""
    if a == b or b in LATTICE[a]:
        return a
    return b if a in LATTICE[b] else "string"


def promoted(a: Column, b: Column) -> Column:
    """``promote`` as a column expression."""
    up = F.create_map(*[x for k, below in LATTICE.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in below]).cast("array<string>"))])
    return F.when((a == b) | F.array_contains(up[a], b), a).when(F.array_contains(up[b], a), b).otherwise(F.lit("string"))


def union_schema(raw_events: DataFrame, rules: DriftRules = DriftRules(), headers: DataFrame | None = None) -> DataFrame:
    """The union schema of the members of args: (field, type), types by the lattice.

    Holds every field that belongs to at least one file. Each file's types of
    a field are folded through the lattice: those that most of its values have
    there, however few such files are, and those of a twentieth of all of the
    field's values. Odd values in single records don't widen a type; they are
    kept in the rest of an event. ``headers`` as in ``schema_changes``.
    """
    counts = stored(file_headers(raw_events)) if headers is None else headers
    records = counts.filter("field = '' and trait = 'records'").select("file_id", F.col("n").alias("records"))
    kinds = ["boolean", "number", "string", "array", "object"]
    per_file = (
        counts.filter("field like 'args.%'")
        .groupBy("file_id", "field")
        .agg(
            *[F.sum(F.expr(f"if(trait = 'type:{t}', n, 0)")).alias(t) for t in kinds],
            F.sum(F.expr("if(trait = 'n:part', n, 0)")).alias("part"),
            F.sum(F.expr("if(trait = 'present', n, 0)")).alias("present"),
        )
        .join(records, "file_id")
    )
    belongs = F.col("present") >= rules.share * F.col("records")
    most = F.greatest(*kinds)
    flags = (
        per_file.groupBy("field")
        .agg(
            *[F.sum(t).alias(t) for t in kinds],
            *[F.bool_or(belongs & (F.col(t) > 0) & (F.col(t) == most)).alias(f"own_{t}") for t in kinds],
            F.sum("part").alias("part"),
            F.bool_or(belongs).alias("kept"),
        )
        .filter("kept")
    )
    total = reduce(lambda a, b: a + b, [F.col(t) for t in kinds])
    narrow = {t: F.lit(t) for t in kinds} | {"number": F.when(F.col("part") > 0, F.lit("double")).otherwise(F.lit("bigint"))}
    observed = F.array_compact(
        F.array(*[F.when(F.col(f"own_{t}") | ((F.col(t) > 0) & (F.col(t) >= rules.share * total)), narrow[t]) for t in kinds])
    )
    return flags.select("field", F.aggregate(observed, F.lit("null"), promoted).alias("type"))


def canonical_names(changes: DataFrame, trace_files: DataFrame, rules: DriftRules = DriftRules()) -> DataFrame:
    """Renamed fields by file: (file_id, field, first_name), for fields whose name has changed.

    Follows each device's renames in the order of its files. Only the log of
    renames and the list of files come together per device, never events.
    """
    files = trace_files.select("file_id", *rules.devices, "started_at").dropDuplicates(["file_id"])
    log = changes.filter("change = 'renamed'").groupBy("file_id").agg(
        F.collect_list(F.struct("field", "new_field")).alias("renames")
    )
    rows = files.join(log, "file_id", "left").select(
        "file_id", *rules.devices, "started_at", F.to_json("renames").alias("renames")
    )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        first: dict[str, str] = {}
        out = []
        for file_id, renames in pdf.sort_values(["started_at", "file_id"])[["file_id", "renames"]].itertuples(index=False):
            for r in json.loads(renames) if isinstance(renames, str) else []:
                start = first.pop(r["field"], r["field"])
                if r["new_field"] != start:
                    first[r["new_field"]] = start
            out += [(file_id, k, v) for k, v in first.items()]
        return pd.DataFrame(out, columns=["file_id", "field", "first_name"])

    return rows.groupBy(*rules.devices).applyInPandas(follow, "file_id bigint, field string, first_name string")


_SPARK_TYPES = {"boolean": "boolean", "bigint": "bigint", "double": "double"}


def consistent_events(raw_events: DataFrame, trace_files: DataFrame, rules: DriftRules = DriftRules()) -> DataFrame:
    """All readable events in one table, whatever their file's schema.

    Columns: file_id, line_no, name, pid, tid, ts, dur, ph (a letter, also
    where the file writes its code or names the field otherwise) and ``args``,
    a struct of the union schema under each field's first name on its device,
    and ``rest``. Arrays and objects in columns are kept as JSON text. What no
    column holds is in ``rest``, a JSON object laid out like the event (null if
    there is nothing): values that their column's type can't hold exactly,
    members of args that belong to no file, args that aren't an object, and
    other fields of the event. Lines that aren't JSON objects are left out.
    """
    headers = stored(file_headers(raw_events))  # one pass over the lines for schema and changes
    schema = union_schema(raw_events, rules, headers).collect()  # one row per field name, no data
    names = stored(canonical_names(schema_changes(raw_events, trace_files, rules, headers), trace_files, rules))
    types = {r["field"][5:]: r["type"] for r in schema}
    merged: dict[str, str] = dict(types)
    for r in names.select("field", "first_name").distinct().collect():  # pairs of field names
        old, new = r["first_name"][5:], r["field"][5:]
        if new in types and r["first_name"].startswith("args."):
            merged[old] = promote(merged.get(old, "null"), types[new])
    fields = sorted(merged)
    struct = T.StructType(
        [T.StructField(f, T._parse_datatype_string(_SPARK_TYPES.get(merged[f], "string"))) for f in fields]
    )
    per_file = names.groupBy("file_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "first_name")))).alias("names"))
    rows = (
        raw_events.select(F.col("file_id").cast("bigint").alias("file_id"), "line_no", "raw")
        .filter("raw is not null")
        .join(per_file, "file_id", "left")
    )
    out = "file_id bigint, line_no int, name string, pid string, tid string, ts double, dur double, ph string, args_json string, rest string"

    def number(v: Any) -> float | None:
        try:
            return float(v) if not isinstance(v, bool) and v is not None else None
        except (TypeError, ValueError, OverflowError):
            return None

    def text(v: Any) -> str | None:
        return v if v is None or isinstance(v, str) else json.dumps(v)

    def value(v: Any, kind: str) -> Any:
        """What the column holds of the value; null if not all of it."""
        if kind == "boolean":
            return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).strip().lower())
        if kind in ("bigint", "double"):
            if kind == "bigint" and isinstance(v, int) and not isinstance(v, bool):
                return v if -(2**63) <= v < 2**63 else None
            x = number(v)
            if x is None or not math.isfinite(x) or (isinstance(v, int) and int(x) != v):
                return None
            return x if kind == "double" else int(x) if x == int(x) and abs(x) <= 2**53 else None
        return text(v)

    def whole(v: Any) -> Any:
        return v if type(v) is int and -(2**63) <= v < 2**63 else value(v, "bigint")

    def real(v: Any) -> Any:
        return v if type(v) is float and math.isfinite(v) else value(v, "double")

    by_type = {"bigint": whole, "double": real, "boolean": lambda v: value(v, "boolean")}
    convert = {f: by_type.get(merged[f], text) for f in fields}

    def unify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, first = None, {}  # a file's renamed members and their first names
        for pdf in batches:
            rows = []
            for file_id, line, raw, names in pdf[["file_id", "line_no", "raw", "names"]].itertuples(index=False):
                r = read_line(raw)
                if r is None:
                    continue
                if names is not asked:  # lines of a file mostly follow each other
                    asked, first = names, json.loads(names) if isinstance(names, str) else {}
                    first = {k[5:]: v[5:] for k, v in first.items() if k.startswith("args.")}
                key = next((k for k, v in r.items() if k not in FIXED and k != "args" and is_phase(v)), None)
                phase = r.get(key)
                ts, dur = number(r.get("ts")), number(r.get("dur"))
                rest = {k: v for k, v in r.items() if v is not None and k not in (*FIXED, "args", key)}
                rest |= {k: r[k] for k, x in (("ts", ts), ("dur", dur)) if x is None and r.get(k) is not None}
                own = members(r.get("args"))
                if not own and r.get("args") not in (None, {}, "{}"):
                    rest["args"] = r["args"]
                args, left = {}, {}
                # a renamed field before an odd member that has its first name
                items = own.items()
                if not first.keys().isdisjoint(own):
                    items = sorted(items, key=lambda m: m[0] not in first)
                for k, v in items:
                    if v is None:
                        continue
                    to = first.get(k, k)
                    x = convert[to](v) if to in convert and to not in args else None
                    if x is None:
                        left[k] = v
                    else:
                        args[to] = x
                if left:
                    rest["args"] = left
                rows.append(
                    (
                        file_id, line, text(r.get("name")), text(r.get("pid")), text(r.get("tid")), ts, dur,
                        chr(phase) if isinstance(phase, int) else phase, json.dumps(args), json.dumps(rest) if rest else None,
                    )
                )
            got = pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])
            got["line_no"] = got["line_no"].astype("Int32")
            yield got

    events = rows.mapInPandas(unify, out)
    return events.withColumn("args", F.from_json("args_json", struct)).drop("args_json")
