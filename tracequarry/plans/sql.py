"""Common table expressions that the SQL counterparts of the queries share."""

from tracequarry.functions import names

DAY_US = 86_400_000_000

TRACE = f"""
trace as (select distinct on (event_seq) * from trace_events where event_seq is not null),
silver as (select * from trace where pid is not null and name is not null and ts_us is not null
           and dur_us between 0 and {DAY_US} and lower(ph) <> 'i' and coalesce(cat, '') <> 'debug')"""

COMM = f"""
comm as (select distinct on (event_seq) * from comm_events where event_seq is not null),
comm_ok as (select * from comm where pid is not null and name is not null and ts_us is not null
            and dur_us between 0 and {DAY_US} and lower(ph) <> 'i')"""


def with_trace(body: str, more: str = "") -> str:
    return f"with {TRACE}{', ' + more if more else ''}\n{body}"


def with_comm(body: str, more: str = "") -> str:
    return f"with {COMM}{', ' + more if more else ''}\n{body}"


def typed(oracles: dict[str, str], types: dict[str, dict[str, str]]) -> None:
    """Gives columns of some queries the type that the engine's result has (sums of bigint come wider in SQL)."""
    for name, columns in types.items():
        casts = ", ".join(f"{c}::{t} as {c}" for c, t in columns.items())
        oracles[name] = f"select * replace ({casts}) from ({oracles[name]})"


def colour_case(kind: str) -> str:
    """The colour of an operation type, by the published lists."""
    lists = {"white": names.AMP_WHITE, "grey": names.AMP_GREY, "black": names.AMP_BLACK, "clear": names.AMP_CLEAR}
    whens = " ".join(f"when {kind} in ({quoted(v)}) then '{k}'" for k, v in lists.items())
    return f"case {whens} end"


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def opened(x: str) -> str:
    """A JSON text in place of an object or array counts as what it holds."""
    space = "' ' || chr(9) || chr(10) || chr(13)"
    x = f"({x})"
    text = f"({x} ->> '$')"
    return (
        f"case when json_type({x}) = 'VARCHAR' and left(ltrim({text}, {space}), 1) in ('{{', '[') and json_valid({text}) "
        f"then {text}::json else {x} end"
    )


def text(x: str) -> str:
    x = f"({x})"
    return f"case when json_type({x}) = 'VARCHAR' then {x} ->> '$' when json_type({x}) <> 'NULL' then {x}::varchar end"


#: Records, their operations at any depth (op) and their events (ev), each with its node.
NESTED = rf"""r as (select distinct record_id, raw from op_metadata where raw is not null and json_valid(raw)),
rec as (select record_id, {opened("raw::json")} as j from r),
op(record_id, node, parent, key, j) as (
  select record_id, 'metadata>' || e.key, null::varchar, e.key, {opened("e.value")}
  from (select record_id, {opened("j -> '$.metadata'")} m from rec where json_type(j) = 'OBJECT') t, json_each(t.m) e where json_type(t.m) in ('OBJECT', 'ARRAY')
  union all
  select record_id, node || '>fused>' || e.key, node, e.key, {opened("e.value")}
  from (select record_id, node, {opened("j -> '$.fused'")} m from op where json_type(j) = 'OBJECT') t, json_each(t.m) e where json_type(t.m) in ('OBJECT', 'ARRAY')),
ops as (select * from op where json_type(j) = 'OBJECT'),
ev as (select record_id, 'traceEvents>' || e.key as node, {opened("e.value")} as j
  from (select record_id, {opened("j -> '$.traceEvents'")} m from rec where json_type(j) = 'OBJECT') t, json_each(t.m) e where json_type(t.m) in ('OBJECT', 'ARRAY')),
evs as (select *, {opened("j -> '$.args'")} as args from ev where json_type(j) = 'OBJECT'),
held as (select record_id, node, 'input' as side, {opened("j -> '$.input'")} as v from ops union all select record_id, node, 'output', {opened("j -> '$.output'")} from ops
  union all select record_id, node, 'args', {opened("args -> '$.inputs'")} from evs where json_type(args) = 'OBJECT'),
ten as (select record_id, node, side, e.key::bigint as pos, {opened("e.value")} as v from (select * from held where json_type(v) = 'ARRAY') t, json_each(t.v) e
  union all select record_id, node, side, 0, v from held where json_type(v) <> 'ARRAY'
  union all select record_id, node, 'args', try_cast(regexp_extract(e.key, '^input([0-9]+)$', 1) as bigint), {opened("e.value")}
    from (select * from evs where json_type(args) = 'OBJECT') t, json_each(t.args) e where regexp_matches(e.key, '^input[0-9]+$')),
tens as (select record_id, node, side, pos, v, case when json_type(v) = 'OBJECT' then coalesce({text("v -> '$.name'")}, '') else string_split({text("v")}, ';')[1] end as name,
  case when json_type(v) = 'OBJECT' then {text("v -> '$.dtype'")} else nullif(regexp_extract({text("v")}, ';\s*dtype\s*=\s*(\([^)]*\)|[^;]*)', 1), '') end as dtype
  from ten where v is not null and json_type(v) <> 'NULL'),
shp as (select record_id, node, side, pos, case when json_type(v) = 'OBJECT' then {opened("v -> '$.shape'")}
    when regexp_matches({text("v")}, ';\s*shape\s*=') then to_json(trim(regexp_extract({text("v")}, ';\s*shape\s*=\s*(\([^)]*\)|[^;]*)', 1))) end as s from tens),
sho as (select record_id, node, side, pos, {opened("s")} as s from shp),
dims as (select record_id, node, side, pos, (i - 1)::bigint as dim, x as size from (
  select record_id, node, side, pos, l, generate_subscripts(l, 1) i, unnest(l) x from (
    select *, case json_type(s) when 'ARRAY' then list_transform(json_extract(s, '$[*]'), lambda y: case when json_type(y) in ('UBIGINT', 'BIGINT', 'DOUBLE') then trunc(y::double)::bigint
        when json_type(y) = 'BOOLEAN' then (y::varchar = 'true')::bigint when json_type(y) = 'VARCHAR' then try_cast(trim(y ->> '$') as bigint) end)
      when 'VARCHAR' then list_transform(regexp_extract_all(s ->> '$', '-?[0-9]+'), lambda y: y::bigint) end as l from sho)))"""


_BYTES = " ".join(f"when '{k}' then {v}" for k, v in names.DTYPE_BYTES.items())
#: After NESTED: tensors with their size in bytes.
SIZES = f"""szs as (select * from (
  select t.*, case when bool_and(d.size >= 0) and bool_and(d.size is not null) then product(d.size) end * any_value(case t.dtype {_BYTES} end) as bytes
  from (select distinct record_id, node, side, pos, name, dtype from tens) t join dims d using (record_id, node, side, pos) group by all) where bytes < 9.2e18)"""
