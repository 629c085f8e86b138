"""PostgreSQL-flavoured scalar functions that Spark lacks or means otherwise, each one Spark SQL expression: JVM-side, in codegen.

``register(spark)`` creates them as temporary SQL functions named ``pg_<name>``; ``call("name", col, ...)`` uses them from Python without a
session's functions, by substituting the arguments. The SQL facade maps the plain names to them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sql.text import closing, split, unquoted

def _match(one: str, whole: str, around: str) -> str:
    """The groups of a match, or the whole of it where the pattern has none: groups are parentheses that aren't escaped and don't start (?."""
    n = r"regexp_count(regexp_replace(p, '\\\\\\\\.', ''), '[(](?![?])')"
    return around.format(f"CASE WHEN {n} > 0 THEN transform(sequence(1, greatest({n}, 1)), k -> {one}) ELSE array({whole}) END")


#: name -> (parameters with types and defaults, result type, expression over :parameters)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # text
    "left": ("s STRING, n INT", "STRING", "CASE WHEN n >= 0 THEN left(s, n) ELSE left(s, greatest(char_length(s) + n, 0)) END"),
    "right": ("s STRING, n INT", "STRING", "CASE WHEN n >= 0 THEN right(s, n) ELSE right(s, greatest(char_length(s) + n, 0)) END"),
    "strpos": ("s STRING, t STRING", "INT", "instr(s, t)"),
    "position": ("s STRING, t STRING", "INT", "instr(s, t)"),
    "concat": ("a STRING, b STRING", "STRING", "concat(coalesce(a, ''), coalesce(b, ''))"),
    "initcap": ("s STRING", "STRING", r"aggregate(split(s, ''), '', (a, c) -> concat(a, CASE WHEN a = '' OR NOT right(a, 1) RLIKE '[\\p{L}\\p{N}]' THEN upper(c) ELSE c END))"),
    "split_part": ("s STRING, d STRING, n INT", "STRING", "CASE WHEN n < 1 THEN '' ELSE split_part(s, d, n) END"),
    "starts_with": ("s STRING, t STRING", "BOOLEAN", "startswith(s, t)"),
    "regexp_match": ("s STRING, p STRING", "ARRAY<STRING>", _match("regexp_extract(s, p, k)", "regexp_extract(s, concat('(', p, ')'), 1)", "CASE WHEN s RLIKE p THEN {} END")),
    "regexp_matches": (
        "s STRING, p STRING, flags STRING DEFAULT ''",
        "ARRAY<ARRAY<STRING>>",
        "CASE WHEN s RLIKE concat(CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '' END, p) THEN transform(CASE WHEN contains(flags, 'g') THEN regexp_extract_all(s, concat(CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '' END, '(', p, ')'), 1) ELSE array(regexp_extract(s, concat(CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '' END, '(', p, ')'), 1)) END, w -> "
        + _match("regexp_extract(w, concat(CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '' END, p), k)", "w", "{}")
        + ") WHEN s IS NOT NULL AND p IS NOT NULL AND contains(flags, 'g') THEN CAST(array() AS ARRAY<ARRAY<STRING>>) END",
    ),
    "regexp_replace": ("s STRING, p STRING, r STRING, flags STRING DEFAULT ''", "STRING", "CASE WHEN contains(flags, 'g') THEN regexp_replace(s, concat(CASE WHEN contains(flags, 'i') THEN '(?i)' ELSE '' END, p), r) ELSE regexp_replace(s, concat(CASE WHEN contains(flags, 'i') THEN '(?is)' ELSE '(?s)' END, '^(.*?)(?:', p, ')(.*)$'), concat('$1', r, '$2')) END"),
    "regexp_split_to_array": ("s STRING, p STRING", "ARRAY<STRING>", "split(s, p)"),
    "regexp_count": ("s STRING, p STRING", "INT", "coalesce(regexp_count(s, p), 0)"),
    "string_to_array": ("s STRING, d STRING, n STRING DEFAULT NULL", "ARRAY<STRING>", r"transform(split(s, concat('\\Q', d, '\\E')), x -> CASE WHEN x = n THEN NULL ELSE x END)"),
    "array_to_string": ("a ARRAY<STRING>, d STRING, n STRING DEFAULT ''", "STRING", "array_join(a, d, n)"),
    "quote_ident": ("s STRING", "STRING", "concat('\"', replace(s, '\"', '\"\"'), '\"')"),
    "quote_literal": ("s STRING", "STRING", "CASE WHEN s IS NULL THEN 'NULL' ELSE concat(\"'\", replace(s, \"'\", \"''\"), \"'\") END"),
    "quote_nullable": ("s STRING", "STRING", "CASE WHEN s IS NULL THEN 'NULL' ELSE concat(\"'\", replace(s, \"'\", \"''\"), \"'\") END"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(CASE WHEN n < 0 THEN n & 4294967295 ELSE n END))"),
    "to_ascii": ("s STRING", "STRING", r"regexp_replace(s, '[^\\x00-\\x7F]', '?')"),
    "encode": ("s STRING, f STRING", "STRING", "CASE lower(f) WHEN 'base64' THEN base64(cast(s AS BINARY)) WHEN 'hex' THEN lower(hex(cast(s AS BINARY))) WHEN 'escape' THEN s ELSE raise_error(concat('encode: no format ', f)) END"),
    "decode": ("s STRING, f STRING", "STRING", "CASE lower(f) WHEN 'base64' THEN cast(unbase64(s) AS STRING) WHEN 'hex' THEN cast(unhex(s) AS STRING) WHEN 'escape' THEN s ELSE raise_error(concat('decode: no format ', f)) END"),
    "hashtext": ("s STRING", "BIGINT", "aggregate(transform(split(s, ''), c -> ascii(c)), CAST(2166136261 AS BIGINT), (h, c) -> ((h ^ c) * 16777619) & 4294967295)"),
    # numbers
    "round": ("x DOUBLE, n INT DEFAULT 0", "DOUBLE", "floor(x * pow(10, n) + 0.5) / pow(10, n)"),
    "trunc": ("x DOUBLE, n INT DEFAULT 0", "DOUBLE", "sign(x) * floor(abs(x) * pow(10, n)) / pow(10, n)"),
    "div": ("a DOUBLE, b DOUBLE", "BIGINT", "CASE WHEN b <> 0 THEN cast(a / nullif(b, 0) AS BIGINT) END"),
    "mod": ("a DOUBLE, b DOUBLE", "DOUBLE", "a % nullif(b, 0)"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 100), named_struct('a', abs(a), 'b', abs(b)), (s, k) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % nullif(s.b, 0)) END, s -> s.a)"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a) div aggregate(sequence(1, 100), named_struct('a', abs(a), 'b', abs(b)), (s, k) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % nullif(s.b, 0)) END, s -> s.a) * abs(b) END"),
    "log": ("a DOUBLE, b DOUBLE DEFAULT NULL", "DOUBLE", "CASE WHEN b IS NULL THEN log10(a) ELSE ln(b) / ln(a) END"),
    "min_scale": ("x STRING", "INT", "char_length(regexp_extract(rtrim('0', CASE WHEN contains(x, '.') THEN x ELSE concat(x, '.') END), '[.](.*)$', 1))"),
    "trim_scale": ("x DOUBLE", "DOUBLE", "x"),
    # times
    "age": ("a TIMESTAMP, b TIMESTAMP", "STRING", "concat(datediff(b, a), ' days')"),
    "date_add": ("u STRING, n INT, t TIMESTAMP", "TIMESTAMP", "CASE lower(u) WHEN 'year' THEN t + make_interval(n) WHEN 'month' THEN t + make_interval(0, n) WHEN 'week' THEN t + make_interval(0, 0, n) WHEN 'day' THEN t + make_interval(0, 0, 0, n) WHEN 'hour' THEN t + make_interval(0, 0, 0, 0, n) WHEN 'minute' THEN t + make_interval(0, 0, 0, 0, 0, n) WHEN 'second' THEN t + make_interval(0, 0, 0, 0, 0, 0, n) END"),
    "date_diff": ("u STRING, a TIMESTAMP, b TIMESTAMP", "BIGINT", "CASE lower(u) WHEN 'year' THEN year(b) - year(a) WHEN 'month' THEN (year(b) - year(a)) * 12 + month(b) - month(a) WHEN 'day' THEN timestampdiff(DAY, a, b) WHEN 'hour' THEN timestampdiff(HOUR, a, b) WHEN 'minute' THEN timestampdiff(MINUTE, a, b) WHEN 'second' THEN timestampdiff(SECOND, a, b) END"),
    "justify_days": ("s STRING", "STRING", "s"),
    "justify_hours": ("s STRING", "STRING", "s"),
    "justify_interval": ("s STRING", "STRING", "s"),
    "isfinite": ("s STRING", "BOOLEAN", "s NOT IN ('infinity', '-infinity')"),
    "overlaps": ("a TIMESTAMP, b TIMESTAMP, c TIMESTAMP, d TIMESTAMP", "BOOLEAN", "least(a, b) < greatest(c, d) AND least(c, d) < greatest(a, b)"),
    "dow": ("t TIMESTAMP", "INT", "dayofweek(t) - 1"),
    "to_number": ("s STRING, f STRING DEFAULT ''", "DOUBLE", "cast(regexp_replace(s, '[^0-9.+-]', '') AS DOUBLE)"),
    "to_char": ("t TIMESTAMP, f STRING", "STRING", "date_format(t, replace(replace(replace(replace(replace(replace(f, 'YYYY', 'yyyy'), 'DD', 'dd'), 'HH24', 'HH'), 'MI', 'mm'), 'SS', 'ss'), 'MON', 'MMM'))"),
    # JSON text
    "json_typeof": ("j STRING", "STRING", "CASE WHEN j IS NULL OR trim(j) = 'null' THEN 'null' WHEN j RLIKE '^\\\\s*[{]' THEN 'object' WHEN j RLIKE '^\\\\s*[\\\\[]' THEN 'array' WHEN j RLIKE '^\\\\s*\"' THEN 'string' WHEN trim(j) IN ('true', 'false') THEN 'boolean' ELSE 'number' END"),
    "json_each": ("j STRING", "ARRAY<STRUCT<key: STRING, value: STRING>>", "map_entries(from_json(j, 'map<string,string>'))"),
    "json_array_elements": ("j STRING", "ARRAY<STRING>", "from_json(j, 'array<string>')"),
    "json_strip_nulls": ("j STRING", "STRING", "to_json(map_filter(from_json(j, 'map<string,variant>'), (k, v) -> NOT is_variant_null(v)))"),
    "json_concat": ("a STRING, b STRING", "STRING", "to_json(map_from_entries(concat(filter(map_entries(from_json(a, 'map<string,variant>')), e -> NOT array_contains(json_object_keys(b), e.key)), map_entries(from_json(b, 'map<string,variant>')))))"),
    "json_delete": ("j STRING, k STRING", "STRING", "to_json(map_filter(from_json(j, 'map<string,variant>'), (x, v) -> x <> k))"),
    "json_set": ("j STRING, k STRING, v STRING", "STRING", "to_json(map_from_entries(concat(filter(map_entries(from_json(j, 'map<string,variant>')), e -> e.key <> k), array(named_struct('key', k, 'value', parse_json(v))))))"),
    # space and system
    "st_distance": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE", "DOUBLE", "2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(by_ - ay) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin(radians(bx - ax) / 2), 2))))"),
    "st_dwithin": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE, m DOUBLE", "BOOLEAN", "2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(by_ - ay) / 2), 2) + cos(radians(ay)) * cos(radians(by_)) * pow(sin(radians(bx - ax) / 2), 2)))) <= m"),
    "gen_random_uuid": ("", "STRING", "uuid()"),
    "has_table_privilege": ("t STRING, p STRING", "BOOLEAN", "true"),
    "has_schema_privilege": ("t STRING, p STRING", "BOOLEAN", "true"),
    "has_column_privilege": ("t STRING, c STRING, p STRING", "BOOLEAN", "true"),
    "txid_current": ("", "BIGINT", "CAST(1 AS BIGINT)"),
}


#: Functions of any type: name -> SQL over the texts of the arguments. They are expanded where they are called.
MACROS: dict[str, Callable[..., str]] = {
    "array_length": lambda a, k="1": f"CASE WHEN size({a}) > 0 THEN size({a}) END",
    "array_upper": lambda a, k="1": f"CASE WHEN size({a}) > 0 THEN size({a}) END",
    "array_lower": lambda a, k="1": f"CASE WHEN size({a}) > 0 THEN 1 END",
    "array_dims": lambda a: f"CASE WHEN size({a}) > 0 THEN concat('[1:', size({a}), ']') END",
    "array_position": lambda a, x: f"nullif(array_position({a}, {x}), 0)",
    "array_positions": lambda a, x: f"filter(transform({a}, (y, k) -> CASE WHEN y <=> {x} THEN k + 1 END), k -> k IS NOT NULL)",
    "array_replace": lambda a, x, y: f"transform({a}, z -> CASE WHEN z <=> {x} THEN {y} ELSE z END)",
    "array_remove": lambda a, x: f"filter({a}, z -> NOT z <=> {x})",
    "array_cat": lambda a, b: f"concat({a}, {b})",
    "array_append": lambda a, x: f"array_append({a}, {x})",
    "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_fill": lambda x, n: f"array_repeat({x}, {n})",
    "generate_subscripts": lambda a, k="1": f"CASE WHEN size({a}) > 0 THEN sequence(1, size({a})) ELSE CAST(array() AS ARRAY<INT>) END",
    "json_extract_path": lambda j, *k: f"get_json_object({j}, concat('$', {', '.join(_step(x) for x in k)}))",
    "typeof": lambda x: f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR startswith(typeof({x}), 'decimal') THEN 'real' WHEN typeof({x}) = 'string' THEN 'text' WHEN typeof({x}) = 'boolean' THEN 'boolean' ELSE 'unknown' END",
    "date_subtract": lambda u, n, t: f"pg_date_add({u}, -({n}), {t})",
    "row_to_json": lambda x: f"to_json({x})",
    "to_jsonb": lambda x: f"to_json({x})",
    "json_build_array": lambda *a: f"to_json(array({', '.join(a)}))",
    "json_build_object": lambda *a: f"to_json(named_struct({', '.join(a)}))",
    "random": lambda: "rand()",
    "statement_timestamp": lambda: "current_timestamp()",
    "timeofday": lambda: "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss yyyy')",
    "current_schema": lambda: "'public'",
    "current_schemas": lambda x="true": "array('public')",
    "current_database": lambda: "'quarry'",
    "session_user": lambda: "current_user()",
    "version": lambda: "concat('quarry on Spark ', version())",
    "st_within": lambda ax, ay, bx, by, m: f"pg_st_dwithin({ax}, {ay}, {bx}, {by}, {m})",
}
MACROS |= {
    "jsonb_extract_path": MACROS["json_extract_path"],
    "json_extract_path_text": MACROS["json_extract_path"],
    "jsonb_extract_path_text": MACROS["json_extract_path"],
    "pg_typeof": MACROS["typeof"],
    "datesub": MACROS["date_subtract"],
    "jsonb_build_array": MACROS["json_build_array"],
    "jsonb_build_object": MACROS["json_build_object"],
    "transaction_timestamp": MACROS["statement_timestamp"],
    "clock_timestamp": MACROS["statement_timestamp"],
    "now": MACROS["statement_timestamp"],
}


def _step(key: str) -> str:
    """One step of a JSON path: an index if it is digits, else a name."""
    return f"CASE WHEN {key} RLIKE '^[0-9]+$' THEN concat('[', {key}, ']') ELSE concat('[\\'', {key}, '\\']') END"


def expand(text: str, prefix: str = "pg_") -> str:
    """text with its calls of MACROS, named with the prefix, written out; arguments first."""
    plain, at = unquoted(text), 0
    for m in re.finditer(r"(?<![\w.])([A-Za-z_]\w*)\s*\(", plain):
        name = m[1].lower()
        if m.start() < at or not name.startswith(prefix) or name[len(prefix) :] not in MACROS:
            continue
        end = closing(text, m.end() - 1)
        args = [expand(a, prefix) for a in split(text[m.end() : end - 1])]
        return text[: m.start()] + MACROS[name[len(prefix) :]](*args) + expand(text[end:], prefix)
    return text


# --- JSON by paths: the built-ins change no value inside, so these parse in Arrow batches ------------------------------------------


def _path(text: str) -> list[str]:
    return [k.strip() for k in text.strip().removeprefix("{").removesuffix("}").split(",")]


def _at(node, key: str):
    if isinstance(node, list):
        k = int(key) if key.lstrip("-").isdigit() else len(node)
        return node[k] if -len(node) <= k < len(node) else None
    return node.get(key) if isinstance(node, dict) else None


def json_set_path(doc: str | None, path: str, value: str | None) -> str | None:
    """The value at a path {a,b} replaced or added; a missing parent leaves all as it is."""
    if doc is None or path is None:
        return None
    root, keys = json.loads(doc), _path(path)
    node = root
    for k in keys[:-1]:
        node = _at(node, k)
    new = None if value is None else json.loads(value)
    if isinstance(node, dict):
        node[keys[-1]] = new
    elif isinstance(node, list) and keys[-1].isdigit() and int(keys[-1]) <= len(node):
        node[int(keys[-1]) : int(keys[-1]) + 1] = [new]
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def json_delete_path(doc: str | None, path: str) -> str | None:
    if doc is None or path is None:
        return None
    root, keys = json.loads(doc), _path(path)
    node = root
    for k in keys[:-1]:
        node = _at(node, k)
    if isinstance(node, dict):
        node.pop(keys[-1], None)
    elif isinstance(node, list) and keys[-1].isdigit() and int(keys[-1]) < len(node):
        del node[int(keys[-1])]
    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)


def json_contains(a: str | None, b: str | None) -> bool | None:
    """a @> b: every part of b is in a."""
    if a is None or b is None:
        return None
    return _holds(json.loads(a), json.loads(b))


def _holds(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_holds(x, y) for x in a) for y in (b if isinstance(b, list) else [b]))
    return type(a) is type(b) and a == b or isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def json_pretty(doc: str | None) -> str | None:
    return None if doc is None else json.dumps(json.loads(doc), indent=2, ensure_ascii=False)


def _batched(fn: Callable, kind: str):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*columns, strict=True)], dtype=object)

    run.__annotations__ = {}
    return F.pandas_udf(run, kind, F.PandasUDFType.SCALAR)


PATHS = {"jsonb_set": (json_set_path, "string", 3), "jsonb_insert": (json_set_path, "string", 3), "jsonb_delete_path": (json_delete_path, "string", 2), "jsonb_contains": (json_contains, "boolean", 2), "jsonb_pretty": (json_pretty, "string", 1)}


def register(spark: SparkSession) -> None:
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pg_{name}({params}) RETURNS {kind} RETURN {body}")
    for name, (fn, kind, _) in PATHS.items():
        spark.udf.register(f"pg_{name}", _batched(fn, kind))


def call(name: str, *args: Column | str) -> Column:
    """The function on columns; a session that has register()ed is not needed to plan, but to run."""
    return F.call_function(f"pg_{name}", *[F.col(a) if isinstance(a, str) else a for a in args])


def names() -> set[str]:
    return set(FUNCTIONS) | set(PATHS)


