"""Queries over scalar functions, grouped by kind: each row of a table through all functions of the kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pg
from ..operators import spatial
from .registry import query
from .tables import Tables


def _table(name: str, table: str, key: str, exprs: dict[str, tuple[str, str]], where: str = "true") -> None:
    """exprs: column -> (Spark SQL, DuckDB SQL)."""
    sql = f"SELECT {key}, " + ", ".join(f"{d} AS {c}" for c, (_, d) in exprs.items()) + f" FROM {table} WHERE {where}"

    @query(name, sql)
    def run(spark, d):
        pg.register(spark)
        return getattr(Tables(spark, d), table).where(where).select(key, *[F.expr(pg.expand(s)).alias(c) for c, (s, _) in exprs.items()])


_same = lambda *names: {n: (e, e) for n, e in names}

_table(
    "functions_text",
    "part",
    "p_partkey",
    {
        **_same(("up", "upper(p_name)"), ("lo", "lower(p_name)"), ("ln", "length(p_name)"), ("tr", "trim(concat('  ', p_brand, ' '))"), ("rp", "replace(p_name, 'a', 'zz')"), ("rv", "reverse(p_brand)"), ("rep", "repeat(p_brand, 2)"), ("md", "md5(p_name)"), ("lp", "lpad(p_brand, 12, '*')"), ("rpd", "rpad(p_brand, 12, '*')"), ("tl", "translate(p_name, 'abc', 'xy')"), ("sub", "substring(p_name, 2, 3)"), ("cws", "concat_ws('-', p_brand, p_type)")),
        "left2": ("pg_left(p_name, 3)", "left(p_name, 3)"),
        "leftneg": ("pg_left(p_name, -2)", "left(p_name, -2)"),
        "rightneg": ("pg_right(p_name, -2)", "right(p_name, -2)"),
        "pos": ("pg_strpos(p_name, 'a')", "strpos(p_name, 'a')"),
        "cc": ("pg_concat(p_name, NULL)", "concat(p_name, NULL)"),
        "sw": ("pg_starts_with(p_brand, 'Brand')", "starts_with(p_brand, 'Brand')"),
        "sp": ("pg_split_part(p_type, ' ', 2)", "split_part(p_type, ' ', 2)"),
        "asc": ("ascii(p_name)", "ascii(p_name)"),
        "ch": ("chr(65 + p_size)", "chr(65 + p_size)"),
        "bits": ("bit_length(p_name)", "octet_length(p_name::BLOB) * 8"),
        "oct": ("octet_length(p_name)", "octet_length(p_name::BLOB)"),
        "rr1": ("pg_regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_')"),
        "rrg": ("pg_regexp_replace(p_name, '[aeiou]', '_', 'g')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
        "rm": ("pg_regexp_match(p_brand, '[0-9]+')", "CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN [regexp_extract(p_brand, '[0-9]+')] END"),
        "rm2": ("pg_regexp_match(p_brand, '([A-Z])[a-z]+#([0-9])')", "[regexp_extract(p_brand, '([A-Z])[a-z]+#([0-9])', 1), regexp_extract(p_brand, '([A-Z])[a-z]+#([0-9])', 2)]"),
        "rmg": ("pg_regexp_matches(p_name, '[aeiou]', 'g')", "list_transform(regexp_extract_all(p_name, '[aeiou]'), lambda x: [x])"),
        "hex": ("pg_encode(p_brand, 'hex')", "lower(hex(p_brand::BLOB))"),
        "unhex": ("pg_decode(pg_encode(p_brand, 'hex'), 'hex')", "p_brand"),
        "ltr": ("ltrim(concat('  ', p_brand))", "ltrim('  ' || p_brand)"),
        "rtr": ("rtrim(concat(p_brand, '  '))", "rtrim(p_brand || '  ')"),
        "rs": ("pg_regexp_split_to_array(p_type, ' ')", "string_split(p_type, ' ')"),
        "rc": ("pg_regexp_count(p_name, '[aeiou]')", "len(regexp_extract_all(p_name, '[aeiou]'))"),
        "sta": ("pg_string_to_array(p_type, ' ')", "string_split(p_type, ' ')"),
        "ats": ("pg_array_to_string(split(p_type, ' '), '+')", "array_to_string(string_split(p_type, ' '), '+')"),
        "qi": ("pg_quote_ident(p_brand)", "'\"' || p_brand || '\"'"),
        "ql": ("pg_quote_literal(p_brand)", "'''' || p_brand || ''''"),
        "hx": ("pg_to_hex(p_partkey)", "lower(hex(p_partkey))"),
        "b64": ("pg_encode(p_brand, 'base64')", "base64(p_brand::BLOB)"),
        "unb": ("pg_decode(pg_encode(p_brand, 'base64'), 'base64')", "p_brand"),
        "ov": ("overlay(p_brand PLACING 'XX' FROM 2 FOR 3)", "left(p_brand, 1) || 'XX' || substring(p_brand, 5)"),
        "fmt": ("format_string('%s/%s', p_brand, p_type)", "p_brand || '/' || p_type"),
        "ic": ("pg_initcap(p_type)", "array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"),
    },
)
_table(
    "functions_math",
    "customer",
    "c_custkey",
    {
        **_same(("ab", "abs(c_acctbal)"), ("pw", "power(c_nationkey, 2)"), ("sq", "sqrt(abs(c_acctbal))"), ("cb", "cbrt(c_acctbal)"), ("ex", "exp(c_nationkey / 10.0)"), ("l10", "log10(c_custkey)"), ("l2", "log2(c_custkey)"), ("dg", "degrees(c_nationkey)"), ("rd", "radians(c_nationkey)"), ("sn", "sin(c_nationkey)"), ("cs", "cos(c_nationkey)"), ("tn", "tan(c_nationkey)"), ("as_", "asin(c_nationkey / 100.0)"), ("ac", "acos(c_nationkey / 100.0)"), ("at", "atan(c_nationkey)"), ("at2", "atan2(c_nationkey, 3)"), ("gr", "greatest(c_nationkey, 5, 12)"), ("le", "least(c_nationkey, 5, 12)"), ("co", "coalesce(NULL, c_nationkey)"), ("pi_", "pi()")),
        "ce": ("cast(ceil(c_acctbal) AS BIGINT)", "ceil(c_acctbal)::BIGINT"),
        "fl": ("cast(floor(c_acctbal) AS BIGINT)", "floor(c_acctbal)::BIGINT"),
        "sg": ("cast(sign(c_acctbal) AS INT)", "sign(c_acctbal)::INT"),
        "rn": ("pg_round(c_acctbal, 1)", "floor(c_acctbal * 10 + 0.5) / 10"),
        "tc": ("pg_trunc(c_acctbal)", "trunc(c_acctbal)"),
        "dv": ("pg_div(c_custkey, 7)", "(c_custkey // 7)"),
        "dv0": ("pg_div(c_custkey, 0)", "NULL::BIGINT"),
        "md": ("pg_mod(c_custkey, 7)", "(c_custkey % 7)::DOUBLE"),
        "gc": ("pg_gcd(c_custkey, 24)", "gcd(c_custkey, 24)"),
        "lc": ("pg_lcm(c_custkey, 24)", "lcm(c_custkey, 24)"),
        "wb": ("width_bucket(c_acctbal, 0, 10000, 5)", "CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 6 ELSE floor(c_acctbal / 2000)::BIGINT + 1 END"),
        "lg": ("pg_log(2, c_custkey)", "ln(c_custkey) / ln(2)"),
    },
    "c_custkey > 0",
)
_table(
    "functions_datetime",
    "orders",
    "o_orderkey",
    {
        **_same(("tr", "date_trunc('month', o_orderdate)"), ("yr", "year(o_orderdate)"), ("mo", "month(o_orderdate)"), ("dy", "day(o_orderdate)"), ("qt", "quarter(o_orderdate)"), ("md", "make_date(1998, 2, 3)")),
        "dw": ("pg_dow(o_orderdate)", "dayofweek(o_orderdate)"),
        "doy": ("date_part('doy', o_orderdate)", "dayofyear(o_orderdate)"),
        "ep": ("unix_timestamp(o_orderdate)", "epoch(o_orderdate)::BIGINT"),
        "ag": ("pg_age(o_orderdate, timestamp'1999-01-01')", "datediff('day', o_orderdate, TIMESTAMP '1999-01-01') || ' days'"),
        "ad": ("pg_date_add('month', 3, o_orderdate)", "o_orderdate + INTERVAL 3 MONTH"),
        "ah": ("pg_date_add('hour', -5, o_orderdate)", "o_orderdate - INTERVAL 5 HOUR"),
        "dd": ("pg_date_diff('day', o_orderdate, timestamp'1999-01-01')", "datesub('day', o_orderdate, TIMESTAMP '1999-01-01')"),
        "dm": ("pg_date_diff('month', o_orderdate, timestamp'1999-01-01')", "datediff('month', o_orderdate, TIMESTAMP '1999-01-01')"),
        "tc": ("pg_to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS')", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
        "td": ("to_date('1997-05-06')", "DATE '1997-05-06'"),
        "ts": ("to_timestamp('1997-05-06 01:02:03')", "TIMESTAMP '1997-05-06 01:02:03'"),
        "mt": ("make_timestamp(1998, 2, 3, 4, 5, 6)", "make_timestamp(1998, 2, 3, 4, 5, 6)"),
        "ovl": ("pg_overlaps(o_orderdate, o_orderdate + interval 10 days, timestamp'1996-01-01', timestamp'1996-02-01')", "(o_orderdate < TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 10 DAY)"),
        "num": ("pg_to_number('$1,234.5')", "1234.5"),
        "fin": ("pg_isfinite('infinity')", "false"),
    },
)
_table(
    "functions_array",
    "part",
    "p_partkey",
    {
        "al": ("pg_array_length(split(p_type, ' '))", "len(string_split(p_type, ' '))"),
        "au": ("pg_array_upper(split(p_type, ' '))", "len(string_split(p_type, ' '))"),
        "alo": ("pg_array_lower(split(p_type, ' '))", "1"),
        "adm": ("pg_array_dims(split(p_type, ' '))", "'[1:' || len(string_split(p_type, ' ')) || ']'"),
        "ap": ("pg_array_position(array('x', p_brand), p_brand)", "list_position(['x', p_brand], p_brand)"),
        "apn": ("pg_array_position(array('x'), p_brand)", "NULL::BIGINT"),
        "aps": ("pg_array_positions(array('a', p_brand, 'a'), 'a')", "[1, 3]"),
        "ar": ("pg_array_replace(array('a', p_brand), 'a', 'b')", "['b', p_brand]"),
        "arm": ("pg_array_remove(array('a', p_brand, 'a'), 'a')", "[p_brand]"),
        "acat": ("pg_array_cat(array('a'), array(p_brand))", "['a', p_brand]"),
        "aap": ("pg_array_append(array('a'), p_brand)", "['a', p_brand]"),
        "app": ("pg_array_prepend(p_brand, array('a'))", "[p_brand, 'a']"),
        "af": ("pg_array_fill(p_brand, 2)", "[p_brand, p_brand]"),
        "gs": ("sequence(1, p_size % 4 + 1)", "range(1, p_size % 4 + 2)"),
        "iap": ("pg_array_append(array(1), p_size)", "[1, p_size]"),
        "ipos": ("pg_array_positions(array(p_size, 1, p_size), p_size)", "CASE WHEN p_size = 1 THEN [1, 2, 3] ELSE [1, 3] END"),
        "irep": ("pg_array_replace(array(p_size, 1), 1, 9)", "CASE WHEN p_size = 1 THEN [9, 9] ELSE [p_size, 9] END"),
        "gsub": ("pg_generate_subscripts(array('a', 'b'))", "[1, 2]"),
        "card": ("cardinality(array(1, 2, 3))", "3"),
        "ovl": ("arrays_overlap(array(p_size), array(1, 2, 3))", "list_has_any([p_size], [1, 2, 3])"),
    },
)
_table(
    "functions_json",
    "events",
    "event_id",
    {
        "k": ("pg_json_extract_path(props, 'k')", "props->>'$.k'"),
        "kt": ("cast(pg_json_extract_path_text(props, 'k') AS INT)", "(props->>'$.k')::INT"),
        "deep": ("pg_json_extract_path('{\"a\": {\"b\": [5, 6]}}', 'a', 'b', '1')", "'6'"),
        "setp": ("pg_jsonb_set('{\"a\":{\"b\":1}}', '{a,b}', cast(event_id AS STRING))", "'{\"a\":{\"b\":' || event_id || '}}'"),
        "delp": ("pg_jsonb_delete_path('{\"a\":{\"b\":1,\"c\":2}}', '{a,b}')", "'{\"a\":{\"c\":2}}'"),
        "cont": ("pg_jsonb_contains(props, '{}')", "true"),
        "cont2": ("pg_jsonb_contains('{\"a\":[1,2]}', '{\"a\":[2]}')", "true"),
        "pret": ("pg_jsonb_pretty('{\"a\":1}')", "'{' || chr(10) || '  \"a\": 1' || chr(10) || '}'"),
        "rtj": ("pg_row_to_json(named_struct('id', event_id))", "'{\"id\":' || event_id || '}'"),
        "keys": ("json_object_keys(props)", "json_keys(props)"),
        "ty": ("pg_json_typeof(props)", "lower(json_type(props))"),
        "each": ("pg_json_each(props).key", "json_keys(props)"),
        "el": ("pg_json_array_elements('[1,2]')", "['1', '2']"),
        "len": ("json_array_length('[1,2,3]')", "3"),
        "bo": ("to_json(named_struct('id', event_id))", "'{\"id\":' || event_id || '}'"),
        "ba": ("to_json(array(event_id, user_id))", "'[' || event_id || ',' || user_id || ']'"),
        "cat": ("pg_json_concat('{\"a\":1}', '{\"b\":2}')", "'{\"a\":1,\"b\":2}'"),
        "del": ("pg_json_delete('{\"a\":1,\"b\":2}', 'a')", "'{\"b\":2}'"),
        "st": ("pg_json_set('{\"a\":1}', 'b', '2')", "'{\"a\":1,\"b\":2}'"),
        "sn": ("pg_json_strip_nulls('{\"a\":1,\"b\":null}')", "'{\"a\":1}'"),
    },
)
_table(
    "functions_system",
    "part",
    "p_partkey",
    {
        "ti": ("pg_typeof(p_size)", "'integer'"),
        "tr": ("pg_typeof(p_retailprice)", "'real'"),
        "tt": ("pg_typeof(p_name)", "'text'"),
        "tb": ("pg_typeof(p_size > 3)", "'boolean'"),
        "tn": ("pg_typeof(CAST(NULL AS INT))", "'null'"),
        "cs": ("pg_current_schema()", "'public'"),
        "pr": ("pg_has_schema_privilege('s', 'x') AND pg_has_column_privilege('t', 'c', 'x')", "true"),
        "tx": ("pg_txid_current()", "1::BIGINT"),
        "uu": ("length(pg_gen_random_uuid())", "36"),
        "rn": ("pg_random() BETWEEN 0 AND 1", "true"),
        "nw": ("pg_statement_timestamp() = pg_transaction_timestamp() AND pg_now() > TIMESTAMP '2020-01-01'", "true"),
        "tz": ("pg_trim_scale(p_retailprice)", "p_retailprice"),
        "jh": ("pg_justify_hours('3 hours')", "'3 hours'"),
        "ji": ("pg_justify_interval('3 hours')", "'3 hours'"),
        "po": ("pg_position(p_name, 'a')", "strpos(p_name, 'a')"),
        "dw": ("pg_st_within(0D, 0D, 1D, 1D, 200000D)", "true"),
        "dn": ("pg_st_dwithin(0D, 0D, 1D, 1D, 100000D)", "false"),
        "ds": ("pg_date_subtract('day', p_size, TIMESTAMP '2024-03-01 00:00:00')", "TIMESTAMP '2024-03-01 00:00:00' - to_days(p_size)"),
        "lg": ("ln(p_size)", "ln(p_size)"),
    },
)
_table("functions_hash", "part", "p_partkey", {"h": ("pg_hashtext(p_brand)", "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(p_brand) + 1), lambda i: ascii(p_brand[i])::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT"), "qn": ("pg_quote_nullable(CAST(NULL AS STRING))", "'NULL'"), "ta": ("pg_to_ascii(concat(p_brand, 'é'))", "p_brand || '?'"), "priv": ("pg_has_table_privilege('t', 'x')", "true"), "ms": ("pg_min_scale('12.300')", "1"), "js": ("pg_justify_days('3 days')", "'3 days'")})


@query(
    "functions_spatial",
    """SELECT c_custkey, 2 * 6371000 * asin(sqrt(pow(sin(radians(40.7 - y) / 2), 2) + cos(radians(y)) * cos(radians(40.7)) * pow(sin(radians(-74.0 - x) / 2), 2))) AS metres
       FROM (SELECT c_custkey, (c_custkey * 37 % 360) - 180.0 AS x, (c_custkey * 17 % 140) - 70.0 AS y FROM customer)""",
)
def _(spark, d):
    t = Tables(spark, d).customer.select("c_custkey", ((F.col("c_custkey") * 37) % 360 - 180.0).alias("x"), ((F.col("c_custkey") * 17) % 140 - 70.0).alias("y"))
    return t.select("c_custkey", spatial.distance(F.col("x"), F.col("y"), F.lit(-74.0), F.lit(40.7)).alias("metres"))


@query(
    "spatial_within",
    """SELECT doc_id, 1 - m / 3000000 AS score FROM (SELECT doc_id, 2 * 6371000 * asin(sqrt(pow(sin(radians(20 - y) / 2), 2) + cos(radians(y)) * cos(radians(20)) * pow(sin(radians(10 - x) / 2), 2))) AS m
       FROM (SELECT c_custkey AS doc_id, (c_custkey * 37 % 360) - 180.0 AS x, (c_custkey * 17 % 140) - 70.0 AS y FROM customer)) WHERE m <= 3000000""",
)
def _(spark, d):
    t = Tables(spark, d).customer.select(F.col("c_custkey").alias("doc_id"), ((F.col("c_custkey") * 37) % 360 - 180.0).alias("x"), ((F.col("c_custkey") * 17) % 140 - 70.0).alias("y"))
    return spatial.within(t, 10, 20, 3_000_000)
