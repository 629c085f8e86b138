"""Queries over the relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import scored as S
from .registry import query
from .tables import Tables

# --- scans, filters, projections ---------------------------------------------------------------------------------------------------


@query("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 10 AND l_discount BETWEEN 0.02 AND 0.05")
def _(spark, d):
    t = Tables(spark, d).lineitem
    return t.where((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("l_quantity") < 10) & F.col("l_discount").between(0.02, 0.05)).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def _(spark, d):
    return Tables(spark, d).customer.where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


@query(
    "predicates",
    """SELECT p_partkey, p_size <> 10 AS ne, p_size > 20 AS gt, p_size >= 20 AS ge, p_size < 20 AS lt, p_size <= 20 AS le, p_size IN (1, 5, 9) AS isin,
       p_size BETWEEN 5 AND 15 AS btw, p_brand IS NULL AS isnull, p_brand IS NOT NULL AS notnull, p_name LIKE '%a%' AS lk, p_name NOT LIKE '%a%' AS nlk,
       p_name ILIKE '%A%' AS ilk, p_name NOT ILIKE '%A%' AS nilk, regexp_full_match(p_brand, 'Brand.(1|2).*') AS sim, p_size BETWEEN 5 AND 15 AS sym,
       p_size IN (3, 7) AS any_eq, p_size > 7 AS all_gt, p_brand IS DISTINCT FROM 'Brand#11' AS dist, nullif(p_size, 5) AS nif,
       CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS bucket FROM part""",
)
def _(spark, d):
    s, n, b = F.col("p_size"), F.col("p_name"), F.col("p_brand")
    two = F.array(F.lit(3), F.lit(7))
    return Tables(spark, d).part.select(
        "p_partkey",
        (s != 10).alias("ne"),
        (s > 20).alias("gt"),
        (s >= 20).alias("ge"),
        (s < 20).alias("lt"),
        (s <= 20).alias("le"),
        s.isin(1, 5, 9).alias("isin"),
        s.between(5, 15).alias("btw"),
        b.isNull().alias("isnull"),
        b.isNotNull().alias("notnull"),
        n.like("%a%").alias("lk"),
        (~n.like("%a%")).alias("nlk"),
        n.ilike("%A%").alias("ilk"),
        (~n.ilike("%A%")).alias("nilk"),
        R.similar_to(b, "Brand_(1|2)%").alias("sim"),
        R.between_symmetric(s, F.lit(15), F.lit(5)).alias("sym"),
        R.compare_any(s, "=", two).alias("any_eq"),
        R.compare_all(s, ">", two).alias("all_gt"),
        R.is_distinct(b, F.lit("Brand#11")).alias("dist"),
        F.nullif(s, F.lit(5)).alias("nif"),
        F.when(s < 10, "small").when(s < 30, "mid").otherwise("large").alias("bucket"),
    )


@query("cast_rules", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, o_totalprice > 1000 AS big, o_orderkey::VARCHAR AS txt, (o_orderkey % 2 = 0) IS NOT TRUE AS odd FROM orders")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", F.col("o_totalprice").cast("long").alias("whole"), (F.col("o_totalprice") > 1000).alias("big"), F.col("o_orderkey").cast("string").alias("txt"), (~(F.col("o_orderkey") % 2 == 0).eqNullSafe(F.lit(True))).alias("odd"))


@query("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS t(column1, column2)")
def _(spark, d):
    return R.values(spark, [(1, "a"), (2, None), (None, "c")], ["int", "string"])


# --- joins ---------------------------------------------------------------------------------------------------------------------------

_JOIN = "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c {} JOIN (SELECT * FROM orders WHERE o_orderkey % 5 = 0) o ON c_custkey = o_custkey"


def _join(how: str):
    def run(spark, d) -> DataFrame:
        t = Tables(spark, d)
        a, b = t.customer.where("c_custkey % 3 <> 0"), t.orders.where("o_orderkey % 5 = 0")
        return a.join(b, a["c_custkey"] == b["o_custkey"], how).select("c_custkey", "o_orderkey")

    return run


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    query(f"join_{_how}", _JOIN.format(_sql))(_join(_how))


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(spark, d):
    t = Tables(spark, d)
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("join_theta", "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey AND a.s_suppkey % 7 = b.n_regionkey")
def _(spark, d):
    t = Tables(spark, d)
    return t.supplier.join(t.nation, (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_suppkey") % 7 == F.col("n_regionkey"))).select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_lateral", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM customer WHERE c_custkey < 200) c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x")
def _(spark, d):
    t = Tables(spark, d)
    w = R.ranking(["o_custkey"], ["o_totalprice desc", "o_orderkey"])
    best = t.orders.where("o_custkey < 200").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return t.customer.where("c_custkey < 200").join(best, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("join_five_way", "SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer, orders, lineitem, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name")
def _(spark, d):
    t = Tables(spark, d)
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("n_name")
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    )


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.customer.where("c_custkey <= 300").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") / 10000).alias("score"), F.col("c_nationkey").alias("k"))
    b = t.supplier.select(F.col("s_suppkey").alias("doc_id"), (F.col("s_acctbal") / 10000).alias("score"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("k"))
    return a, b


_SIDES = "WITH a AS (SELECT c_custkey AS id, c_acctbal / 10000 AS s, c_nationkey AS k FROM customer WHERE c_custkey <= 300), b AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS s, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS k FROM supplier) "
for _how in ("inner", "left", "right", "full"):
    query(f"scored_join_{_how}", _SIDES + f"SELECT a.id AS left_id, a.k AS left_k, b.id AS right_id, b.k AS right_k, coalesce(a.s, 0) + coalesce(b.s, 0) AS score FROM a {_how} JOIN b ON a.k = b.k")(
        lambda spark, d, how=_how: S.join(*_sides(Tables(spark, d)), "k", "k", how)
    )
query("scored_merge_join", _SIDES + "SELECT a.id AS left_id, a.k AS left_k, b.id AS right_id, b.k AS right_k, a.s + b.s AS score FROM a JOIN b ON a.k = b.k")(lambda spark, d: S.merge_join(*_sides(Tables(spark, d)), "k", "k"))
query("scored_index_join", _SIDES + "SELECT a.id AS left_id, a.k AS left_k, b.id AS right_id, b.k AS right_k, a.s + b.s AS score FROM a JOIN b ON a.k = b.k")(lambda spark, d: S.index_join(*_sides(Tables(spark, d)), "k", "k"))
query("scored_cross", _SIDES + "SELECT a.id AS left_id, a.k AS left_k, b.id AS right_id, b.k AS right_k, a.s + b.s AS score FROM a, b")(lambda spark, d: S.cross(*_sides(Tables(spark, d))))
query("scored_semi", _SIDES + "SELECT id AS doc_id, s AS score, k FROM a WHERE id IN (SELECT id FROM b)")(lambda spark, d: S.semi(*_sides(Tables(spark, d))))
query("scored_anti", _SIDES + "SELECT id AS doc_id, s AS score, k FROM a WHERE id NOT IN (SELECT id FROM b)")(lambda spark, d: S.anti(*_sides(Tables(spark, d))))

# --- aggregation -----------------------------------------------------------------------------------------------------------------------

#: SQL, and the expression, made at use: modules are imported without a session.
_AGGS = {
    "count_all": ("count(*)", lambda: F.count("*")),
    "count_distinct": ("count(DISTINCT l_suppkey)", lambda: F.count_distinct("l_suppkey")),
    "sum_qty": ("sum(l_quantity)", lambda: F.sum("l_quantity")),
    "avg_price": ("avg(l_extendedprice)", lambda: F.avg("l_extendedprice")),
    "min_ship": ("min(l_shipdate)", lambda: F.min("l_shipdate")),
    "max_tax": ("max(l_tax)", lambda: F.max("l_tax")),
    "bool_all": ("bool_and(l_quantity > 0)", lambda: F.bool_and(F.col("l_quantity") > 0)),
    "bool_any": ("bool_or(l_quantity > 49)", lambda: F.bool_or(F.col("l_quantity") > 49)),
    "sd_samp": ("stddev_samp(l_quantity)", lambda: F.stddev_samp("l_quantity")),
    "sd_pop": ("stddev_pop(l_quantity)", lambda: F.stddev_pop("l_quantity")),
    "v_samp": ("var_samp(l_quantity)", lambda: F.var_samp("l_quantity")),
    "v_pop": ("var_pop(l_quantity)", lambda: F.var_pop("l_quantity")),
    "filtered": ("count(*) FILTER (WHERE l_discount > 0.05)", lambda: F.count(F.when(F.col("l_discount") > 0.05, 1))),
}


@query("aggregate_group_by", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"{s} AS {n}" for n, (s, _) in _AGGS.items()) + " FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag", "l_linestatus").agg(*[c().alias(n) for n, (_, c) in _AGGS.items()]).where("count_all > 1")


_STATS = ["corr", "covar_pop", "covar_samp", "regr_count", "regr_avgx", "regr_avgy", "regr_sxx", "regr_syy", "regr_sxy", "regr_slope", "regr_intercept", "regr_r2"]


@query("aggregate_two_argument", "SELECT l_returnflag, " + ", ".join(f"{f}(l_extendedprice, l_quantity) AS {f}" for f in _STATS) + " FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(*[F.expr(f"{f}(l_extendedprice, l_quantity)").alias(f) for f in _STATS])


@query(
    "aggregate_ordered_set",
    """SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS p25, quantile_disc(c_acctbal, 0.5) AS p50d, mode(c_nationkey ORDER BY c_nationkey) AS md FROM
       (SELECT * FROM customer) GROUP BY c_mktsegment""".replace("mode(c_nationkey ORDER BY c_nationkey) AS md", "(SELECT c_nationkey FROM customer i WHERE i.c_mktsegment = o.c_mktsegment GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 1) AS md").replace("(SELECT * FROM customer) GROUP", "customer o GROUP"),
)
def _(spark, d):
    return Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.expr("percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal)").alias("p25"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY c_acctbal)").alias("p50d"), F.expr("mode() WITHIN GROUP (ORDER BY c_nationkey)").alias("md"))


@query(
    "aggregate_collect",
    """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_agg(n_nationkey ORDER BY n_nationkey DESC) AS keys,
       '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS obj, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS arr FROM nation GROUP BY n_regionkey""",
)
def _(spark, d):
    return Tables(spark, d).nation.groupBy("n_regionkey").agg(
        F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"),
        F.sort_array(F.collect_list("n_nationkey"), False).alias("keys"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))))).alias("obj"),
        F.to_json(F.sort_array(F.collect_list("n_nationkey"))).alias("arr"),
    )


@query("aggregate_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_tax) AS a FROM lineitem WHERE l_quantity < 0")
def _(spark, d):
    return Tables(spark, d).lineitem.where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.avg("l_tax").alias("a"))


@query("aggregate_inline", "SELECT o_orderpriority, sum(o_totalprice) / count(*) AS mean, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority HAVING sum(o_totalprice) > 1000")
def _(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderpriority").agg((F.sum("o_totalprice") / F.count("*")).alias("mean"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"), F.sum("o_totalprice").alias("total")).where("total > 1000").drop("total")


@query("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, d):
    return Tables(spark, d).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


for _m, _f in {"count": "count(c_acctbal)", "sum": "sum(c_acctbal)", "avg": "avg(c_acctbal)", "min": "min(c_acctbal)", "max": "max(c_acctbal)", "quantile": "quantile_cont(c_acctbal, 0.5)"}.items():
    query(f"monoid_{_m}", f"SELECT 0::BIGINT AS doc_id, {_f}::DOUBLE AS aggregate FROM customer")(lambda spark, d, m=_m: S.aggregate(Tables(spark, d).customer, "c_acctbal", m))
query("monoid_group_by", "SELECT c_mktsegment, avg(c_acctbal) AS aggregate FROM customer GROUP BY c_mktsegment")(lambda spark, d: S.group_by(Tables(spark, d).customer, "c_mktsegment", "c_acctbal", "avg"))
query("facet_one", "SELECT lang AS facet_value, count(*) AS facet_count FROM documents WHERE lang IS NOT NULL GROUP BY 1")(lambda spark, d: S.facet(Tables(spark, d).documents, "lang"))
query("facet_two", "SELECT 'lang' AS facet_field, lang AS facet_value, count(*) AS facet_count FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY ALL")(lambda spark, d: S.facet(Tables(spark, d).documents, "lang", "source"))

# --- windows -----------------------------------------------------------------------------------------------------------------------------

_W = "PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey"
_RANKS = {"rn": ("row_number()", lambda: F.row_number()), "rk": ("rank()", lambda: F.rank()), "dr": ("dense_rank()", lambda: F.dense_rank()), "pr": ("percent_rank()", lambda: F.percent_rank()), "cd": ("cume_dist()", lambda: F.cume_dist()), "nt": ("ntile(4)", lambda: F.ntile(4)), "lg": ("lag(c_acctbal, 2, -1)", lambda: F.lag("c_acctbal", 2, -1.0)), "ld": ("lead(c_acctbal)", lambda: F.lead("c_acctbal"))}


@query("window_ranking", "SELECT c_custkey, " + ", ".join(f"{s} OVER ({_W}) AS {n}" for n, (s, _) in _RANKS.items()) + " FROM customer")
def _(spark, d):
    w = R.ranking(["c_mktsegment"], ["c_acctbal", "c_custkey"])
    return Tables(spark, d).customer.select("c_custkey", *[c().over(w).alias(n) for n, (_, c) in _RANKS.items()])


@query("window_rank_ties", "SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) AS rk, dense_rank() OVER (ORDER BY c_nationkey) AS dr FROM customer")
def _(spark, d):
    w = R.ranking([], ["c_nationkey"])
    return Tables(spark, d).customer.select("c_custkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"))


@query("window_ntile_even", "SELECT c_custkey, (floor((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) * 5 / count(*) OVER (PARTITION BY c_mktsegment)) + 1)::INT AS b FROM customer")
def _(spark, d):
    return Tables(spark, d).customer.select("c_custkey", R.ntile_even(5, ["c_mktsegment"], ["c_custkey"]).alias("b"))


_FRAME = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {} AND {}"
_ALL, _RUN = _FRAME.format("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING"), _FRAME.format("UNBOUNDED PRECEDING", "CURRENT ROW")


@query(
    "window_aggregates",
    f"""SELECT o_orderkey, sum(o_totalprice) OVER ({_RUN}) AS s, count(*) OVER ({_RUN}) AS n, avg(o_totalprice) OVER ({_RUN}) AS a, min(o_totalprice) OVER ({_RUN}) AS lo,
        max(o_totalprice) OVER ({_RUN}) AS hi, first_value(o_orderkey) OVER ({_ALL}) AS f, last_value(o_orderkey) OVER ({_ALL}) AS l, nth_value(o_orderkey, 2) OVER ({_ALL}) AS n2,
        sum(o_totalprice) OVER (PARTITION BY o_custkey) AS whole FROM orders""",
)
def _(spark, d):
    order = ["o_orderdate", "o_orderkey"]
    run, whole, part = R.window(["o_custkey"], order), R.window(["o_custkey"], order, ("rows", None, None)), R.window(["o_custkey"])
    x = F.col("o_totalprice")
    return Tables(spark, d).orders.select(
        "o_orderkey", F.sum(x).over(run).alias("s"), F.count("*").over(run).alias("n"), F.avg(x).over(run).alias("a"), F.min(x).over(run).alias("lo"), F.max(x).over(run).alias("hi"),
        F.first("o_orderkey").over(whole).alias("f"), F.last("o_orderkey").over(whole).alias("l"), F.nth_value("o_orderkey", 2).over(whole).alias("n2"), F.sum(x).over(part).alias("whole"),
    )


@query(
    "window_frames",
    f"""SELECT o_orderkey, sum(o_totalprice) OVER ({_FRAME.format('1 PRECEDING', '1 FOLLOWING')}) AS near, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS band,
        count(*) FILTER (WHERE o_totalprice > 100000) OVER ({_RUN}) AS dear FROM orders""",
)
def _(spark, d):
    order = ["o_orderdate", "o_orderkey"]
    near, band, run = R.window(["o_custkey"], order, ("rows", -1, 1)), R.window(["o_orderstatus"], ["o_custkey"], ("range", -5, 5)), R.window(["o_custkey"], order)
    return Tables(spark, d).orders.select("o_orderkey", F.sum("o_totalprice").over(near).alias("near"), F.count("*").over(band).alias("band"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).over(run).alias("dear"))


# --- sorts, limits, sets, subqueries ----------------------------------------------------------------------------------------------------------


@query("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 5")
def _(spark, d):
    return R.order_by(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey").offset(5).limit(20)


@query("order_nulls_default", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS v FROM customer) ORDER BY v ASC NULLS LAST, k LIMIT 1000")
def _(spark, d):
    t = Tables(spark, d).customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("v"))
    return R.top_k(t, 1000, "v", "k")


def _key_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


for _op in ("union", "intersect", "except"):
    for _all in (False, True):
        query(f"set_{_op}{'_all' * _all}", f"SELECT c_nationkey AS k FROM customer {_op} {'ALL' * _all} SELECT s_nationkey FROM supplier")(lambda spark, d, op=_op, a=_all: R.set_op(*_key_sides(Tables(spark, d)), op, a))


@query("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > (SELECT avg(total) FROM big)) SELECT count(*) AS n, sum(total) AS total FROM top")
def _(spark, d):
    Tables(spark, d).orders.createOrReplaceTempView("cte_orders")
    return spark.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM cte_orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > (SELECT avg(total) FROM big)) SELECT count(*) AS n, sum(total) AS total FROM top")


@query("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def _(spark, d):
    seed = spark.createDataFrame([(1, 1)], "n int, f long")
    return R.fixpoint(seed, lambda new: new.where("n < 15").select(F.col("n") + 1, F.col("f") * (F.col("n") + 1)), distinct=False)


@query("recursive_union", "WITH RECURSIVE r(k) AS (SELECT 3 UNION SELECT (k * 7) % 25 FROM r) SELECT k FROM r")
def _(spark, d):
    return R.fixpoint(spark.createDataFrame([(3,)], "k int"), lambda new: new.select((F.col("k") * 7) % 25))


@query("subqueries", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey) AS beats FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, d):
    t = Tables(spark, d)
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    best = t.supplier.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))
    c = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").join(best, F.col("c_nationkey") == F.col("s_nationkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("c_acctbal") > F.col("best"), F.lit(True)).alias("beats"))


# --- statements as DataFrames ------------------------------------------------------------------------------------------------------------------


@query("upsert_nothing", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    t = Tables(spark, d)
    return R.upsert(t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), t.supplier.select(F.col("s_suppkey").alias("n_nationkey"), F.col("s_name").alias("n_name")), ["n_nationkey"], None)


@query("upsert_update", "SELECT n.n_nationkey, coalesce(s_name, n_name) AS n_name FROM nation n LEFT JOIN supplier ON s_suppkey = n_nationkey UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    t = Tables(spark, d)
    return R.upsert(t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), t.supplier.select(F.col("s_suppkey").alias("n_nationkey"), F.col("s_name").alias("n_name")), ["n_nationkey"], {"n_name": F.col("new.n_name")})


@query("update_from", "SELECT n_nationkey, coalesce((SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey), n_name) AS n_name FROM nation")
def _(spark, d):
    t = Tables(spark, d)
    return R.update_from(t.nation.select("n_nationkey", "n_name"), t.supplier, F.col("t.n_nationkey") == F.col("s.s_nationkey"), {"n_name": F.col("s.s_name")}, ["s_name"])


@query("delete_using", "SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0)")
def _(spark, d):
    t = Tables(spark, d)
    return R.delete_using(t.nation.select("n_nationkey", "n_name"), t.supplier.where("s_acctbal < 0"), F.col("t.n_nationkey") == F.col("s.s_nationkey"))
