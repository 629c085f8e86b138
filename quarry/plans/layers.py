"""Queries over layered fusion, bounded top-k, graph indexes and matches that use vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..graph import core, paths
from ..graph import indexes as gi
from ..operators import deep
from ..operators.lineage import shared_dir
from ..text import topk
from .graph import CUSTOMER, NATION, SUPPLIER, E, V, nations, trade
from .registry import query
from .retrieval import Q1, Q2, _bm25_sql, _index
from .tables import Tables

# --- deep fusion over nations and regions: a nation's signal is a function of its key ------------------------------------------------

_P = f"p AS (SELECT n_nationkey + {NATION} AS id, 0.1 + (n_nationkey % 8) / 10.0::DOUBLE AS p FROM nation)"
_N = f"n AS (SELECT n_nationkey + {NATION} AS a, n_regionkey AS b FROM nation UNION ALL SELECT n_regionkey, n_nationkey + {NATION} FROM nation)"
_L = "l AS (SELECT id, ln(p / (1 - p)) AS x FROM p)"


def _signal(t: Tables):
    return t.nation.select((F.col("n_nationkey") + NATION).cast("long").alias("doc_id"), (F.lit(0.1) + (F.col("n_nationkey") % 8) / 10.0).alias("score"))


def _deep(name: str, sql: str, layers, gating: str = "none", channel: int = 0) -> None:
    @query(name, sql)
    def _(spark, d):
        t = Tables(spark, d)
        return deep.deep_fusion([deep.layer(_signal(t)), *layers()], nations(t), gating=gating).select("doc_id", F.col("ch")[channel].alias("x"), "score")


_OUT = "SELECT id AS doc_id, x, 1 / (1 + exp(-x)) AS score FROM"
_deep("deep_signal", f"WITH {_P}, {_L} {_OUT} l", lambda: [])
_deep("deep_signal_relu", f"WITH {_P}, {_L} {_OUT} (SELECT id, greatest(x, 0) AS x FROM l)", lambda: [], "relu")
for _how, _agg in (("mean", "avg(p)"), ("sum", "least(sum(p), 1 - 1e-10)"), ("max", "max(p)")):
    _deep(
        f"deep_propagate_{_how}",
        f"WITH {_P}, {_L}, {_N}, m AS (SELECT a AS id, {_agg} AS q FROM n JOIN p ON b = p.id GROUP BY a) {_OUT} (SELECT id, coalesce(x, 0) + coalesce(ln(q / (1 - q)), 0) AS x FROM l FULL JOIN m USING (id))",
        lambda how=_how: [deep.propagate("in", how)],
    )
_deep(
    "deep_convolve",
    f"""WITH {_P}, {_L}, {_N}, two AS (SELECT DISTINCT x.a AS id, y.b AS o FROM n x JOIN n y ON x.b = y.a WHERE x.a <> y.b), m AS (SELECT two.id, avg(p) AS q FROM two JOIN p ON p.id = o GROUP BY two.id)
    {_OUT} (SELECT id, x + ln(v / (1 - v)) AS x FROM (SELECT l.id, l.x, 0.5 * p.p + 0.2 * coalesce(q, 0) AS v FROM l JOIN p USING (id) LEFT JOIN m USING (id)))""",
    lambda: [deep.convolve("in", [0.5, 0.3, 0.2])],
)
_deep("deep_pool_max", f"WITH {_P}, {_L} {_OUT} (SELECT min(id) AS id, max(x) AS x FROM (SELECT id, x, n_regionkey AS r FROM l JOIN nation ON n_nationkey + {NATION} = id) GROUP BY r)", lambda: [deep.pool("in", "max", 1000)])
_deep("deep_dense", f"WITH {_P}, {_L} SELECT id AS doc_id, -2 * x + 0.5 AS x, 1 / (1 + exp(-(3 * x + 1))) AS score FROM l", lambda: [deep.dense([[3.0], [-2.0]], [1.0, 0.5])], channel=1)
_deep("deep_softmax", f"WITH {_P}, {_L} SELECT id AS doc_id, exp(3 * x + 1) / (exp(3 * x + 1) + exp(0.5 - 2 * x)) AS x, greatest(exp(3 * x + 1), exp(0.5 - 2 * x)) / (exp(3 * x + 1) + exp(0.5 - 2 * x)) AS score FROM l", lambda: [deep.dense([[3.0], [-2.0]], [1.0, 0.5]), deep.softmax()])
_deep("deep_batch_norm", f"WITH {_P}, {_L} {_OUT} (SELECT id, (x - avg(x) OVER ()) / sqrt(var_pop(x) OVER () + 1e-5) AS x FROM l)", lambda: [deep.batch_norm(1e-5)])
_deep("deep_dropout", f"WITH {_P}, {_L} {_OUT} (SELECT id, x * 0.75 AS x FROM l)", lambda: [deep.dropout(0.25)])
_deep("deep_flatten", f"WITH {_P}, {_L} SELECT min(id) AS doc_id, arg_max(x, id) AS x, 1 / (1 + exp(-arg_min(x, id))) AS score FROM l", lambda: [deep.flatten()], channel=24)
_deep("deep_global_pool", f"WITH {_P}, {_L} SELECT min(id) AS doc_id, max(x) AS x, 1 / (1 + exp(-avg(x))) AS score FROM l", lambda: [deep.global_pool("avg_max")], channel=1)
_deep("deep_attention", f"WITH {_P}, {_L}, s AS (SELECT q.id, exp(q.x * k.x) AS e, k.x AS v FROM l q, l k) {_OUT} (SELECT id, sum(e * v) / sum(e) AS x FROM s GROUP BY id)", lambda: [deep.attention(1)])


@query("deep_embed", "SELECT 1::BIGINT AS doc_id, 0.5::DOUBLE AS x UNION ALL SELECT 2, -1.0")
def _(spark, d):
    return deep.deep_fusion([deep.embed([0.5, -1.0])], nations(Tables(spark, d))).select("doc_id", F.col("ch")[0].alias("x"))


@query("deep_learn")
def _(spark, d):
    """Held against a fixed seed by tests; here, the classes that the learner gives back to its own rows."""
    rows = Tables(spark, d).embeddings
    model = deep.deep_learn(rows, (("orthogonal", 8, 2),))
    return deep.deep_predict(rows, model, "embedding", "vec_id", "label")


# --- top-k with bounds -----------------------------------------------------------------------------------------------------------------

_TOP = f"WITH {_bm25_sql(Q1)} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20"


@query("wand_top_k", _TOP)
def _(spark, d):
    return topk.wand(_index(Tables(spark, d)), "text", Q1, 20)


@query("block_max_wand_top_k", _TOP)
def _(spark, d):
    return topk.block_max(_index(Tables(spark, d)), "text", Q1, 20)


@query("adaptive_wand_top_k", _TOP)
def _(spark, d):
    return topk.adaptive(_index(Tables(spark, d)), "text", Q1, 20)


@query("bound_analyzer", f"WITH {_bm25_sql(Q1)} SELECT term, max(w) AS bound, count(*) AS n FROM h GROUP BY term")
def _(spark, d):
    plan = topk.analyse(topk._hits(_index(Tables(spark, d)), "text", Q1), 20)
    return spark.createDataFrame([(t, plan.bounds[t], plan.counts[t]) for t in plan.bounds], "term string, bound double, n long")  # a row a query term


_FUSED = f"WITH {_bm25_sql(Q1)}, {_bm25_sql(Q2, '2')}, u AS (SELECT doc_id, b.score AS p, b2.score AS q FROM b FULL JOIN b2 USING (doc_id)), r AS (SELECT count(p) / count(*) AS rp, count(q) / count(*) AS rq FROM u), z AS (SELECT doc_id, coalesce(p, 0.5 * (1 - rp) + 0.01 * rp) AS p, coalesce(q, 0.5 * (1 - rq) + 0.01 * rq) AS q FROM u, r) SELECT doc_id, 1 / (1 + exp(-((ln(p / (1 - p)) + ln(q / (1 - q))) / 2 * sqrt(2)))) AS score FROM z ORDER BY score DESC, doc_id LIMIT 15"


@query("fusion_wand_top_k", _FUSED)
def _(spark, d):
    i = _index(Tables(spark, d))
    return topk.fused([i.bayesian("text", Q1), i.bayesian("text", Q2)], 15)


@query("fusion_wand_tightened_top_k", _FUSED)
def _(spark, d):
    i = _index(Tables(spark, d))
    return topk.fused([i.bayesian("text", Q1), i.bayesian("text", Q2)], 15, tightened=True)


# --- graph indexes -----------------------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


@query("graph_label_index", f"WITH {V} SELECT id FROM v WHERE label = 'supplier'")
def _(spark, d):
    return gi.LabelIndex(trade(Tables(spark, d)), _folder(spark)).ids("supplier")


@query("graph_vertex_property_index", f"WITH {V} SELECT id FROM v WHERE bal BETWEEN 100 AND 2000")
def _(spark, d):
    return gi.PropertyIndex(trade(Tables(spark, d)).vertices, _folder(spark)).between("acctbal", 100, 2000)


@query("graph_edge_property_index", "SELECT event_id AS id FROM events WHERE day(ts) = 4")
def _(spark, d):
    from .graph import visits

    return gi.PropertyIndex(visits(Tables(spark, d)).edges, _folder(spark)).equal("timestamp", 4)


@query("graph_neighborhood_index", f"WITH {E}, b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e), one AS (SELECT z AS near FROM b WHERE a = 103), two AS (SELECT DISTINCT b.z AS near FROM one JOIN b ON a = near WHERE b.z <> 103 AND b.z NOT IN (SELECT near FROM one)) SELECT near, 1 AS depth FROM one UNION ALL SELECT near, 2 FROM two")
def _(spark, d):
    return gi.NeighborhoodIndex(trade(Tables(spark, d)), 2).of(NATION + 3)


@query("graph_path_index", f"WITH {E} SELECT DISTINCT a.src AS start_id, b.dst AS end_id FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'based' AND b.label = 'in'")
def _(spark, d):
    return gi.PathIndex(trade(Tables(spark, d)), [["based", "in"], ["lives", "in"]]).pairs(["based", "in"])


_SHAPE = {"s": paths.V("supplier"), "n": paths.V("nation"), "r": paths.V("region")}
_EDGES = [paths.E("s", "n", "based"), paths.E("n", "r", "in")]


@query("graph_subgraph_index", f"SELECT s_suppkey + {SUPPLIER} AS s, n_nationkey + {NATION} AS n, n_regionkey::BIGINT AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    held = gi.SubgraphIndex(trade(Tables(spark, d)))
    held.matches(_SHAPE, _EDGES)
    return held.matches(_SHAPE, _EDGES)


@query("graph_incremental_match", f"SELECT s_suppkey + {SUPPLIER} AS s, n_nationkey + {NATION} AS n, n_regionkey::BIGINT AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    """Matches of a graph that lacked five nations, brought up to date."""
    g = trade(Tables(spark, d))
    new = g.vertices.where(F.col("label") == "nation").where(F.col("id") < NATION + 5).select("id")
    old = core.Delta(drop_vertices=new).apply(g)
    return paths.incremental(g, paths.match(old, _SHAPE, _EDGES), new, _SHAPE, _EDGES)


_SIM = "(x * 1.0 + y * 0.5) / (sqrt(x * x + y * y) * sqrt(1.25))"
_XY = f"SELECT n_nationkey + {NATION} AS id, ((n_nationkey * 7) % 11)::DOUBLE + 1 AS x, ((n_nationkey * 3) % 5)::DOUBLE + 1 AS y FROM nation"


def _vectors(t: Tables):
    k = F.col("n_nationkey")
    return t.nation.select((k + NATION).cast("long").alias("id"), F.array(((k * 7) % 11).cast("double") + 1, ((k * 3) % 5).cast("double") + 1).alias("embedding"))


@query("graph_vertex_embedding", f"SELECT id AS doc_id, {_SIM} AS score FROM ({_XY}) WHERE {_SIM} >= 0.9")
def _(spark, d):
    t = Tables(spark, d)
    return gi.vertex_embedding(trade(t), _vectors(t), [1.0, 0.5], 0.9)


@query("graph_vector_match", f"SELECT s_suppkey + {SUPPLIER} AS s, id AS n, {_SIM} AS score FROM ({_XY}) JOIN supplier ON s_nationkey + {NATION} = id WHERE {_SIM} >= 0.9")
def _(spark, d):
    t = Tables(spark, d)
    return gi.vector_match(trade(t), {"s": paths.V("supplier"), "n": paths.V("nation")}, [paths.E("s", "n", "based")], "n", _vectors(t), [1.0, 0.5], 0.9)


@query("graph_relational_join", f"SELECT c_custkey + {CUSTOMER} AS c, n_nationkey + {NATION} AS n, n_name, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000")
def _(spark, d):
    t = Tables(spark, d)
    g = trade(t)
    found = paths.match(g, {"c": paths.V("customer", where="cast(try_element_at(props, 'acctbal') AS double) > 5000"), "n": paths.V("nation")}, [paths.E("c", "n", "lives")])
    return gi.graph_relational_join(found, "n", g, "name", t.nation.select("n_name", "n_regionkey"), "n_name")
