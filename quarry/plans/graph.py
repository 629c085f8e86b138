"""Queries over property graphs made of the supplied tables' keys, and over points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import core, paths
from ..operators import spatial
from .registry import query
from .tables import Tables

NATION, CUSTOMER, SUPPLIER = 100, 1_000, 10_000_000


def trade(t: Tables) -> core.Graph:
    """customer -lives-> nation -in-> region; supplier -based-> nation."""
    props = lambda *pairs: F.create_map(*[x for k, c in pairs for x in (F.lit(k), F.col(c).cast("string"))])
    vertex = lambda df, i, label, name, bal: df.select(i.cast("long").alias("id"), F.lit(label).alias("label"), props(("name", name), *([("acctbal", bal)] if bal else [])).alias("props"))
    region = vertex(t.region, F.col("r_regionkey"), "region", "r_name", None)
    nation = vertex(t.nation, F.col("n_nationkey") + NATION, "nation", "n_name", None)
    customer = vertex(t.customer, F.col("c_custkey") + CUSTOMER, "customer", "c_name", "c_acctbal")
    supplier = vertex(t.supplier, F.col("s_suppkey") + SUPPLIER, "supplier", "s_name", "s_acctbal")
    edge = lambda df, a, b, label: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(label).alias("label"))
    edges = edge(t.nation, F.col("n_nationkey") + NATION, F.col("n_regionkey"), "in").unionAll(edge(t.customer, F.col("c_custkey") + CUSTOMER, F.col("c_nationkey") + NATION, "lives")).unionAll(edge(t.supplier, F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey") + NATION, "based"))
    return core.Graph.of(region.unionAll(nation).unionAll(customer).unionAll(supplier), edges, "trade")


def nations(t: Tables) -> core.Graph:
    """Only nations and regions: small enough for all-pairs measures."""
    g = trade(t)
    return g.subgraph(g.vertices.where(F.col("label").isin("nation", "region")))


def visits(t: Tables) -> core.Graph:
    """user -event type-> 'type' vertices, each edge with the event's day as its timestamp."""
    e = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("src"), (F.lit(-1) - F.length("event_type")).cast("long").alias("dst"), F.col("event_type").alias("label"), F.create_map(F.lit("timestamp"), F.dayofmonth("ts").cast("string")).alias("props"))
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("label", F.when(F.col("id") < 0, "kind").otherwise("user"))
    return core.Graph.of(v, e, "visits")


def chain(t: Tables) -> core.Graph:
    """nation -next-> the nation of the following key, with a weight."""
    k = F.col("n_nationkey").cast("long")
    e = t.nation.where("n_nationkey < 24").select(k.alias("src"), (k + 1).alias("dst"), F.lit("next").alias("label"), F.create_map(F.lit("weight"), (k * 0.5 + 1).cast("string")).alias("props"))
    return core.Graph.of(t.nation.select(k.alias("id"), F.lit("nation").alias("label")), e, "chain")


_CHAIN = "k AS (SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT + 1 AS z, n_nationkey * 0.5::DOUBLE + 1 AS w FROM nation WHERE n_nationkey < 24)"
E = f"""e AS (SELECT n_nationkey + {NATION} AS src, n_regionkey AS dst, 'in' AS label FROM nation UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 'lives' FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + {NATION}, 'based' FROM supplier)"""
V = f"""v AS (SELECT r_regionkey::BIGINT AS id, 'region' AS label, NULL::DOUBLE AS bal FROM region UNION ALL SELECT n_nationkey + {NATION}, 'nation', NULL FROM nation
  UNION ALL SELECT c_custkey + {CUSTOMER}, 'customer', c_acctbal FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER}, 'supplier', s_acctbal FROM supplier)"""
B = "b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e)"


@query("graph_traverse", f"WITH RECURSIVE {E}, {B}, w(id, d) AS (SELECT 103::BIGINT, 0 UNION SELECT z, d + 1 FROM w JOIN b ON a = id WHERE d < 3) SELECT id AS doc_id, 1.0 / (1 + min(d)) AS score FROM w GROUP BY id")
def _(spark, d):
    return trade(Tables(spark, d)).traverse(NATION + 3, hops=3, direction="both")


@query("graph_traverse_label", f"WITH {E} SELECT 103::BIGINT AS doc_id, 1.0::DOUBLE AS score UNION ALL SELECT dst, 0.5 FROM e WHERE src = 103 AND label = 'in'")
def _(spark, d):
    return trade(Tables(spark, d)).traverse(NATION + 3, "in", hops=2)


@query("graph_neighbors", f"WITH {E}, {V} SELECT src AS id, v.label, 1 AS depth FROM e JOIN v ON v.id = src WHERE dst = 103")
def _(spark, d):
    return trade(Tables(spark, d)).neighbors(NATION + 3, direction="in").drop("path")


@query("graph_rpq", f"WITH {E} SELECT DISTINCT a.src AS start_id, b.dst AS end_id FROM e a JOIN e b ON a.dst = b.src WHERE a.label IN ('lives', 'based') AND b.label = 'in'")
def _(spark, d):
    return paths.rpq(trade(Tables(spark, d)), "(lives|based)/in")


@query("graph_rpq_star", f"WITH {E}, {V} SELECT id AS start_id, id AS end_id FROM v UNION SELECT src, dst FROM e WHERE label = 'in'")
def _(spark, d):
    return paths.rpq(trade(Tables(spark, d)), "in*")


@query("graph_rpq_bounded", f"WITH {_CHAIN} SELECT DISTINCT a AS start_id, z AS end_id FROM (SELECT a, z FROM k UNION ALL SELECT x.a, y.z FROM k x JOIN k y ON x.z = y.a)")
def _(spark, d):
    return paths.rpq(chain(Tables(spark, d)), "next{1,2}")


@query("graph_weighted_rpq", f"WITH {_CHAIN} SELECT y.z AS doc_id, x.w + y.w AS score FROM k x JOIN k y ON x.z = y.a WHERE x.a = 4")
def _(spark, d):
    return paths.weighted_rpq(chain(Tables(spark, d)), "next/next", 4, "weight")


PATTERN = {"c": paths.V("customer", where="cast(try_element_at(props, 'acctbal') AS double) > 9000"), "n": paths.V("nation"), "s": paths.V("supplier", where="cast(try_element_at(props, 'acctbal') AS double) < 0")}


@query(
    "graph_match",
    f"SELECT c_custkey + {CUSTOMER} AS c, c_nationkey + {NATION} AS n, s_suppkey + {SUPPLIER} AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal < 0",
)
def _(spark, d):
    return paths.match(trade(Tables(spark, d)), PATTERN, [paths.E("c", "n", "lives"), paths.E("s", "n", "based")]).select(*[F.col(x).cast("long").alias(x) for x in "cns"])


@query("graph_match_negated", f"SELECT n_nationkey + {NATION} AS n, r_regionkey::BIGINT AS r FROM nation, region WHERE n_regionkey <> r_regionkey")
def _(spark, d):
    """Pairs without an edge between them."""
    return paths.match(nations(Tables(spark, d)), {"n": paths.V("nation"), "r": paths.V("region")}, [paths.E("n", "r", "in", negated=True)])


@query("graph_temporal_traverse", "SELECT user_id AS doc_id, 0.5::DOUBLE AS score FROM events WHERE event_type = 'purchase' AND day(ts) BETWEEN 3 AND 5 GROUP BY user_id UNION ALL SELECT -9, 1.0")
def _(spark, d):
    return visits(Tables(spark, d)).traverse(-1 - len("purchase"), "purchase", direction="in", edge_filter=core.temporal(between=(3, 5)))


@query("graph_message_passing", f"WITH {E}, {V}, m AS (SELECT node, avg(1.0) AS m FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT id AS doc_id, 1 / (1 + exp(-(1.0 + coalesce(m, 0)))) AS score FROM v LEFT JOIN m ON node = id")
def _(spark, d):
    return core.message_passing(trade(Tables(spark, d)), rounds=1)


@query("graph_vertex_aggregate", f"WITH {V} SELECT id AS doc_id, (SELECT avg(bal) FROM v WHERE label = 'customer') AS score FROM v WHERE label = 'customer'")
def _(spark, d):
    g = trade(Tables(spark, d))
    return core.vertex_aggregate(g.vertices.where("label = 'customer'").select(F.col("id").alias("doc_id")), g, "acctbal")


@query("graph_join", f"WITH {E} SELECT src AS left_id, dst AS right_id, 3.0::DOUBLE AS score FROM e WHERE label = 'lives'")
def _(spark, d):
    g = trade(Tables(spark, d))
    side = lambda label, s: g.vertices.where(F.col("label") == label).select(F.col("id").alias("doc_id"), F.lit(s).alias("score"))
    return core.graph_join(side("customer", 1.0), g, side("nation", 2.0), "lives").select("left_id", "right_id", "score")


@query("graph_degree", f"WITH {E} SELECT node AS id, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def _(spark, d):
    return trade(Tables(spark, d)).steps(direction="both").groupBy(F.col("at").alias("id")).agg(F.count("*").alias("degree"))


@query("graph_algebra", f"WITH {V} SELECT label, count(*) AS n FROM v WHERE label <> 'supplier' GROUP BY label")
def _(spark, d):
    g = trade(Tables(spark, d))
    suppliers = g.subgraph(g.vertices.where("label = 'supplier'"))
    return g.union(suppliers).difference(suppliers).vertices.groupBy("label").agg(F.count("*").alias("n"))


@query("graph_intersect", f"WITH {V} SELECT label, count(*) AS n FROM v WHERE label IN ('nation', 'customer') GROUP BY label")
def _(spark, d):
    g = trade(Tables(spark, d))
    part = lambda *labels: g.subgraph(g.vertices.where(F.col("label").isin(*labels)))
    return part("nation", "customer", "region").intersect(part("nation", "customer", "supplier")).vertices.groupBy("label").agg(F.count("*").alias("n"))


@query("graph_versions", f"WITH {V} SELECT 'now' AS at, label, count(*) AS n FROM v WHERE label <> 'region' GROUP BY label UNION ALL SELECT 'now', 'island', 1 UNION ALL SELECT 'before', label, count(*) FROM v GROUP BY label UNION ALL SELECT 'undone', label, count(*) FROM v GROUP BY label")
def _(spark, d):
    """A change that adds a vertex and takes five, its inverse, and a rollback."""
    g = trade(Tables(spark, d))
    log = core.Versions(g)
    island = core.Graph.of(spark.createDataFrame([(99_999_999, "island")], "id long, label string"), spark.createDataFrame([], "src long, dst long, label string")).vertices
    delta = core.Delta(add_vertices=island, drop_vertices=g.vertices.where("label = 'region'").select("id"))
    inverse = delta.inverse(g)
    log.apply(delta)
    count = lambda graph, at: graph.vertices.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(at).alias("at"), "label", "n")
    now = count(log.graph, "now")
    undone = count(inverse.apply(log.graph), "undone")
    return now.unionAll(undone).unionAll(count(log.rollback(0), "before"))


def _pagerank_sql(rounds: int) -> str:
    parts = [E, V, "g AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)", "n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM v, n)"]
    for k in range(1, rounds + 1):
        old = f"r{k - 1}"
        parts.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(s, 0) + loose / n) AS r FROM v LEFT JOIN (SELECT dst AS id, sum(r * w) AS s FROM g JOIN {old} ON src = id GROUP BY dst) i ON i.id = v.id, n, (SELECT sum(r) AS loose FROM {old} WHERE id NOT IN (SELECT src FROM e)))")
    return f"WITH {', '.join(parts)} SELECT id::BIGINT AS doc_id, r AS score FROM r{rounds}"


def _hits_sql(rounds: int) -> str:
    parts = [E, V, "h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS h FROM v)"]
    for k in range(1, rounds + 1):
        parts.append(f"x{k} AS MATERIALIZED (SELECT dst AS id, sum(h) AS a FROM e JOIN h{k - 1} ON src = id GROUP BY dst), a{k} AS MATERIALIZED (SELECT v.id, coalesce(a / (SELECT sqrt(sum(a * a)) FROM x{k}), 0) AS a FROM v LEFT JOIN x{k} USING (id))")
        parts.append(f"y{k} AS MATERIALIZED (SELECT src AS id, sum(a) AS h FROM e JOIN a{k} ON dst = id GROUP BY src), h{k} AS MATERIALIZED (SELECT v.id, coalesce(h / (SELECT sqrt(sum(h * h)) FROM y{k}), 0) AS h FROM v LEFT JOIN y{k} USING (id))")
    return f"WITH {', '.join(parts)} SELECT id::BIGINT AS doc_id, h + a AS score, h AS hub, a AS authority FROM h{rounds} JOIN a{rounds} USING (id)"


@query("pagerank", _pagerank_sql(8))
def _(spark, d):
    return core.pagerank(trade(Tables(spark, d)), iterations=8, tolerance=0.0)


@query("hits", _hits_sql(8))
def _(spark, d):
    return core.hits(trade(Tables(spark, d)), iterations=8, tolerance=0.0)


@query("betweenness", f"SELECT n_regionkey::BIGINT AS doc_id, count(*) * (count(*) - 1) / 2.0::DOUBLE AS score FROM nation GROUP BY n_regionkey UNION ALL SELECT n_nationkey + {NATION}, 0 FROM nation")
def _(spark, d):
    return core.betweenness(nations(Tables(spark, d)))


@query("graph_embedding")
def _(spark, d):
    return core.embedding(nations(Tables(spark, d)))


_XY = "((c_custkey * 7) % 360 - 180)::DOUBLE AS x, ((c_custkey * 3) % 180 - 90)::DOUBLE AS y"


@query(
    "spatial_within_box",
    f"""WITH p AS (SELECT c_custkey AS doc_id, {_XY} FROM customer), q AS (SELECT doc_id, 2 * 6371000 * asin(sqrt(sin(radians(y - 40) / 2) ** 2 + cos(radians(40)) * cos(radians(y)) * sin(radians(x - 10) / 2) ** 2)) AS m FROM p)
SELECT doc_id, 1 - m / 2000000.0 AS score FROM q WHERE m <= 2000000""",
)
def _(spark, d):
    k = F.col("c_custkey")
    at = Tables(spark, d).customer.select(k.alias("doc_id"), ((k * 7) % 360 - 180).cast("double").alias("x"), ((k * 3) % 180 - 90).cast("double").alias("y"))
    return spatial.within(at, 10.0, 40.0, 2_000_000.0).select("doc_id", "score")
