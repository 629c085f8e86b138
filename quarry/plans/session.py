"""Queries through the SQL session: definition and changes, retrieval in WHERE, table functions, foreign data, openCypher."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph.cypher import run
from ..sql.engine import Session
from .graph import CUSTOMER, NATION, SUPPLIER, E, trade
from .registry import query
from .retrieval import Q1, Q2, _bm25_sql
from .tables import Tables


def session(spark, d, *tables: str) -> Session:
    s = Session(spark)
    for t in tables:
        key = {"documents": "doc_id", "customer": "c_custkey", "embeddings": "vec_id"}.get(t)
        s.register(t, getattr(Tables(spark, d), t), key)
        if t == "documents":
            s.analyzers["documents", "text"] = "simple"
    return s


@query("sql_select", "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY total DESC")
def _(spark, d):
    return session(spark, d, "customer").sql("SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM customer WHERE c_acctbal > $1 GROUP BY c_mktsegment ORDER BY total DESC", [0])


@query("sql_create_insert", "SELECT n_nationkey AS id, n_name AS name, 0.5::DOUBLE AS rate FROM nation UNION ALL SELECT 100, 'NOWHERE', 2.5")
def _(spark, d):
    s = session(spark, d, "nation")
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, rate REAL DEFAULT 0.5 CHECK (rate > 0)); INSERT INTO t (id, name) SELECT n_nationkey, n_name FROM nation; INSERT INTO t VALUES (100, 'NOWHERE', 2.5)")
    return s.sql("SELECT * FROM t")


@query("sql_insert_returning", "SELECT n_nationkey + 1 AS id, upper(n_name) AS name FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    s = session(spark, d, "nation")
    s.sql("CREATE TABLE t (id INT, name TEXT)")
    return s.sql("INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 RETURNING id + 1 AS id, upper(name) AS name")


@query("sql_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT -1, 'added'")
def _(spark, d):
    s = session(spark, d, "customer")
    s.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT); INSERT INTO t SELECT c_custkey, 'old' FROM customer")
    s.sql("INSERT INTO t SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 0 ON CONFLICT (id) DO UPDATE SET v = excluded.v; INSERT INTO t VALUES (-1, 'added'), (-1, 'twice'), (2, 'no') ON CONFLICT (id) DO NOTHING")
    return s.sql("SELECT * FROM t")


@query("sql_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    s = session(spark, d, "customer")
    s.sql("UPDATE customer SET c_acctbal = 0 WHERE c_acctbal < 0")
    return s.sql("SELECT c_custkey, c_acctbal FROM customer")


@query("sql_update_from", "SELECT c_custkey, n_name AS c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def _(spark, d):
    s = session(spark, d, "customer", "nation")
    return s.sql("UPDATE customer SET c_name = n.n_name FROM nation n WHERE customer.c_nationkey = n.n_nationkey AND n.n_regionkey = 2 RETURNING c_custkey, c_name")


@query("sql_delete", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3)")
def _(spark, d):
    s = session(spark, d, "customer", "nation")
    s.sql("DELETE FROM customer WHERE c_acctbal < 0; DELETE FROM customer USING nation n WHERE customer.c_nationkey = n.n_nationkey AND n.n_regionkey = 3")
    return s.sql("SELECT c_custkey FROM customer")


@query("sql_alter", "SELECT n_nationkey, n_name AS label, n_regionkey::BIGINT * 2 AS n_regionkey, 'x' AS tag FROM nation")
def _(spark, d):
    s = session(spark, d, "nation")
    s.sql("ALTER TABLE nation ADD COLUMN tag TEXT DEFAULT 'x'; ALTER TABLE nation RENAME COLUMN n_name TO label; ALTER TABLE nation ALTER COLUMN n_regionkey TYPE BIGINT USING n_regionkey * 2; ALTER TABLE nation RENAME TO lands")
    return s.sql("SELECT * FROM lands")


@query("sql_view", "SELECT n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%'")
def _(spark, d):
    s = session(spark, d, "nation", "region")
    s.sql("CREATE VIEW a AS SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
    return s.sql("SELECT n_name FROM a WHERE r_name LIKE 'A%'")


@query("sql_ctas_truncate", "SELECT 'kept' AS what, count(*) AS n FROM part WHERE p_size > 25 UNION ALL SELECT 'gone', 0")
def _(spark, d):
    s = session(spark, d, "part")
    s.sql("CREATE TABLE big AS SELECT * FROM part WHERE p_size > 25; CREATE TABLE gone AS SELECT * FROM big; TRUNCATE gone")
    return s.sql("SELECT 'kept' AS what, count(*) AS n FROM big UNION ALL SELECT 'gone', count(*) FROM gone")


@query("sql_transaction", "SELECT count(*) AS n, min(c_custkey) AS least FROM customer WHERE c_custkey > 10")
def _(spark, d):
    s = session(spark, d, "customer")
    s.sql("BEGIN; DELETE FROM customer WHERE c_custkey <= 10; SAVEPOINT a; DELETE FROM customer; ROLLBACK TO SAVEPOINT a; COMMIT; BEGIN; DELETE FROM customer; ROLLBACK")
    return s.sql("SELECT count(*) AS n, min(c_custkey) AS least FROM customer")


@query("sql_prepared", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
def _(spark, d):
    s = session(spark, d, "part")
    s.sql("PREPARE q (INT, INT) AS SELECT p_partkey FROM part WHERE p_size BETWEEN $1 AND $2")
    return s.sql("EXECUTE q(10, 12)")


@query("sql_sequence", "SELECT 100::BIGINT AS a, 105::BIGINT AS b, 105::BIGINT AS c")
def _(spark, d):
    s = Session(spark)
    s.sql("CREATE SEQUENCE q START WITH 100 INCREMENT BY 5")
    return s.sql("SELECT nextval('q')::bigint AS a, nextval('q')::bigint AS b, currval('q')::bigint AS c")


@query("sql_information_schema", "SELECT column_name, ordinal_position::INT AS ordinal_position FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) AS t(column_name, ordinal_position)")
def _(spark, d):
    return session(spark, d, "nation").sql("SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'nation'")


@query("sql_pg_catalog", "SELECT 'nation' AS name, 'table' AS kind UNION ALL SELECT 'v', 'view' UNION ALL SELECT 'ix', 'index'")
def _(spark, d):
    s = session(spark, d, "nation")
    s.sql("CREATE VIEW v AS SELECT * FROM nation; CREATE INDEX ix ON nation USING btree (n_name)")
    return s.sql("SELECT tablename AS name, 'table' AS kind FROM pg_catalog.pg_tables UNION ALL SELECT viewname, 'view' FROM pg_catalog.pg_views UNION ALL SELECT indexname, 'index' FROM pg_catalog.pg_indexes")


@query("sql_settings", "SELECT 'sales, public' AS search_path")
def _(spark, d):
    s = Session(spark)
    s.sql("CREATE SCHEMA sales; SET search_path TO sales, public")
    return s.sql("SHOW search_path")


@query("sql_schema", "SELECT count(*) AS n FROM region")
def _(spark, d):
    s = session(spark, d, "region")
    s.sql("CREATE SCHEMA geo; CREATE TABLE geo.area AS SELECT * FROM region; SET search_path TO geo, public")
    return s.sql("SELECT count(*) AS n FROM area")


@query("sql_analyze", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_acctbal IS NULL) AS n_null, min(c_mktsegment) AS least, max(c_mktsegment) AS greatest FROM customer")
def _(spark, d):
    return session(spark, d, "customer").sql("ANALYZE customer").where("column_name = 'c_mktsegment'").select("n_rows", "n_null", "least", "greatest")


@query("sql_explain", "SELECT true AS scans")
def _(spark, d):
    return session(spark, d, "part").sql("EXPLAIN SELECT p_partkey FROM part WHERE p_size = 3").agg(F.max(F.col("plan").contains("Scan")).alias("scans"))


@query("sql_foreign_table", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 10")
def _(spark, d):
    s = session(spark, d, "region")
    s.sql(f"CREATE SERVER f FOREIGN DATA WRAPPER duckdb_fdw; CREATE FOREIGN TABLE far (n_nationkey INT, n_name TEXT, n_regionkey INT) SERVER f OPTIONS (source '{d}/nation.parquet')")
    return s.sql("SELECT n_name, r_name FROM far JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey > 10")


@query("sql_text_match", f"WITH {_bm25_sql(Q1)} SELECT doc_id, lang, score AS _score FROM s JOIN documents USING (doc_id) WHERE lang = 'en'")
def _(spark, d):
    return session(spark, d, "documents").sql(f"SELECT doc_id, lang, _score FROM documents WHERE text_match(text, '{Q1}') AND lang = 'en'")


@query("sql_bayesian_match", f"WITH {_bm25_sql(Q1)} SELECT doc_id, score AS _score FROM b")
def _(spark, d):
    return session(spark, d, "documents").sql(f"SELECT doc_id, _score FROM documents WHERE bayesian_match(text, '{Q1}')")


@query("sql_fts_operator", f"WITH {_bm25_sql(Q1)}, {_bm25_sql(Q2, '2')} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM h GROUP BY doc_id HAVING count(*) = 2) AND NOT doc_id IN (SELECT doc_id FROM s2)")
def _(spark, d):
    return session(spark, d, "documents").sql(f"SELECT doc_id FROM documents WHERE text @@ '{Q1}' AND NOT text_match(text, '{Q2}')")


_DOT = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"


@query("sql_knn_match", f"SELECT vec_id, label, {_DOT} AS _score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) ORDER BY _score DESC, vec_id LIMIT 10")
def _(spark, d):
    s = session(spark, d, "embeddings")
    (row,) = Tables(spark, d).embeddings.where("vec_id = 7").select("embedding").collect()
    return s.sql("SELECT vec_id, label, _score FROM embeddings WHERE knn_match(embedding, $1, 10)", [[float(x) for x in row.embedding]])


@query("sql_fuse_log_odds", f"WITH {_bm25_sql(Q1)}, {_bm25_sql(Q2, '2')}, u AS (SELECT doc_id, b.score AS p, b2.score AS q FROM b FULL JOIN b2 USING (doc_id)), r AS (SELECT count(p) / count(*) AS rp, count(q) / count(*) AS rq FROM u), z AS (SELECT doc_id, coalesce(p, 0.5 * (1 - rp) + 0.01 * rp) AS p, coalesce(q, 0.5 * (1 - rq) + 0.01 * rq) AS q FROM u, r) SELECT doc_id, 1 / (1 + exp(-((ln(p / (1 - p)) + ln(q / (1 - q))) / 2 * sqrt(2)))) AS _score FROM z")
def _(spark, d):
    return session(spark, d, "documents").sql(f"SELECT doc_id, _score FROM documents WHERE fuse_log_odds(text_match(text, '{Q1}'), text_match(text, '{Q2}'))")


@query("sql_uqa_facets", f"WITH {_bm25_sql(Q1)} SELECT lang AS facet_value, count(*) AS facet_count FROM s JOIN documents USING (doc_id) GROUP BY lang")
def _(spark, d):
    return session(spark, d, "documents").sql(f"SELECT uqa_facets(lang) FROM documents WHERE text_match(text, '{Q1}')")


@query("sql_generate_series", "SELECT n_nationkey, g FROM nation, unnest(range(1, n_regionkey + 2)) AS u(g)")
def _(spark, d):
    return session(spark, d, "nation").sql("SELECT n_nationkey, u.g FROM nation, generate_series(1, n_regionkey + 1) AS u(g)")


@query("sql_json_each", "SELECT event_id, 'k' AS key, props->>'$.k' AS value FROM events WHERE props->>'$.k' IS NOT NULL")
def _(spark, d):
    return session(spark, d, "events").sql("SELECT event_id, j.key, j.value FROM events, json_each(props) AS j WHERE j.key = 'k'")


@query("sql_regexp_split_to_table", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
def _(spark, d):
    return session(spark, d, "part").sql("SELECT p_partkey, r.w FROM part, regexp_split_to_table(p_type, ' ') AS r(w)")


@query("sql_json_containment", "SELECT event_id FROM events WHERE (props->>'$.k')::INT = 5")
def _(spark, d):
    return session(spark, d, "events").sql("""SELECT event_id FROM events WHERE props @> '{"k": 5}'""")


def _graphs(spark, d) -> Session:
    s = Session(spark)
    s.state.graphs["trade"] = trade(Tables(spark, d))
    return s


@query("sql_graph_nodes", f"SELECT n_nationkey + {NATION} AS id, 'nation' AS label FROM nation")
def _(spark, d):
    return _graphs(spark, d).sql("SELECT id, label FROM graph_nodes('trade', 'nation')")


@query("sql_graph_edges", f"SELECT s_suppkey + {SUPPLIER} AS source, s_nationkey + {NATION} AS target FROM supplier")
def _(spark, d):
    return _graphs(spark, d).sql("SELECT source, target FROM graph_edges('trade', 'based')")


@query("sql_graph_changes", "SELECT 1::BIGINT AS source, 2::BIGINT AS target, 'KNOWS' AS label")
def _(spark, d):
    s = Session(spark)
    s.sql("SELECT create_graph('g'); SELECT * FROM graph_add_vertex(1, 'P', 'g', 'age=1'); SELECT * FROM graph_create_node('g', 'P', '{\"age\": 2}'); SELECT * FROM graph_create_node('g', 'Q'); SELECT * FROM graph_add_edge(7, 1, 2, 'KNOWS', 'g'); SELECT * FROM graph_create_edge('g', 'X', 2, 3); SELECT graph_delete_edge('g', 8); SELECT graph_delete_node('g', 3)")
    return s.sql("SELECT source, target, label FROM graph_edges('g')")


@query("sql_graph_functions", f"WITH {E} SELECT src AS id FROM e WHERE dst = 103 AND label = 'lives'")
def _(spark, d):
    return _graphs(spark, d).sql("SELECT id FROM graph_traverse('trade', 103, 'lives', 'incoming', 1)")


@query("sql_rpq", f"WITH {E} SELECT b.dst AS end_id FROM e a JOIN e b ON a.dst = b.src WHERE a.src = {CUSTOMER + 7} AND a.label = 'lives' AND b.label = 'in'")
def _(spark, d):
    return _graphs(spark, d).sql(f"SELECT end_id FROM rpq('lives/in', {CUSTOMER + 7}, 'trade')")


# --- openCypher ----------------------------------------------------------------------------------------------------------------------


def _cypher(name: str, text: str, sql: str, params: dict | None = None) -> None:
    @query(name, sql)
    def _(spark, d):
        return run(trade(Tables(spark, d)), text, params)[0]


_cypher("cypher_match_where", "MATCH (c:customer) WHERE c.acctbal > $least RETURN id(c) AS id, c.name AS name", f"SELECT c_custkey + {CUSTOMER} AS id, c_name AS name FROM customer WHERE c_acctbal > 9000", {"least": 9000})
_cypher("cypher_path", "MATCH (c:customer)-[:lives]->(n:nation)-[r:`in`]->(m:region {name: 'ASIA'}) RETURN c.name AS c, n.name AS n, type(r) AS t", "SELECT c_name AS c, n_name AS n, 'in' AS t FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
_cypher("cypher_optional", "MATCH (n:nation) OPTIONAL MATCH (n)<-[:based]-(s:supplier) RETURN n.name AS n, count(s) AS k", "SELECT n_name AS n, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
_cypher("cypher_variable_length", "MATCH (s:supplier)-[p*1..2]->(x) RETURN id(s) AS s, id(x) AS x, size(p) AS hops", f"SELECT s_suppkey + {SUPPLIER} AS s, s_nationkey + {NATION} AS x, 1 AS hops FROM supplier UNION ALL SELECT s_suppkey + {SUPPLIER}, n_regionkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey")
_cypher("cypher_with", "MATCH (c:customer)-[:lives]->(n) WITH n, avg(c.acctbal) AS mean, count(*) AS k WHERE k > 1 RETURN n.name AS n, mean ORDER BY mean DESC SKIP 1 LIMIT 5", "SELECT n_name AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) > 1 ORDER BY mean DESC LIMIT 5 OFFSET 1")
_cypher("cypher_unwind", "UNWIND range(1, 5) AS x WITH x, x * x AS y WHERE y > 3 RETURN sum(x) AS s, collect(y) AS l, max(y) AS m", "SELECT 14::BIGINT AS s, [4, 9, 16, 25]::BIGINT[] AS l, 25::BIGINT AS m")
_cypher("cypher_case", "MATCH (s:supplier) RETURN CASE WHEN s.acctbal < 0 THEN 'debt' WHEN s.acctbal < 5000 THEN 'low' ELSE 'high' END AS c, count(*) AS k, sum(s.acctbal) AS total", "SELECT CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS c, count(*) AS k, sum(s_acctbal) AS total FROM supplier GROUP BY 1")
_cypher("cypher_exists", "MATCH (n:nation) WHERE NOT (n)<-[:based]-(:supplier) RETURN n.name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
_cypher("cypher_operators", "MATCH (n:nation) WHERE n.name IN ['CHINA', 'INDIA', 'PERU'] AND (n.name STARTS WITH 'C' OR n.name ENDS WITH 'A') AND NOT n.name CONTAINS 'X' RETURN toLower(n.name) AS a, size(n.name) AS b, substring(n.name, 1, 2) AS c, labels(n)[0] AS d, coalesce(n.nothing, 'none') AS e", "SELECT lower(n_name) AS a, length(n_name) AS b, substring(n_name, 2, 2) AS c, 'nation' AS d, 'none' AS e FROM nation WHERE n_name IN ('CHINA', 'INDIA')")


@query("cypher_create_set", "SELECT 'AFRICA' AS r, 'moon' AS m, '2' AS k UNION ALL SELECT 'AMERICA', 'moon', '2' UNION ALL SELECT 'ASIA', 'moon', '2' UNION ALL SELECT 'EUROPE', 'moon', '2' UNION ALL SELECT 'MIDDLE EAST', 'moon', '2'")
def _(spark, d):
    _, g = run(trade(Tables(spark, d)), "MATCH (r:region) CREATE (r)-[:has]->(m:moon {name: 'moon'}) SET m.k = 2")
    return run(g, "MATCH (r:region)-[:has]->(m:moon) RETURN r.name AS r, m.name AS m, m.k AS k")[0]


@query("cypher_merge", "SELECT 5::BIGINT AS old, 1::BIGINT AS new")
def _(spark, d):
    _, g = run(trade(Tables(spark, d)), "MATCH (r:region) WITH r.name AS w MERGE (x:region {name: w}) ON MATCH SET x.seen = 1")
    _, g = run(g, "MERGE (x:region {name: 'ATLANTIS'}) ON CREATE SET x.made = 1")
    return run(g, "MATCH (x:region) RETURN count(x.seen) AS old, count(x.made) AS new")[0]


@query("cypher_delete", "SELECT count(*) FILTER (WHERE n_regionkey <> 1) AS left_nations FROM nation")
def _(spark, d):
    _, g = run(trade(Tables(spark, d)), "MATCH (n:nation)-[:`in`]->(r:region {name: 'AMERICA'}) DETACH DELETE n, r")
    return run(g, "MATCH (n:nation) RETURN count(*) AS left_nations")[0]
