from __future__ import annotations

import base64

import pyarrow as pa
import pytest

from quarry.sql.engine import Session, SqlError


@pytest.fixture
def s(spark):
    return Session(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tables_constraints_and_changes(s):
    s.sql("CREATE TABLE dept (id INT PRIMARY KEY, name TEXT NOT NULL); CREATE TABLE emp (id SERIAL PRIMARY KEY, name TEXT, dept_id INT REFERENCES dept(id), salary REAL DEFAULT 10 CHECK (salary > 0))")
    assert rows(s.sql("INSERT INTO dept VALUES (1, 'eng'), (2, 'ops')")) == [(2,)]
    assert rows(s.sql("INSERT INTO emp (name, dept_id, salary) VALUES ('a', 1, 5), ('b', 2, 7.5) RETURNING id, name")) == [(1, "a"), (2, "b")]
    s.sql("INSERT INTO emp (name) VALUES ('c')")
    assert rows(s.sql("SELECT id, name, dept_id, salary FROM emp ORDER BY dept_id DESC, id")) == [(3, "c", None, 10.0), (2, "b", 2, 7.5), (1, "a", 1, 5.0)]
    for wrong in ("INSERT INTO emp (name, salary) VALUES ('x', -1)", "INSERT INTO emp (name, dept_id) VALUES ('x', 9)", "INSERT INTO dept VALUES (1, 'again')", "INSERT INTO dept VALUES (3, NULL)", "DELETE FROM dept WHERE id = 1", "INSERT INTO nowhere VALUES (1)"):
        with pytest.raises(SqlError):
            s.sql(wrong)
    assert rows(s.sql("UPDATE emp SET salary = salary * 2 WHERE dept_id IS NOT NULL RETURNING id, salary"))[0][1] in (10.0, 15.0)
    assert rows(s.sql("UPDATE emp SET name = d.name FROM dept d WHERE emp.dept_id = d.id")) == [(2,)]
    assert rows(s.sql("SELECT name FROM emp ORDER BY id")) == [("eng",), ("ops",), ("c",)]
    assert rows(s.sql("DELETE FROM emp USING dept d WHERE emp.dept_id = d.id AND d.name = 'ops' RETURNING id")) == [(2,)]
    assert rows(s.sql("DELETE FROM emp WHERE id = 3")) == [(1,)]
    s.sql("TRUNCATE emp")
    assert rows(s.sql("SELECT count(*) FROM emp")) == [(0,)]
    with pytest.raises(SqlError):
        s.sql("DROP TABLE dept")
    s.sql("DROP TABLE dept CASCADE; DROP TABLE IF EXISTS dept")


def test_conflicts_take_each_key_once(s):
    s.sql("CREATE TABLE t (k INT PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'old')")
    s.sql("INSERT INTO t VALUES (1, 'x'), (2, 'first'), (2, 'second') ON CONFLICT (k) DO NOTHING")
    assert rows(s.sql("SELECT * FROM t ORDER BY k")) == [(1, "old"), (2, "first")]
    s.sql("INSERT INTO t VALUES (1, 'new'), (3, 'c') ON CONFLICT (k) DO UPDATE SET v = excluded.v || t.v WHERE t.k < 5")
    assert rows(s.sql("SELECT * FROM t ORDER BY k")) == [(1, "newold"), (2, "first"), (3, "c")]
    s.sql("INSERT INTO t SELECT k + 10, v FROM t")
    assert rows(s.sql("SELECT count(*) FROM t")) == [(6,)]


def test_alter_views_sequences_and_schemas(s):
    s.sql("CREATE TABLE a (id INT, x TEXT); INSERT INTO a VALUES (1, '7'), (2, '8')")
    s.sql("ALTER TABLE a ADD COLUMN y INT DEFAULT 4; ALTER TABLE a RENAME COLUMN x TO z; ALTER TABLE a ALTER COLUMN z TYPE INT USING cast(z AS int) + 1; ALTER TABLE a ALTER COLUMN id SET NOT NULL; ALTER TABLE a ADD CONSTRAINT u UNIQUE (id)")
    assert rows(s.sql("SELECT * FROM a ORDER BY id")) == [(1, 8, 4), (2, 9, 4)]
    s.sql("ALTER TABLE a ALTER COLUMN y SET DEFAULT 9; ALTER TABLE a ALTER COLUMN y DROP DEFAULT; ALTER TABLE a DROP COLUMN y; ALTER TABLE a RENAME TO b")
    s.sql("CREATE VIEW w AS SELECT z FROM b WHERE id = 2; CREATE TABLE c AS SELECT z * 2 AS zz FROM w")
    assert rows(s.sql("SELECT zz FROM c")) == [(18,)]
    assert {r[1] for r in rows(s.sql("SELECT table_schema, table_name FROM information_schema.tables"))} >= {"b", "c", "w"}
    assert rows(s.sql("SELECT column_name, is_nullable FROM information_schema.columns WHERE table_name = 'b' ORDER BY ordinal_position")) == [("id", "NO"), ("z", "YES")]
    assert ("b",) in rows(s.sql("SELECT tablename FROM pg_catalog.pg_tables")) and rows(s.sql("SELECT viewname FROM pg_catalog.pg_views")) == [("w",)]
    assert ("jsonb",) in rows(s.sql("SELECT typname FROM pg_catalog.pg_type"))
    s.sql("CREATE INDEX ix ON b USING btree (z)")
    assert rows(s.sql("SELECT indexname FROM pg_catalog.pg_indexes")) == [("ix",)]
    s.sql("DROP INDEX ix; DROP VIEW w")
    s.sql("CREATE SEQUENCE q START WITH 5 INCREMENT BY 2")
    assert rows(s.sql("SELECT nextval('q') AS a, nextval('q') AS b, currval('q') AS c")) == [(5, 7, 7)]
    s.sql("ALTER SEQUENCE q RESTART WITH 50")
    assert rows(s.sql("SELECT nextval('q') AS a, setval('q', 80) AS b, lastval() AS c")) == [(50, 80, 80)]
    s.sql("CREATE SCHEMA sales; CREATE TABLE sales.o (id INT); INSERT INTO sales.o VALUES (3); SET search_path TO sales, public")
    assert rows(s.sql("SELECT id FROM sales.o")) == rows(s.sql("SELECT id FROM o")) == [(3,)]
    assert rows(s.sql("SHOW search_path")) == [("sales, public",)]
    s.sql("RESET search_path; DROP SCHEMA sales CASCADE; DISCARD ALL")
    assert rows(s.sql("ANALYZE b"))[0][:5] == ("b", "id", 2, 2, 0)
    assert any("Scan" in r[0] for r in rows(s.sql("EXPLAIN SELECT * FROM b WHERE z > 8")))


def test_transactions_and_prepared(s):
    s.sql("CREATE TABLE t (id INT); INSERT INTO t VALUES (1)")
    s.sql("BEGIN; INSERT INTO t VALUES (2); SAVEPOINT p; INSERT INTO t VALUES (3); CREATE TABLE u (x INT); ROLLBACK TO SAVEPOINT p")
    assert rows(s.sql("SELECT id FROM t ORDER BY id")) == [(1,), (2,)]
    with pytest.raises(SqlError):
        s.sql("INSERT INTO u VALUES (1)")
    s.sql("RELEASE SAVEPOINT p; ROLLBACK")
    assert rows(s.sql("SELECT id FROM t")) == [(1,)]
    s.sql("BEGIN; INSERT INTO t VALUES (5); COMMIT")
    s.sql("PREPARE f (INT) AS SELECT id FROM t WHERE id >= $1 ORDER BY id")
    assert rows(s.sql("EXECUTE f(2)")) == [(5,)] and rows(s.sql("SELECT id + $1 AS x FROM t WHERE id = $2", [10, 5])) == [(15,)]
    s.sql("DEALLOCATE f")
    with pytest.raises(SqlError):
        s.sql("EXECUTE f(2)")


def test_retrieval_in_where(s):
    s.sql("CREATE TABLE docs (id INT PRIMARY KEY, title TEXT, body TEXT, meta JSONB, emb VECTOR(2)); CREATE INDEX g ON docs USING gin (title, body)")
    s.sql("""INSERT INTO docs VALUES (1, 'machine learning basics', 'neural networks learn', '{"a": {"b": 3}}', ARRAY[1.0, 0.0]),
             (2, 'deep learning', 'graph neural models', '{"a": {"b": 5}}', ARRAY[0.6, 0.8]), (3, 'cooking recipes', 'soup and bread', '{"a": 1}', ARRAY[0.0, 1.0])""")
    got = rows(s.sql("SELECT id, _score FROM docs WHERE text_match(title, 'learning') ORDER BY _score DESC, id"))
    assert [g[0] for g in got] == [2, 1] and got[0][1] > got[1][1] > 0
    assert rows(s.sql("SELECT id FROM docs WHERE text_match(title, 'learning') AND id > 1")) == [(2,)]
    assert rows(s.sql("SELECT id FROM docs WHERE NOT text_match(title, 'learning') OR body @@ 'graph' ORDER BY id")) == [(2,), (3,)]
    assert rows(s.sql("SELECT id FROM docs WHERE knn_match(emb, ARRAY[1.0, 0.1], 2) ORDER BY _score DESC")) == [(1,), (2,)]
    assert rows(s.sql("SELECT id FROM docs WHERE knn_match(emb, $1, 1)", [[0.0, 1.0]])) == [(3,)]
    for call in ("fuse_log_odds(text_match(title, 'learning'), knn_match(emb, ARRAY[1.0, 0.0], 3), alpha => 0.3, gating => 'relu')", "fuse_prob_and(bayesian_match(title, 'learning'), bayesian_match(body, 'neural'))", "fuse_prob_or(bayesian_match(title, 'learning'), bayesian_match(body, 'soup'))", "fuse_prob_not(bayesian_match(title, 'soup'))", "staged_retrieval(text_match(title, 'learning'), 2, text_match(body, 'graph'), 1)", "fuse_attention(text_match(title, 'learning'), text_match(body, 'neural'))", "multi_field_match(title, body, 'learning')", "sparse_threshold(text_match(title, 'learning'), 0.01)"):
        out = rows(s.sql(f"SELECT id, _score FROM docs WHERE {call} ORDER BY _score DESC"))
        assert out and all(x[1] is not None for x in out), call
    assert rows(s.sql("SELECT id FROM docs WHERE path_filter('meta.a.b', '>', 3)")) == [(2,)]
    assert s.sql("SELECT * FROM docs WHERE text_match(title, 'learning')").columns == ["id", "title", "body", "meta", "emb"]
    assert {tuple(r) for r in s.sql("SELECT uqa_facets(title) FROM docs WHERE text_match(title, 'learning')").collect()} == {("deep learning", 1), ("machine learning basics", 1)}
    s.sql("CREATE TABLE o (doc INT, n INT); INSERT INTO o VALUES (1, 10), (2, 20)")
    assert rows(s.sql("SELECT d.id, o.n FROM docs d JOIN o ON o.doc = d.id WHERE text_match(d.title, 'deep')")) == [(2, 20)]
    assert "<b>learning</b>" in rows(s.sql("SELECT uqa_highlight(title, 'learning') AS h FROM docs WHERE id = 2"))[0][0]


def test_table_functions(s):
    assert rows(s.sql("SELECT * FROM generate_series(1, 5, 2) AS g")) == [(1,), (3,), (5,)]
    assert rows(s.sql("SELECT x FROM unnest(ARRAY['a', 'b']) AS x ORDER BY x DESC")) == [("b",), ("a",)]
    assert rows(s.sql("""SELECT key, value FROM json_each('{"a": 1, "b": "x"}') ORDER BY key""")) == [("a", "1"), ("b", "x")]
    assert rows(s.sql("SELECT value FROM jsonb_array_elements('[1, 2]')")) == [("1",), ("2",)]
    assert rows(s.sql("SELECT * FROM regexp_split_to_table('a1b2c', '[0-9]') AS w")) == [("a",), ("b",), ("c",)]
    s.sql("CREATE TABLE t (id INT, tags TEXT[]); INSERT INTO t VALUES (1, ARRAY['x', 'y']), (2, ARRAY['z'])")
    assert rows(s.sql("SELECT t.id, u.tag FROM t, unnest(t.tags) AS u(tag) ORDER BY id, tag")) == [(1, "x"), (1, "y"), (2, "z")]
    s.sql("SELECT create_graph('g')")
    for k, label in ((1, "P"), (2, "P"), (3, "C")):
        s.sql(f"SELECT * FROM graph_add_vertex({k}, '{label}', 'g', 'age={k * 10}')")
    s.sql("SELECT * FROM graph_add_edge(1, 1, 2, 'KNOWS', 'g', 'since=2000'); SELECT * FROM graph_create_edge('g', 'LIVES', 2, 3)")
    assert rows(s.sql("SELECT * FROM graph_create_node('g', 'P', '{\"age\": 5}')")) == [(4,)]
    assert {r[0] for r in rows(s.sql("SELECT id FROM graph_nodes('g', 'P')"))} == {1, 2, 4}
    assert rows(s.sql("SELECT id FROM graph_nodes('g', 'P', '{\"age\": 20}')")) == [(2,)]
    assert {tuple(r) for r in rows(s.sql("SELECT source, target FROM graph_edges('g')"))} == {(1, 2), (2, 3)}
    assert rows(s.sql("SELECT source FROM graph_edges('g', 'LIVES')")) == [(2,)]
    assert rows(s.sql("SELECT id, depth FROM graph_neighbors('g', 1, '', 'outgoing', 2) ORDER BY depth")) == [(2, 1), (3, 2)]
    assert {r[0] for r in rows(s.sql("SELECT id FROM graph_traverse('g', 1, 'KNOWS,LIVES', 'outgoing', 5)"))} >= {2, 3}
    assert {r[0] for r in rows(s.sql("SELECT doc_id FROM traverse(1, 'KNOWS', 2, 'g')"))} == {1, 2}
    assert rows(s.sql("SELECT count(*) FROM rpq('KNOWS/LIVES', 1, 'g')")) == [(1,)]
    assert abs(sum(r[1] for r in rows(s.sql("SELECT doc_id, score FROM pagerank('g')"))) - 1) < 1e-6
    s.sql("SELECT graph_delete_edge('g', 1); SELECT graph_delete_node('g', 3)")
    assert rows(s.sql("SELECT count(*) FROM graph_edges('g')")) == [(0,)]
    s.sql("SELECT drop_graph('g'); SELECT * FROM build_grid_graph('grid', 2, 3, 'next')")
    assert rows(s.sql("SELECT count(*) FROM graph_nodes('grid')")) == [(6,)]
    assert ("standard",) in rows(s.sql("SELECT analyzer_name FROM list_analyzers()"))
    with pytest.raises(Exception):
        s.sql("SELECT * FROM nosuch_function(1)").collect()


def test_foreign_tables(s, tmp_path):
    s.spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.5)], "id int, name string, x double").write.parquet(f"{tmp_path}/p.parquet")
    (tmp_path / "c.csv").write_text("id,name\n1,one\n2,two\n")
    t = pa.table({"id": pa.array([7, 8]), "w": ["p", "q"]})
    with pa.OSFile(f"{tmp_path}/f.arrow", "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    s.sql("CREATE SERVER d FOREIGN DATA WRAPPER duckdb_fdw; CREATE SERVER ar FOREIGN DATA WRAPPER arrow_fdw OPTIONS (x '1')")
    s.sql(f"CREATE FOREIGN TABLE p (id INT, name TEXT, x REAL) SERVER d OPTIONS (source '{tmp_path}/p.parquet')")
    s.sql(f"CREATE FOREIGN TABLE c (id INT, name TEXT) SERVER d OPTIONS (source '{tmp_path}/c.csv')")
    s.sql("""CREATE FOREIGN TABLE j (id INT, dept TEXT) SERVER d OPTIONS (data '[{"id": 1, "dept": "eng"}]')""")
    s.sql(f"CREATE FOREIGN TABLE f (id BIGINT, w TEXT) SERVER ar OPTIONS (source '{tmp_path}/f.arrow')")
    s.sql(f"CREATE FOREIGN TABLE b (id BIGINT, w TEXT) SERVER ar OPTIONS (data '{base64.b64encode(sink.getvalue().to_pybytes()).decode()}')")
    assert rows(s.sql("SELECT p.name, c.name, j.dept FROM p JOIN c ON c.id = p.id JOIN j ON j.id = p.id")) == [("a", "one", "eng")]
    assert rows(s.sql("SELECT id, w FROM f WHERE id > 7")) == rows(s.sql("SELECT id, w FROM b WHERE id > 7")) == [(8, "q")]
    plan = "\n".join(r[0] for r in rows(s.sql("EXPLAIN SELECT name FROM p WHERE id = 2")))
    assert "EqualTo(id,2)" in plan and "x:double" not in plan
    assert rows(s.servers.scan("p", ["name"], "id > 0", 1))[0][0] in "ab"
    with pytest.raises(ValueError):
        s.sql("DROP SERVER d")
    s.sql("DROP FOREIGN TABLE p; DROP SERVER d CASCADE")


def test_save_and_load(s, spark, tmp_path):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'x')")
    s.add_document("t", 40, {"id": 2, "v": "doc"})
    s.save(f"file://{tmp_path}/db")
    other = Session(spark)
    other.load(f"file://{tmp_path}/db")
    assert rows(other.sql("SELECT * FROM t ORDER BY id")) == [(1, "x"), (2, "doc")]
    with pytest.raises(SqlError):
        other.sql("INSERT INTO t VALUES (1, 'again')")


def test_a_statement_reads_its_texts_once_and_writes_postings_only_for_a_declared_index(spark, monkeypatch):
    from quarry.text import index as ix

    passes, saved = [], []
    stage, save = ix.stage, ix.Index.save
    monkeypatch.setattr(ix, "stage", lambda df, name: passes.append(name) or stage(df, name))
    monkeypatch.setattr(ix.Index, "save", lambda self, path: saved.append(path) or save(self, path))
    s = Session(spark)
    s.register("notes", spark.createDataFrame([(1, "graph theory"), (2, "soup of the day"), (3, "the graph"), (4, None), (5, "")], "id long, body string"), "id")
    ask = lambda where: sorted(r[0] for r in s.sql(f"SELECT id FROM notes WHERE {where}").collect())
    assert ask("body @@ 'graph theory' AND NOT text_match(body, 'soup')") == [1]
    assert (len(passes), saved) == (1, [])
    assert ask("text_match(body, 'theory')") == [1] and ask("bayesian_match(body, 'soup graph')") == [1, 2, 3] and len(passes) == 1
    assert ask("fuse_log_odds(text_match(body, 'day'), text_match(body, 'graph'))") == [1, 2, 3] and len(passes) == 2
    assert ask("body @@ '\"graph theory\" OR soup'") == [1, 2]
    assert ask("text_match(body, '')") == [] and ask("text_match(body, 'nowhere')") == [] and saved == []
    before = {r[0]: r[1] for r in s.sql("SELECT id, _score FROM notes WHERE text_match(body, 'graph')").collect()}
    s.sql("CREATE INDEX g ON notes USING gin (body)")
    after = {r[0]: r[1] for r in s.sql("SELECT id, _score FROM notes WHERE text_match(body, 'graph')").collect()}
    assert len(saved) == 1 and after == pytest.approx(before)
