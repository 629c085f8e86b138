from __future__ import annotations

import pytest

from quarry.graph.core import Graph
from quarry.graph.cypher import CypherError, run


@pytest.fixture(scope="module")
def g(spark):
    v = [(1, "Person", {"name": "Alice", "age": "30"}), (2, "Person", {"name": "Bob", "age": "25"}), (3, "Person", {"name": "Charlie", "age": "35"}), (4, "Person", {"name": "Diana", "age": "28"}), (10, "City", {"name": "NYC"}), (11, "City", {"name": "SF"})]
    e = [(1, 1, 2, "KNOWS", {"since": "2020"}), (2, 1, 3, "KNOWS", {"since": "2019"}), (3, 2, 4, "KNOWS", {"since": "2021"}), (4, 3, 4, "KNOWS", {"since": "2018"}), (5, 1, 10, "LIVES_IN", {}), (6, 2, 11, "LIVES_IN", {}), (7, 3, 10, "LIVES_IN", {}), (8, 4, 11, "LIVES_IN", {})]
    return Graph.of(spark.createDataFrame(v, "id long, label string, props map<string,string>").cache(), spark.createDataFrame(e, "id long, src long, dst long, label string, props map<string,string>").cache(), "g")


CASES = {
    "MATCH (n:Person) RETURN n.name AS name ORDER BY name": [("Alice",), ("Bob",), ("Charlie",), ("Diana",)],
    "MATCH (n:Person) WHERE n.age > 28 RETURN n.name ORDER BY n.age DESC": [("Charlie",), ("Alice",)],
    "MATCH (n {name: 'Bob'}) RETURN id(n), labels(n), n.age + 1": [(2, ["Person"], 26.0)],
    "MATCH (a:Person)-[r:KNOWS]->(b) WHERE r.since >= 2020 RETURN a.name, b.name, type(r) ORDER BY a.name": [("Alice", "Bob", "KNOWS"), ("Bob", "Diana", "KNOWS")],
    "MATCH (a)<-[:KNOWS]-(b {name: 'Alice'}) RETURN a.name ORDER BY a.name": [("Bob",), ("Charlie",)],
    "MATCH (a {name: 'Bob'})-[:KNOWS]-(b) RETURN b.name ORDER BY b.name": [("Alice",), ("Diana",)],
    "MATCH (a {name: 'Alice'})-[:KNOWS*1..2]->(b) RETURN b.name ORDER BY b.name": [("Bob",), ("Charlie",), ("Diana",), ("Diana",)],
    "MATCH (a {name: 'Alice'})-[:KNOWS*2]->(b) RETURN DISTINCT b.name": [("Diana",)],
    "MATCH (a {name: 'Alice'})-[p:KNOWS*]->(b) RETURN count(*) AS n, max(size(p)) AS longest": [(4, 2)],
    "MATCH (a)-[:LIVES_IN]->(c)<-[:LIVES_IN]-(b) WHERE a.name < b.name RETURN a.name, b.name, c.name ORDER BY c.name": [("Alice", "Charlie", "NYC"), ("Bob", "Diana", "SF")],
    "MATCH (n:Person) OPTIONAL MATCH (n)-[:KNOWS]->(m) RETURN n.name, count(m) AS k ORDER BY n.name": [("Alice", 2), ("Bob", 1), ("Charlie", 1), ("Diana", 0)],
    "MATCH (n:Person)-[:LIVES_IN]->(c) WITH c, avg(n.age) AS mean, collect(n.name) AS who WHERE mean > 30 RETURN c.name, mean, who": [("NYC", 32.5, ["Alice", "Charlie"])],
    "UNWIND [1, 2, 3] AS x WITH x WHERE x <> 2 RETURN sum(x) AS s, collect(x * 10) AS l": [(4, [10, 30])],
    "MATCH (n:Person) RETURN CASE WHEN n.age < 29 THEN 'young' ELSE 'old' END AS c, count(*) AS k ORDER BY c": [("old", 2), ("young", 2)],
    "MATCH (n:Person) WHERE n.name IN ['Bob', 'Diana'] AND NOT n.name ENDS WITH 'a' RETURN n.name": [("Bob",)],
    "MATCH (n:Person) WHERE n.name STARTS WITH 'A' OR n.name CONTAINS 'ia' RETURN n.name ORDER BY n.name SKIP 1 LIMIT 1": [("Diana",)],
    "MATCH (n) WHERE n.age IS NULL RETURN n.name ORDER BY n.name": [("NYC",), ("SF",)],
    "MATCH (n:Person) WHERE NOT (n)-[:KNOWS]->() RETURN n.name": [("Diana",)],
    "MATCH (n:Person) WHERE (n)-[:KNOWS]->({name: 'Diana'}) RETURN n.name ORDER BY n.name": [("Bob",), ("Charlie",)],
    "RETURN toUpper('ab') AS a, size('abc') AS b, head([7, 8]) AS c, last([7, 8]) AS d, reverse('ab') AS e, range(1, 3) AS f, coalesce(null, 4) AS g, substring('hello', 1, 3) AS h, split('a,b', ',') AS i, toInteger('12') AS j, abs(-3) AS k, [5, 6][1] AS l, tail([1, 2]) AS m, replace('aXa', 'X', 'b') AS n, trim(' q ') AS o, 7 / 2 AS p, 7 % 4 AS q, null = null AS r": [("AB", 3, 7, 8, "ba", [1, 2, 3], 4, "ell", ["a", "b"], 12, 3, 6, [2], "aba", "q", 3, 3, True)],
    "MATCH (n {name: 'Alice'})-[r]->(m:City) RETURN keys(n) AS k, startNode(r) AS s, endNode(r) AS e, properties(m) AS p": [(["age", "name"], 1, 10, {"name": "NYC"})],
    "MATCH (n:Person) RETURN min(n.age) AS a, max(n.age) AS b, sum(n.age) AS c, count(DISTINCT n.name) AS d": [("25", "35", 118.0, 4)],
    "MATCH (n:Nobody) RETURN count(n) AS k, sum(n.age) AS s": [(0, 0.0)],
    "MATCH (n:Person) WHERE n.age > $least RETURN count(*) AS k": [(2,)],
}


@pytest.mark.parametrize("text", CASES)
def test_reads(g, text):
    assert [tuple(r) for r in run(g, text, {"least": 28})[0].collect()] == CASES[text]


def names(g, text="MATCH (n) RETURN n.name AS x ORDER BY x"):
    return [tuple(r) for r in run(g, text)[0].collect()]


def test_writes(g):
    out, h = run(g, "CREATE (a:Person {name: 'Eve', age: 22})-[:KNOWS {since: 2024}]->(b:Person {name: 'Fay'}) RETURN a.name, b.name")
    assert [tuple(r) for r in out.collect()] == [("Eve", "Fay")]
    assert names(h, "MATCH (a {name: 'Eve'})-[r:KNOWS]->(b) RETURN b.name, r.since") == [("Fay", "2024")]
    _, h = run(h, "MATCH (a {name: 'Eve'}), (c:City) CREATE (a)-[:VISITED]->(c)")
    assert names(h, "MATCH (:Person {name: 'Eve'})-[:VISITED]->(c) RETURN c.name ORDER BY c.name") == [("NYC",), ("SF",)]
    _, h = run(h, "MATCH (a {name: 'Eve'}) SET a.age = a.age + 1, a:Student, a += {city: 'SF'}")
    assert names(h, "MATCH (a:Student) RETURN a.age, a.city, a.name") == [("23.0", "SF", "Eve")]
    _, h = run(h, "MATCH (a:Student) REMOVE a.city")
    assert names(h, "MATCH (a:Student) RETURN a.city") == [(None,)]
    with pytest.raises(CypherError):
        run(h, "MATCH (a:Student) DELETE a")
    _, h = run(h, "MATCH (a:Student) DETACH DELETE a")
    assert names(h, "MATCH (a:Student) RETURN count(*) AS k") == [(0,)]
    _, h = run(h, "MATCH (:Person {name: 'Alice'})-[r:KNOWS]->() DELETE r")
    assert names(h, "MATCH (:Person {name: 'Alice'})-[r:KNOWS]->() RETURN count(r) AS k") == [(0,)]


def test_merge(g):
    for text, want in (("MERGE (n:Person {name: 'Bob'}) ON CREATE SET n.made = 1 ON MATCH SET n.seen = 2 RETURN n.made, n.seen", (None, "2")), ("MERGE (n:Person {name: 'Zed'}) ON CREATE SET n.made = 1 ON MATCH SET n.seen = 2 RETURN n.made, n.seen", ("1", None))):
        out, h = run(g, text)
        assert [tuple(r) for r in out.collect()] == [want]
    assert names(h, "MATCH (n:Person) RETURN count(*) AS k") == [(5,)]
    _, h = run(g, "UNWIND ['x', 'x', 'y'] AS w MERGE (n:Tag {name: w})")
    assert names(h, "MATCH (n:Tag) RETURN n.name ORDER BY n.name") == [("x",), ("y",)]
    _, h = run(g, "MATCH (a:Person), (c:City {name: 'NYC'}) MERGE (a)-[:LIVES_IN]->(c)")
    assert names(h, "MATCH (:Person)-[:LIVES_IN]->(c {name: 'NYC'}) RETURN count(*) AS k") == [(4,)]


def test_errors(g):
    for wrong in ("MATCH (n RETURN n", "RETURN nosuch(1)", "RETURN x", "FOO", "MATCH (n) RETURN $nothing"):
        with pytest.raises(CypherError):
            run(g, wrong)
