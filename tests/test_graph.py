"""Graph measures on small graphs against their definitions."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from quarry.graph import core, indexes, paths

EDGES = [(1, 2, "knows"), (1, 3, "knows"), (2, 4, "knows"), (3, 4, "knows"), (4, 5, "likes"), (5, 1, "likes")]


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    e = spark.createDataFrame(EDGES, "src long, dst long, label string")
    return core.Graph.of(v, e)


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_pagerank_equals_power_iteration(graph):
    rank = dict.fromkeys(range(1, 7), 1 / 6)
    out = {v: [d for s, d, _ in EDGES if s == v] for v in rank}
    for _ in range(12):
        loose = sum(r for v, r in rank.items() if not out[v])
        rank = {v: 0.15 / 6 + 0.85 * (loose / 6 + sum(rank[s] / len(out[s]) for s in rank for d in out[s] if d == v)) for v in rank}
    assert scores(core.pagerank(graph, iterations=12, tolerance=0)) == pytest.approx(rank)


def test_betweenness_equals_counting_paths(graph):
    near = {v: {b for a, b, _ in EDGES if a == v} | {a for a, b, _ in EDGES if b == v} for v in range(1, 7)}

    def shortest(a, b):
        found, front = [], [[a]]
        while front and not found:
            found = [p for p in front if p[-1] == b]
            front = [[*p, n] for p in front for n in near[p[-1]] if n not in p]
        return found

    want = dict.fromkeys(near, 0.0)
    for a, b in itertools.combinations(near, 2):
        ways = shortest(a, b)
        for p in ways:
            for v in p[1:-1]:
                want[v] += 1 / len(ways)
    assert scores(core.betweenness(graph)) == pytest.approx(want)


def test_hits_are_of_length_one(graph):
    rows = core.hits(graph, iterations=8).collect()
    assert math.isclose(sum(r.hub**2 for r in rows), 1, rel_tol=1e-6) and math.isclose(sum(r.authority**2 for r in rows), 1, rel_tol=1e-6)
    assert max(rows, key=lambda r: r.authority).doc_id == 4


def test_paths_and_patterns(graph):
    pairs = lambda text: {(r.start_id, r.end_id) for r in paths.rpq(graph, text).collect()}
    assert pairs("knows/knows") == {(1, 4)}
    assert pairs("knows{2,3}|likes") == {(1, 4), (4, 5), (5, 1)}
    found = paths.match(graph, {"a": paths.V(), "b": paths.V(), "c": paths.V()}, [paths.E("a", "b", "knows"), paths.E("b", "c", "knows")])
    assert {(r.a, r.b, r.c) for r in found.collect()} == {(1, 2, 4), (1, 3, 4)}


def test_traversal_scores_fall_with_depth(graph):
    assert scores(graph.traverse(1, "knows", hops=2)) == {1: 1.0, 2: 0.5, 3: 0.5, 4: pytest.approx(1 / 3)}


def test_neighborhood_index_holds_each_step_once_and_answers_from_one_vertex(spark, graph):
    index = indexes.NeighborhoodIndex(graph, 2)
    near = {a: {d for s, d, _ in EDGES if s == a} | {s for s, d, _ in EDGES if d == a} for a in range(1, 7)}
    want = {(a, b, 1) for a in near for b in near[a]} | {(a, c, 2) for a in near for b in near[a] for c in near[b] - near[a] - {a}}
    assert {tuple(r) for r in index.pairs().collect()} == want
    for a in range(1, 8):
        assert sorted(map(tuple, index.of(a).collect())) == sorted((n, d) for v, n, d in want if v == a)
        assert {r.near for r in index.of(a, 1).collect()} == near.get(a, set())
    # A hub of 30,000: 9 * 10^8 pairs, of which nothing is made.
    leaves = spark.range(1, 30_001)
    hub = indexes.NeighborhoodIndex(core.Graph.of(spark.range(30_001), leaves.select("id", F.lit(0).cast("long").alias("dst")).withColumnRenamed("id", "src")), 2)
    assert hub.steps.count() == 60_000
    assert {(r.depth, r["count"]) for r in hub.of(7).groupBy("depth").count().collect()} == {(1, 1), (2, 29_999)}


@pytest.mark.parametrize("measure", [core.pagerank, core.hits])
def test_rounds_send_no_number_a_vertex_to_the_driver(graph, monkeypatch, measure):
    joins, settle = [], core.settle

    def watched(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.extend(line for line in plan.splitlines() if "Join Inner, (" in line or "Join LeftOuter, (" in line)
        return settle(df)

    measure(graph, iterations=1)
    monkeypatch.setattr(core, "settle", watched)
    measure(graph, iterations=1)
    rounds = [x for x in joins if "src" in x or "dst" in x or "id#" in x]
    assert sum("strategy=merge" in x for x in rounds) >= len(rounds) - (measure is core.pagerank) * 2 > 0
