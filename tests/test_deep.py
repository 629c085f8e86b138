from __future__ import annotations

import math

import numpy as np
import pytest

from quarry.graph.core import Graph
from quarry.operators import deep as D

EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (2, 5), (6, 7)]


@pytest.fixture(scope="module")
def g(spark):
    v = spark.createDataFrame([(k, "n") for k in range(1, 8)], "id long, label string")
    return Graph.of(v, spark.createDataFrame([(a, b, "e") for a, b in EDGES], "src long, dst long, label string"), "g")


def near(i):
    return {b for a, b in EDGES if a == i} | {a for a, b in EDGES if b == i}


def sig(x):
    return 1 / (1 + math.exp(-x))


def lo(p):
    p = min(max(p, 1e-10), 1 - 1e-10)
    return math.log(p / (1 - p))


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, 0.9), (2, 0.4), (4, 0.7)], "doc_id long, score double")


P = {1: 0.9, 2: 0.4, 4: 0.7}


def state(df):
    return {r.doc_id: list(r.ch) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k]), k


def test_signals_and_residual(spark, one):
    two = spark.createDataFrame([(1, 0.6), (9, 0.8)], "doc_id long, score double")
    close(state(D.deep_fusion([D.layer(one)])), {k: [lo(p)] for k, p in P.items()})
    close(state(D.deep_fusion([D.layer(one), D.layer(two)])), {1: [lo(0.9) + lo(0.6)], 2: [lo(0.4)], 4: [lo(0.7)], 9: [lo(0.8)]})
    rows = D.deep_fusion([D.layer(one)], gating="relu").collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({k: sig(max(0, lo(p))) for k, p in P.items()})


@pytest.mark.parametrize("how", ["mean", "sum", "max"])
def test_propagate(g, one, how):
    want = {}
    for v in set(P) | {n for k in P for n in near(k)}:
        heard = [P[n] for n in near(v) if n in P]
        add = lo({"mean": sum(heard) / max(1, len(heard)), "sum": min(sum(heard), 1 - 1e-10), "max": max(heard, default=0)}[how]) if heard else 0.0
        if v in P or heard:
            want[v] = [lo(P[v]) + add if v in P else add]
    close(state(D.deep_fusion([D.layer(one), D.propagate("e", how)], g)), want)


def test_convolve(g, one):
    want = {}
    for v in P:
        x, ring, seen = 0.5 * P[v], {v}, {v}
        for w in (0.3, 0.2):
            ring = {n for r in ring for n in near(r)} - seen
            seen |= ring
            heard = [P[n] for n in ring if n in P]
            x += w * sum(heard) / len(heard) if heard else 0
        want[v] = [lo(P[v]) + lo(x)]
    close(state(D.deep_fusion([D.layer(one), D.convolve("e", [5, 3, 2])], g)), want)
    close(state(D.deep_fusion([D.layer(one), D.convolve("e", [0, 0])], g)), {k: [lo(p)] for k, p in P.items()})


def test_pool_is_greedy(g, spark):
    df = spark.createDataFrame([(k, sig(k)) for k in range(1, 8)], "doc_id long, score double")
    got = state(D.deep_fusion([D.layer(df), D.pool("e", "max", 3)], g))
    close(got, {1: [3.0], 4: [5.0], 6: [7.0]})
    close(state(D.deep_fusion([D.layer(df), D.pool("e", "avg", 2)], g)), {1: [1.5], 3: [3.5], 5: [5.0], 6: [6.5]})


def test_channel_layers(g, one):
    w, b = [[1.0], [-2.0], [0.5]], [0.1, 0.2, 0.3]
    base = np.array([[lo(P[k])] for k in sorted(P)])
    x = base @ np.array(w).T + b
    ids = sorted(P)
    layers = [D.layer(one), D.dense(w, b)]
    close(state(D.deep_fusion(layers)), {k: x[i].tolist() for i, k in enumerate(ids)})
    e = np.exp(x - x.max(axis=1, keepdims=True))
    soft = e / e.sum(axis=1, keepdims=True)
    rows = D.deep_fusion([*layers, D.softmax()]).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({k: soft[i].max() for i, k in enumerate(ids)})
    close(state(D.deep_fusion([*layers, D.batch_norm(1e-5)])), {k: ((x[i] - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + 1e-5)).tolist() for i, k in enumerate(ids)})
    close(state(D.deep_fusion([*layers, D.dropout(0.25)])), {k: (x[i] * 0.75).tolist() for i, k in enumerate(ids)})
    close(state(D.deep_fusion([*layers, D.flatten()])), {1: x.ravel().tolist()})
    for how, want in (("avg", x.mean(axis=0)), ("max", x.max(axis=0)), ("avg_max", np.concatenate([x.mean(axis=0), x.max(axis=0)]))):
        close(state(D.deep_fusion([*layers, D.global_pool(how)])), {1: want.tolist()})
    s = np.exp(x @ x.T / math.sqrt(3))
    close(state(D.deep_fusion([*layers, D.attention(1)])), {k: ((s / s.sum(axis=1, keepdims=True)) @ x)[i].tolist() for i, k in enumerate(ids)})
    close(state(D.deep_fusion([D.embed([0.5, -1.0])], g)), {1: [0.5], 2: [-1.0]})


def test_attention_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 4))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "doc_id long, ch array<double>")
    monkeypatch.setattr(D, "BLOCK", 7)
    v = r.normal(size=(4, 4))
    got = state(D.Fusion().attention(df, 2, None, None, v))
    want = np.zeros_like(x)
    for h in (slice(0, 2), slice(2, 4)):
        s = np.exp(x[:, h] @ x[:, h].T / math.sqrt(2))
        want[:, h] = s / s.sum(axis=1, keepdims=True) @ (x @ v)[:, h]
    close(got, {k: want[k].tolist() for k in range(40)})


def test_solvers_and_kernels():
    r = np.random.default_rng(0)
    x, w = r.normal(size=(200, 5)), np.array([[1.0], [0], [-2], [0], [0.5]])
    y = x @ w
    assert D.ridge(x.T @ x, x.T @ y, 1e-9) == pytest.approx(w, abs=1e-6)
    sparse = D.elastic_net(x.T @ x, x.T @ y, 200, 0.3, 0.0)
    assert sparse[1, 0] == 0 and sparse[3, 0] == 0 and 0.5 < sparse[0, 0] < 1
    assert (D.prune(np.array([0.1, -5, 2, 0.2]), 0.5) == [0, -5, 2, 0]).all()
    for kind in ("kaiming", "orthogonal", "gabor", "kmeans"):
        k = D.kernels(kind, 6, 2, patches=r.normal(size=(50, 2, 3, 3)))
        assert k.shape == (6, 2, 3, 3) and (k == D.kernels(kind, 6, 2, patches=r.normal(size=(50, 2, 3, 3)))).all() == (kind != "kmeans")
    o = D.kernels("orthogonal", 9, 1).reshape(9, 9)
    assert o @ o.T == pytest.approx(np.eye(9), abs=1e-9)
    k = np.zeros((1, 1, 3, 3))
    k[0, 0, 1, 1] = 2.0
    assert D.grid_forward(np.arange(16.0).reshape(1, 1, 4, 4), [(k, 2)]).tolist() == [[5.0, 9.0, 21.0, 25.0]]


def test_learn_and_predict(spark):
    r = np.random.default_rng(3)
    marks = r.normal(size=(3, 64))
    rows = [(k, (marks[k % 3] + 0.5 * r.normal(size=64)).tolist(), "abc"[k % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label string").repartition(4)
    m = D.deep_learn(df, (("orthogonal", 8, 2), ("kaiming", 8, 2)))
    assert m.accuracy > 0.9 and m.classes == ["a", "b", "c"]
    out = D.deep_predict(df, m, "embedding", "id", "label").collect()
    assert all(sum(x.probabilities) == pytest.approx(1) for x in out) and sum(x.predicted == x.label for x in out) > 270
    assert D.deep_learn(df, (("kmeans", 8, 2),), l1=1e-4, prune_ratio=0.2).accuracy > 0.8
    feats = m.features(np.array([rows[0][1]]))
    state_ = spark.createDataFrame([(0, feats[0].tolist())], "doc_id long, ch array<double>")
    f = D.Fusion()
    dense, _ = D.model_layers(m)
    assert list(f.dense(state_, **dense.args).first().ch) == pytest.approx(m.scores(np.array([rows[0][1]]))[0].tolist())
