"""Joins on vectors in blocks against all pairs by definition."""

from __future__ import annotations

import math
import random

import pytest

from quarry.operators import vector

KINDS = "doc_id long, k string, embedding array<float>"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return None if n == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    own = [(i, "hot" if i % 4 else rng.choice(["a", "b", None]), [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)]
    return [*own, (300, "hot", None), (301, "hot", [0.0] * 4), (302, "hot", [1.0, 2.0]), (303, "hot", [2.0, 4.0]), (304, "hot", [1.0, None, 2.0, 3.0]), (305, "hot", [])]


def test_joins_in_blocks_equal_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 40)  # many blocks of the hot key, one of the others
    df = spark.createDataFrame(rows, KINDS)
    # 0.5 is the very cosine of many pairs of small whole numbers.
    want = {(i, j): (s, a == b) for i, a, x in rows for j, b, y in rows for s in [cosine(x, y)] if s is not None and s >= 0.5}
    found = vector.hybrid_join(df, df, "k", 0.5).collect()
    assert len(found) == len({r[:2] for r in found})
    assert {(r.left_id, r.right_id): r.score for r in found} == {p: s for p, (s, same) in want.items() if same and rows[p[0]][1] is not None}
    assert {(r.left_id, r.right_id): r.score for r in vector.similarity_join(df.drop("k"), df.drop("k"), 0.5).collect()} == {p: s for p, (s, _) in want.items()}


def test_no_task_holds_more_than_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 100)
    df = spark.range(2000).selectExpr("id AS doc_id", "'hot' AS k", "array(1D + id, 1D) AS embedding")
    made = vector._product

    def watched(threshold):
        inner = made(threshold)

        def pairs(a, b):
            out = inner(a, b)
            return out.slice(0, 0) if not out.num_rows else out.slice(0, 1).set_column(2, "score", [[float(a.num_rows + b.num_rows)]])

        return pairs

    monkeypatch.setattr(vector, "_product", watched)
    sizes = [r.score for r in vector.hybrid_join(df, df, "k", 0.0).collect()]
    assert len(sizes) == 400 and max(sizes) < 350
