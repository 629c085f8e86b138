from __future__ import annotations

import re
from collections import defaultdict

import pytest

from quarry.llm import mixing

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, cap):
    """Targets by resharing until none is above its cap."""
    total = sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wt = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_ = {}, set(names)
    while True:
        rest = total - sum(out.values())
        share = {s: rest * wt[s] / sum(wt[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        if not open_:
            return out


def test_targets_sizes_and_limits(spark, odd, odd_rows):
    rows = mixing.mix(odd).collect()
    sizes = defaultdict(int)
    for _, t, _, s in odd_rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = filled(sizes, mixing.WEIGHTS, mixing.MAX_COPIES)
    assert len(rows) == len(odd_rows)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= mixing.MAX_COPIES
        taken[r.source] += r.copies * r.size
    largest = defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_many_documents_come_near_their_targets(spark):
    docs = frame(spark, [(k, "w " * (1 + k * 7 % 50), "en", "abcd"[k % 4] if k % 3 else "a") for k in range(4000)])
    rows = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.001 * t)
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(13)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}


def test_inclusion_is_proportional_to_size(spark):
    """A source of which half of the words are wanted: documents are taken about as often as their probability says, the largest for certain."""
    docs = [(k, "w " * (1 + k % 40), "en", "a") for k in range(8000)] + [(9000, "w " * 9000, "en", "a")] + [(10_000 + k, "w " * 20, "en", "b") for k in range(20_000)]
    rows = [r for r in mixing.mix(frame(spark, docs)).collect() if r.source == "a"]
    sizes, need = [r.size for r in rows], rows[0].target % rows[0].source_size
    whole = int(rows[0].target // rows[0].source_size)
    sure = set()
    while True:  # the definition: those that would pass 1 are certain, the rest share what is left by size
        rest = [n for n in sizes if n not in sure]
        rate = (need - sum(n for n in sizes if n in sure)) / sum(n * n for n in rest)
        over = {n for n in rest if rate * n >= 1}
        if not over:
            break
        sure |= over
    for low, high in ((1, 10), (11, 20), (21, 30), (31, 40)):
        own = [r for r in rows if low <= r.size <= high]
        got, want = sum(r.copies - whole for r in own) / len(own), sum(min(1, rate * r.size) for r in own) / len(own)
        assert abs(got - want) < 0.05, (low, got, want)
    assert all(r.copies == whole + 1 for r in rows if r.size in sure)


def test_null_ids_draw_apart(spark):
    docs = [(None, "w " * (1 + k % 30) + f"x{k}", "en", "ab"[k % 4 == 0]) for k in range(3000)]
    rows = mixing.mix(frame(spark, docs)).collect()
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 0.02 * own[0].target
    assert mixing.take(frame(spark, docs)).count() == sum(r.copies for r in rows)


def test_columns_that_clash_stay(spark, odd):
    more = odd.selectExpr("*", "1 AS _id", "2 AS _copies", "3 AS __id", "4 AS copies", "5 AS u")
    assert mixing.take(more).columns == more.columns


def test_take_repeats_rows_and_keeps_columns(spark, odd):
    out = mixing.take(odd)
    assert out.columns == odd.columns
    want = sum(r.copies for r in mixing.mix(odd).collect())
    assert out.count() == want


def test_empty_table(spark, empty):
    assert mixing.mix(empty).collect() == []
    assert mixing.take(empty).collect() == []
