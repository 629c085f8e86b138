from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import common
from quarry.llm import simhash as M

from .conftest import frame


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """prints: [(doc_id, fingerprint)] -> {fingerprint: least doc_id reachable}."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        least[find(f)] = min(least.get(find(f), i), i)
    return {f: least[find(f)] for f in fps}


def test_fingerprints_equal_brute_force(odd_rows):
    for _, t, _, _ in odd_rows:
        assert M.fingerprint(t) == fingerprint(t)
    for t in ("A b", "one", "ONE two THREE", "a b c a b c a b c", "É é"):
        assert M.fingerprint(t) == fingerprint(t)


def near_copies(seed, n=400):
    r = random.Random(seed)
    say = lambda k: [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(k)]
    bases, rows = [say(400) for _ in range(12)], []
    for k in range(n):
        words = list(r.choice(bases)) if r.random() < 0.7 else say(r.randint(1, 60))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "edit" + str(k)
        rows.append((k * 7 % 1009, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("shard", [4096, 8])
def test_components_equal_brute_force(spark, shard, monkeypatch):
    rows = near_copies(4)
    monkeypatch.setattr(M.links, "__defaults__", (2, shard))
    got = M.near_duplicates(frame(spark, rows)).collect()
    prints = [(i, fingerprint(t)) for i, t, _, _ in rows]
    want = components(prints)
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got} == {(i, f, want[f]) for i, f in prints}
    assert len(got) == len(rows) and len({r.component_id for r in got}) < len(rows)


def test_index_finds_every_close_pair():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]]))
    fps = fps[np.argsort(M.gray_rank(fps))]
    got = {(int(i), int(j)) for a, b in M.close_pairs(fps) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want


def test_gray_rank_is_the_place_in_the_code():
    codes = np.array([k ^ k >> 1 for k in range(300)], dtype=np.uint64)
    assert M.gray_rank(codes).tolist() == list(range(300))


def test_odd_rows_and_keep_one(spark, odd, odd_rows):
    rows = M.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    blank = {r.component_id for r in rows if r.doc_id in (1, 2, 3)}
    assert blank == {1} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = M.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4} <= set(ids) and not {2, 3, 5} & set(ids)


def test_empty_table(spark, empty):
    assert M.near_duplicates(empty).collect() == []
    assert M.keep_one(empty).collect() == []


def test_string_ids_clashing_columns_and_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    rows = [(f"d{k:02d}", "the same words here again and again" if k % 3 else f"other text number {k} with words of its own", 1, 2, 3) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _stays int, __stays int, fp int").repartition(4)
    want = components([(i, fingerprint(t)) for i, t, *_ in rows])
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()}
    assert got == {i: want[fingerprint(t)] for i, t, *_ in rows}
    out = M.keep_one(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == set(got.values())
