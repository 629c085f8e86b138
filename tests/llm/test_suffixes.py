from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffixes as S

from .conftest import frame


def brute(docs, width=100):
    """docs: {id: text}, in order of id. Per id: (bytes, removed, spans, sha of the rest)."""
    seen, out = set(), {}
    for i in sorted(docs):
        data = (docs[i] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            w = data[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abc déf\n") for _ in range(n))
    shared = [say(r.randint(90, 400)) for _ in range(6)]
    docs = {}
    for k in range(80):
        parts = [r.choice([say(r.randint(0, 150)), r.choice(shared), r.choice(shared)[r.randint(0, 60) :], "ab" * r.randint(0, 120), "z" * r.randint(0, 260)]) for _ in range(r.randint(0, 5))]
        docs[k * 3] = "".join(parts)
    docs[1], docs[2], docs[4] = None, "", docs[0]
    docs[7] = "q" * 5000 + docs[3]
    docs[8] = ("0123456789" * 40 + "x") * 3
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = frame(spark, [(i, t, "en", "a") for i, t in docs.items()]).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in S.digests(df).collect()}
    assert got == brute(docs)


def test_salted_anchors_equal_brute_force(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(S.repeats, "__defaults__", (S.WIDTH, 3))
    df = frame(spark, [(i, t, "en", "a") for i, t in docs.items()]).repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in S.digests(df).collect()} == brute(docs)


@pytest.mark.parametrize("kept", [2, 1 << 17])
def test_batches_settle_across_each_other(spark, kept, monkeypatch):
    """Passages in every document, batches of four, in an order that isn't that of the ids; string ids; columns with the names used inside."""
    r = random.Random(13)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [say(300) for _ in range(4)]
    docs = {f"id{k:03d}": say(60) + shared[k % 4] + say(60) + shared[k * 7 % 4][:180] for k in range(60)}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    monkeypatch.setattr(S, "KEPT", kept)
    rows = list(docs.items())
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id string, text string, _doc int, _hash int, least int, __cut int").coalesce(1)
    got = {x.doc_id: tuple(x)[1:] for x in S.digests(df).collect()}
    out = S.dedup(df)
    left = {x.doc_id: x.text for x in out.collect()}
    spark.conf.set(key, before)
    want = brute(docs)
    assert got == want and out.columns == df.columns
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()} == {i: w[3] for i, w in want.items()}


def test_pieces_of_long_texts(spark, monkeypatch):
    r = random.Random(9)
    block = "".join(r.choice("abcd") for _ in range(3000))
    docs = {1: block + "".join(r.choice("abcd") for _ in range(2000)) + block, 2: block[100:2900], 3: "a" * 4000}
    data = np.frombuffer(docs[1].encode(), dtype=np.uint8)
    whole = S.runs(data)
    monkeypatch.setattr(S, "PIECE", 700)
    cut = S.runs(data)
    assert (whole[3] - whole[2] + 1).sum() == (cut[3] - cut[2] + 1).sum() == len(data) - S.WIDTH + 1
    # Runs that a piece's edge cuts have other bytes, and are settled by the shards.
    df = frame(spark, [(i, t, "en", "a") for i, t in docs.items()])
    monkeypatch.undo()
    assert {x.doc_id: tuple(x)[1:] for x in S.digests(df).collect()} == brute(docs)


def test_suffix_array_and_prefixes_equal_brute_force():
    r = random.Random(2)
    for _ in range(60):
        n = r.randint(1, 300)
        data = bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcdef") for _ in range(n))
        if r.random() < 0.3:
            data = (data[: n // 4 + 1] * 5)[:n]
        text = np.frombuffer(data, dtype=np.uint8)
        sa = S.suffix_array(text, n + 1)
        assert sa.tolist() == sorted(range(n), key=lambda k: data[k:])
        lcp = S.common_prefixes(text, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            want = 0
            while want < S.WIDTH and a + want < n and b + want < n and data[a + want] == data[b + want]:
                want += 1
            assert lcp[b] == want


def test_odd_rows(spark, odd, odd_rows):
    rows = S.digests(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].n_removed == by[5].n_bytes and by[4].n_removed < by[4].n_bytes
    out = S.dedup(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)


def test_empty_table(spark, empty):
    assert S.digests(empty).collect() == []
    assert S.dedup(empty).collect() == []
