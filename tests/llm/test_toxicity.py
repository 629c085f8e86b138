from __future__ import annotations

import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from quarry.llm import toxicity as T

from .conftest import frame

VILE = ["grobnik", "snarfhead", "plimwit", "dungbrain"]


def word(r):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))


def spoiled(w, r):
    k = r.randrange(1, len(w) - 1)
    return r.choice([w, w[:k] + r.choice("xyz*.-") + w[k:], " ".join(w), w.upper()])


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    vocab = [word(r) for _ in range(1500)]
    rows, labels = [], []
    for k in range(900):
        words = [r.choice(vocab) for _ in range(r.randint(5, 150))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), spoiled(r.choice(VILE), r))
        rows.append((k, " ".join(words), "en", "a"))
        labels.append((k, int(toxic)))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark, labelled):
    docs, labels, said = labelled
    rows = T.score(docs, T.train(docs, labels)).collect()
    held = [(said[r.doc_id], r.score, r.predicted) for r in rows if T.held_out(r.doc_id)]
    assert len(rows) == 900 and len(held) > 200
    hit = [(y, p) for y, _, p in held]
    assert sum(p for y, p in hit if y) / sum(y for y, _ in hit) > 0.9
    assert sum(p for y, p in hit if not y) / sum(1 - y for y, _ in hit) < 0.02
    assert all(p == (s >= 0.7) and 0 <= s <= 1 for _, s, p in held)


def test_held_out_labels_and_other_columns_do_not_matter(spark, labelled):
    docs, labels, said = labelled
    turned = spark.createDataFrame([(k, 1 - y if T.held_out(k) else y) for k, y in said.items()], "doc_id long, toxic int")
    a, b = T.train(docs, labels), T.train(docs.selectExpr("doc_id", "text", "'zz' AS lang", "'q' AS source"), turned)
    assert a.weights == b.weights and a.curve == b.curve


def test_machine_equals_its_kernel():
    """The folded weights give what the sum over subsequences of the word gives."""
    m = T.fit([(k % 2, " ".join([VILE[k % 4] if k % 2 else "plain", "some", "words" + "abc"[k % 3]])) for k in range(60)])
    for w in (*VILE, "grobxnik", "some", "zzz"):
        m.decide([w])
        want = sum(v * m.weights.get(k, 0.0) for k, v in T.subsequences(w).items()) + m.bias
        assert math.isclose(m.known[w], want, rel_tol=1e-9, abs_tol=1e-9)


def test_subsequences_equal_brute_force():
    from itertools import combinations

    for w in ("abc", "gap", "aabbcc", "x"):
        s, want = f"^{w}$", {}
        for c in combinations(range(len(s)), 3):
            if c[2] - c[0] < T.SPAN:
                k = "".join(s[i] for i in c)
                want[k] = want.get(k, 0) + T.DECAY ** (c[2] - c[0] + 1) / T.size_of(len(s))
        assert T.subsequences(w) == pytest.approx(want)


def test_odd_rows_no_labels_and_empty(spark, odd, odd_rows, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.score(odd, T.train(odd, none)).collect()
    assert len(rows) == len(odd_rows) and len({r.score for r in rows}) == 1
    labels = spark.createDataFrame([(4, 1), (6, 0), (20, 0), (21, 1)], "doc_id long, toxic int")
    m = T.train(odd, labels)
    assert T.score(empty, m).collect() == []
    assert T.clean(odd, m).columns == odd.columns


def test_held_out_is_the_crc_of_the_decimal_id():
    assert [T.held_out(k) for k in range(50)] == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(50)]


def test_rare_and_wide_characters_count():
    """More than 127 characters, some beyond the first plane: a word's decision is the sum over its subsequences, whatever they are of."""
    words = ["".join(chr(0x4E00 + 7 * k + j) for j in range(4)) for k in range(80)] + ["".join(chr(0x20000 + j) for j in range(4)), "insult"]
    m = T.Model({k: 1.0 + n for n, w in enumerate(words) for k in T.subsequences(w)}, -1.0)
    m.decide(words)
    for w in words:
        assert abs(m.known[w] - sum(v * m.weights[k] for k, v in T.subsequences(w).items()) + 1.0) < 1e-6


def test_short_insults_are_learned():
    """Two characters, scored through the end-marked subsequences."""
    r = random.Random(3)
    vocab = ["".join(chr(0x4E00 + r.randrange(400)) for _ in range(2)) for _ in range(600)]
    bad = chr(0x6000) + chr(0x6001)
    say = lambda *more: " ".join([*r.sample(vocab, 12), *more])
    m = T.fit([(0, say()) for _ in range(150)] + [(1, say(bad)) for _ in range(150)])
    assert m.score(" ".join([*r.sample(vocab, 12), bad])) > 0.7 > 0.3 > m.score(" ".join(r.sample(vocab, 12)))


def test_windows_across_blanks_equal_their_joined_words():
    """The best of all windows of two to four words, by joining each and deciding it as a word."""
    r = random.Random(12)
    m = T.fit([(k % 2, " ".join([VILE[k % 4]] * (k % 2) + [word(r) for _ in range(6)])) for k in range(200)])
    docs = [[r.choice(["gro", "bnik", "grob", "nik", "sn", "arf", "head", "a", "9", "o'b", *VILE]) for _ in range(r.randint(0, 9))] for _ in range(80)]
    got_of = m.windows
    m.decide({x for d in docs for x in d})
    for d, got in zip(docs, got_of(docs), strict=True):
        want = T.LOWEST
        for i in range(len(d)):
            for n in range(2, T.PARTS + 1):
                part = d[i : i + n]
                whole = "".join(map(T.letters, part))
                if len(part) == n and T.LEAST <= len(whole) <= T.JOINED:
                    other = T.Model(m.weights, m.bias)
                    other.decide([whole])
                    if other.known[whole] > max(m.known[x] for x in part) + 1e-6:
                        want = max(want, other.known[whole])
        assert got == pytest.approx(want)


def test_split_and_spelled_insults_are_found(spark, labelled):
    docs, labels, said = labelled
    m = T.train(docs, labels)
    clean = next(r.text for r in docs.collect() if not said[r.doc_id] and len(r.text.split()) > 60)
    assert m.score(clean) < 0.7
    for insult in ("grobnik", "grob-nik", "g r o b n i k", "grob nik", "gr ob ni k", "gr0bn1k", "GROBxNIK"):
        assert m.score(f"{clean} {insult} {clean}") >= 0.7, insult


def test_slices_carry_windows_over(monkeypatch, spark, labelled):
    docs, labels, _ = labelled
    m = T.train(docs, labels)
    text = "some plain words here " * 5 + "grob nik " + "and more of these " * 5
    whole = m.summaries([text])
    monkeypatch.setattr(T, "SLICE", 16)
    monkeypatch.setattr(T, "RUN", 50)
    assert m.summaries([text])[0] == pytest.approx(whole[0])


def test_parted_classes_keep_their_machine():
    """Rounds may leave no clean word within the margin; what the round before has learned stays."""
    r = random.Random(3)
    vocab = [word(r) for _ in range(300)]
    say = lambda: [r.choice(vocab) for _ in range(40)]
    m = T.fit([(0, " ".join(say())) for _ in range(200)] + [(1, " ".join([*say(), r.choice(VILE)])) for _ in range(80)])
    said = " ".join(say())
    assert m.score(said) < 0.3
    assert all(m.score(f"{said} {w}") > 0.7 for w in VILE)


def test_newton_steps_copy_a_block_at_a_time():
    r = np.random.default_rng(4)
    x = r.normal(size=(200_000, 32)).astype(np.float32)
    own = np.arange(len(x) - 1, -1, -1)
    y, weight = np.where(x[own, 0] > 0.5, 1.0, -1.0), np.full(len(x), 1e-3)
    tracemalloc.start()
    w = T._newton(x, own, y, weight, 1.0, np.zeros(33))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 2
    assert (w == T._newton(x[own], np.arange(len(x)), y, weight, 1.0, np.zeros(33))).all()
