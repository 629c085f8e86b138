from __future__ import annotations

import random
import re

import numpy as np

from quarry.llm import quality as Q

from .conftest import frame


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_brute_force(odd_rows):
    r = random.Random(6)
    texts = ["".join(r.choice("ab #*\n\t|") for _ in range(r.randint(0, 200))) for _ in range(200)] + ["a b c a b c a b c", "x\nx\n \n \nx", "a a a a a"]
    for t in [*texts, *(t for _, t, _, _ in odd_rows if len(t or "") < 5000)]:
        assert Q.counts(t)[:5] == brute(t)


def clean_and_odd(n=600, seed=0):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(int(np.exp(r.gauss(5, 0.5))) + 50)), "en", "a") for k in range(n)]
    rows += [(10_000 + k, " ".join("".join(r.choice("#*$%&|<>") for _ in range(6)) for _ in range(200)), "en", "a") for k in range(20)]
    rows += [(20_000 + k, " ".join("x" * 40 + str(r.random()) for _ in range(200)), "en", "a") for k in range(20)]
    return rows


def test_outliers_go_and_clean_documents_stay(spark):
    got = {r.doc_id: r for r in Q.judge(frame(spark, clean_and_odd())).collect()}
    assert len(got) == 640
    assert all(r.kept for i, r in got.items() if i < 10_000)
    assert not any(r.kept for i, r in got.items() if i >= 10_000)


def test_planted_outliers_go_on_every_axis(spark):
    """In a group with tight scales; each is far out by one statistic only, and none fails the base rule."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    say = lambda n, longer=0: [word(r.randint(4, 9) + longer) for _ in range(n)]
    lines = lambda words: "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
    rows = [(k, lines(say(int(200 * np.exp(r.gauss(0, 0.1))))), "en", "a") for k in range(400)]
    passage = say(45)
    planted = {
        1000: lines(say(200, 2)),
        1001: lines(say(1600)),
        1002: lines([w if k % 2 else "#" * 3 + w[3:] for k, w in enumerate(say(200))]),
        1003: "\n".join(x for k in range(20) for x in (" ".join(say(9)), "same")),
        1004: " ".join(passage + say(65) + passage + say(45)),
    }
    got = {x.doc_id: x for x in Q.judge(frame(spark, rows + [(i, t, "en", "a") for i, t in planted.items()])).collect()}
    assert not any(x.base_failed for x in got.values())
    assert [i for i in planted if got[i].kept] == []
    assert sum(not got[k].kept for k in range(400)) <= 2


def exact(groups):
    """Brute force: {key: rows} -> {key: (centre, precision)}, with sorted distances, every start, steps until nothing changes."""
    langs = {}
    for (lang, _), rows in groups.items():
        langs.setdefault(lang, []).append(rows)
    low = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    floor = lambda v: np.array([Q.RIDGE, Q.RIDGE, *v.mean(axis=0)])

    def scatter(rows):
        x, v = rows[:, :5], rows[:, 5:]
        return low(x), np.maximum((1.4826 * low(abs(x - low(x)))) ** 2, floor(v))

    every = np.unique(np.vstack([np.unique(g, axis=0) for g in groups.values()]), axis=0) if len(groups) == 1 else np.vstack([np.unique(g, axis=0) for g in groups.values()])
    c_all, t_all = scatter(every)
    out = {}
    for (lang, source), rows in groups.items():
        rows = np.unique(rows, axis=0)
        own = np.vstack([np.unique(g, axis=0) for g in langs[lang]])
        c, t = scatter(own)
        centre, target = (len(own) * c + c_all) / (len(own) + 1), (len(own) * t + Q.PRIOR * t_all) / (len(own) + Q.PRIOR)
        x, v, n = rows[:, :5], rows[:, 5:], len(rows)
        m, s = scatter(rows)
        starts = [(centre, np.diag(1 / target)), (m, np.diag(1 / ((n * s + Q.PRIOR * target) / (n + Q.PRIOR))))]
        starts.append(Q.solved(n, x.mean(axis=0), np.cov(x.T, bias=True).reshape(5, 5) if n > 1 else np.zeros((5, 5)), v.mean(axis=0), centre, target, 1.0)[:2])
        best = None
        for mid, prec in starts:
            last = np.inf
            while True:
                d = np.einsum("ij,jk,ik->i", x - mid, prec, x - mid)
                pick = np.argsort(d, kind="stable")[: max(1, int(n * Q.SUPPORT))]
                got = Q.solved(len(pick), x[pick].mean(axis=0), np.cov(x[pick].T, bias=True).reshape(5, 5) if len(pick) > 1 else np.zeros((5, 5)), v[pick].mean(axis=0), centre, target, Q.factor_of(Q.SUPPORT))
                if got[2] >= last - 1e-9:
                    break
                (mid, prec, last) = got
            if best is None or last < best[2]:
                best = mid, prec, last
        out[lang, source] = best
    return out


def test_verdicts_equal_brute_force_at_every_size(spark):
    """Groups of 1 to 300 documents, a third with planted outliers: the same are rejected, and small groups reject too."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows, odd = [], set()
    for g, n in enumerate([1, 2, 3, 4, 6, 9, 14, 30, 60, 120, 300]):
        for _ in range(n):
            rows.append((len(rows), say(int(np.exp(r.gauss(5, 0.4))) + 50), "en" if g % 2 else None, f"s{g}"))
        for _ in range(n // 5 + (n < 3)):
            odd.add(len(rows))
            rows.append((len(rows), " ".join(r.choice(["#" * 6, "<$>%&*"]) + str(r.random()) for _ in range(150)), "en" if g % 2 else None, f"s{g}"))
    got = {x.doc_id: x for x in Q.judge(frame(spark, rows)).collect()}
    every = np.array(Q.vectors(np.array([Q.counts(t) for _, t, _, _ in rows]))).T
    groups = {}
    for i, _, lang, source in rows:
        groups.setdefault((lang, source), []).append(every[i])
    found = exact({k: np.array(v) for k, v in groups.items()})
    cut = Q.chi2_quantile(1 - Q.BEYOND, Q.D)
    for i, _, lang, source in rows:
        mid, prec, _ = found[lang, source]
        d = (every[i][:5] - mid) @ prec @ (every[i][:5] - mid)
        assert got[i].kept == (d <= cut), (i, source, d, got[i].distance2)
    assert [i for i in odd if got[i].kept] == []
    assert sum(not x.kept for i, x in got.items() if i not in odd) <= 3


def test_copies_do_not_make_the_estimate(spark):
    """A text that a group holds a thousand times is one observation: the group's other documents stay."""
    rows = [x for x in clean_and_odd(200) if x[0] < 10_000]
    same = rows[0][1]
    got = Q.judge(frame(spark, rows + [(50_000 + k, same, "en", "a") for k in range(1000)])).collect()
    assert all(x.kept for x in got)


def test_odd_rows(spark, odd, odd_rows):
    rows = Q.judge(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.kept for r in rows if r.doc_id in (1, 2, 3)} == {False}


def test_empty_table(spark, empty):
    assert Q.judge(empty).collect() == []
