from __future__ import annotations

import random
import re

from quarry.llm import licences as L


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(k, label) for p, label in L.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places_equal_brute_force(spark, odd, odd_rows):
    r = random.Random(1)
    vocab = "under the mit license apache version 2 cc by nc Under MIT.License x the,the".split(" ")
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["under the under the mit license mit license", "CC-BY-NC cc by/nc", "Apache License, Version 2.0"]
    s = L.scanner()
    for t in [*texts, *(t for _, t, _, _ in odd_rows)]:
        assert s.file(t or "")[:5] == brute(t)
    rows = L.scan(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in rows) == sorted((i is None, i or 0, brute(t)[0]) for i, t, _, _ in odd_rows)


def test_slices_carry_over(monkeypatch):
    text = "aa bb under the mit license cc dd " * 50
    whole = L.Scanner().file(text)
    monkeypatch.setattr(L, "SLICE", 11)
    assert L.Scanner().file(text) == whole


def test_automaton_statistics_equal_brute_force():
    r = random.Random(3)
    for _ in range(60):
        strings = [[r.randint(1, 3) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 4))]
        sa = L.SuffixAutomaton(strings)
        state = length = 0
        text = [r.randint(1, 4) for _ in range(40)]
        for k, token in enumerate(text):
            state, length = sa.step(state, length, token)
            best = next(n for n in range(k + 1, -1, -1) if n == 0 or any(text[k - n + 1 : k + 1] == s[i : i + n] for s in strings for i in range(len(s))))
            assert length == best
            want = {(n, e) for n, s in enumerate(strings) for e in range(length, len(s) + 1) if s[e - length : e] == text[k - length + 1 : k + 1]} if length else set()
            assert sa.ends[state] == want


def tiny(strings):
    return L.Scanner({f"l{k}": (" ".join(s),) for k, s in enumerate(strings)}, {"zz yy": "base"})


def test_runs_equal_brute_force():
    """Every maximal common run of three words or more of the file and each template."""
    r = random.Random(4)
    for _ in range(60):
        strings = [[r.choice("abc") for _ in range(r.randint(3, 14))] for _ in range(r.randint(1, 4))]
        text = [r.choice("abcx") for _ in range(50)]
        want = set()
        for t, s in enumerate(strings):
            for i in range(len(text)):
                for j in range(len(s)):
                    if text[i] == s[j] and (i == 0 or j == 0 or text[i - 1] != s[j - 1]):
                        n = 0
                        while i + n < len(text) and j + n < len(s) and text[i + n] == s[j + n]:
                            n += 1
                        if n >= L.MIN_RUN:
                            want.add((i, i + n - 1, t, j))
        got = tiny(strings).scan(" ".join(text))[2]
        assert len(got) == len(set(got)) and set(got) == want


def test_best_chain_equals_brute_force():
    """The most tokens that any admissible sequence of runs covers, by trying all."""
    r = random.Random(5)
    for _ in range(40):
        s = [r.choice("abcd") for _ in range(12)]
        k = r.randint(3, 9)
        text = s[:k] + s[r.randint(0, k) : r.randint(k, 12)] + ["x"] * r.randint(0, 8) + s[r.randint(0, k) :]
        scanner = tiny([s])
        runs = sorted(scanner.scan(" ".join(text))[2])

        def extend(covered, run):
            best = covered
            for nxt in runs:
                end, nend = run[3] + run[1] - run[0] + 1, nxt[3] + nxt[1] - nxt[0] + 1
                if nxt[0] > run[0] and nxt[3] > run[3] and nend > end and nxt[1] > run[1] and nxt[0] - run[1] - 1 <= L.MAX_GAP:
                    more = nxt[1] - nxt[0] + 1 - max(0, run[1] + 1 - nxt[0], end - nxt[3])
                    if more > 0:
                        best = max(best, extend(covered + more, nxt))
            return best

        want = max((extend(x[1] - x[0] + 1, x) for x in runs), default=0)
        assert max((c[0] for c in scanner.chains(runs)), default=0) == want


def test_repeated_and_overlapping_parts_are_chained():
    s = L.scanner()
    c = L.TEMPLATES["mit"][1].split()
    for words in (c[:9] + c[:4] + c[9:], c[:8] + c[5:], c[:5] + ["in", "between"] + c[5:]):
        out = s.file(" ".join(words))
        assert out[5] == "mit" and out[6] == 1.0
    assert s.file("this is licensed under the mit")[5] == ""


def test_licences_that_share_wording_are_told_apart():
    s = L.scanner()
    for label in ("bsd-2", "bsd-3", "gpl-2", "gpl-3", "lgpl", "agpl-3", "mit", "isc", "zlib", "apache-2", "cc-by", "cc-by-nc", "cc-by-sa"):
        for whole in L.TEMPLATES[label]:
            assert label in s.file("x " * 30 + whole + " y" * 30)[5].split(",")
            assert s.file(whole)[5].split(",") == [label], (label, whole)


def test_templates_are_found_with_gaps_and_clean_text_is_not():
    s = L.scanner()
    for label, clauses in L.TEMPLATES.items():
        for c in clauses:
            words = c.split()
            assert label in s.file(f"some words before {c} and after")[5].split(",")
            if len(words) > 10:
                assert label in s.file(" ".join([*words[:6], "inserted", *words[6:]]))[5].split(",")
    assert s.file("the software is provided to any person who wants a copy of this book")[5] == ""
    assert s.file("")[5:7] == ("", 0.0)


def test_spans_and_empty(spark, empty):
    docs = spark.createDataFrame([(1, "x " + L.TEMPLATES["mit"][1] + " y"), (2, None)], "doc_id long, text string")
    (row,) = L.spans(docs).collect()
    assert (row.doc_id, row.label, row.first_word, row.cover) == (1, "mit", 1, 1.0)
    assert L.scan(empty).collect() == []
