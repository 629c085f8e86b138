from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp int, label string"


def frame(spark, rows):
    """rows of (doc_id, text, lang, source); the further columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, 3, "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    r = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    same = say(60)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, same, "en", "b"), (5, same, "en", "b"), (5, same, "en", "b")]
    rows += [(6, say(30_000), "de", "a"), (None, say(40), "en", "b"), (None, None, None, None), (7, "x" * 200_000, "fr", "c"), (8, "Ünïcode ÀÉ 日本語 🙂 " * 40, "fr", "c")]
    rows += [(k, say(r.randint(1, 120)), r.choice(["en", "de"]), r.choice(["a", "b", "c", None])) for k in range(20, 140)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()
