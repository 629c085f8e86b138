"""Highlighting finds the words that stemming each word would, and stems few of them."""

from __future__ import annotations

import random

from quarry.text import highlight
from quarry.text.analysis import porter

TEXT = "Things, thinging THING thing_thing a1things Keeping keeps İssue I i is Σigma σigma don't 3rd ties ies sses eed ing ying Été 中文 s ss"


def test_hits_equal_those_of_every_word():
    rng = random.Random(3)
    made = [" ".join("".join(rng.choice("aeiouystinglde") for _ in range(rng.randint(1, 9))) for _ in range(400)) for _ in range(5)]
    for text in [TEXT, "", *made]:
        for w in {m[0].lower() for m in highlight.WORD.finditer(text)}:
            stems = frozenset([porter(w)])
            assert [m.span() for m in highlight.hits_of(text, stems)] == [m.span() for m in highlight.WORD.finditer(text) if porter(m[0].lower()) in stems]
    assert highlight.hits_of(TEXT, frozenset()) == [] and highlight.hits_of(TEXT, frozenset([""])) == []


def test_words_of_other_letters_are_not_stemmed_and_a_word_once():
    highlight.stem.cache_clear()
    text = "the things of other thinkers " * 1000
    assert highlight.highlight_text(text, frozenset(["thing"])).count("<b>things</b>") == 1000
    assert highlight.stem.cache_info().misses == 3
