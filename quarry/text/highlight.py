"""Highlighting: the words of a text whose stems are the query's get marks; optionally the best fragments only."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import porter
from .fts import query_terms

WORD = re.compile(r"[^\W_]+")


stem = lru_cache(1 << 16)(porter)


@lru_cache(64)
def _words(first: frozenset[str]) -> re.Pattern:
    """Whole words whose lower case starts with one of the letters."""
    own = "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if c.lower()[0] in first and WORD.match(c))
    return re.compile(rf"(?<![^\W_])[{own}][^\W_]*")


def hits_of(text: str, stems: frozenset[str]) -> list[re.Match]:
    """The words with one of the stems. A stemmer keeps a word's first letter, so words with another aren't stemmed."""
    first = frozenset(s[0] for s in stems if WORD.match(s))
    return [m for m in _words(first).finditer(text) if stem(m[0].lower()) in stems] if first else []


def highlight_text(text: str | None, stems: frozenset[str], start: str = "<b>", end: str = "</b>", max_fragments: int = 0, fragment_size: int = 150) -> str | None:
    if text is None:
        return None
    hits = hits_of(text, stems)

    def marked(lo: int, hi: int) -> str:
        out, at = [], lo
        for m in hits:
            if lo <= m.start() and m.end() <= hi:
                out += [text[at : m.start()], start, m[0], end]
                at = m.end()
        return "".join([*out, text[at:hi]])

    if max_fragments <= 0:
        return marked(0, len(text))
    if not hits:
        return text[:fragment_size]
    spans: list[list[int]] = []
    for m in hits:
        if spans and m.end() - spans[-1][0] <= fragment_size:
            spans[-1][2] += 1
            continue
        lo = max(0, m.start() - fragment_size // 4)
        spans.append([lo, min(len(text), lo + fragment_size), 1])
    best = sorted(sorted(spans, key=lambda s: (-s[2], s[0]))[:max_fragments])
    return " ... ".join(marked(lo, hi).strip() for lo, hi, _ in best)


def highlight(c: Column, query: str, start: str = "<b>", end: str = "</b>", max_fragments: int = 0, fragment_size: int = 150) -> Column:
    stems = frozenset(porter(t.lower()) for q in query_terms(query) for t in WORD.findall(q))

    @F.pandas_udf("string")
    def mark(s: pd.Series) -> pd.Series:
        return s.map(lambda t: highlight_text(t, stems, start, end, max_fragments, fragment_size))

    return mark(c)
