"""The @@ mini-language: terms, "phrases", field:scope, field:[vector], AND / OR / NOT and parentheses, as a DataFrame of scores.

A bare sequence of terms is an AND. Terms score by calibrated BM25; AND of text and vectors fuses by log odds, other ANDs intersect;
OR unites; NOT is the complement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import fusion, scored
from ..operators import vector as vec
from .index import Index

TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<field>[A-Za-z_]\w*):(?=["\[\w])|(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<vector>\[[^\]]*\])|(?P<word>[^\s()":\[\]]+))')


@dataclass
class Node:
    kind: str  # term, phrase, vector, and, or, not
    value: object = None
    field: str | None = None
    children: tuple[Node, ...] = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r} in {text!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "word" and value.upper() in ("AND", "OR", "NOT"):
            kind, value = value.lower(), value
        out.append((kind, value))
        at = m.end()
    return out


def parse(text: str) -> Node:
    own, at = tokens(text), 0

    def peek() -> str | None:
        return own[at][0] if at < len(own) else None

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "or":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", children=tuple(parts))

    def both() -> Node:
        nonlocal at
        parts = [one()]
        while peek() not in (None, "or", "close"):
            if peek() == "and":
                at += 1
            parts.append(one())
        return parts[0] if len(parts) == 1 else Node("and", children=tuple(parts))

    def one(field: str | None = None) -> Node:
        nonlocal at
        if at >= len(own):
            raise ValueError(f"{text!r} ends too early")
        kind, value = own[at]
        at += 1
        if kind == "not":
            return Node("not", children=(one(),))
        if kind == "open":
            inner = either()
            if peek() != "close":
                raise ValueError(f"a parenthesis isn't closed in {text!r}")
            at += 1
            return inner
        if kind == "field":
            return one(value)
        if kind == "phrase":
            return Node("phrase", value[1:-1].replace('\\"', '"'), field)
        if kind == "vector":
            return Node("vector", [float(x) for x in value[1:-1].split(",") if x.strip()], field)
        if kind == "word":
            return Node("term", value, field)
        raise ValueError(f"unexpected {value!r} in {text!r}")

    out = either()
    if at < len(own):
        raise ValueError(f"unexpected {own[at][1]!r} in {text!r}")
    return out


def query_terms(text: str) -> list[str]:
    """Terms and words of phrases that aren't negated, in order."""
    out: list[str] = []

    def walk(n: Node) -> None:
        if n.kind == "term":
            out.append(str(n.value))
        elif n.kind == "phrase":
            out.extend(str(n.value).split())
        elif n.kind != "not":
            for c in n.children:
                walk(c)

    walk(parse(text))
    return out


def asked(text: str, names: list[str], field: str = "_all") -> dict[str, list[str]]:
    """field -> the terms and phrases that are looked up in it; names: the fields that _all means."""
    out: dict[str, list[str]] = {}

    def walk(n: Node) -> None:
        if n.kind in ("term", "phrase"):
            own = n.field or field
            for f in names if own == "_all" else [own]:
                out.setdefault(f, []).append(str(n.value))
        for c in n.children:
            walk(c)

    walk(parse(text))
    return out


def search(index: Index, text: str, universe: DataFrame, field: str = "_all", vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
    """index fields are searched; _all means every one. universe: (doc_id). vectors: (doc_id, embedding) for vector literals."""

    def fields(name: str | None) -> list[str]:
        name = name or field
        return list(index.analyzers) if name == "_all" else [name]

    def build(n: Node) -> DataFrame:
        if n.kind == "vector":
            if vectors is None:
                raise ValueError("a vector needs a table of vectors")
            return vec.knn(vectors, n.value, k, calibrated=True)
        if n.kind == "term":
            own = fields(n.field)
            return index.bayesian(own[0], n.value) if len(own) == 1 else index.multi_field(n.value, dict.fromkeys(own, 1.0))
        if n.kind == "phrase":
            parts = []
            for f in fields(n.field):
                rated = index.bayesian(f, n.value)
                parts.append(scored.semi(rated, index.phrase(f, n.value)))
            return parts[0] if len(parts) == 1 else fusion.log_odds(parts)
        if n.kind == "not":
            return scored.complement(build(n.children[0]), universe)
        if n.kind == "or":
            return scored.union(*map(build, n.children))
        built = [(c, build(c)) for c in n.children]
        text_ = [d for c, d in built if c.kind != "vector"]
        near = [d for c, d in built if c.kind == "vector"]
        if near and text_:
            return fusion.log_odds([scored.intersect(*text_) if len(text_) > 1 else text_[0], *near])
        return scored.intersect(*[d for _, d in built])

    for f, queries in asked(text, list(index.analyzers), field).items():
        index.prepare(f, queries)
    return build(parse(text))
