"""Regular path queries: an expression becomes a deterministic automaton on the driver, and (vertex, state) pairs a frontier loop."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import settle
from .core import Graph

# label | a/b | a|b | e* | e{m,n} | (e)


@dataclass(frozen=True)
class Label:
    name: str


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Star:
    inner: object


@dataclass(frozen=True)
class Repeat:
    inner: object
    least: int
    most: int


def parse(text: str):
    toks = re.findall(r"\s*([A-Za-z_]\w*|[/|()*]|\{\s*\d+\s*(?:,\s*\d+\s*)?\})", text)
    if "".join(toks).replace(" ", "") != re.sub(r"\s", "", text):
        raise ValueError(f"no path expression: {text!r}")
    at = 0

    def peek():
        return toks[at] if at < len(toks) else None

    def either():
        nonlocal at
        parts = [concat()]
        while peek() == "|":
            at += 1
            parts.append(concat())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def concat():
        nonlocal at
        parts = [unary()]
        while peek() == "/":
            at += 1
            parts.append(unary())
        return parts[0] if len(parts) == 1 else Concat(tuple(parts))

    def unary():
        nonlocal at
        t = peek()
        if t is None or t in "/|)*":
            raise ValueError(f"unexpected {t!r} in {text!r}")
        at += 1
        if t == "(":
            e = either()
            if peek() != ")":
                raise ValueError(f"a parenthesis isn't closed in {text!r}")
            at += 1
        else:
            e = Label(t)
        while peek() and (peek() == "*" or peek()[0] == "{"):
            t = peek()
            at += 1
            if t == "*":
                e = Star(e)
            else:
                nums = [int(x) for x in re.findall(r"\d+", t)]
                if nums[-1] < nums[0]:
                    raise ValueError(f"{t} is no range")
                e = Repeat(e, nums[0], nums[-1])
        return e

    out = either()
    if at < len(toks):
        raise ValueError(f"unexpected {toks[at]!r} in {text!r}")
    return out


def simplify(e):
    """Flat concatenations and alternatives without repeats, stars of stars as one."""
    if isinstance(e, Concat):
        parts = [q for p in map(simplify, e.parts) for q in (p.parts if isinstance(p, Concat) else (p,))]
        return Concat(tuple(parts))
    if isinstance(e, Either):
        parts = list(dict.fromkeys(q for p in map(simplify, e.parts) for q in (p.parts if isinstance(p, Either) else (p,))))
        return parts[0] if len(parts) == 1 else Either(tuple(parts))
    if isinstance(e, Star):
        inner = simplify(e.inner)
        return inner if isinstance(inner, Star) else Star(inner)
    if isinstance(e, Repeat):
        return Repeat(simplify(e.inner), e.least, e.most)
    return e


@dataclass
class Automaton:
    """arcs: (state, label, state). State 0 starts."""

    arcs: list[tuple[int, str, int]]
    accept: frozenset[int]


def compile_path(text: str) -> Automaton:
    """Thompson's construction, then subset construction."""
    eps: dict[int, set[int]] = {}
    moves: list[tuple[int, str, int]] = []
    count = 0

    def new() -> int:
        nonlocal count
        count += 1
        return count - 1

    def link(a: int, b: int) -> None:
        eps.setdefault(a, set()).add(b)

    def build(e) -> tuple[int, int]:
        a, b = new(), new()
        if isinstance(e, Label):
            moves.append((a, e.name, b))
        elif isinstance(e, Concat):
            last = a
            for p in e.parts:
                x, y = build(p)
                link(last, x)
                last = y
            link(last, b)
        elif isinstance(e, Either):
            for p in e.parts:
                x, y = build(p)
                link(a, x)
                link(y, b)
        elif isinstance(e, Star):
            x, y = build(e.inner)
            link(a, x), link(y, x), link(y, b), link(a, b)
        else:
            last = a
            for k in range(e.most):
                if k >= e.least:
                    link(last, b)
                x, y = build(e.inner)
                link(last, x)
                last = y
            link(last, b)
        return a, b

    start, end = build(simplify(parse(text)))

    def closure(states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in eps.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    first = closure({start})
    number, todo, arcs = {first: 0}, [first], []
    while todo:
        s = todo.pop()
        for label in sorted({m for a, m, _ in moves if a in s}):
            to = closure({b for a, m, b in moves if a in s and m == label})
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs.append((number[s], label, number[to]))
    return Automaton(arcs, frozenset(k for s, k in number.items() if end in s))


def _product(g: Graph, a: Automaton) -> DataFrame:
    """(at, state, to, nxt, edge): the edges times the automaton's arcs, which are few and driver-made."""
    spark = g.edges.sparkSession
    arcs = spark.createDataFrame(a.arcs, "state int, label string, nxt int") if a.arcs else spark.createDataFrame([], "state int, label string, nxt int")
    return g.edges.join(F.broadcast(arcs), "label").select(F.col("src").alias("at"), "state", F.col("dst").alias("to"), "nxt", F.col("id").alias("edge"))


def rpq(g: Graph, text: str, start: int | None = None, limit: int = 1000) -> DataFrame:
    """(start_id, end_id): distinct ends of paths that spell a word of the expression; a start alone counts if the empty word does."""
    a = compile_path(text)
    steps = settle(_product(g, a).select("at", "state", "to", "nxt").distinct())
    spark = g.edges.sparkSession
    first = g.vertices.select("id").distinct() if start is None else spark.createDataFrame([(start,)], "id long")
    front = first.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("q"))
    seen = front
    for _ in range(limit):
        nxt = front.join(steps, (front["v"] == steps["at"]) & (front["q"] == steps["state"])).select("s", F.col("to").alias("v"), F.col("nxt").alias("q")).distinct()
        front = settle(nxt.join(seen, ["s", "v", "q"], "left_anti"))
        if front.isEmpty():
            break
        seen = settle(seen.unionAll(front))
    return seen.where(F.col("q").isin(list(a.accept))).select(F.col("s").alias("start_id"), F.col("v").alias("end_id")).distinct()


def weighted_rpq(g: Graph, text: str, start: int, prop: str, agg: str = "sum", threshold: float | None = None, limit: int = 1000) -> DataFrame:
    """(doc_id, score): the fold of a property along the first path, breadth first, to each (vertex, state); of ties the least edge. Missing weights are 1."""
    a = compile_path(text)
    spark = g.edges.sparkSession
    w = g.edges.select(F.col("id").alias("edge"), F.coalesce(F.try_element_at("props", F.lit(prop)).cast("double"), F.lit(1.0)).alias("w"))
    steps = settle(_product(g, a).join(w, "edge"))
    fold = {"sum": lambda x, y: x + y, "product": lambda x, y: x * y, "min": F.least, "max": F.greatest}[agg]
    unit = {"sum": 0.0, "product": 1.0, "min": float("inf"), "max": float("-inf")}[agg]
    front = spark.createDataFrame([(start, 0, unit)], "v long, q int, x double")
    seen = front
    order = W.partitionBy("v", "q").orderBy("edge", "from_v", "from_q")
    for _ in range(limit):
        grown = front.join(steps, (front["v"] == steps["at"]) & (front["q"] == steps["state"])).select(F.col("to").alias("v"), F.col("nxt").alias("q"), fold(F.col("x"), F.col("w")).alias("x"), "edge", front["v"].alias("from_v"), front["q"].alias("from_q"))
        one = grown.withColumn("k", F.row_number().over(order)).where("k = 1").select("v", "q", "x")
        front = settle(one.join(seen.select("v", "q"), ["v", "q"], "left_anti").select("v", "q", "x"))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    out = seen.where(F.col("q").isin(list(a.accept))).groupBy("v").agg(F.min(F.struct("q", "x")).alias("b")).select(F.col("v").alias("doc_id"), F.col("b.x").alias("score"))
    return out if threshold is None else out.where(F.col("score") >= threshold)


# --- patterns ----------------------------------------------------------------------------------------------------------------------


@dataclass
class V:
    """A pattern vertex: label, property constraints by equality, and further conditions on columns label and props."""

    label: str | None = None
    props: dict[str, str] | None = None
    where: str | None = None


@dataclass
class E:
    src: str
    dst: str
    label: str | None = None
    negated: bool = False
    where: str | None = None


def match(g: Graph, vertices: dict[str, V], edges: list[E], injective: bool = True, edge_filter=None) -> DataFrame:
    """One column of vertex ids a variable. Edges are joined in an order that keeps the pattern connected; negated ones are anti joins."""
    ids: dict[str, DataFrame] = {}
    for name, v in vertices.items():
        d = g.vertices
        if v.label:
            d = d.where(F.col("label") == v.label)
        for k, x in (v.props or {}).items():
            d = d.where(F.try_element_at("props", F.lit(k)) == str(x))
        if v.where:
            d = d.where(v.where)
        ids[name] = d.select(F.col("id").alias(name))
    own = g.edges if edge_filter is None else g.edges.where(edge_filter(g.edges))

    def pairs(e: E) -> DataFrame:
        d = own if not e.label else own.where(F.col("label") == e.label)
        d = d.where(e.where) if e.where else d
        return d.select(F.col("src").alias(e.src), F.col("dst").alias(e.dst)).distinct()

    out, bound, todo = None, set(), [e for e in edges if not e.negated]
    while todo:
        e = next((x for x in todo if {x.src, x.dst} & bound), todo[0]) if bound else todo[0]
        todo.remove(e)
        d = pairs(e)
        for end in (e.src, e.dst):
            if end not in bound:
                d = d.join(ids[end], end, "left_semi")
        shared = [x for x in dict.fromkeys((e.src, e.dst)) if x in bound]
        out = d if out is None else out.join(d, shared) if shared else out.crossJoin(d)
        bound |= {e.src, e.dst}
    for name in vertices:
        if name not in bound:
            out = ids[name] if out is None else out.crossJoin(ids[name])
            bound.add(name)
    if injective:
        names = list(vertices)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                out = out.where(F.col(a) != F.col(b))
    for e in edges:
        if e.negated:
            out = out.join(pairs(e), [e.src, e.dst], "left_anti")
    return out.select(*vertices)


def numbered(found: DataFrame) -> DataFrame:
    """Matches with doc_id, their number in the order of their bindings."""
    return found.withColumn("doc_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*found.columns)) - 1)


def connected(vertices: dict[str, V], edges: list[E]) -> bool:
    """Whether the pattern's positive edges join all its variables."""
    reached = {next(iter(vertices))}
    while more := {x for e in edges if not e.negated and {e.src, e.dst} & reached for x in (e.src, e.dst)} - reached:
        reached |= more
    return reached == set(vertices)


def incremental(g: Graph, cached: DataFrame, changed: DataFrame, vertices: dict[str, V], edges: list[E]) -> DataFrame:
    """cached matches of an older graph, brought up to g: those that touch changed vertices (id) are found anew, others stay."""
    touches = None
    for name in vertices:
        hit = cached.join(changed.select(F.col("id").alias(name)), name, "left_semi").select(*vertices)
        touches = hit if touches is None else touches.unionAll(hit)
    stay = cached.join(touches.distinct(), list(vertices), "left_anti")
    fresh = None
    # A new match holds a changed vertex, so the rest of it is within as many hops; a pattern in several parts needs the whole graph.
    own = g.subgraph(g.bfs(changed, max(1, len(vertices) - 1), direction="both").select("id")) if connected(vertices, edges) else g
    now = match(own, vertices, edges)
    for name in vertices:
        hit = now.join(changed.select(F.col("id").alias(name)), name, "left_semi").select(*vertices)
        fresh = hit if fresh is None else fresh.unionAll(hit)
    return stay.select(*vertices).unionAll(fresh.distinct())
