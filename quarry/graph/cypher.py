"""An openCypher subset compiled to DataFrames: bindings are rows, each clause a plan over the last one's rows.

``run(graph, text, params)`` gives the rows of RETURN (None without one) and the graph after CREATE, MERGE, SET, REMOVE and DELETE. A node
variable is a struct (id, label, props), a relationship variable (id, src, dst, label, props), one of variable length an array of
these. Relationships of one pattern differ; nodes may repeat. Properties are text: they compare and add as numbers where both sides
are numbers, and give text in RETURN. ``null = null`` is true, as is usual in this dialect; AND and OR are two-valued.

A hop is a join with the edges, a bound end an equality in it; unbounded lengths run until no path grows, each round settled. Nothing is
collected but whether a round found rows.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import settle
from .core import Graph

TOKEN = re.compile(r"\s+|//[^\n]*|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<par>\$\w+)|(?P<op><=|>=|<>|=~|\.\.|->|<-|\+=|[-+*/%^=<>()\[\]{},.:|])")
CLAUSES = ("MATCH", "OPTIONAL", "CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "RETURN", "WITH", "UNWIND", "CALL")
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
NODE = "struct<id: bigint, label: string, props: map<string,string>>"


class CypherError(ValueError):
    pass


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CypherError(f"can't read {text[at:at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


@dataclass
class NodeP:
    var: str | None
    labels: list[str]
    props: dict[str, tuple]


@dataclass
class RelP:
    var: str | None
    types: list[str]
    props: dict[str, tuple]
    direction: str = "both"
    span: tuple[int, int | None] | None = None


@dataclass
class PathP:
    nodes: list[NodeP]
    rels: list[RelP]


@dataclass
class Clause:
    kind: str
    paths: list[PathP] = field(default_factory=list)
    items: list = field(default_factory=list)
    where: tuple | None = None
    order: list = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None
    distinct: bool = False
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


class Parser:
    """Tokens to clauses; an expression is a tuple (kind, ...)."""

    def __init__(self, text: str):
        self.t, self.at = lex(text), 0

    def peek(self, *words: str) -> bool:
        if self.at + len(words) > len(self.t):
            return False
        return all(t[1].upper() == w and t[0] in ("name", "op") for t, w in zip(self.t[self.at :], words, strict=False))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"expected {word} at {' '.join(x for _, x in self.t[self.at:self.at + 5])!r}")

    def name(self) -> str:
        kind, x = self.t[self.at] if self.at < len(self.t) else ("", "")
        if kind != "name":
            raise CypherError(f"expected a name at {x!r}")
        self.at += 1
        return x.strip("`")

    def query(self) -> list[Clause]:
        out = []
        while self.at < len(self.t):
            out.append(self.clause())
        return out

    def many(self, one):
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def clause(self) -> Clause:
        if self.take("OPTIONAL", "MATCH") or self.take("MATCH"):
            c = Clause("OPTIONAL" if self.t[self.at - 2][1].upper() == "OPTIONAL" else "MATCH", paths=self.many(self.path))
            c.where = self.expr() if self.take("WHERE") else None
            return c
        if self.take("CREATE"):
            return Clause("CREATE", paths=self.many(self.path))
        if self.take("MERGE"):
            c = Clause("MERGE", paths=[self.path()])
            while self.take("ON"):
                made = self.take("CREATE") or not self.take("MATCH")
                self.need("SET")
                (c.on_create if made else c.on_match).extend(self.many(self.set_item))
            return c
        if self.take("SET"):
            return Clause("SET", items=self.many(self.set_item))
        if self.take("REMOVE"):
            return Clause("REMOVE", items=self.many(self.set_target))
        if self.take("DETACH", "DELETE") or self.take("DELETE"):
            return Clause("DETACH" if self.t[self.at - 2][1].upper() == "DETACH" else "DELETE", items=self.many(self.name))
        if self.take("UNWIND"):
            e = self.expr()
            self.need("AS")
            return Clause("UNWIND", items=[(e, self.name())])
        if self.take("RETURN") or self.take("WITH"):
            c = Clause(self.t[self.at - 1][1].upper())
            c.distinct = self.take("DISTINCT")
            c.items = [("*", None)] if self.take("*") else self.many(self.item)
            if self.take("ORDER", "BY"):
                c.order = self.many(lambda: (self.expr(), self.take("DESC") or self.take("DESCENDING") or (self.take("ASC") or self.take("ASCENDING")) and False))
            c.skip = self.expr() if self.take("SKIP") else None
            c.limit = self.expr() if self.take("LIMIT") else None
            c.where = self.expr() if c.kind == "WITH" and self.take("WHERE") else None
            return c
        if self.take("CALL"):
            while self.at < len(self.t) and not any(self.peek(w) for w in CLAUSES):
                self.at += 1
            return Clause("CALL")
        raise CypherError(f"no clause at {self.t[self.at][1]!r}")

    def item(self):
        start = self.at
        e = self.expr()
        text = "".join(x if x != "," else ", " for _, x in self.t[start : self.at])
        return e, self.name() if self.take("AS") else e[1] if e[0] == "var" else text

    def set_target(self):
        v = self.name()
        if self.take("."):
            return v, "prop", self.name()
        self.need(":")
        return v, "label", self.name()

    def set_item(self):
        v = self.name()
        if self.take("."):
            k = self.name()
            self.need("=")
            return v, "prop", k, self.expr()
        if self.take(":"):
            return v, "label", self.name(), None
        how = "add" if self.take("+=") else "all"
        if how == "all":
            self.need("=")
        return v, how, None, self.expr()

    def path(self) -> PathP:
        if self.at + 1 < len(self.t) and self.t[self.at][0] == "name" and self.t[self.at + 1][1] == "=":
            self.at += 2  # a path's own name isn't used
        nodes, rels = [self.node()], []
        while self.peek("-") or self.peek("<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return PathP(nodes, rels)

    def props(self) -> dict[str, tuple]:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                k = self.name()
                self.need(":")
                out[k] = self.expr()
                self.take(",")
        return out

    def node(self) -> NodeP:
        self.need("(")
        var = self.name() if self.t[self.at][0] == "name" else None
        labels = []
        while self.take(":") or self.take("|"):
            labels.append(self.name())
        p = self.props()
        self.need(")")
        return NodeP(var, labels, p)

    def rel(self) -> RelP:
        left = self.take("<-")
        if not left:
            self.need("-")
        r = RelP(None, [], {})
        if self.take("["):
            if self.t[self.at][0] == "name":
                r.var = self.name()
            if self.take(":"):
                r.types.append(self.name())
                while self.take("|"):
                    self.take(":")
                    r.types.append(self.name())
            if self.take("*"):
                lo = int(self.t[self.at][1]) if self.t[self.at][0] == "num" else None
                self.at += lo is not None
                hi = lo
                if self.take(".."):
                    hi = int(self.t[self.at][1]) if self.t[self.at][0] == "num" else None
                    self.at += hi is not None
                elif lo is None:
                    hi = None
                r.span = (1 if lo is None else lo, hi)
            r.props = self.props()
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        r.direction = "in" if left and not right else "out" if right and not left else "both"
        return r

    # expressions, loosest first

    def expr(self):
        return self.binary(0)

    LEVELS = (("OR",), ("XOR",), ("AND",))

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.negation()
        a = self.binary(level + 1)
        while any(self.peek(w) for w in self.LEVELS[level]):
            op = self.t[self.at][1].upper()
            self.at += 1
            a = ("op", op, a, self.binary(level + 1))
        return a

    def negation(self):
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self):
        a = self.sum()
        while True:
            for op in ("<=", ">=", "<>", "=~", "=", "<", ">", "IN", "CONTAINS"):
                if self.take(op):
                    a = ("op", op, a, self.sum())
                    break
            else:
                if self.take("STARTS", "WITH"):
                    a = ("op", "STARTS", a, self.sum())
                elif self.take("ENDS", "WITH"):
                    a = ("op", "ENDS", a, self.sum())
                elif self.take("IS", "NOT", "NULL"):
                    a = ("not", ("null", a))
                elif self.take("IS", "NULL"):
                    a = ("null", a)
                else:
                    return a

    def sum(self):
        a = self.product()
        while self.peek("+") or self.peek("-"):
            op = self.t[self.at][1]
            self.at += 1
            a = ("op", op, a, self.product())
        return a

    def product(self):
        a = self.unary()
        while any(self.peek(x) for x in "*/%^"):
            op = self.t[self.at][1]
            self.at += 1
            a = ("op", op, a, self.unary())
        return a

    def unary(self):
        if self.take("-"):
            return ("op", "-", ("lit", 0), self.unary())
        return self.postfix(self.atom())

    def postfix(self, a):
        while True:
            if self.take("."):
                a = ("prop", a, self.name())
            elif self.take("["):
                a = ("index", a, self.expr())
                self.need("]")
            else:
                return a

    def atom(self):
        kind, x = self.t[self.at]
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", r"\1", x[1:-1]))
        if kind == "num":
            self.at += 1
            return ("lit", float(x) if "." in x or "e" in x.lower() else int(x))
        if kind == "par":
            self.at += 1
            return ("param", x[1:])
        if self.take("("):
            if self.is_pattern():
                self.at -= 1
                return ("exists", self.path())
            e = self.expr()
            self.need(")")
            return e
        if self.take("["):
            items = [] if self.peek("]") else self.many(self.expr)
            self.need("]")
            return ("list", items)
        if self.peek("{"):
            return ("map", self.props())
        if self.take("CASE"):
            subject = None if self.peek("WHEN") else self.expr()
            whens, other = [], ("lit", None)
            while self.take("WHEN"):
                c = self.expr()
                self.need("THEN")
                whens.append((("op", "=", subject, c) if subject else c, self.expr()))
            if self.take("ELSE"):
                other = self.expr()
            self.need("END")
            return ("case", whens, other)
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return ("lit", value)
        name = self.name()
        if self.take("("):
            if name.lower() == "exists" and self.peek("("):
                p = self.path()
                self.need(")")
                return ("exists", p)
            if self.take("*"):
                self.need(")")
                return ("call", name.lower(), False, [])
            distinct = self.take("DISTINCT")
            args = [] if self.peek(")") else self.many(self.expr)
            self.need(")")
            return ("call", name.lower(), distinct, args)
        return ("var", name)

    def is_pattern(self) -> bool:
        """Whether the parenthesis just opened is a node that a relationship follows."""
        depth, k = 1, self.at
        while k < len(self.t) and depth:
            depth += {"(": 1, ")": -1}.get(self.t[k][1], 0)
            k += 1
        after = [x for _, x in self.t[k : k + 2]]
        return after[:1] == ["<-"] or after[:2] == ["-", "["] or after[:2] == ["-", "("] or after[:1] == ["->"]


#: A compiled expression: its column, and what it is: int, num, str, bool, any (a property's text), list, map, node, rel, null.
Typed = tuple[Column, str]


class Compiler:
    def __init__(self, g: Graph, params: dict):
        self.g, self.params, self.spark = g, params, g.vertices.sparkSession
        self.rows: DataFrame | None = None
        self.kinds: dict[str, str] = {}
        self.out: DataFrame | None = None
        self.serial = 0

    # --- expressions

    def value(self, e: tuple) -> Typed:
        return getattr(self, f"_{e[0]}")(*e[1:])

    def _lit(self, v) -> Typed:
        if isinstance(v, list | tuple):
            return self._list([("lit", x) for x in v])
        if isinstance(v, dict):
            return self._map({k: ("lit", x) for k, x in v.items()})
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "num" if isinstance(v, float) else "str"
        return (F.lit(v).cast("bigint") if kind == "int" else F.lit(v)), kind

    def _param(self, name: str) -> Typed:
        if name not in self.params:
            raise CypherError(f"no parameter ${name}")
        return self._lit(self.params[name])

    def _var(self, name: str) -> Typed:
        if name not in self.kinds:
            raise CypherError(f"{name} isn't bound")
        return F.col(f"`{name}`"), self.kinds[name]

    def _prop(self, a: tuple, key: str) -> Typed:
        c, kind = self.value(a)
        if kind in ("node", "rel"):
            return c["props"][key], "any"
        return c[key], "any"

    def _index(self, a: tuple, k: tuple) -> Typed:
        c, kind = self.value(a)
        i = self.value(k)[0].cast("int")
        if kind == "map" or kind in ("node", "rel"):
            return (c["props"] if kind != "map" else c)[self.value(k)[0]], "any"
        return F.get(c, F.when(i < 0, F.size(c) + i).otherwise(i)), self.inner(kind)

    @staticmethod
    def inner(kind: str) -> str:
        return kind.partition(":")[2] or "any"

    def _list(self, items: list) -> Typed:
        vs = [self.value(x) for x in items]
        kinds = {k for _, k in vs if k != "null"}
        kind = kinds.pop() if len(kinds) == 1 else "num" if kinds and kinds <= {"int", "num"} else "any"
        cast = {"int": "bigint", "num": "double", "str": "string", "any": "string", "bool": "boolean"}.get(kind)
        return (F.array(*[c.cast(cast) if cast else c for c, _ in vs]) if vs else F.array().cast("array<string>")), f"list:{kind}"

    def _map(self, items: dict) -> Typed:
        parts = [x for k, e in items.items() for x in (F.lit(k), self.value(e)[0].cast("string"))]
        return F.create_map(*parts).cast("map<string,string>"), "map"

    def _not(self, a: tuple) -> Typed:
        return ~F.coalesce(self.value(a)[0].cast("boolean"), F.lit(False)), "bool"

    def _null(self, a: tuple) -> Typed:
        return self.value(a)[0].isNull(), "bool"

    def _case(self, whens: list, other: tuple) -> Typed:
        vs = [self.value(v) for _, v in whens] + [self.value(other)]
        kinds = {k for _, k in vs if k != "null"}
        kind = kinds.pop() if len(kinds) == 1 else "num" if kinds and kinds <= {"int", "num"} else "any"
        cast = {"num": "double", "any": "string"}.get(kind)
        out = None
        for (c, _), (v, _) in zip(whens, vs, strict=False):
            v = v.cast(cast) if cast else v
            hit = F.coalesce(self.value(c)[0].cast("boolean"), F.lit(False))
            out = F.when(hit, v) if out is None else out.when(hit, v)
        last = vs[-1][0]
        return out.otherwise(last.cast(cast) if cast else last), kind

    def number(self, v: Typed) -> Column:
        return v[0] if v[1] in ("int", "num") else v[0].try_cast("double")

    def pair(self, a: Typed, b: Typed, compare) -> Column:
        """By numbers where both are, else as text."""
        if "bool" in (a[1], b[1]) or a[1] in ("node", "rel"):
            return compare(a[0] if a[1] not in ("node", "rel") else a[0]["id"], b[0].cast("boolean") if b[1] in ("str", "any") else b[0] if b[1] not in ("node", "rel") else b[0]["id"])
        if a[1].startswith("list"):
            return compare(a[0], b[0])
        if a[1] in ("int", "num") and b[1] in ("int", "num"):
            return compare(a[0], b[0])
        if a[1] == "str" or b[1] == "str":
            return compare(a[0].cast("string"), b[0].cast("string"))
        x, y = self.number(a), self.number(b)
        return F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(compare(a[0].cast("string"), b[0].cast("string")))

    def _op(self, op: str, left: tuple, right: tuple) -> Typed:
        a, b = self.value(left), self.value(right)
        truth = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
        if op in ("AND", "OR", "XOR"):
            x, y = truth(a[0]), truth(b[0])
            return {"AND": x & y, "OR": x | y, "XOR": x != y}[op], "bool"
        if op == "=":
            return self.pair(a, b, lambda x, y: x.eqNullSafe(y)), "bool"
        if op == "<>":
            return ~self.pair(a, b, lambda x, y: x.eqNullSafe(y)), "bool"
        if op in ("<", ">", "<=", ">="):
            return truth(self.pair(a, b, {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op])), "bool"
        if op == "IN":
            inner = self.inner(b[1])
            if inner in ("int", "num") and a[1] not in ("int", "num"):
                return F.coalesce(F.array_contains(b[0].cast("array<double>"), self.number(a)), F.lit(False)), "bool"
            kind = "double" if inner in ("int", "num") else "string"
            return F.coalesce(F.array_contains(b[0].cast(f"array<{kind}>"), a[0].cast(kind)), F.lit(False)), "bool"
        if op in ("CONTAINS", "STARTS", "ENDS", "=~"):
            x, y = a[0].cast("string"), b[0].cast("string")
            return truth({"CONTAINS": F.contains, "STARTS": F.startswith, "ENDS": F.endswith, "=~": lambda p, q: F.regexp_like(p, F.concat(F.lit("^(?:"), q, F.lit(")$")))}[op](x, y)), "bool"
        if op == "+":
            if a[1].startswith("list") or b[1].startswith("list"):
                return F.concat(a[0] if a[1].startswith("list") else F.array(a[0]), b[0] if b[1].startswith("list") else F.array(b[0])), a[1] if a[1].startswith("list") else b[1]
            if "str" in (a[1], b[1]):
                return F.concat(a[0].cast("string"), b[0].cast("string")), "str"
            if a[1] == b[1] == "any":
                x, y = self.number(a), self.number(b)
                return F.when(x.isNotNull() & y.isNotNull(), plain(x + y)).otherwise(F.concat(a[0], b[0])), "any"
        x, y = self.number(a), self.number(b)
        whole = a[1] == b[1] == "int"
        if op == "/":
            out = x / F.nullif(y, F.lit(0))
            return (out.cast("bigint"), "int") if whole else (out, "num")
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % F.nullif(y, F.lit(0)), "^": lambda: F.pow(x, y)}[op]()
        return out, "int" if whole and op != "^" else "num"

    def _exists(self, path: PathP) -> Typed:
        raise CypherError("a pattern stands for a condition only at the top of WHERE")

    def _call(self, name: str, distinct: bool, args: list) -> Typed:
        if name in AGGREGATES:
            return self.aggregate(name, distinct, args)
        vs = [self.value(a) for a in args]
        c, kind = vs[0] if vs else (None, "")
        text = lambda k=0: vs[k][0].cast("string")
        at = lambda k: vs[k][0].cast("int")
        if name == "id":
            return c["id"], "int"
        if name in ("type", "label"):
            return c["label"], "str"
        if name == "labels":
            return F.array(c["label"]), "list:str"
        if name == "properties":
            return c["props"], "map"
        if name == "keys":
            return F.array_sort(F.map_keys(c if kind == "map" else c["props"])), "list:str"
        if name in ("startnode", "endnode"):
            return c["src" if name == "startnode" else "dst"], "int"
        if name == "tostring":
            return text(), "str"
        if name == "tointeger":
            return c.try_cast("double").cast("bigint") if kind != "int" else c, "int"
        if name == "tofloat":
            return c.try_cast("double"), "num"
        if name in ("size", "length"):
            return (F.size(c) if kind.startswith("list") else F.char_length(text())).cast("bigint"), "int"
        if name in ("head", "last"):
            return F.try_element_at(c, F.lit(1 if name == "head" else -1)), self.inner(kind)
        if name == "tail":
            return F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), kind
        if name == "reverse":
            return F.reverse(c if kind.startswith("list") else text()), kind if kind.startswith("list") else "str"
        if name == "range":
            return F.sequence(*[v[0].cast("bigint") for v in vs]), "list:int"
        if name == "abs":
            return F.abs(self.number(vs[0])), "int" if kind == "int" else "num"
        if name in ("ceil", "floor", "round", "sqrt", "sign"):
            return getattr(F, name)(self.number(vs[0])).cast("double"), "num"
        if name == "coalesce":
            kinds = {k for _, k in vs if k != "null"}
            return F.coalesce(*[v if len(kinds) == 1 else v.cast("string") for v, _ in vs]), kinds.pop() if len(kinds) == 1 else "any"
        if name in ("tolower", "toupper"):
            return (F.lower if name == "tolower" else F.upper)(text()), "str"
        if name in ("trim", "ltrim", "rtrim"):
            return getattr(F, name)(text()), "str"
        if name == "replace":
            return F.replace(text(), text(1), text(2)), "str"
        if name == "substring":
            return (F.substring(text(), at(1) + 1, at(2)) if len(vs) > 2 else F.substr(text(), at(1) + 1)), "str"
        if name == "split":
            return F.split(text(), F.concat(F.lit("\\Q"), text(1), F.lit("\\E"))), "list:str"
        if name == "exists":
            return c.isNotNull(), "bool"
        raise CypherError(f"unknown function {name}")

    def aggregate(self, name: str, distinct: bool, args: list) -> Typed:
        if not args:
            return F.count("*"), "int"
        c, kind = self.value(args[0])
        if name == "count":
            c = c["id"] if kind in ("node", "rel") else c
            return (F.count_distinct(c) if distinct else F.count(c)), "int"
        if name == "collect":
            return F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)) if kind not in ("node", "rel", "map") else F.collect_list(c), f"list:{kind}"
        if name in ("sum", "avg"):
            n = self.number((c, kind))
            out = F.sum_distinct(n) if distinct and name == "sum" else F.sum(n) if name == "sum" else F.avg(n)
            return (F.coalesce(out, F.lit(0).cast("bigint" if kind == "int" else "double")), kind if kind == "int" else "num") if name == "sum" else (out, "num")
        if kind == "any":
            n = self.number((c, kind))
            pick = F.min_by if name == "min" else F.max_by
            return pick(c, F.struct(n, c)), "any"
        return (F.min if name == "min" else F.max)(c), kind

    # --- matching

    def start(self) -> DataFrame:
        if self.rows is None:
            self.rows = self.spark.range(1).select(F.lit(0).alias("_one"))
        return self.rows

    def fresh(self, what: str) -> str:
        self.serial += 1
        return f"_{what}{self.serial}"

    def fits(self, c: Column, labels: list[str], props: dict) -> Column:
        ok = c["label"].isin(labels) if labels else F.lit(True)
        for k, e in props.items():
            ok = ok & F.coalesce(self.pair((c["props"][k], "any"), self.value(e), lambda x, y: x == y), F.lit(False))
        return ok

    def node(self, rows: DataFrame, n: NodeP, on: Column | None) -> tuple[DataFrame, str]:
        """rows with the node bound: joined by the column that holds its id, or each vertex where there is none."""
        if n.var and n.var in self.kinds:
            c = F.col(f"`{n.var}`")
            ok = self.fits(c, n.labels, n.props) & c.isNotNull()
            return rows.where(ok if on is None else ok & (c["id"] == on)), n.var
        name = n.var or self.fresh("n")
        v = self.g.vertices.where(F.col("label").isin(n.labels)) if n.labels else self.g.vertices
        side = v.select(F.struct("id", "label", "props").alias(name), F.col("id").alias("_vid"))
        out = (rows.crossJoin(side) if on is None else rows.join(side, on == F.col("_vid"))).drop("_vid")
        self.kinds[name] = "node"
        return out.where(self.fits(F.col(f"`{name}`"), [], n.props)), name

    def edges(self, r: RelP) -> DataFrame:
        """(_from, _to, _e) in the direction to walk."""
        e = self.g.edges.where(F.col("label").isin(r.types)) if r.types else self.g.edges
        one = F.struct("id", "src", "dst", "label", "props").alias("_e")
        out, back = e.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), one), e.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), one)
        return out if r.direction == "out" else back if r.direction == "in" else out.unionByName(back.where("_from != _to"))

    def path(self, rows: DataFrame, p: PathP, used: list[str]) -> DataFrame:
        rows, at = self.node(rows, p.nodes[0], None)
        for r, n in zip(p.rels, p.nodes[1:], strict=True):
            e, name = self.edges(r), r.var or self.fresh("r")
            here = F.col(f"`{at}`")["id"]
            if r.span is None:
                rows = rows.join(e, here == F.col("_from")).where(self.fits(F.col("_e"), [], r.props))
                for u in used:
                    rows = rows.where(F.col("_e")["id"] != F.col(f"`{u}`")["id"] if self.kinds[u] == "rel" else ~F.exists(F.col(f"`{u}`"), lambda x: x["id"] == F.col("_e")["id"]))
                if name in self.kinds:
                    rows = rows.where(F.col("_e")["id"] == F.col(f"`{name}`")["id"]).drop("_e")
                else:
                    rows = rows.withColumnRenamed("_e", name)
                rows, self.kinds[name] = rows.drop("_from"), "rel"
            else:
                rows, self.kinds[name] = self.spread(rows, here, e, r, name), "list:rel"
            used.append(name)
            rows, at = self.node(rows, n, F.col("_to"))
            rows = rows.drop("_to")
        return rows

    def spread(self, rows: DataFrame, here: Column, e: DataFrame, r: RelP, name: str) -> DataFrame:
        """Paths of several hops, no edge twice; each round joins the ends of the last one's paths."""
        lo, hi = r.span
        none = F.array().cast("array<struct<id: bigint, src: bigint, dst: bigint, label: string, props: map<string,string>>>")
        now = rows.withColumn(name, none).withColumn("_to", here)
        out, k = (now if lo == 0 else None), 0
        while hi is None or k < hi:
            k += 1
            step = now.withColumnRenamed("_to", "_last").join(e, F.col("_last") == F.col("_from")).where(self.fits(F.col("_e"), [], r.props))
            step = step.where(~F.exists(F.col(name), lambda x: x["id"] == F.col("_e")["id"]))
            now = step.withColumn(name, F.concat(F.col(name), F.array("_e"))).drop("_last", "_from", "_e")
            if hi is None or k % 4 == 0:
                now = settle(now)
                if now.isEmpty():
                    break
            if k >= lo:
                out = now if out is None else out.unionByName(now)
        return out if out is not None else now.limit(0)

    def matched(self, rows: DataFrame, paths: list[PathP], where: tuple | None) -> DataFrame:
        used: list[str] = []
        for p in paths:
            rows = self.path(rows, p, used)
        return self.filtered(rows, where) if where else rows

    def filtered(self, rows: DataFrame, where: tuple) -> DataFrame:
        """Conditions joined by AND one after the other; a pattern among them is a semi or anti join."""
        if where[0] == "op" and where[1] == "AND":
            return self.filtered(self.filtered(rows, where[2]), where[3])
        negated = where[0] == "not"
        inner = where[1] if negated else where
        if inner[0] == "exists":
            key = self.fresh("row")
            held = settle(rows.withColumn(key, F.monotonically_increasing_id()))
            kinds = dict(self.kinds)
            found = self.matched(held, [inner[1]], None).select(key).distinct()
            self.kinds = kinds
            return held.join(found, key, "left_anti" if negated else "left_semi").drop(key)
        return rows.where(F.coalesce(self.value(where)[0].cast("boolean"), F.lit(False)))

    # --- clauses

    def run(self, clauses: list[Clause]) -> None:
        for c in clauses:
            getattr(self, f"do_{c.kind.lower()}")(c)

    def do_match(self, c: Clause) -> None:
        self.rows = self.matched(self.start(), c.paths, c.where)

    def do_optional(self, c: Clause) -> None:
        key, before = self.fresh("row"), set(self.kinds)
        held = settle(self.start().withColumn(key, F.monotonically_increasing_id()))
        found = self.matched(held, c.paths, c.where)
        new = [n for n in self.kinds if n not in before]
        self.rows = held.join(found.select(key, *[f"`{n}`" for n in new]), key, "left").drop(key)

    def do_unwind(self, c: Clause) -> None:
        e, name = c.items[0]
        v, kind = self.value(e)
        self.rows = self.start().withColumn(name, F.explode(v))
        self.kinds[name] = self.inner(kind)

    def aggregates(self, e) -> bool:
        if isinstance(e, tuple):
            return e[:1] == ("call",) and e[1] in AGGREGATES or any(self.aggregates(x) for x in e[1:])
        return isinstance(e, list) and any(self.aggregates(x) for x in e)

    def project(self, c: Clause) -> DataFrame:
        rows = self.start()
        items = [(("var", n), n) for n in self.kinds if not n.startswith("_")] if c.items == [("*", None)] else c.items
        typed = {alias: self.value(e) for e, alias in items}
        grouped = any(self.aggregates(e) for e, _ in items)
        if grouped:
            keys = {a: typed[a][0] for e, a in items if not self.aggregates(e)}
            # A map can't be a key: nodes and relationships are grouped by their ids and looked up by the first.
            plain = {a: (k["id"] if typed[a][1] in ("node", "rel") else k) for a, k in keys.items()}
            held = [F.first(keys[a]).alias(f"_first_{a}") for a in keys if typed[a][1] in ("node", "rel")]
            out = rows.groupBy(*[k.alias(f"_key_{a}") for a, k in plain.items()]).agg(*[typed[a][0].alias(a) for e, a in items if self.aggregates(e)], *held)
            out = out.select(*[F.col(f"`{a}`") if a not in keys else (F.col(f"`_first_{a}`") if typed[a][1] in ("node", "rel") else F.col(f"`_key_{a}`")).alias(a) for _, a in items])
        else:
            out = rows.select(*[typed[a][0].alias(a) for _, a in items], *([] if c.distinct else [F.col(f"`{n}`").alias(f"_was_{n}") for n in self.kinds]))
        before = dict(self.kinds)
        after = {a: k for a, (_, k) in typed.items()}
        if c.distinct:
            flat = [F.col(f"`{a}`")["id"] if after[a] in ("node", "rel") else F.col(f"`{a}`") for a in after]
            out = out.withColumns({f"_d{k}": x for k, x in enumerate(flat)}).dropDuplicates([f"_d{k}" for k in range(len(flat))]).drop(*[f"_d{k}" for k in range(len(flat))])
        if c.order:
            scope = dict(after)
            if not grouped and not c.distinct:  # what stood before may order the rows, too
                for n, k in before.items():
                    if n not in scope:
                        scope[n] = k
                        out = out.withColumn(n, F.col(f"`_was_{n}`"))
            self.kinds = scope
            keys = []
            for e, down in c.order:
                alias = next((a for x, a in items if x == e), None)
                v, kind = (F.col(f"`{alias}`"), after[alias]) if alias else self.value(e)
                for k in [self.number((v, kind)), v] if kind == "any" else [v["id"] if kind in ("node", "rel") else v]:
                    keys.append(k.desc_nulls_first() if down else k.asc_nulls_last())
            out = out.orderBy(*keys)
        if c.skip:
            out = out.offset(int(self.constant(c.skip)))
        if c.limit:
            out = out.limit(int(self.constant(c.limit)))
        self.kinds = after
        return out.select(*[F.col(f"`{a}`") for a in after])

    def constant(self, e: tuple):
        return self.params[e[1]] if e[0] == "param" else e[1]

    def do_with(self, c: Clause) -> None:
        self.rows = self.project(c)
        if c.where:
            self.rows = self.filtered(self.rows, c.where)

    def do_return(self, c: Clause) -> None:
        self.out = self.project(c)

    def do_call(self, c: Clause) -> None:
        """Procedures have no effect."""

    def make(self, rows: DataFrame, p: PathP) -> DataFrame:
        """Vertices and edges of a path, one a row, with numbers after the largest; rows with the new variables bound."""
        top = self.g.vertices.agg(F.max("id")).first()[0], self.g.edges.agg(F.max("id")).first()[0]
        text = lambda props: F.create_map(*[x for k, e in props.items() for x in (F.lit(k), self.value(e)[0].cast("string"))]).cast("map<string,string>")
        new_nodes, new_edges, names = [], [], []
        key = self.fresh("k")
        rows = settle(rows.withColumn(key, F.monotonically_increasing_id()))
        number = lambda base, k, n: F.lit((base or 0) + 1 + k) + F.col(key) * n
        made = [n for n in p.nodes if not (n.var and n.var in self.kinds)]
        for n in p.nodes:
            if n.var and n.var in self.kinds:
                names.append(n.var)
                continue
            name = n.var or self.fresh("n")
            rows = rows.withColumn(name, F.struct(number(top[0], len(new_nodes), len(made)).alias("id"), F.lit(n.labels[0] if n.labels else "").alias("label"), text(n.props).alias("props")))
            self.kinds[name] = "node"
            new_nodes.append(name)
            names.append(name)
        for k, r in enumerate(p.rels):
            a, b = (names[k + 1], names[k]) if r.direction == "in" else (names[k], names[k + 1])
            name = r.var or self.fresh("r")
            rows = rows.withColumn(name, F.struct(number(top[1], k, len(p.rels)).alias("id"), F.col(f"`{a}`")["id"].alias("src"), F.col(f"`{b}`")["id"].alias("dst"), F.lit(r.types[0] if r.types else "").alias("label"), text(r.props).alias("props")))
            self.kinds[name] = "rel"
            new_edges.append(name)
        rows = settle(rows.drop(key))
        v, e = self.g.vertices, self.g.edges
        for name in new_nodes:
            v = v.unionByName(rows.select(F.lit(self.g.name).alias("graph"), f"`{name}`.*"))
        for name in new_edges:
            e = e.unionByName(rows.select(F.lit(self.g.name).alias("graph"), f"`{name}`.*"))
        self.g = Graph.of(settle(v), settle(e), self.g.name)
        return rows

    def do_create(self, c: Clause) -> None:
        rows = self.start()
        for p in c.paths:
            rows = self.make(rows, p)
        self.rows = rows

    def do_merge(self, c: Clause) -> None:
        key = self.fresh("row")
        held = settle(self.start().withColumn(key, F.monotonically_increasing_id()))
        before = dict(self.kinds)
        found = settle(self.matched(held, c.paths, None))
        matched_kinds = dict(self.kinds)
        missing = held.join(found.select(key).distinct(), key, "left_anti")
        self.kinds = dict(before)
        p = c.paths[0]
        # Rows that would make the same path make it once.
        same = [F.col(f"`{n.var}`")["id"] for n in p.nodes if n.var in before] + [self.value(e)[0].cast("string") for x in [*p.nodes, *p.rels] for e in x.props.values()]
        one = missing.withColumns({f"_same{k}": x for k, x in enumerate(same)}).withColumn("_same", F.lit(0))
        reps = one.dropDuplicates(["_same", *[f"_same{k}" for k in range(len(same))]]).select(*missing.columns)
        made = self.make(reps, p) if not missing.isEmpty() else None
        names = [n for n in matched_kinds if not n.startswith("_")]
        if made is not None:
            if c.on_create:
                self.rows = made
                self.do_set(Clause("SET", items=c.on_create))
            self.kinds = dict(before)
            again = settle(self.matched(held, c.paths, None))
            self.kinds = matched_kinds
            self.rows = again.drop(key)
            if c.on_match and not found.isEmpty():
                self.rows = again.join(found.select(key).distinct(), key, "left_semi").drop(key)
                self.do_set(Clause("SET", items=c.on_match))
                self.kinds = dict(before)
                self.rows = self.matched(held, c.paths, None).drop(key)
        else:
            self.kinds = matched_kinds
            self.rows = found.drop(key)
            if c.on_match:
                self.do_set(Clause("SET", items=c.on_match))
        self.kinds = {n: k for n, k in matched_kinds.items() if n in names or n in self.rows.columns}

    def do_set(self, c: Clause) -> None:
        for var, how, key, e in c.items:
            kind = self.kinds[var]
            node = F.col(f"`{var}`")
            rows = self.start()
            if how == "prop":
                v = self.value(e)[0].cast("string")
                props = F.when(v.isNull(), without(node["props"], key)).otherwise(F.map_concat(without(node["props"], key), F.create_map(F.lit(key), v)))
            elif how in ("add", "all"):
                m = self.value(e)[0] if self.value(e)[1] == "map" else self.value(e)[0]["props"]
                props = m if how == "all" else merged(node["props"], m)
            else:
                props = node["props"]
            self.write(rows, var, kind, F.lit(key) if how == "label" else node["label"], props)

    def write(self, rows: DataFrame, var: str, kind: str, label: Column, props: Column) -> None:
        """The variable's elements changed, in the graph and in the rows."""
        node = F.col(f"`{var}`")
        changed = settle(rows.where(node.isNotNull()).select(node["id"].alias("_id"), label.alias("_label"), props.alias("_props")).groupBy("_id").agg(F.first("_label").alias("_label"), F.first("_props").alias("_props")))
        df = self.g.vertices if kind == "node" else self.g.edges
        new = df.join(changed, F.col("id") == F.col("_id"), "left")
        hit = F.col("_id").isNotNull()
        new = settle(new.withColumns({"label": F.when(hit, F.col("_label")).otherwise(F.col("label")), "props": F.when(hit, F.col("_props")).otherwise(F.col("props"))}).select(*df.columns))
        self.g = Graph.of(new, self.g.edges, self.g.name) if kind == "node" else Graph.of(self.g.vertices, new, self.g.name)
        # Other variables may hold the same elements.
        for other, k in list(self.kinds.items()):
            if k == kind and other in rows.columns:
                o = F.col(f"`{other}`")
                joined = rows.join(changed, o["id"] == F.col("_id"), "left")
                swapped = F.when(hit, o.withField("label", F.col("_label")).withField("props", F.col("_props"))).otherwise(o)
                rows = joined.withColumn(other, swapped).drop("_id", "_label", "_props")
        self.rows = settle(rows)

    def do_remove(self, c: Clause) -> None:
        for var, how, key in c.items:
            node = F.col(f"`{var}`")
            props = without(node["props"], key) if how == "prop" else node["props"]
            self.write(self.start(), var, self.kinds[var], F.when(node["label"] == key, F.lit("")).otherwise(node["label"]) if how == "label" else node["label"], props)

    def do_delete(self, c: Clause, detach: bool = False) -> None:
        v, e = self.g.vertices, self.g.edges
        for var in c.items:
            gone = settle(self.start().where(F.col(f"`{var}`").isNotNull()).select(F.col(f"`{var}`")["id"].alias("_id")).distinct())
            if self.kinds[var] == "rel":
                e = e.join(gone, F.col("id") == F.col("_id"), "left_anti")
                continue
            v = v.join(gone, F.col("id") == F.col("_id"), "left_anti")
            if detach:
                for end in ("src", "dst"):
                    e = e.join(gone, F.col(end) == F.col("_id"), "left_anti")
            elif not functools.reduce(lambda a, b: a.unionByName(b), [e.join(gone, F.col(end) == F.col("_id"), "left_semi") for end in ("src", "dst")]).isEmpty():
                raise CypherError("a node with relationships can only be detached and deleted")
        self.g = Graph.of(settle(v), settle(e), self.g.name)

    def do_detach(self, c: Clause) -> None:
        self.do_delete(c, True)


def plain(x: Column) -> Column:
    """A number as the text of a whole number where it is one."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def merged(props: Column, more: Column) -> Column:
    return F.map_concat(F.map_filter(props, lambda k, _: ~F.map_contains_key(more, k)), more)


def without(props: Column, key: str) -> Column:
    return F.map_filter(props, lambda k, _: k != key)


def run(g: Graph, text: str, params: dict | None = None) -> tuple[DataFrame | None, Graph]:
    c = Compiler(g, params or {})
    c.run(Parser(text).query())
    return c.out, c.g


__all__ = ["CypherError", "Parser", "run"]
