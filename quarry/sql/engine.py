"""A SQL session: data definition and changes over immutable snapshots, a catalogue, prepared statements, transactions, and SELECT.

A table is a DataFrame with a hidden number for each row, ``_doc_id``. Each change makes a new snapshot (a plan over the old one,
checkpointed to the shared folder), so a transaction's savepoint is the set of snapshots at its time. SELECT goes to Spark's own
parser and optimizer once the parts that Spark lacks are rewritten: parameters ``$1``, table functions and retrieval functions (see
``retrieval``), the catalogue's views, and PostgreSQL's order of nulls.

Statistics and constraints are checked by aggregates over the rows that change, never by collecting them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pg
from ..graph.core import Graph
from ..operators.lineage import settle, shared_dir
from ..sources.foreign import Servers
from .graphs import Graphs
from .text import clause, closing, masked, split, statements, string, unquoted

#: SQL type -> Spark type. Fixed values.
TYPES = {
    "int": "int", "integer": "int", "int2": "smallint", "int4": "int", "int8": "bigint", "smallint": "smallint", "bigint": "bigint",
    "serial": "bigint", "bigserial": "bigint", "smallserial": "bigint", "float": "double", "float4": "float", "float8": "double", "real": "double", "double": "double",
    "double precision": "double", "text": "string", "varchar": "string", "char": "string", "character": "string", "character varying": "string", "name": "string", "uuid": "string",
    "boolean": "boolean", "bool": "boolean", "date": "date", "time": "string", "timestamp": "timestamp", "timestamptz": "timestamp", "interval": "string",
    "json": "string", "jsonb": "string", "bytea": "binary", "point": "struct<x: double, y: double>", "string": "string",
}
ROW = "_doc_id"


class SqlError(ValueError):
    """A statement that can't be carried out; nothing has changed."""


def spark_type(text: str) -> str:
    t = re.sub(r"\s+", " ", text.strip().lower())
    if t.endswith("[]"):
        return f"array<{spark_type(t[:-2])}>"
    base, _, args = t.partition("(")
    base = base.strip()
    if base in ("numeric", "decimal"):
        return f"decimal({args.rstrip(')')})" if args else "double"
    if base == "vector":
        return "array<double>"
    return TYPES.get(re.sub(r" with(out)? time zone", "", base), "string")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    sequence: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[ColumnDef, ...]
    df: DataFrame
    keys: tuple[tuple[str, ...], ...] = ()  # unique column lists; the first is the primary key if has_pk
    has_pk: bool = False
    checks: tuple[str, ...] = ()
    foreign: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    next_id: int = 0
    version: int = 0
    indexes: tuple[tuple[str, str, tuple[str, ...], str], ...] = ()  # name, method, columns, analyzer

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name == name:
                return c
        raise SqlError(f"{self.name} has no column {name}")


@dataclass
class Sequence_:
    value: int
    step: int
    start: int


@dataclass
class State:
    """What a transaction restores."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    graphs: dict[str, Graph] = field(default_factory=dict)
    sequences: dict[str, Sequence_] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"public"})

    def copy(self) -> State:
        return State(dict(self.tables), dict(self.views), dict(self.graphs), {k: replace(v) for k, v in self.sequences.items()}, set(self.schemas))


class Session:
    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, State()
        self.servers = Servers(spark)
        self.prepared: dict[str, str] = {}
        self.settings: dict[str, str] = {"search_path": "public"}
        self.saved: list[tuple[str, State]] = []
        self.analyzers: dict[tuple[str, str], str] = {}
        self.last_sequence: str | None = None
        self._indexes: dict = {}
        self._views = 0
        self.graphs = Graphs(self)
        pg.register(spark)

    def graph(self, name: str, create: bool = False) -> Graph:
        if name not in self.state.graphs:
            if not create:
                raise SqlError(f"no graph {name}")
            self.state.graphs[name] = Graph.empty(self.spark, name)
        return self.state.graphs[name]

    def index_dir(self) -> str:
        """Where this session's text indexes are written: the shared folder."""
        return f"{shared_dir(self.spark)}/indexes-{id(self)}"

    # --- entry ---------------------------------------------------------------------------------------------------------------

    def sql(self, text: str, params: Sequence | None = None) -> DataFrame | None:
        """Run statements; the last one's rows, None if it has none. $1, $2, ... are params."""
        out = None
        for s in statements(text):
            out = self._one(s, list(params or []))
        return out

    def register(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A DataFrame as a table; its key, a long, becomes the hidden row number."""
        columns = tuple(ColumnDef(f.name, f.dataType.simpleString()) for f in df.schema.fields)
        rows = df.withColumn(ROW, F.col(key).cast("long")) if key else settle(df.withColumn(ROW, F.monotonically_increasing_id()))
        self._put(Table(name.lower(), columns, rows, ((key,),) if key else (), bool(key), next_id=1 << 40))

    def _one(self, text: str, params: list) -> DataFrame | None:
        head = re.match(r"\s*(\w+)(?:\s+(\w+))?(?:\s+(\w+))?", text)
        if not head:
            return None
        first, second = head[1].lower(), (head[2] or "").lower()
        handler = getattr(self, f"_{first}_{second}", None) or getattr(self, f"_{first}", None)
        if handler is None:
            raise SqlError(f"unknown statement {first}")
        return handler(text.strip(), params)

    # --- helpers -------------------------------------------------------------------------------------------------------------

    def _name(self, text: str) -> str:
        n = text.strip().strip('"').lower()
        schema, _, table = n.rpartition(".")
        if schema in ("", "public"):
            for s in [x.strip() for x in self.settings["search_path"].split(",")]:
                if s != "public" and not schema and f"{s}.{table}" in self.state.tables:
                    return f"{s}.{table}"
            return table
        return n

    def table(self, name: str) -> Table:
        n = self._name(name)
        if n not in self.state.tables:
            raise SqlError(f"no table {name}")
        return self.state.tables[n]

    def _put(self, t: Table) -> None:
        self.state.tables[t.name] = t
        t.df.select(*[F.col(f"`{c}`") for c in t.names()]).createOrReplaceTempView(self._view(t.name))

    @staticmethod
    def _view(name: str) -> str:
        return name.replace(".", "__")

    def _changed(self, t: Table, df: DataFrame, **more) -> Table:
        return replace(t, df=settle(df.select(ROW, *[F.col(f"`{c}`") for c in t.names()])), version=t.version + 1, **more)

    def temp(self, df: DataFrame) -> str:
        self._views += 1
        name = f"__q{self._views}"
        df.createOrReplaceTempView(name)
        return name

    def literal(self, text: str, params: list):
        """The value of a constant expression."""
        t = text.strip()
        if m := re.fullmatch(r"\$(\d+)", t):
            return params[int(m[1]) - 1]
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d*\.\d+(?:[eE]-?\d+)?", t):
            return float(t)
        if re.fullmatch(r"'(?:[^']|'')*'|\$\$.*\$\$", t, re.S):
            return string(t)
        if m := re.fullmatch(r"(?is)(?:ARRAY)?\[(.*)\](?:::\w+(?:\[\])?)?", t):
            return [self.literal(x, params) for x in split(m[1])]
        if m := re.fullmatch(r"(?is)POINT\s*\((.*)\)", t):
            return tuple(float(self.literal(x, params)) for x in split(m[1]))
        if t.upper() in ("NULL", "TRUE", "FALSE"):
            return {"NULL": None, "TRUE": True, "FALSE": False}[t.upper()]
        return self.select(f"SELECT {t} AS v", params).first()[0]

    def select(self, text: str, params: list) -> DataFrame:
        from .retrieval import rewritten

        return rewritten(self, text, params)

    def _returning(self, t: Table, rows: DataFrame, items: str | None, n: int, what: str) -> DataFrame:
        if not items:
            return self.spark.range(1).select(F.lit(n).cast("long").alias(what))
        name = self.temp(rows.select(*[F.col(f"`{c}`") for c in t.names()]))
        return self.spark.sql(f"SELECT {items} FROM {name}")

    # --- definition ----------------------------------------------------------------------------------------------------------

    def _create_table(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)\s*", text)
        name = self._name(m[2])
        if name in self.state.tables:
            if m[1]:
                return
            raise SqlError(f"table {name} exists")
        if "." in name and name.split(".")[0] not in self.state.schemas:
            raise SqlError(f"no schema {name.split('.')[0]}")
        rest = text[m.end() :]
        if as_ := re.match(r"(?is)AS\s+", rest):
            df = self.select(rest[as_.end() :], params)
            rows = settle(df.withColumn(ROW, F.monotonically_increasing_id()))
            self._put(Table(name, tuple(ColumnDef(f.name, f.dataType.simpleString()) for f in df.schema.fields), rows, next_id=1 << 40))
            return
        columns, keys, checks, foreign, pk = [], [], [], [], []
        for part in split(rest[1 : closing(rest, 0) - 1]):
            part = re.sub(r"(?i)^CONSTRAINT\s+\w+\s+", "", part)
            if k := re.match(r"(?is)(PRIMARY\s+KEY|UNIQUE)\s*\((.*)\)", part):
                own = tuple(x.strip().strip('"').lower() for x in k[2].split(","))
                (pk if k[1].upper().startswith("P") else keys).append(own)
            elif k := re.match(r"(?is)CHECK\s*\((.*)\)$", part):
                checks.append(k[1])
            elif k := re.match(r"(?is)FOREIGN\s+KEY\s*\((.*?)\)\s*REFERENCES\s+([\w.]+)\s*\((.*?)\)", part):
                foreign.append((tuple(x.strip().lower() for x in k[1].split(",")), self._name(k[2]), tuple(x.strip().lower() for x in k[3].split(","))))
            else:
                c, own_pk, unique, own_checks, ref = self._column(name, part)
                columns.append(c)
                if own_pk:
                    pk.append((c.name,))
                if unique:
                    keys.append((c.name,))
                checks += own_checks
                if ref:
                    foreign.append(((c.name,), *ref))
        required = {x for k in pk for x in k}
        columns = [replace(c, not_null=c.not_null or c.name in required) for c in columns]
        schema = f"{ROW} long, " + ", ".join(f"`{c.name}` {c.type}" for c in columns)
        self._put(Table(name, tuple(columns), self.spark.createDataFrame([], schema), tuple([*pk, *keys]), bool(pk), tuple(checks), tuple(foreign)))

    _create_temp = _create_temporary = _create_table

    def _column(self, table: str, text: str):
        m = re.match(r"(?is)(\"?[\w]+\"?)\s+(double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|\w+)\s*(\([^)]*\))?\s*((?:\[\])*)", text)
        name, kind, rest = m[1].strip('"').lower(), m[2] + (m[3] or "") + m[4], text[m.end() :]
        bare = masked(rest)
        default = re.search(r"(?is)\bDEFAULT\b(.*?)(?=\bNOT\s+NULL\b|\bPRIMARY\b|\bUNIQUE\b|\bCHECK\b|\bREFERENCES\b|\bNULL\s*$|$)", bare)
        checks = [rest[c.end() - 1 :][1 : closing(rest[c.end() - 1 :], 0) - 1] for c in re.finditer(r"(?i)\bCHECK\s*\(", rest)]
        ref = re.search(r"(?i)\bREFERENCES\s+([\w.]+)\s*\(\s*(\w+)\s*\)", rest)
        serial = "serial" in m[2].lower() or bool(re.search(r"(?i)\bGENERATED\b.*\bIDENTITY\b", rest))
        sequence = None
        if serial:
            sequence = f"{table}_{name}_seq"
            self.state.sequences[sequence] = Sequence_(0, 1, 1)
        column = ColumnDef(name, spark_type(kind), serial or bool(re.search(r"(?i)\bNOT\s+NULL\b", bare)), rest[default.start(1) : default.end(1)].strip() if default else None, sequence)
        return column, bool(re.search(r"(?i)\bPRIMARY\s+KEY\b", bare)), bool(re.search(r"(?i)\bUNIQUE\b", bare)), checks, (self._name(ref[1]), (ref[2].lower(),)) if ref else None

    def _create_view(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\s+([\w.]+)\s+AS\s+(.*)$", text)
        self.state.views[self._name(m[1])] = m[2]
        self.select(m[2], params).createOrReplaceTempView(self._view(self._name(m[1])))

    def _create_or(self, text: str, params: list) -> None:
        self._create_view(text, params)

    def _drop_view(self, text: str, params: list) -> None:
        m = re.match(r"(?is)DROP\s+VIEW\s+(IF\s+EXISTS\s+)?([\w.]+)", text)
        if self.state.views.pop(self._name(m[2]), None) is None and not m[1]:
            raise SqlError(f"no view {m[2]}")
        self.spark.catalog.dropTempView(self._view(self._name(m[2])))

    def _drop_table(self, text: str, params: list) -> None:
        m = re.match(r"(?is)DROP\s+TABLE\s+(IF\s+EXISTS\s+)?([\w.]+)\s*(CASCADE)?", text)
        name = self._name(m[2])
        if name not in self.state.tables:
            if m[1]:
                return
            raise SqlError(f"no table {name}")
        by = [t.name for t in self.state.tables.values() if t.name != name and any(f[1] == name for f in t.foreign)]
        if by and not m[3]:
            raise SqlError(f"{name} is referenced by {', '.join(by)}")
        for b in by:
            self.state.tables[b] = replace(self.state.tables[b], foreign=tuple(f for f in self.state.tables[b].foreign if f[1] != name))
        del self.state.tables[name]
        self.spark.catalog.dropTempView(self._view(name))

    def _truncate(self, text: str, params: list) -> None:
        t = self.table(re.match(r"(?is)TRUNCATE\s+(?:TABLE\s+)?([\w.]+)", text)[1])
        self._put(self._changed(t, t.df.limit(0)))

    def _create_schema(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+SCHEMA\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)", text)
        if m[2].lower() in self.state.schemas and not m[1]:
            raise SqlError(f"schema {m[2]} exists")
        self.state.schemas.add(m[2].lower())

    def _drop_schema(self, text: str, params: list) -> None:
        m = re.match(r"(?is)DROP\s+SCHEMA\s+(IF\s+EXISTS\s+)?(\w+)\s*(CASCADE)?", text)
        name = m[2].lower()
        if name not in self.state.schemas:
            if m[1]:
                return
            raise SqlError(f"no schema {name}")
        own = [t for t in self.state.tables if t.startswith(f"{name}.")]
        if own and not m[3]:
            raise SqlError(f"schema {name} isn't empty")
        for t in own:
            del self.state.tables[t]
        self.state.schemas.discard(name)

    def _alter_table(self, text: str, params: list) -> None:
        m = re.match(r"(?is)ALTER\s+TABLE\s+([\w.]+)\s+(.*)$", text)
        t, act = self.table(m[1]), m[2].strip()
        if a := re.match(r"(?is)ADD\s+COLUMN\s+(?:IF\s+NOT\s+EXISTS\s+)?(.*)$", act):
            c, *_ = self._column(t.name, a[1])
            value = self.select(f"SELECT CAST({c.default} AS {c.type}) AS v", params).first()[0] if c.default else None
            if c.not_null and value is None and not t.df.isEmpty():
                raise SqlError(f"column {c.name} would be null")
            t2 = replace(t, columns=(*t.columns, c), df=t.df.withColumn(c.name, F.lit(value).cast(c.type)))
        elif a := re.match(r"(?is)DROP\s+COLUMN\s+(?:IF\s+EXISTS\s+)?(\w+)", act):
            t.column(a[1].lower())
            t2 = replace(t, columns=tuple(c for c in t.columns if c.name != a[1].lower()), keys=tuple(k for k in t.keys if a[1].lower() not in k))
        elif a := re.match(r"(?is)RENAME\s+COLUMN\s+(\w+)\s+TO\s+(\w+)", act):
            was, now = a[1].lower(), a[2].lower()
            t.column(was)
            swap = lambda names: tuple(now if n == was else n for n in names)
            t2 = replace(t, columns=tuple(replace(c, name=now) if c.name == was else c for c in t.columns), keys=tuple(map(swap, t.keys)), df=t.df.withColumnRenamed(was, now))
        elif a := re.match(r"(?is)RENAME\s+TO\s+([\w.]+)", act):
            del self.state.tables[t.name]
            self.spark.catalog.dropTempView(self._view(t.name))
            t2 = replace(t, name=self._name(a[1]))
        elif a := re.match(r"(?is)ALTER\s+COLUMN\s+(\w+)\s+SET\s+DEFAULT\s+(.*)$", act):
            t2 = replace(t, columns=tuple(replace(c, default=a[2]) if c.name == a[1].lower() else c for c in t.columns))
        elif a := re.match(r"(?is)ALTER\s+COLUMN\s+(\w+)\s+DROP\s+DEFAULT", act):
            t2 = replace(t, columns=tuple(replace(c, default=None) if c.name == a[1].lower() else c for c in t.columns))
        elif a := re.match(r"(?is)ALTER\s+COLUMN\s+(\w+)\s+(SET|DROP)\s+NOT\s+NULL", act):
            on = a[2].upper() == "SET"
            if on and not t.df.where(F.col(a[1]).isNull()).isEmpty():
                raise SqlError(f"column {a[1]} has nulls")
            t2 = replace(t, columns=tuple(replace(c, not_null=on) if c.name == a[1].lower() else c for c in t.columns))
        elif a := re.match(r"(?is)ALTER\s+COLUMN\s+(\w+)\s+(?:SET\s+DATA\s+)?TYPE\s+(.*?)(?:\s+USING\s+(.*))?$", act):
            kind, name = spark_type(a[2]), a[1].lower()
            t.column(name)
            t2 = replace(t, columns=tuple(replace(c, type=kind) if c.name == name else c for c in t.columns), df=t.df.withColumn(name, (F.expr(a[3]) if a[3] else F.col(name)).cast(kind)))
        elif a := re.match(r"(?is)ADD\s+(?:CONSTRAINT\s+\w+\s+)?(CHECK|UNIQUE|PRIMARY\s+KEY|FOREIGN\s+KEY)\s*\((.*?)\)\s*(?:REFERENCES\s+([\w.]+)\s*\((.*?)\))?$", act):
            kind, own = a[1].upper(), tuple(x.strip().lower() for x in a[2].split(","))
            t2 = replace(t, checks=(*t.checks, a[2])) if kind == "CHECK" else replace(t, foreign=(*t.foreign, (own, self._name(a[3]), tuple(x.strip().lower() for x in a[4].split(","))))) if kind.startswith("F") else replace(t, keys=(*t.keys, own))
            self._check(t2, t2.df, t2.df)
        else:
            raise SqlError(f"ALTER TABLE can't {act}")
        self._put(self._changed(t2, t2.df))

    def _create_index(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+([\w.]+)\s*(?:USING\s+(\w+))?\s*\((.*?)\)\s*(?:WITH\s*\(\s*analyzer\s*=\s*'?(\w+)'?\s*\))?", text)
        t, columns = self.table(m[3]), tuple(x.strip().split()[0].lower() for x in m[5].split(","))
        for c in columns:
            t.column(c)
        method = (m[4] or "btree").lower()
        if method == "gin" and m[6]:
            for c in columns:
                self.analyzers[t.name, c] = m[6]
        df = t.df
        if method == "btree":  # rows of near keys stand together, so that stored ranges prune
            df = t.df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        t2 = replace(t, indexes=(*t.indexes, (m[2].lower(), method, columns, m[6] or "standard")), keys=(*t.keys, columns) if m[1] else t.keys)
        if m[1]:
            self._check(t2, t2.df, t2.df)
        self._put(self._changed(t2, df))

    def _create_unique(self, text: str, params: list) -> None:
        self._create_index(text, params)

    def _drop_index(self, text: str, params: list) -> None:
        m = re.match(r"(?is)DROP\s+INDEX\s+(IF\s+EXISTS\s+)?(\w+)", text)
        found = [t for t in self.state.tables.values() if any(i[0] == m[2].lower() for i in t.indexes)]
        if not found and not m[1]:
            raise SqlError(f"no index {m[2]}")
        for t in found:
            self.state.tables[t.name] = replace(t, indexes=tuple(i for i in t.indexes if i[0] != m[2].lower()))

    # --- sequences -----------------------------------------------------------------------------------------------------------

    def _create_sequence(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+SEQUENCE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)(.*)$", text)
        if m[2].lower() in self.state.sequences:
            if m[1]:
                return
            raise SqlError(f"sequence {m[2]} exists")
        start, step = self._bounds(m[3], 1, 1)
        self.state.sequences[m[2].lower()] = Sequence_(start - step, step, start)

    def _alter_sequence(self, text: str, params: list) -> None:
        m = re.match(r"(?is)ALTER\s+SEQUENCE\s+(\w+)(.*)$", text)
        s = self._sequence(m[1])
        s.start, s.step = self._bounds(m[2], s.start, s.step)
        if r := re.search(r"(?i)\bRESTART(?:\s+(?:WITH\s+)?(-?\d+))?", m[2]):
            s.value = (int(r[1]) if r[1] else s.start) - s.step

    @staticmethod
    def _bounds(text: str, start: int, step: int) -> tuple[int, int]:
        a, b = re.search(r"(?i)(?<!RE)\bSTART\s+(?:WITH\s+)?(-?\d+)", text), re.search(r"(?i)\bINCREMENT\s+(?:BY\s+)?(-?\d+)", text)
        return int(a[1]) if a else start, int(b[1]) if b else step

    def _sequence(self, name: str) -> Sequence_:
        if name.lower() not in self.state.sequences:
            raise SqlError(f"no sequence {name}")
        return self.state.sequences[name.lower()]

    def nextval(self, name: str) -> int:
        s = self._sequence(name)
        s.value += s.step
        self.last_sequence = name.lower()
        return s.value

    def currval(self, name: str) -> int:
        return self._sequence(name).value

    def setval(self, name: str, value: int) -> int:
        self._sequence(name).value = value
        return value

    def lastval(self) -> int:
        if self.last_sequence is None:
            raise SqlError("no sequence has been advanced")
        return self.currval(self.last_sequence)

    # --- rows ----------------------------------------------------------------------------------------------------------------

    def _check(self, t: Table, new: DataFrame, whole: DataFrame) -> None:
        """Constraints of t: not null and checks over the new rows, keys over the whole, references by anti-joins."""
        wrong = [F.max(F.col(c.name).isNull()).alias(f"null {c.name}") for c in t.columns if c.not_null]
        wrong += [F.max(~F.expr(c)).alias(f"check {c}") for c in t.checks]
        if wrong:
            row = new.agg(*wrong).first().asDict()
            if bad := [k for k, v in row.items() if v]:
                raise SqlError(f"{t.name}: violated {', '.join(bad)}")
        for key in t.keys:
            some = F.lit(True)
            for c in key:
                some = some & F.col(c).isNotNull()
            if not whole.where(some).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
                raise SqlError(f"{t.name}: duplicate key ({', '.join(key)})")
        for columns, other, refs in t.foreign:
            some = F.lit(True)
            for c in columns:
                some = some & F.col(c).isNotNull()
            target = whole if other == t.name else self.table(other).df
            o = target.select(*[F.col(r).alias(f"_r{k}") for k, r in enumerate(refs)])
            if not new.where(some).join(o, [F.col(c) == F.col(f"_r{k}") for k, c in enumerate(columns)], "left_anti").isEmpty():
                raise SqlError(f"{t.name}: ({', '.join(columns)}) isn't in {other}")

    def _referenced(self, t: Table, left: DataFrame) -> None:
        """Rows of other tables must still find what they reference."""
        for other in self.state.tables.values():
            for columns, name, refs in other.foreign:
                if name == t.name and other.name != t.name:
                    o = left.select(*[F.col(r).alias(f"_r{k}") for k, r in enumerate(refs)])
                    if not other.df.dropna(subset=list(columns)).join(o, [F.col(c) == F.col(f"_r{k}") for k, c in enumerate(columns)], "left_anti").isEmpty():
                        raise SqlError(f"{other.name} references rows of {t.name}")

    def _insert(self, text: str, params: list) -> DataFrame:
        m = re.match(r"(?is)INSERT\s+INTO\s+([\w.]+)\s*", text)
        t, rest = self.table(m[1]), text[m.end() :]
        names = t.names()
        if rest.startswith("("):
            end = closing(rest, 0)
            names, rest = [x.strip().strip('"').lower() for x in rest[1 : end - 1].split(",")], rest[end:].strip()
        parts = clause(rest, "ON CONFLICT", "RETURNING")
        body = parts[""]
        if re.match(r"(?i)DEFAULT\s+VALUES", body):
            given, names = self.spark.range(1).select(F.lit(0).cast("long").alias("_o")), []
        elif re.match(r"(?i)VALUES\b", body):
            rows = []
            for k, tup in enumerate(split(re.sub(r"(?i)^VALUES\s*", "", body))):
                items = split(tup[1:-1])
                if len(items) != len(names):
                    raise SqlError(f"{len(names)} columns, {len(items)} values")
                cast = [f"CAST({self._default(t, n, params) if i.upper() == 'DEFAULT' else i} AS {t.column(n).type}) AS `{n}`" for n, i in zip(names, items, strict=True)]
                rows.append(f"SELECT {', '.join(cast)}, {k}L AS _o")
            given = self.select(" UNION ALL ".join(rows), params)
        else:
            found = self.select(body, params)
            if len(found.columns) != len(names):
                raise SqlError(f"{len(names)} columns, {len(found.columns)} values")
            given = found.toDF(*names).withColumn("_o", F.monotonically_increasing_id())
        given = settle(given)
        full = given
        for c in t.columns:
            if c.name in names:
                full = full.withColumn(c.name, F.col(f"`{c.name}`").cast(c.type))
            elif c.sequence:
                s, n = self._sequence(c.sequence), W.orderBy("_o")  # a statement's own rows, few or one ordered pass
                full = full.withColumn(c.name, (F.lit(s.value) + F.row_number().over(n) * s.step).cast(c.type))
            else:
                full = full.withColumn(c.name, F.expr(f"CAST({self._default(t, c.name, params)} AS {c.type})"))
        for c in t.columns:
            if c.sequence:
                s, n = self._sequence(c.sequence), given.count() if c.name not in names else 0
                s.value += n * s.step
                self.last_sequence = c.sequence if n else self.last_sequence
        rows = settle(full.withColumn(ROW, F.lit(t.next_id) + F.col("_o")))
        conflict = parts.get("ON CONFLICT")
        if conflict is None:
            added, whole = rows, t.df.unionByName(rows.select(ROW, *t.names()))
        else:
            added, whole = self._upsert(t, rows, conflict)
        added, whole = settle(added), settle(whole.select(ROW, *t.names()))
        self._check(t, added, whole)
        top = rows.agg(F.max(ROW)).first()[0]
        self._put(replace(t, df=whole, version=t.version + 1, next_id=max(t.next_id, (top if top is not None else -1) + 1)))
        return self._returning(t, added, parts.get("RETURNING"), added.count() if not parts.get("RETURNING") else 0, "inserted")

    def _default(self, t: Table, name: str, params: list) -> str:
        c = t.column(name)
        if c.sequence:
            return str(self.nextval(c.sequence))
        if c.default is None:
            return "NULL"
        d = {"current_timestamp": "current_timestamp()", "current_date": "current_date()", "now()": "current_timestamp()"}.get(c.default.lower(), c.default)
        if n := re.fullmatch(r"(?i)nextval\('(\w+)'\)", d):
            return str(self.nextval(n[1]))
        return d

    def _upsert(self, t: Table, rows: DataFrame, conflict: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose key is new (the first given of each key), and the table with the others left or updated by the last given."""
        m = re.match(r"(?is)(?:\((.*?)\))?\s*DO\s+(NOTHING|UPDATE\s+SET\s+(.*))$", conflict)
        on = tuple(x.strip().lower() for x in m[1].split(",")) if m[1] else (t.keys[0] if t.keys else ())
        if not on:
            raise SqlError(f"{t.name} has no key to conflict on")
        key = [F.col(c) for c in on]
        first = rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy("_o"))).where("_k = 1").drop("_k")
        o, n = t.df.alias("old"), first.alias("new")
        same = [F.col(f"old.{c}") == F.col(f"new.{c}") for c in on]
        fresh = n.join(o, same, "left_anti").select(ROW, *t.names())
        if m[2].upper() == "NOTHING":
            return fresh, t.df.unionByName(fresh)
        updates = clause(m[3], "WHERE")
        last = rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(F.col("_o").desc()))).where("_k = 1").drop("_k")
        joined = self.temp(o.join(last.alias("new"), same, "left").select(*[F.col(f"old.{c}").alias(c) for c in [ROW, *t.names()]], *[F.col(f"new.{c}").alias(f"excluded__{c}") for c in t.names()], F.col(f"new.{ROW}").isNotNull().alias("_hit")))
        expr = lambda e: re.sub(rf"(?i)\b{t.name}\.(\w+)", r"\1", re.sub(r"(?i)\bexcluded\.(\w+)", r"excluded__\1", e))
        sets = {k.strip().lower(): v for k, _, v in (s.partition("=") for s in split(updates[""]))}
        hit = f"_hit AND ({expr(updates['WHERE'])})" if "WHERE" in updates else "_hit"
        cols = [f"CAST(CASE WHEN {hit} THEN {expr(sets[c])} ELSE `{c}` END AS {t.column(c).type}) AS `{c}`" if c in sets else f"`{c}`" for c in t.names()]
        kept = self.spark.sql(f"SELECT {ROW}, {', '.join(cols)}, {hit} AS _hit FROM {joined}")
        kept = settle(kept)
        return fresh.unionByName(kept.where("_hit").drop("_hit")), kept.drop("_hit").unionByName(fresh)

    def _update(self, text: str, params: list) -> DataFrame:
        parts = clause(text, "UPDATE", "SET", "FROM", "WHERE", "RETURNING")
        target, _, alias = parts["UPDATE"].partition(" ")
        t = self.table(target)
        alias = re.sub(r"(?i)^AS\s+", "", alias.strip()) or self._view(t.name)
        sets = {k.strip().lower().split(".")[-1]: v for k, _, v in (s.partition("=") for s in split(parts["SET"]))}
        where = parts.get("WHERE")
        base = self.temp(t.df)
        cols = [f"CAST({sets[c]} AS {t.column(c).type}) AS `_set_{c}`" for c in sets]
        source = f"{base} {alias}" + (f", {parts['FROM']}" if "FROM" in parts else "")
        found = self.select(f"SELECT {alias}.{ROW} AS _row, {', '.join(cols)} FROM {source}" + (f" WHERE {where}" if where else ""), params)
        # Of several matching source rows one is taken: the least by the values it sets, so reruns agree.
        order = [F.to_json(F.struct(*[f"_set_{c}" for c in sets]))]
        first = found.withColumn("_k", F.row_number().over(W.partitionBy("_row").orderBy(*order))).where("_k = 1").drop("_k") if "FROM" in parts else found
        first = settle(first)
        joined = t.df.join(first, F.col(ROW) == F.col("_row"), "left")
        new = joined.select(ROW, *[F.when(F.col("_row").isNotNull(), F.col(f"_set_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in t.names()], F.col("_row").isNotNull().alias("_hit"))
        new = settle(new)
        touched = new.where("_hit")
        self._check(t, touched, new)
        self._referenced(t, new)
        self._put(replace(t, df=new.drop("_hit"), version=t.version + 1))
        return self._returning(t, touched, parts.get("RETURNING"), first.count() if not parts.get("RETURNING") else 0, "updated")

    def _delete(self, text: str, params: list) -> DataFrame:
        parts = clause(re.sub(r"(?i)^DELETE\s+FROM", "DELETE_FROM", text), "DELETE_FROM", "USING", "WHERE", "RETURNING")
        target, _, alias = parts["DELETE_FROM"].partition(" ")
        t = self.table(target)
        alias = re.sub(r"(?i)^AS\s+", "", alias.strip()) or self._view(t.name)
        base = self.temp(t.df)
        source = f"{base} {alias}" + (f", {parts['USING']}" if "USING" in parts else "")
        gone = settle(self.select(f"SELECT DISTINCT {alias}.{ROW} AS _row FROM {source}" + (f" WHERE {parts['WHERE']}" if "WHERE" in parts else ""), params))
        left = settle(t.df.join(gone, F.col(ROW) == F.col("_row"), "left_anti"))
        self._referenced(t, left)
        lost = settle(t.df.join(gone, F.col(ROW) == F.col("_row"), "left_semi")) if parts.get("RETURNING") else t.df
        self._put(replace(t, df=left, version=t.version + 1))
        return self._returning(t, lost, parts.get("RETURNING"), gone.count() if not parts.get("RETURNING") else 0, "deleted")

    def add_document(self, table: str, doc_id: int, doc: dict) -> None:
        """A row with its own number; its columns must be the table's."""
        t = self.table(table)
        row = self.spark.createDataFrame([tuple([doc_id, *[doc.get(c) for c in t.names()]])], f"{ROW} long, " + ", ".join(f"`{c.name}` {c.type}" for c in t.columns))
        whole = settle(t.df.where(F.col(ROW) != doc_id).unionByName(row))
        self._check(t, row, whole)
        self._put(replace(t, df=whole, version=t.version + 1, next_id=max(t.next_id, doc_id + 1)))

    # --- sessions ------------------------------------------------------------------------------------------------------------

    def _begin(self, text: str, params: list) -> None:
        self.saved = [("", self.state.copy())]

    _start = _begin

    def _savepoint(self, text: str, params: list) -> None:
        self._within().append((text.split()[1].lower(), self.state.copy()))

    def _within(self) -> list:
        if not self.saved:
            raise SqlError("no transaction is open")
        return self.saved

    def _release(self, text: str, params: list) -> None:
        name = text.split()[-1].lower()
        at = [k for k, (n, _) in enumerate(self._within()) if n == name]
        if not at:
            raise SqlError(f"no savepoint {name}")
        del self.saved[at[-1] :]

    def _commit(self, text: str, params: list) -> None:
        self._within()
        self.saved = []

    _end = _commit

    def _rollback(self, text: str, params: list) -> None:
        saved = self._within()
        m = re.match(r"(?is)ROLLBACK\s+(?:TRANSACTION\s+|WORK\s+)?TO\s+(?:SAVEPOINT\s+)?(\w+)", text)
        at = [k for k, (n, _) in enumerate(saved) if n == (m[1].lower() if m else "")]
        if not at:
            raise SqlError(f"no savepoint {m[1]}")
        k = at[-1]
        for name in self.state.tables.keys() - saved[k][1].tables.keys():
            self.spark.catalog.dropTempView(self._view(name))
        self.state = saved[k][1].copy()
        self.saved = saved[: k + 1] if m else []
        for t in self.state.tables.values():
            self._put(t)

    def _prepare(self, text: str, params: list) -> None:
        m = re.match(r"(?is)PREPARE\s+(\w+)\s*(?:\([^)]*\))?\s+AS\s+(.*)$", text)
        self.prepared[m[1].lower()] = m[2]

    def _execute(self, text: str, params: list) -> DataFrame | None:
        m = re.match(r"(?is)EXECUTE\s+(\w+)\s*(?:\((.*)\))?\s*$", text)
        if m[1].lower() not in self.prepared:
            raise SqlError(f"nothing prepared as {m[1]}")
        return self._one(self.prepared[m[1].lower()], [self.literal(x, params) for x in split(m[2] or "")])

    def _deallocate(self, text: str, params: list) -> None:
        name = text.split()[-1].lower()
        if name == "all":
            self.prepared.clear()
        elif self.prepared.pop(name, None) is None:
            raise SqlError(f"nothing prepared as {name}")

    def _set(self, text: str, params: list) -> None:
        m = re.match(r"(?is)SET\s+(?:SESSION\s+|LOCAL\s+)?([\w.]+)\s*(?:=|\bTO\b)\s*(.*)$", text)
        self.settings[m[1].lower()] = ", ".join(string(x) for x in split(m[2]))

    def _show(self, text: str, params: list) -> DataFrame:
        name = text.split()[1].lower()
        return self.spark.range(1).select(F.lit(self.settings.get(name, "")).alias(name))

    def _reset(self, text: str, params: list) -> None:
        name = text.split()[1].lower()
        if name == "all":
            self.settings = {"search_path": "public"}
        elif name == "search_path":
            self.settings[name] = "public"
        else:
            self.settings.pop(name, None)

    def _discard(self, text: str, params: list) -> None:
        self.prepared.clear()
        self.settings = {"search_path": "public"}

    def _explain(self, text: str, params: list) -> DataFrame:
        df = self.select(re.sub(r"(?is)^EXPLAIN\s+(?:ANALYZE\s+)?", "", text), params)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")

    def _analyze(self, text: str, params: list) -> DataFrame:
        """(table_name, column_name, n_rows, n_distinct, n_null, least, greatest, bounds of 100 equal parts, common values): one aggregate a table, and one a column for common values."""
        m = re.match(r"(?is)ANALYZE\s*([\w.]+)?", text)
        tables = [self.table(m[1])] if m[1] else list(self.state.tables.values())
        out = None
        for t in tables:
            for c in t.columns:
                v = F.col(f"`{c.name}`")
                plain = re.match(r"(tinyint|smallint|int|bigint|float|double|decimal)", c.type)
                bounds = F.percentile_approx(v.cast("double"), [k / 100 for k in range(101)], 10_000) if plain else F.lit(None).cast("array<double>")
                simple = not c.type.startswith(("array", "struct", "map"))
                own = t.df.agg(F.count("*").alias("n_rows"), (F.approx_count_distinct(v, 0.02) if simple else F.lit(None).cast("long")).alias("n_distinct"), F.count_if(v.isNull()).alias("n_null"), F.min(v.cast("string")).alias("least"), F.max(v.cast("string")).alias("greatest"), bounds.alias("bounds"))
                common = t.df.where(v.isNotNull()).groupBy(v.cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "v").limit(10).agg(F.sort_array(F.collect_list(F.struct("n", "v")), asc=False).alias("common"))
                row = own.crossJoin(common).select(F.lit(t.name).alias("table_name"), F.lit(c.name).alias("column_name"), "*")  # one row each
                out = row if out is None else out.unionByName(row)
        return out

    # --- foreign data --------------------------------------------------------------------------------------------------------

    def _create_server(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+SERVER\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+FOREIGN\s+DATA\s+WRAPPER\s+(\w+)\s*(?:OPTIONS\s*\((.*)\))?\s*$", text)
        self.servers.create(m[2].lower(), m[3].lower(), self._options(m[4]), bool(m[1]))

    def _drop_server(self, text: str, params: list) -> None:
        m = re.match(r"(?is)DROP\s+SERVER\s+(IF\s+EXISTS\s+)?(\w+)\s*(CASCADE)?", text)
        self.servers.drop(m[2].lower(), bool(m[1]), bool(m[3]))

    def _create_foreign(self, text: str, params: list) -> None:
        m = re.match(r"(?is)CREATE\s+FOREIGN\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s*", text)
        rest = text[m.end() :]
        end = closing(rest, 0)
        columns = [self._column(m[2], c)[0] for c in split(rest[1 : end - 1])]
        s = re.match(r"(?is)\s*SERVER\s+(\w+)\s*(?:OPTIONS\s*\((.*)\))?\s*$", rest[end:])
        self.servers.create_table(self._name(m[2]), s[1].lower(), [(c.name, c.type) for c in columns], self._options(s[2]), bool(m[1]))
        self.servers.scan(self._name(m[2])).createOrReplaceTempView(self._view(self._name(m[2])))

    def _drop_foreign(self, text: str, params: list) -> None:
        m = re.match(r"(?is)DROP\s+FOREIGN\s+TABLE\s+(IF\s+EXISTS\s+)?([\w.]+)", text)
        self.servers.drop_table(self._name(m[2]), bool(m[1]))
        self.spark.catalog.dropTempView(self._view(self._name(m[2])))

    @staticmethod
    def _options(text: str | None) -> dict[str, str]:
        return {m[1].lower(): m[2].replace("''", "'") for m in re.finditer(r"(\w+)\s+'((?:[^']|'')*)'", text or "")}

    # --- queries -------------------------------------------------------------------------------------------------------------

    def _select(self, text: str, params: list) -> DataFrame:
        return self.select(text, params)

    _with = _values = _select

    # --- catalogue -----------------------------------------------------------------------------------------------------------

    def catalogue(self, name: str) -> DataFrame:
        """The rows of information_schema or pg_catalog views: one a table, column or index of this session."""
        tables = [(*(["public", n] if "." not in n else n.split(".")), kind) for n, kind in [*((t, "BASE TABLE") for t in sorted(self.state.tables)), *((v, "VIEW") for v in sorted(self.state.views)), *((f, "FOREIGN") for f in sorted(self.servers.tables))]]
        make = self.spark.createDataFrame
        if name == "information_schema.tables":
            return make(tables, "table_schema string, table_name string, table_type string")
        if name == "information_schema.columns":
            rows = [(*(["public", t.name] if "." not in t.name else t.name.split(".")), c.name, k, c.type, "NO" if c.not_null else "YES", c.default) for t in self.state.tables.values() for k, c in enumerate(t.columns, 1)]
            return make(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string")
        if name == "pg_catalog.pg_tables":
            return make([(s, t, "owner") for s, t, k in tables if k == "BASE TABLE"], "schemaname string, tablename string, tableowner string")
        if name == "pg_catalog.pg_views":
            return make([("public", v, d) for v, d in self.state.views.items()], "schemaname string, viewname string, definition string")
        if name == "pg_catalog.pg_indexes":
            return make([("public", t.name, i[0], f"CREATE INDEX {i[0]} ON {t.name} USING {i[1]} ({', '.join(i[2])})") for t in self.state.tables.values() for i in t.indexes], "schemaname string, tablename string, indexname string, indexdef string")
        if name == "pg_catalog.pg_type":
            return make([(k, n) for k, n in enumerate(sorted(TYPES))], "oid int, typname string")
        raise SqlError(f"no catalogue view {name}")

    def save(self, path: str) -> None:
        """All tables as Parquet with their definitions; load() reads them back."""
        import json

        for t in self.state.tables.values():
            t.df.write.mode("overwrite").parquet(f"{path}/tables/{t.name}")
        told = [(t.name, json.dumps({"columns": [vars(c) for c in t.columns], "keys": t.keys, "has_pk": t.has_pk, "checks": t.checks, "foreign": t.foreign, "next_id": t.next_id, "indexes": t.indexes})) for t in self.state.tables.values()]
        self.spark.createDataFrame(told, "name string, said string").coalesce(1).write.mode("overwrite").parquet(f"{path}/catalogue")

    def load(self, path: str) -> None:
        import json

        deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
        for r in self.spark.read.parquet(f"{path}/catalogue").collect():  # a row a table
            said = json.loads(r.said)
            columns = tuple(ColumnDef(**c) for c in said.pop("columns"))
            self._put(Table(r.name, columns, self.spark.read.parquet(f"{path}/tables/{r.name}"), **{k: deep(v) for k, v in said.items()}))


def null_order(text: str) -> str:
    """The last top-level ORDER BY with PostgreSQL's order of nulls: last ascending, first descending."""
    mask = masked(text)
    found = list(re.finditer(r"(?i)\bORDER\s+BY\b", mask))
    if not found:
        return text
    at = found[-1].end()
    stop = re.search(r"(?i)\b(LIMIT|OFFSET|FETCH|UNION|INTERSECT|EXCEPT)\b", mask[at:])
    end = at + stop.start() if stop else len(text)
    items = []
    for item in split(text[at:end]):
        if not re.search(r"(?i)\bNULLS\s+(FIRST|LAST)\b", unquoted(item)):
            item += " NULLS FIRST" if re.search(r"(?i)\bDESC\s*$", unquoted(item)) else " NULLS LAST"
        items.append(item)
    return f"{text[:at]} {', '.join(items)} {text[end:]}"


