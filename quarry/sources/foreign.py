"""Foreign servers and tables.

A wrapper is a reader: Parquet, CSV, JSON and ORC files by Spark's own sources, whose filters and columns Catalyst pushes down; rows given
in line as JSON; and Arrow IPC files or buffers. ``register_wrapper`` adds more. A foreign table names its columns and types; nothing
is read before a query runs, but for Arrow buffers given in line, which are part of the statement.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Columns = list[tuple[str, str]]
Wrapper = Callable[[SparkSession, Columns, dict[str, str]], DataFrame]


def _format(options: dict[str, str]) -> str:
    """The format that the options name, or the source's ending."""
    named = options.get("format") or options.get("source", "").rsplit(".", 1)[-1].lower()
    return {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "arrow": "arrow", "feather": "arrow"}.get(named, "parquet")


def files(spark: SparkSession, columns: Columns, options: dict[str, str]) -> DataFrame:
    """Rows of files, or of the option ``data``, a JSON array of objects."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in columns)
    if "data" in options:
        rows = [json.dumps(r) for r in json.loads(options["data"])]
        return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ddl).alias("r")).select("r.*")
    kind = _format(options)
    if kind == "arrow":
        return arrow(spark, columns, options)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", options.get("header", "true")).option("sep", options.get("delimiter", "\t" if options["source"].endswith(".tsv") else ","))
    if kind in ("csv", "json"):
        reader = reader.schema(ddl)
    return reader.load(options["source"]).select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in columns])


def arrow(spark: SparkSession, columns: Columns, options: dict[str, str]) -> DataFrame:
    """Arrow IPC: a base64 buffer in the option ``data``, or files, each read by one task a record batch at a time."""
    cast = [F.col(f"`{n}`").cast(t).alias(n) for n, t in columns]
    if "data" in options:
        with pa.ipc.open_stream(base64.b64decode(options["data"])) as r:
            return spark.createDataFrame(r.read_all()).select(*cast)
    names = [n for n, _ in columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                buffer = content.as_buffer()
                reader = pa.ipc.open_file(buffer) if buffer.slice(0, 6).to_pybytes() == b"ARROW1" else pa.ipc.open_stream(buffer)
                parts = (reader.get_batch(k) for k in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader
                for part in parts:
                    yield part.select(names)

    found = spark.read.format("binaryFile").load(options["source"]).select("content")
    return found.mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in columns)).select(*cast)


WRAPPERS: dict[str, Wrapper] = {"duckdb_fdw": files, "file_fdw": files, "arrow_fdw": arrow}


def register_wrapper(name: str, wrapper: Wrapper) -> None:
    """wrapper(spark, columns, options) gives a lazy DataFrame; options are the server's with the table's over them."""
    WRAPPERS[name] = wrapper


class Servers:
    """Named servers with their options, and the foreign tables on them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.servers: dict[str, tuple[str, dict[str, str]]] = {}
        self.tables: dict[str, tuple[str, Columns, dict[str, str]]] = {}

    def create(self, name: str, wrapper: str, options: dict[str, str], quiet: bool = False) -> None:
        if wrapper not in WRAPPERS:
            raise ValueError(f"unknown wrapper {wrapper}")
        if name in self.servers:
            if quiet:
                return
            raise ValueError(f"server {name} exists")
        self.servers[name] = (wrapper, options)

    def drop(self, name: str, quiet: bool = False, cascade: bool = False) -> None:
        own = [t for t, (s, _, _) in self.tables.items() if s == name]
        if own and not cascade:
            raise ValueError(f"server {name} has tables: {', '.join(own)}")
        if self.servers.pop(name, None) is None and not quiet:
            raise ValueError(f"no server {name}")
        for t in own:
            del self.tables[t]

    def create_table(self, name: str, server: str, columns: Columns, options: dict[str, str], quiet: bool = False) -> None:
        if server not in self.servers:
            raise ValueError(f"no server {server}")
        if name in self.tables and not quiet:
            raise ValueError(f"foreign table {name} exists")
        self.tables[name] = (server, columns, options)

    def drop_table(self, name: str, quiet: bool = False) -> None:
        if self.tables.pop(name, None) is None and not quiet:
            raise ValueError(f"no foreign table {name}")

    def scan(self, name: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
        """The table's rows; columns, predicate and limit are part of the plan, and reach the files that can use them."""
        server, own, options = self.tables[name]
        wrapper, shared = self.servers[server]
        df = WRAPPERS[wrapper](self.spark, own, shared | options)
        df = df.where(where) if where else df
        df = df.select(*columns) if columns else df
        return df.limit(limit) if limit is not None else df
