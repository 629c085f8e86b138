"""Every registered query of the engine with its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered already")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


MODULES = ("relational", "functions", "retrieval", "graph", "session", "layers")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
