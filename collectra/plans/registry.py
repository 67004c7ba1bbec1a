"""Named queries and, where SQL can say the same, their DuckDB form."""
from __future__ import annotations

import inspect
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MODULES = ["quality", "dates_text", "selection", "authority", "review", "export", "ingest", "models"]


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = inspect.cleandoc(sql)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"collectra.plans.{module}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
