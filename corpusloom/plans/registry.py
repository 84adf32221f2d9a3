"""Collects the named queries of every plan module."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: names a (spark, sf_dir) -> DataFrame function and its SQL twin."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = Query(fn, sql)
        return fn

    return wrap


def _load() -> None:
    import corpusloom.plans as home

    for module in pkgutil.iter_modules(home.__path__):
        if module.name != "registry":
            importlib.import_module(f"{home.__name__}.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: q.run for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in _QUERIES.items() if q.sql}
