"""Registry of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hostelry.registry import fixtures


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers a query. ``uses`` names the stand-in tables its SQL reads."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else fixtures.with_tables(sql, uses)
        QUERIES[name] = Query(name, tuple(covers.split()), fn, text)
        return fn

    return add
