"""All queries of the raster engine with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _loaded() -> None:
    from terralith.plans import cameras, files, fits, geometry, params, rasters, sharpen, tables, tags  # noqa: F401


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_sql)
