"""All queries of the catalogue operators, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photolake.plans.catalog import Catalog, oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of the catalogue as a query, with SQL over catalogue tables if that can express it."""

    def register(function: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered already")
        _QUERIES[name] = lambda spark, sf_dir: function(Catalog(spark, sf_dir))
        if sql:
            _SQL[name] = oracle(sql)
        return function

    return register


def _load() -> None:
    from importlib import import_module

    for name in ("timeline", "search", "stats", "people", "reconcile", "sync", "more"):
        import_module(f"photolake.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
