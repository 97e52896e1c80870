"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers ``f(*views)``, a function of the named views, as a query; ``sql`` is its twin for DuckDB."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register
