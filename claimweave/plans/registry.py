"""Registry of named queries and of the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..bridge import Bridge, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(bridge)`` as a query of (spark, sf_dir); ``sql`` may name domain tables (g_*)."""

    def register(f: Callable[[Bridge], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Bridge(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_tables(sql)
        return f

    return register
