"""Queries by the ids of the operator inventory, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Further DuckDB views for the twins: normalised rows, their errors and what follows from these.
TWIN_VIEWS: dict[str, str] = {}


class Source:
    """Views of one folder of tables, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.VIEWS or name in fixtures.TABLES:
            return fixtures.view(self._spark, self._dir, name)
        raise AttributeError(name)

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def folder(self) -> str:
        return self._dir


def query(name: str, sql: str | None = None):
    """Register a function of a Source as the query name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = fixtures.with_views(sql, TWIN_VIEWS)
        return f

    return add
