"""The engine's queries, each with its SQL for another engine where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import catalog, dialect
from ..session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _tables(sql: str) -> list[str]:
    return [t for t in catalog.TABLES if re.search(rf"\b{t}\b", sql)]


def same(name: str, sql: str) -> None:
    """One statement that both engines read alike."""
    pair(name, sql, sql)


def pair(name: str, spark_sql: str, oracle: str | None) -> None:
    """A statement for this engine's front end, and its like."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        catalog.register(importable(spark), folder, _tables(spark_sql))
        return dialect.sql(spark, spark_sql)

    QUERIES[name] = run
    if oracle:
        ORACLE[name] = oracle


def built(name: str, oracle: str | None = None):
    """A function of ``(tables, spark)``; ``tables`` gives a table by its name."""

    def put(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda t: catalog.table(spark, folder, t), importable(spark))

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return fn

    return put


from . import aggregates, changes, extras, intelligence, joins, more, scalars, scans, tables, windows  # noqa: E402, F401
