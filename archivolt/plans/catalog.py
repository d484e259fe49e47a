"""All named queries of the engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archivolt.plans.standins import Tables, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    """Register a function of Tables under its name, with the SELECT that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = (with_(*needs) if needs else "") + sql
        return f

    return add


from archivolt.plans import admin, documents, knowledge, retrieval, scorecard  # noqa: E402,F401,I001
from archivolt.plans import application, files  # noqa: E402,F401,I001
