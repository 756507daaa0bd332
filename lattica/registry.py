"""All queries of the engine, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import catalog

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {q.name: q.run for q in catalog.all_queries()}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.oracle for q in catalog.all_queries() if q.oracle is not None}
