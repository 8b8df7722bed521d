"""Registry of the library's queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kadenz.plans import metric_queries, more_queries, source_queries, table_queries, time_queries  # noqa: F401
from kadenz.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all recordings summarised per labelled interval (row A2)."""
    return time_queries.a2(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
