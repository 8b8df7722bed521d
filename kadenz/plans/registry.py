"""Where queries register themselves with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir); without SQL a test covers the query."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    """Rounded to six decimals, so that the order of sums does not show; -0 becomes 0."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    # what is rounded is the product, as in SQL: a double's shortest decimals may end in a 5 that the double lies below
    return F.when(F.abs(c) < 1e300, F.round(c * 1e6) / 1e6).otherwise(c) + F.lit(0.0)


def signed6(c: str | Column) -> Column:
    """As r6, but what rounds to 0 keeps its sign, as in SQL: a list tells 0 and -0 apart where single numbers do not."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(c) < 1e300, F.round(F.abs(c) * 1e6) / 1e6 * F.signum(c)).otherwise(c)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns but the kept ones, rounded."""
    return df.select(*[r6(f"`{c}`").alias(c) if k == "double" and c not in keep else F.col(f"`{c}`") for c, k in df.dtypes])
