"""User-function surface: metrics, row transforms, learn/apply/revert, maps over recordings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric(df: DataFrame, keys: list[str], functions: dict[str, Callable[[DataFrame, list[str]], DataFrame]]) -> DataFrame:
    """(keys, metric, value) of functions (df, keys) -> (keys, value); each stays one aggregate plan."""
    parts = [f(df, keys).select(*keys, F.lit(n).alias("metric"), F.col("value").cast("double").alias("value")) for n, f in functions.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def transformed(df: DataFrame, functions: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Functions applied in order."""
    return reduce(lambda d, f: d.transform(f), functions, df)


def per_recording(df: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """A pandas function per recording; for user code that no DataFrame operator covers."""
    return df.groupBy(key).applyInPandas(function, schema)


class Transform:
    """Three callables: learn(df) -> learned, apply(df, learned) -> df, revert(df, learned) -> df."""

    def __init__(self, learn: Callable, apply: Callable, revert: Callable):
        self.learn, self._apply, self._revert, self.learned = learn, apply, revert, None

    def fit(self, df: DataFrame) -> Transform:
        self.learned = self.learn(df)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self.learned)

    def revert(self, df: DataFrame) -> DataFrame:
        return self._revert(df, self.learned)
