"""Splits, folds, shuffles and samples; all by a portable hash, so they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.ordering import numbered

PRIME = 2147483647

#: Cumulative chances of Poisson(1) for 0, 1, 2, ... draws, from exp(-1) / k!.
LIMITS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def portable_hash(column: str | Column, seed: int = 0) -> Column:
    """Two rounds of integer arithmetic that every SQL engine agrees on."""
    c = F.col(column) if isinstance(column, str) else column
    once = F.pmod(F.pmod(c.cast("long"), F.lit(PRIME)) * 1103515245 + (seed * 12345 + 42), F.lit(PRIME))
    return F.pmod(once * 1103515245 + (seed * 12345 + 42), F.lit(PRIME))


def portable_hash_sql(column: str, seed: int = 0) -> str:
    once = f"((({column} % {PRIME}) * 1103515245 + {seed * 12345 + 42}) % {PRIME})"
    return f"(({once} * 1103515245 + {seed * 12345 + 42}) % {PRIME})"


def stratified(df: DataFrame, label: str, tie: str, proportions: list[int], seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Adds partition: rows sorted by label are dealt, block by block of sum(proportions) rows, in shuffled order."""
    k = sum(proportions)
    rows = numbered(df, [label, tie], "__rn").withColumn("__block", F.floor((F.col("__rn") - 1) / k))
    w = Window.partitionBy("__block").orderBy(portable_hash(tie, seed), tie)
    rows = rows.withColumn("__at", F.row_number().over(w) - 1)
    part = F.lit(0)
    start = 0
    for p, size in enumerate(proportions):
        part = F.when((F.col("__at") >= start) & (F.col("__at") < start + size), F.lit(p)).otherwise(part)
        start += size
    return rows.withColumn("partition", part).drop("__rn", "__block", "__at")


def fold_roles(df: DataFrame, fold: str, folds: int = 5) -> DataFrame:
    """Each row once per test fold f: test where its fold is f, validation in the next one, training elsewhere."""
    f = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("f"))
    role = F.when(F.col(fold) == F.col("f"), "test").when(F.col(fold) == (F.col("f") + 1) % folds, "validation").otherwise("training")
    return df.crossJoin(F.broadcast(f)).withColumn("role", role)  # `folds` rows


def fold_of(key: str, folds: int = 5, seed: int = 0) -> Column:
    """Fold of a group key; no group crosses folds."""
    return (portable_hash(key, seed) % folds).cast("int")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A fixed sample of n rows."""
    return df.orderBy(portable_hash(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds position: a permutation of the rows from 1."""
    return numbered(df.withColumn("__h", portable_hash(key, seed)), ["__h", key], "position").drop("__h")


def chunks(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Adds chunk: k chunks in order, whose sizes differ by at most one, larger ones first."""
    return chunks_of_numbered(numbered(df, order, "__rn"), "__rn", df.count(), k).drop("__rn")


def chunks_of_numbered(rows: DataFrame, number: str, n: int, k: int) -> DataFrame:
    """As chunks, for n rows that have their numbers, from 1, already."""
    small, extra = divmod(n, k)
    i = F.col(number) - 1
    big = extra * (small + 1)
    chunk = F.when(i < big, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - big) / max(1, small))) + 1
    return rows.withColumn("chunk", chunk.cast("int"))
