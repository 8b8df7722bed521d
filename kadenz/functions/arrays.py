"""Array and vector functions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def elementwise_mean(arrays: list[Column]) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return F.transform(out, lambda x: x / len(arrays))


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, pooled): mean of the vectors of a group, element by element."""
    each = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e.m).alias("pooled"))


def padded(vector: Column, n: Column | int, fill: float = 0.0) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(vector, F.array_repeat(F.lit(fill), n.cast("int"))), F.lit(1), n.cast("int"))


def transposed(matrix: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.transform(matrix, lambda row: F.get(row, i)))


def interaction(a: Column, b: Column) -> Column:
    """Flattened outer product of both vectors with 1 appended, without the final 1."""
    one = F.array(F.lit(1.0))
    left, right = F.concat(a, one), F.concat(b, one)
    full = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: x * y)))
    return F.slice(full, F.lit(1), F.size(full) - 1)


def rbf(a: Column, b: Column, scale: float) -> Column:
    s = F.exp((2 * dot(a, b) - dot(a, a) - dot(b, b)) * scale)
    return F.least(F.greatest(s, F.lit(1e-8)), F.lit(1.0))


def cosine_similarity(a: Column, b: Column, scale: float) -> Column:
    cos = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.exp(cos * scale - scale)


def softmax_weighted(df: DataFrame, keys: list[str], score: str, value: str) -> DataFrame:
    """(keys, pooled): sum of softmax(score) * value per group."""
    top = F.max(score).over(Window.partitionBy(*keys))
    w = df.withColumn("__w", F.exp(F.col(score) - top))
    return w.groupBy(*keys).agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias("pooled"))


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def centred_kernel(pairs: DataFrame, kernel: str) -> DataFrame:
    """(i, j, c): a kernel minus its row, column and overall means (pairs hold all i, j)."""
    rows = pairs.groupBy("i").agg(F.avg(kernel).alias("ri"))
    cols = pairs.groupBy("j").agg(F.avg(kernel).alias("cj"))
    every = pairs.agg(F.avg(kernel).alias("m"))
    return pairs.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(every)).select("i", "j", (F.col(kernel) - F.col("ri") - F.col("cj") + F.col("m")).alias("c"))  # one row
