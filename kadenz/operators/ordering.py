"""Numbers and running sums over a total order, without bringing all rows into one task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled values for each bound, bounds at most, and bounds up to which they stand in one tree of comparisons.
SAMPLED, MOST, TREE = 20, 4096, 64


def _tree(value: Column, bounds: list, low: int, high: int) -> Column:
    """How many of bounds[low:high] are at or below the value, plus low; by bisection."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(value < bounds[mid], _tree(value, bounds, low, mid)).otherwise(_tree(value, bounds, mid + 1, high))


def _literal(value, order: list[str], schema) -> Column:
    return F.struct(*[F.lit(v).cast(schema[c].dataType).alias(c) for v, c in zip(value, order, strict=True)])


def with_range(rows: DataFrame, order: list[str], name: str = "__b") -> DataFrame:
    """Adds a range number that rises with the order columns (ascending, nulls first).

    A sample of rows by hash gives bounds over the whole tuple, so rows that agree in the first column are spread too;
    a row's place is part of its hash, so copies of one tuple take their share of the sample and no more. The driver sees
    SAMPLED values for each shuffle partition. Once there are bounds, a row's range depends on its values alone, so a
    task that runs again gives the same. Rows that agree in all order columns share a range.
    """
    parts = min(MOST, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = rows.select(*order).orderBy(F.xxhash64(*order, F.monotonically_increasing_id()), *order).limit(SAMPLED * parts).collect()
    found = sorted(map(tuple, sample), key=lambda row: [(v is not None, v != v, v if v == v else 0) for v in row])[SAMPLED - 1 :: SAMPLED]
    bounds = [_literal(b, order, rows.schema) for b in dict.fromkeys(found)]
    value = F.struct(*order)
    if len(bounds) <= TREE:
        return rows.withColumn(name, _tree(value, bounds, 0, len(bounds)))
    # a tree over every width-th bound, then the few between two of them
    width = isqrt(len(bounds))
    coarse = bounds[width::width]
    slots = F.array(*[F.array(*bounds[i : i + width]) for i in range(0, len(bounds), width)])
    at = _tree(value, coarse, 0, len(coarse))
    return rows.withColumn("__at", at).withColumn(name, (F.col("__at") * width + F.size(F.filter(slots[F.col("__at")], lambda b: b <= F.struct(*order)))).cast("int")).drop("__at")


def running(rows: DataFrame, order: list[str], sums: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Adds, under each name, the sum of a column over the rows before, per key; 0 for the first.

    Rows are summed within ranges, and a range starts from the sums of those before it. Ranges rise with (keys, order), so
    of the keys in a range only its first can have rows in earlier ones: the starts that are not 0 are at most one row per
    range, MOST in all, and are broadcast whatever the number of rows and keys. Rows move once, to their ranges.
    Give an order without ties: rows that tie come in any order.
    """
    keys = keys or []
    placed = with_range(rows, [*keys, *order])
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__b", F.count(F.lit(1)).over(ahead).alias("__ranges"), *[F.sum(f"__t_{n}").over(ahead).alias(f"__s_{n}") for n in sums]).where("__ranges > 0")
    own = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__w_{n}") for n, c in sums.items()])
    same = [own["__b"] == starts["__b"], *[own[k].eqNullSafe(starts[k]) for k in keys]]
    met = own.join(F.broadcast(starts), same, "left")  # at most one row per range
    return met.select(*[own[c] for c in rows.columns], *[(F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.col(f"__w_{n}")).alias(n) for n in sums])


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Adds 1, 2, ... in the given total order."""
    one = running(rows.withColumn("__one", F.lit(1).cast("long")), order, {"__before": "__one"})
    return one.withColumn(name, F.col("__before") + 1).drop("__one", "__before")
