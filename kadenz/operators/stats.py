"""Statistic maps, rolling windows, moments and fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.ordering import running, with_range
from kadenz.session import written

#: Statistic by name. std, var and iqr of fewer than two values are 0.
STATISTICS = {
    "mean": lambda c: F.avg(c), "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "var": lambda c: F.coalesce(F.var_samp(c), F.lit(0.0)),
    "median": lambda c: F.percentile(c, 0.5), "iqr": lambda c: F.coalesce(F.percentile(c, 0.75) - F.percentile(c, 0.25), F.lit(0.0)),
    "min": lambda c: F.min(c), "max": lambda c: F.max(c), "sum": lambda c: F.sum(c), "count": lambda c: F.count(c),
}


def columns_of(statistics: dict[str, list[str]], there: list[str]) -> list[Column]:
    """Aggregates named column_statistic; columns that are absent are passed over."""
    return [STATISTICS[s](F.col(c)).alias(f"{c}_{s}") for s, cols in statistics.items() for c in cols if c in there]


def aggregate(df: DataFrame, statistics: dict[str, list[str]], keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(*columns_of(statistics, df.columns))


def aggregate_to_intervals(samples: DataFrame, intervals: DataFrame, statistics: dict[str, list[str]], ids: list[str]) -> DataFrame:
    """Statistics of the samples in each interval. Every interval stays: empty ones have null, and 0 for dispersion."""
    from kadenz.operators.joins import contains

    got = aggregate(contains(samples, intervals), statistics, ids)
    zero = {c: 0.0 for c in got.columns if c.endswith(("_std", "_var", "_iqr"))}
    return intervals.select(*ids).join(got, ids, "left").fillna(zero)


#: Statistics by the beginning of a column's name: first match wins.
RULES = (("is_", ["mean"]), ("count_", ["max"]), ("acoustic_", ["mean", "std"]), ("vision_", ["median", "iqr"]), ("language_", ["mean"]))


def suggest(columns: list[str], rules=RULES) -> dict[str, list[str]]:
    """Which statistics fit which columns; unknown ones get the mean."""
    if len(set(columns)) != len(columns):
        raise ValueError("a column name comes twice")
    out: dict[str, list[str]] = {}
    for c in columns:
        for s in next((names for start, names in rules if c.startswith(start)), ["mean"]):
            out.setdefault(s, []).append(c)
    return out


#: Rows of a window up to which it is a frame.
FRAME = 32


def rolling(df: DataFrame, column: str, window: int, names: list[str], key: str = "rec_id", order: str = "t") -> DataFrame:
    """Trailing statistics over the last `window` rows; null with fewer than window // 4 values, dispersion then 0.

    Short windows are frames, which are read anew for each row; longer ones slide over chunks of a recording.
    """
    if window > FRAME:
        from kadenz.operators.recordings import sliding

        return sliding(df, column, window, names, key, order)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    enough = F.count(column).over(w) >= max(1, window // 4)
    exprs = {"mean": F.avg(column).over(w), "std": F.stddev_samp(column).over(w), "median": F.percentile(column, 0.5).over(w), "iqr": F.percentile(column, 0.75).over(w) - F.percentile(column, 0.25).over(w), "min": F.min(column).over(w), "max": F.max(column).over(w)}
    out = df
    for n in names:
        value = F.when(enough, exprs[n])
        out = out.withColumn(f"{column}_{n}", F.coalesce(value, F.lit(0.0)) if n in ("std", "iqr") else value)
    return out


def filled(df: DataFrame, columns: list[str], key: str = "rec_id", order: str = "t", chunk: float = 86400.0) -> DataFrame:
    """Forward, then backward fill per recording, within chunks of time; a row per chunk carries values over its borders."""
    kept = df.columns
    rows = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    # both frames grow row by row, so a chunk is read once for each
    before, after = (Window.partitionBy(key, "__chunk").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order)))
    near = {f"__{side}{i}": F.last(c, ignorenulls=True).over(w) for i, c in enumerate(columns) for side, w in (("b", before), ("a", after))}
    there = [e for i, c in enumerate(columns) for e in (F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"l{i}"), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"f{i}"))]
    ends = rows.groupBy(key, "__chunk").agg(*there)
    earlier, later = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__chunk"), F.desc("__chunk")))
    over = [e for i in range(len(columns)) for e in (F.last(f"l{i}", ignorenulls=True).over(earlier).alias(f"__x{i}"), F.last(f"f{i}", ignorenulls=True).over(later).alias(f"__y{i}"))]
    ends = ends.select(F.col(key).alias("__key"), F.col("__chunk").alias("__c"), *over)
    rows = rows.withColumns(near)
    met = rows.join(ends, rows[key].eqNullSafe(ends["__key"]) & rows["__chunk"].eqNullSafe(ends["__c"]))
    found = {c: F.coalesce(f"__b{i}", f"__x{i}", f"__a{i}", f"__y{i}").alias(c) for i, c in enumerate(columns)}
    return met.select(*[found.get(c, rows[c]) for c in kept if c not in found], *found.values())


def sliding_rate(df: DataFrame, flag: Column, half: int, seconds: float, name: str = "rate", key: str = "rec_id", order: str = "t") -> DataFrame:
    """Flagged rows per second in windows of up to `half` rows either way; a whole window lasts `seconds`."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    share = F.count(F.lit(1)).over(w) / float(2 * half + 1)
    return df.withColumn(name, F.sum(flag.cast("int")).over(w) / (share * seconds))


def centred_means(df: DataFrame, value: str, half: int, least: int, name: str = "r", key: str = "rec_id", order: str = "t") -> DataFrame:
    """Mean of the rows up to `half` before and after, where the window has at least `least` values."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    return df.select("*", F.avg(value).over(w).alias(name), F.count(value).over(w).alias("__n")).where(F.col("__n") >= least).drop("__n")


def context_pool(df: DataFrame, value: Column, before: int, name: str, key: str, order: str) -> DataFrame:
    """Mean over the rows of the same key that come up to `before` rows earlier; null for the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-before, -1)
    return df.withColumn(name, F.avg(value).over(w))


def running_best(df: DataFrame, value: str, order: str, patience: int) -> DataFrame:
    """Adds best, best_epoch and stop (no better value for more than `patience` steps). Ranges of the order, with one row each for
    what came before, keep the rows of all epochs out of one task."""
    placed = with_range(df, [order])
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # of equal values the later epoch, as in one frame over all rows
    top = lambda v, o: F.struct(F.col(v).alias("v"), F.col(o).alias("o"))
    ends = placed.where(F.col(value).isNotNull()).groupBy("__b").agg(F.max(top(value, order)).alias("m"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = placed.select("__b").distinct().join(ends, "__b", "left").select(F.col("__b").alias("__c"), F.max("m").over(ahead).alias("__m"))
    own = placed.withColumn("__own", F.max(F.when(F.col(value).isNotNull(), top(value, order))).over(w))
    met = own.join(before, F.col("__b") == F.col("__c")).withColumn("__best", F.greatest("__own", "__m"))
    return met.select(*df.columns, F.col("__best.v").alias("best"), F.col("__best.o").alias("best_epoch"), (F.col(order) - F.col("__best.o") > patience).alias("stop"))


def median_step(df: DataFrame, key: str = "rec_id", order: str = "t") -> DataFrame:
    """(key, step): median of successive time differences."""
    w = Window.partitionBy(key).orderBy(order)
    steps = df.select(key, (F.col(order) - F.lag(order).over(w)).alias("d"))
    return steps.groupBy(key).agg(F.percentile("d", 0.5).alias("step"))


def hop_windows(df: DataFrame, length: int, hop: int, value: str, key: str = "rec_id", order: str = "t") -> DataFrame:
    """(key, k, n-th row, value) of complete windows of `length` rows every `hop` rows."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, value, (F.row_number().over(w) - 1).alias("i"))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - (length - 1)) / hop)).cast("long")
    rows = rows.withColumn("k", F.explode(F.sequence(low, F.floor(F.col("i") / hop).cast("long"))))
    rows = rows.withColumn("p", F.col("i") - F.col("k") * hop).where((F.col("p") >= 0) & (F.col("p") < length))
    whole = rows.groupBy(key, "k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == length).select(key, "k")
    return rows.join(whole, [key, "k"]).select(key, "k", "p", order, value)


def median_filtered(df: DataFrame, column: str, kernel: int, key: str = "rec_id", order: str = "t") -> DataFrame:
    """Median filter with an odd kernel; beyond the ends stand zeros, and nulls count as zeros."""
    half = kernel // 2
    if kernel > FRAME:
        from kadenz.operators.recordings import sliding_median

        return sliding_median(df, column, kernel, key, order)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    got = F.collect_list(F.coalesce(column, F.lit(0.0))).over(w)
    padded = F.array_sort(F.concat(got, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(got))))
    return df.withColumn(f"{column}_median", F.element_at(padded, half + 1))


def eroded(df: DataFrame, flag: str, n: int, key: str = "rec_id", order: str = "t") -> DataFrame:
    """True only where all rows up to n before and after are true; outside counts as false."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, n)
    return df.withColumn(f"{flag}_eroded", (F.min(F.col(flag).cast("int")).over(w) == 1) & (F.count(F.lit(1)).over(w) == 2 * n + 1))


def mean_ranks(df: DataFrame, column: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """0-based ranks; ties share their mean. Ties are counted before ranking, so the ranking runs over distinct values."""
    keys = keys or []
    values = written(df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__c")), "values")
    below = running(values, [column], {"__before": "__c"}, keys)
    return df.join(below.select(*keys, column, (F.col("__before") + (F.col("__c") - 1) / 2.0).alias(name)), [*keys, column])


def moments(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each column in one pass."""
    aggs = [e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(*(keys or [])).agg(*aggs)


def inverse_frequency_weights(df: DataFrame, key: str, counts: Column | None = None) -> DataFrame:
    """(key, n, weight): total / n, scaled to mean 1 over the keys."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if counts is not None:
        n = n.withColumn("n", counts)
    return n.crossJoin(n.agg(F.avg(1 / F.col("n")).alias("m"))).select(key, "n", (1 / F.col("n") / F.col("m")).alias("weight"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean that passes over null values."""
    there = value.isNotNull()
    return F.try_divide(F.sum(F.when(there, value * weight)), F.sum(F.when(there, weight)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
