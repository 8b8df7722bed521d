"""Joins on time: containment, overlap, nearest sample, lookup; all keyed by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Intervals of similar length share a bin width: the next power of STEP. SHORTEST is the least length told apart.
STEP, SHORTEST = 8.0, 1e-6


class Bins:
    """Bin widths by level; one level for all intervals, if a width is given."""

    def __init__(self, width: float | None, *sides: tuple[DataFrame, str, str]):
        self.fixed = width
        found = {0} if width else {r.level for df, *ends in sides for r in df.select(self.level(*ends).alias("level")).where("level IS NOT NULL").distinct().collect()}
        self.levels = F.array(*[F.lit(x) for x in sorted(found)]).cast("array<int>")  # a few dozen at most

    def level(self, begin: str, end: str) -> Column:
        if self.fixed:
            return F.lit(0)
        length = F.greatest(F.col(end) - F.col(begin), F.lit(SHORTEST))
        return F.ceil(F.round(F.log(length) / F.log(F.lit(STEP)), 9)).cast("int")

    def of(self, t: str) -> Column:
        """The bin of a time on the row's level."""
        return F.floor(F.col(t) / (F.lit(self.fixed) if self.fixed else F.pow(F.lit(STEP), F.col("__level"))))

    def touched(self, begin: str, end: str) -> Column:
        return F.explode(F.sequence(self.of(begin), self.of(end)))


def contains(points: DataFrame, intervals: DataFrame, key: str = "rec_id", t: str = "t", begin: str = "begin_t", end: str = "end_t", width: float | None = None) -> DataFrame:
    """Samples in intervals, both ends inclusive.

    An interval touches two bins of its level, and samples meet it on (key, level, bin), so a long recording is
    spread over many keys, and one very long interval is not cut into the bins of the short ones; the exact predicate
    follows. A sample is copied once for each level. An empty interval (end before begin) holds nothing.
    """
    there = intervals.where(F.col(end) >= F.col(begin))
    bins = Bins(width, (there, begin, end))
    right = there.withColumn("__level", bins.level(begin, end)).withColumn("__bin", bins.touched(begin, end))
    left = points.withColumn("__level", F.explode(bins.levels)).withColumn("__bin", bins.of(t))
    return left.join(right, [key, "__level", "__bin"]).where((F.col(t) >= F.col(begin)) & (F.col(t) <= F.col(end))).drop("__level", "__bin")


def overlaps(a: DataFrame, b: DataFrame, key: str = "rec_id", a_cols=("a_begin", "a_end"), b_cols=("b_begin", "b_end"), width: float | None = None) -> DataFrame:
    """Pairs of intervals that share more than a border.

    A pair is made on the level of its longer interval, in the first bin that both touch there, so none comes twice.
    """
    a, b = (df.where(F.col(end) >= F.col(begin)) for df, (begin, end) in ((a, a_cols), (b, b_cols)))
    bins = Bins(width, (a, *a_cols), (b, *b_cols))

    def binned(df: DataFrame, begin: str, end: str, own: str) -> DataFrame:
        rows = df.withColumn(own, bins.level(begin, end))
        rows = rows.withColumn("__level", F.explode(F.filter(bins.levels, lambda x: x >= F.col(own))))
        return rows.withColumn("__bin", bins.touched(begin, end))

    met = binned(a, *a_cols, "__la").join(binned(b, *b_cols, "__lb"), [key, "__level", "__bin"])
    first = F.greatest(bins.of(a_cols[0]), bins.of(b_cols[0]))
    own = (F.col("__level") == F.greatest("__la", "__lb")) & (F.col("__bin") == first)
    return met.where((F.col(a_cols[0]) < F.col(b_cols[1])) & (F.col(a_cols[1]) > F.col(b_cols[0])) & own).drop("__level", "__bin", "__la", "__lb")


def all_pairs_of(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, block: int = 4096) -> DataFrame:
    """Each row of a stated query set beside all rows, as blocks that meet by number; no side is broadcast or in one task."""
    nq, nr = (max(1, -(-df.count() // block)) for df in (queries, rows))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("__q", of(query_id, nq)).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    right = rows.withColumn("__r", of(row_id, nr)).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return right.join(left.hint("shuffle_hash"), ["__q", "__r"]).drop("__q", "__r")


def neighbours(grid: DataFrame, samples: DataFrame, values: list[str], key: str = "rec_id", t: str = "t", chunk: float = 86400.0) -> DataFrame:
    """Per grid row the last sample at or before (prev) and the first at or after (next): structs of t and values.

    Grid and samples are laid together and carried along in time within chunks of a recording; what enters a chunk
    from outside is carried over one row per chunk. So no task holds a whole recording.
    """
    content = F.struct(F.col(t).alias("t"), *values)
    cols = grid.columns
    both = grid.select(*cols, F.lit(None).cast(samples.select(content.alias("s")).schema["s"].dataType).alias("s"), F.lit(1).alias("is_grid"))
    missing = [F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in cols if c not in (key, t)]
    both = both.unionByName(samples.select(key, t, content.alias("s"), F.lit(0).alias("is_grid"), *missing)).withColumn("chunk", F.floor(F.col(t) / chunk))
    # both frames grow row by row; one that shrinks towards its end would be read anew for each row
    back, ahead = (Window.partitionBy(key, "chunk").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc(t), F.desc(t)))
    near = both.withColumn("prev", F.last("s", ignorenulls=True).over(back)).withColumn("next", F.last("s", ignorenulls=True).over(ahead)).where("is_grid = 1")
    chunks = both.groupBy(key, "chunk").agg(F.max("s").alias("hi"), F.min("s").alias("lo"))
    earlier, later = (Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("chunk"), F.desc("chunk")))
    chunks = chunks.select(
        F.col(key).alias("__key"), F.col("chunk").alias("__chunk"),
        F.last("hi", ignorenulls=True).over(earlier).alias("before"), F.last("lo", ignorenulls=True).over(later).alias("after"),
    )
    out = near.join(chunks, (near[key] == chunks["__key"]) & (near["chunk"] == chunks["__chunk"]))
    return out.select(*cols, F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def nearest(grid: DataFrame, samples: DataFrame, values: list[str], key: str = "rec_id", t: str = "t", tolerance: float | None = None) -> DataFrame:
    """The sample nearest in time for each grid row; a tie takes the later one. Null beyond the tolerance, which is exclusive."""
    near = neighbours(grid, samples, values, key, t)
    later = F.col("prev").isNull() | (F.col("next.t") - F.col(t) <= F.col(t) - F.col("prev.t"))
    best = near.withColumn("s", F.when(F.col("next").isNotNull() & later, F.col("next")).otherwise(F.col("prev")))
    if tolerance is not None:
        best = best.withColumn("s", F.when(F.abs(F.col("s.t") - F.col(t)) < tolerance, F.col("s")))
    return best.select(*grid.columns, F.col("s.t").alias("near_t"), *[F.col(f"s.{v}").alias(f"near_{v}") for v in values])


def without_overlap(intervals: DataFrame, key: str = "rec_id", begin: str = "begin_t", end: str = "end_t", tie: str = "seg_id") -> DataFrame:
    """Cuts neighbours that overlap at (begin of the first + end of the second) / 2, and numbers intervals from 0."""
    w = Window.partitionBy(key).orderBy(begin, tie)
    cut_end = F.when(F.lead(begin).over(w) < F.col(end), (F.col(begin) + F.lead(end).over(w)) / 2).otherwise(F.col(end))
    cut_begin = F.when(F.lag(end).over(w) > F.col(begin), (F.lag(begin).over(w) + F.col(end)) / 2).otherwise(F.col(begin))
    return intervals.select("*", cut_begin.alias("cut_begin"), cut_end.alias("cut_end"), (F.row_number().over(w) - 1).alias("interval_number"))


def grid(samples: DataFrame, rate: float, key: str = "rec_id", t: str = "t") -> DataFrame:
    """A regular clock per recording over the span of its samples, `rate` points a second."""
    span = samples.groupBy(key).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) * rate).cast("long"))
    return span.select(key, "lo", F.explode(steps).alias("k")).select(key, (F.col("lo") + F.col("k") / rate).alias(t))


def with_fallback(rows: DataFrame, lookup: DataFrame, key: str, clean: Column, columns: list[str]) -> DataFrame:
    """Lookup by the key; rows without a hit try their cleaned key, if it differs."""
    first = lookup.select(F.col(key).alias("__k1"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__1{c}") for c in columns])
    second = lookup.select(F.col(key).alias("__k2"), *[F.col(c).alias(f"__2{c}") for c in columns])
    out = rows.join(first, F.col(key) == F.col("__k1"), "left")
    retry = F.when(F.col("__hit").isNull() & (clean != F.col(key)), clean)
    out = out.withColumn("__retry", retry).join(second, F.col("__retry") == F.col("__k2"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"__1{c}", f"__2{c}").alias(c) for c in columns])
