"""Segments, pauses and behaviour markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.joins import overlaps


def segments(df: DataFrame, active: str, keys: list[str], t: str = "t", last_on: bool = False, chunk: float = 86400.0) -> DataFrame:
    """(keys, seg_id, begin_t, end_t): runs where `active` holds; null counts as off.

    A run ends at the first off sample after it, or, at the end of a recording, one median step after the last sample;
    with last_on it ends at its last on sample. Runs are found within chunks of time; a row per chunk (first and last
    sample, starts in it) tells the next ones what goes on and how many runs came before, so no task holds a recording.
    """
    on = F.coalesce(F.col(active), F.lit(False))
    w = Window.partitionBy(*keys, "__chunk").orderBy(t)
    rows = df.select(*keys, t, on.alias("__on"), F.floor(F.col(t) / chunk).alias("__chunk"))
    rows = rows.withColumns({"__was": F.lag("__on").over(w), "__prev": F.lag(t).over(w), "__next": F.lead(t).over(w)})
    rows = rows.withColumn("__new", (F.col("__on") & ~F.coalesce("__was", F.lit(False))).cast("int")).withColumn("__runs", F.sum("__new").over(w))
    # one row per chunk; a run that goes on from the chunk before is not new
    sums = rows.groupBy(*keys, "__chunk").agg(F.sum("__new").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.min_by("__on", t).alias("first"), F.max_by("__on", t).alias("last"))
    order = Window.partitionBy(*keys).orderBy("__chunk")
    sums = sums.withColumn("goes_on", (F.col("first") & F.coalesce(F.lag("last").over(order), F.lit(False))).cast("int"))
    before = F.coalesce(F.sum(F.col("n") - F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("goes_on")
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__c"), before.alias("__before"), F.lag("hi").over(order).alias("__hi"), F.lead("lo").over(order).alias("__lo"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(sums[f"__k{i}"]) for i, k in enumerate(keys)], rows["__chunk"] == sums["__c"])
    rows = rows.join(sums, same).select(*keys, t, "__on", (F.col("__before") + F.col("__runs")).alias("__run"), F.coalesce("__next", "__lo").alias("__next"), (F.col(t) - F.coalesce("__prev", "__hi")).alias("__d"))
    if last_on:
        out = rows.where("__on").groupBy(*keys, "__run").agg(F.min(t).alias("begin_t"), F.max(t).alias("end_t"))
    else:
        out = rows.where("__on").groupBy(*keys, "__run").agg(F.min(t).alias("begin_t"), F.max(F.struct(F.col(t).alias("t"), F.col("__next").alias("n"))).alias("l"))
        steps = rows.groupBy(*keys).agg(F.percentile("__d", 0.5).alias("__step"))
        out = out.join(steps, keys).withColumn("end_t", F.coalesce(F.col("l.n"), F.col("l.t") + F.coalesce("__step", F.lit(0.0))))
    return out.select(*keys, F.col("__run").alias("seg_id"), "begin_t", "end_t")


def longer(segs: DataFrame, seconds: float) -> DataFrame:
    return segs.where(F.col("end_t") - F.col("begin_t") > seconds)


def merged_pauses(a: DataFrame, b: DataFrame, gap: float, key: str = "rec_id") -> DataFrame:
    """Neighbouring segments of `a` become one where less than `gap` lies between and no segment of `b` overlaps that."""
    w = Window.partitionBy(key).orderBy("begin_t", "end_t")
    rows = a.withColumn("__end", F.lag("end_t").over(w)).withColumn("__row", F.row_number().over(w))
    gaps = rows.where((F.col("begin_t") - F.col("__end") < gap) & (F.col("begin_t") > F.col("__end"))).select(key, "__row", F.col("__end").alias("a_begin"), F.col("begin_t").alias("a_end"))
    hit = overlaps(gaps, b.select(key, F.col("begin_t").alias("b_begin"), F.col("end_t").alias("b_end")), key).select(key, "__row").distinct().withColumn("__hit", F.lit(True))
    rows = rows.join(hit, [key, "__row"], "left")
    starts = F.col("__end").isNull() | (F.col("begin_t") - F.col("__end") >= gap) | F.col("__hit").isNotNull()
    runs = rows.withColumn("__run", F.sum(starts.cast("int")).over(w))
    return runs.groupBy(key, F.col("__run").alias("seg_id")).agg(F.min("begin_t").alias("begin_t"), F.max("end_t").alias("end_t"))


def pauses(a: DataFrame, b: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, kind, begin_t, end_t): pauses of `a`. Without `b` in between: intra. `b` ends in it: inter, from its last end.

    A pause in which the last overlapping segment of `b` goes on is passed over.
    """
    w = Window.partitionBy(key).orderBy("begin_t", "end_t")
    gaps = a.select(key, F.col("end_t").alias("a_begin"), F.lead("begin_t").over(w).alias("a_end")).where("a_end > a_begin")
    hit = overlaps(gaps, b.select(key, F.col("begin_t").alias("b_begin"), F.col("end_t").alias("b_end")), key)
    last = hit.groupBy(key, "a_begin", "a_end").agg(F.max("b_end").alias("b_end"))
    both = gaps.join(last, [key, "a_begin", "a_end"], "left")
    kind = F.when(F.col("b_end").isNull(), "intra").when(F.col("b_end") < F.col("a_end"), "inter")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "kind", F.coalesce("b_end", "a_begin").alias("begin_t"), F.col("a_end").alias("end_t"))


def event_rate(segs: DataFrame, spans: DataFrame, key: str = "rec_id", least: float = 0.2) -> DataFrame:
    """(key, rate): segments longer than `least` per second of the recording (key, seconds)."""
    n = longer(segs, least).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return spans.join(n, key, "left").select(key, F.try_divide(F.coalesce("n", F.lit(0)), F.col("seconds")).alias("rate"))


def masked(df: DataFrame, columns: list[str], keep) -> DataFrame:
    """Columns become null where `keep` is false or null."""
    return df.withColumns({c: F.when(F.coalesce(keep, F.lit(False)), F.col(c)) for c in columns})
