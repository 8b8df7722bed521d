"""Bootstrap intervals, conformal prediction and bagging weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.bootstrap import weighted_sums
from kadenz.operators.ordering import numbered, running
from kadenz.operators.splits import LIMITS, PRIME, portable_hash
from kadenz.session import written

def poisson_weight(key: str, draw: str) -> Column:
    """Draws of a row in a resample: Poisson(1) from the portable hash, in place of multinomial counts."""
    u = portable_hash(F.pmod(F.col(key).cast("long"), F.lit(PRIME)) * 7919 + F.col(draw) * 104729) / PRIME
    w = F.lit(len(LIMITS))
    for k in range(len(LIMITS) - 1, -1, -1):
        w = F.when(u < LIMITS[k], F.lit(k)).otherwise(w)
    return w


def bootstrap_mean(df: DataFrame, value: Column, key: str, draws: int, level: float = 0.95) -> DataFrame:
    """lower, center, upper of the mean of value over Poisson resamples; rows with a null are left out.

    Each task adds its rows up for all draws at once, as a product of weights and values, so rows are never multiplied by draws.
    """
    sums = weighted_sums(df, key, {"n": F.lit(1), "v": value}, draws)
    means = sums.select(F.try_divide("v", "n").alias("m"))
    a = (1 - level) / 2
    return means.agg(F.percentile("m", a).alias("lower"), F.percentile("m", 0.5).alias("center"), F.percentile("m", 1 - a).alias("upper"))


def clustered_bootstrap(per_cluster: DataFrame, value: str, cluster: str, draws: int, level: float = 0.95) -> DataFrame:
    """Resamples cluster values with replacement: in each draw as many picks as clusters, each pick by hash."""
    values = written(numbered(per_cluster.select(cluster, F.col(value).alias("v")), [cluster], "i").select(F.col("i").cast("int").alias("i"), "v"), "cluster-values")
    n = values.count()
    picks = per_cluster.sparkSession.range(draws * n).select((F.col("id") / n).cast("long").alias("draw"), (portable_hash("id", 3) % max(1, n) + 1).cast("int").alias("i"))
    means = picks.join(values, "i").groupBy("draw").agg(F.avg("v").alias("m"))
    a = (1 - level) / 2
    return means.agg(F.percentile("m", a).alias("lower"), F.percentile("m", 0.5).alias("center"), F.percentile("m", 1 - a).alias("upper"))


def conformal_interval(calibration: DataFrame, test: DataFrame, eps: float, y: str = "y", h: str = "h") -> DataFrame:
    """Adds low and high to test rows: h plus and minus the calibration error at position floor(n * eps + 1), largest first.

    The position is found in running counts of distinct errors, so no task holds the largest ones.
    """
    scores = calibration.select(F.abs(F.col(y) - F.col(h)).alias("s")).where("s IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    scores = written(scores.withColumn("down", -F.col("s")), "calibration")
    placed = running(scores, ["down"], {"before": "c"}).crossJoin(F.broadcast(scores.agg(F.sum("c").alias("n"))))  # one row
    bar = placed.where(F.col("before") < F.floor(F.col("n") * eps + 1) + 1).agg(F.min("s").alias("bar"))
    return test.crossJoin(F.broadcast(bar)).select("*", (F.col(h) - F.col("bar")).alias("low"), (F.col(h) + F.col("bar")).alias("high")).drop("bar")  # one row


def conformal_p_values(calibration: DataFrame, test: DataFrame, score: str, by: str) -> DataFrame:
    """Adds p to test rows: (calibration scores of the group at or above + 1) / (n + 1).

    Distinct scores of both are counted and laid together; counts run over ranges of a group's scores, not in one task for each group.
    """
    cal = calibration.groupBy(by, score).agg(F.count(F.lit(1)).alias("c"))
    there = test.select(by, score).distinct().withColumn("c", F.lit(0).cast("long"))
    both = cal.unionByName(there).groupBy(by, score).agg(F.sum("c").alias("c")).withColumn("__down", -F.col(score))
    both = written(both, "conformal-scores")
    above = running(both, ["__down"], {"__before": "c"}, keys=[by])
    total = both.groupBy(by).agg(F.sum("c").alias("__n"))  # one row per group
    p = above.join(total, by).select(by, score, ((F.col("__before") + F.col("c") + 1) / (F.col("__n") + 1)).alias("p"))
    return test.join(p, [by, score], "left")


def bagging(df: DataFrame, key: str, models: int) -> DataFrame:
    """(key, model, w): draws per model; a row that no model draws counts once in model 0."""
    rows = df.select(key).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
    rows = rows.withColumn("w", poisson_weight(key, "model"))
    alone = F.max("w").over(Window.partitionBy(key)) == 0
    return rows.withColumn("w", F.when(alone & (F.col("model") == 0), 1).otherwise(F.col("w")))
