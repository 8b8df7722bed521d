"""Bootstrap intervals of any metric, of one model or two and their paired difference.

A resample draws each row a number of times, which is its weight; weights come from a hash of the row's key and the draw's
number, so both models see the same resamples and a task that runs again gives the same. Metrics are functions of
weighted sums, of weighted cell counts or of weighted rank sums. A task adds these up for all draws while it reads its rows,
as products of a matrix of weights and one of values, and hands on one row per draw: rows are never multiplied by draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.metrics import nominal_of
from kadenz.operators.splits import LIMITS, PRIME

#: Weights that a task works out at once.
BLOCK = 2_000_000


def weights(keys: np.ndarray, draws: int) -> np.ndarray:
    """Draws x rows: the numbers that resample.poisson_weight gives."""
    x = (np.mod(keys, PRIME)[None] * 7919 + np.arange(draws, dtype=np.int64)[:, None] * 104729) % PRIME
    for _ in range(2):
        x = (x * 1103515245 + 42) % PRIME
    return np.searchsorted(LIMITS, x / PRIME, side="right").astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    size = max(1, BLOCK // draws)
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            rows = batch.slice(at, size)
            yield rows, weights(rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64), draws)


def weighted_sums(df: DataFrame, key: str, values: dict[str, Column], draws: int) -> DataFrame:
    """(draw, and each name): the sum of a value over a resample. Rows with a null among them are left out."""
    names = list(values)
    rows = df.select(F.col(key).cast("long").alias("__key"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((draws, len(names)))
        for block, w in _blocks(batches, draws):
            sums += w @ np.column_stack([block.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), *map(pa.array, sums.T)], names=["draw", *[f"v{i}" for i in range(len(names))]])

    parts = rows.mapInArrow(run, ", ".join(["draw int", *[f"v{i} double" for i in range(len(names))]]))
    return parts.groupBy("draw").agg(*[F.sum(f"v{i}").alias(n) for i, n in enumerate(names)])


def interval_scores(df: DataFrame, key: str, y: str, models: dict[str, str], draws: int) -> DataFrame:
    """(draw, model, metric, value): mse, rmse, mae, ccc and pcc. Rows with a null target or prediction are left out."""
    df = df.dropna(subset=[y, *models.values()])
    means = df.agg(F.avg(y).alias("y"), *[F.avg(h).alias(m) for m, h in models.items()]).first()  # sums about the means keep their digits
    if means.y is None:
        return df.sparkSession.createDataFrame([], "draw int, model string, metric string, value double")
    a = F.col(y).cast("double") - float(means.y)
    values = {"n": F.lit(1), "y": a, "yy": a * a}
    for i, (m, h) in enumerate(models.items()):
        b, d = F.col(h).cast("double") - float(means[m]), F.col(y).cast("double") - F.col(h).cast("double")
        values |= {f"h{i}": b, f"hh{i}": b * b, f"yh{i}": a * b, f"d{i}": d * d, f"l{i}": F.abs(d)}
    sums = weighted_sums(df, key, values, draws)
    n, my = F.col("n"), F.col("y") / F.col("n")
    vy = F.col("yy") / n - my * my
    found = []
    for i, m in enumerate(models):
        mh = F.col(f"h{i}") / n
        vh, cov = F.col(f"hh{i}") / n - mh * mh, F.col(f"yh{i}") / n - my * mh
        gap = my - mh + float(means.y) - float(means[m])
        scores = {"mse": F.col(f"d{i}") / n, "rmse": F.sqrt(F.col(f"d{i}") / n), "mae": F.col(f"l{i}") / n, "ccc": F.coalesce(F.try_divide(2 * cov, vy + vh + gap * gap), F.lit(0.0)), "pcc": F.coalesce(F.try_divide(cov, F.sqrt(vy * vh)), F.lit(0.0))}
        found += [F.struct(F.lit(m).alias("model"), F.lit(k).alias("metric"), v.alias("value")) for k, v in scores.items()]
    return sums.where("n > 0").select("draw", F.explode(F.array(*found)).alias("s")).select("draw", "s.*")


def nominal_scores(df: DataFrame, key: str, y: str, models: dict[str, str], k: int, draws: int) -> DataFrame:
    """(draw, model, metric, value): accuracy, balanced, macro and weighted scores of classes 0 to k - 1, from weighted confusion tables."""
    rows = df.select(F.col(key).cast("long").alias("__key"), *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate([y, *models.values()])]).dropna()
    names = list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(names), draws, k * k))
        for block, w in _blocks(batches, draws):
            true = block.column(1).to_numpy(zero_copy_only=False)
            for m in range(len(names)):
                cell = true * k + block.column(m + 2).to_numpy(zero_copy_only=False)
                order = np.argsort(cell, kind="stable")
                there, first = np.unique(cell[order], return_index=True)
                cells[m][:, there] += np.add.reduceat(w[:, order], first, axis=1)
        m, d, c = (x.ravel() for x in np.indices(cells.shape))
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(d, pa.int32()), pa.array(c // k, pa.int32()), pa.array(c % k, pa.int32()), pa.array(cells.ravel())], names=["m", "draw", "i", "j", "n"])

    parts = rows.mapInArrow(run, "m int, draw int, i int, j int, n double").groupBy("m", "draw", "i", "j").agg(F.sum("n").alias("n"))
    model = F.array(*map(F.lit, names))[F.col("m")]
    wide = nominal_of(parts, ["m", "draw"]).withColumn("model", model).drop("m")
    return wide.unpivot(["draw", "model"], [c for c in wide.columns if c not in ("draw", "model")], "metric", "value")


def auc_scores(df: DataFrame, key: str, positive: Column, models: dict[str, str], draws: int) -> DataFrame:
    """(draw, model, metric auc, value): rank sums with ties as a half; null where a resample lacks a class.

    Rows are dealt by ranges of the score and read in order. A range hands on, per draw, its positives, its negatives and the
    pairs that it orders by itself; ranges then meet like the two halves of a merge, one row per range and draw.
    """
    out = None
    for name, score in models.items():
        rows = df.select(F.col(key).cast("long").alias("__key"), F.col(score).cast("double").alias("s"), positive.cast("boolean").alias("p")).dropna()
        parts = rows.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(_ordered_pairs(draws), "lowest double, draw int, p double, q double, won double")
        below = F.coalesce(F.sum("q").over(Window.partitionBy("draw").orderBy("lowest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # one row per range
        one = parts.withColumn("below", below).groupBy("draw").agg(F.try_divide(F.sum(F.col("won") + F.col("p") * F.col("below")), F.sum("p") * F.sum("q")).alias("value"))
        one = one.select("draw", F.lit(name).alias("model"), F.lit("auc").alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def _ordered_pairs(draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q, won, lowest = np.zeros(draws), np.zeros(draws), np.zeros(draws), None
        tied, at = np.zeros((2, draws)), None  # the last score's positives and negatives, which may go on in the next block
        for block, w in _blocks(batches, draws):
            s, y = (block.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            lowest = s[0] if lowest is None else lowest
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            pos, neg = (np.add.reduceat(np.where(y == side, w, 0.0), starts, axis=1) for side in (True, False))
            if at == s[0]:
                pos[:, 0] += tied[0]
                neg[:, 0] += tied[1]
            elif at is not None:
                pos, neg = np.column_stack([tied[0], pos]), np.column_stack([tied[1], neg])
            tied, at = np.stack([pos[:, -1], neg[:, -1]]), s[-1]
            pos, neg = pos[:, :-1], neg[:, :-1]
            below = q[:, None] + np.cumsum(neg, axis=1) - neg
            won += (pos * (below + neg / 2)).sum(axis=1)
            p, q = p + pos.sum(axis=1), q + neg.sum(axis=1)
        if at is not None:
            won += tied[0] * (q + tied[1] / 2)
            columns = [np.full(draws, lowest), np.arange(draws, dtype=np.int32), p + tied[0], q + tied[1], won]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["lowest", "draw", "p", "q", "won"])

    return run


def intervals(scores: DataFrame, level: float = 0.95) -> DataFrame:
    """(model, metric, lower, center, upper) of (draw, model, metric, value); with models 1 and 2 also of their difference, 1-2.

    The difference is taken within a draw, where both models have the same resample, so it is a paired comparison.
    """
    pair = scores.groupBy("draw", "metric").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"v{m}") for m in ("1", "2")])
    both = pair.select(F.lit("1-2").alias("model"), "metric", (F.col("v1") - F.col("v2")).alias("value"))
    a = (1 - level) / 2
    cut = lambda q, n: F.percentile("value", q).alias(n)
    return scores.select("model", "metric", "value").unionByName(both).where("value IS NOT NULL").groupBy("model", "metric").agg(cut(a, "lower"), cut(0.5, "center"), cut(1 - a, "upper"))
