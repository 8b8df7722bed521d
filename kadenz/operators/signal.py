"""Signal operators over long tables of samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.joins import nearest
from kadenz.operators.recordings import added, waves, whitened, without_noise
from kadenz.operators.stats import hop_windows


def volume(samples: DataFrame, length: int, hop: int, value: str = "v", key: str = "rec_id", order: str = "t") -> DataFrame:
    """(key, k, db): 10 log10 of the mean Hann-weighted square in each complete window."""
    w = hop_windows(samples, length, hop, value, key, order)
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("p") / (length - 1))
    return w.groupBy(key, "k").agg((10 * F.log10(F.avg(hann * (F.col(value) * F.col(value) + 1e-10)))).alias("db"))


def signal_to_noise(samples: DataFrame, mask: str, value: str) -> DataFrame:
    """(a, b, snr): difference of the medians of each two masks; one row per mask is crossed."""
    m = samples.groupBy(mask).agg(F.percentile(value, 0.5).alias("m"))
    a, b = m.select(F.col(mask).alias("a"), F.col("m").alias("ma")), m.select(F.col(mask).alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", (F.col("ma") - F.col("mb")).alias("snr"))


def cross_correlation(a: DataFrame, b: DataFrame, most: int, value: str = "v", key: str = "rec_id", order: str = "t") -> DataFrame:
    """(key, lag, c): sum of a[n] * b[n + lag] for lags up to `most` either way."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    left = a.select(key, F.col(value).alias("va"), n.alias("na")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("nb", F.col("na") + F.col("lag"))
    right = b.select(key, F.col(value).alias("vb"), n.alias("nb"))
    return left.join(right, [key, "nb"]).groupBy(key, "lag").agg(F.sum(F.col("va") * F.col("vb")).alias("c"))


def clip_windows(lengths: DataFrame, key: str, frames: int, n: str = "n") -> DataFrame:
    """(key, clip): every window of `frames` consecutive frames, by its first one; recordings shorter than that have none."""
    return lengths.where(F.col(n) >= frames).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - frames)).alias("clip"))


def speaker_by_delay(samples: DataFrame, delays: DataFrame, loud: float, early: float, value: str = "v", key: str = "rec_id", t: str = "t") -> DataFrame:
    """Adds a: the sample is loud, and the nearest delay measurement, if any, comes less than `early` after it."""
    near = nearest(samples, delays, [value], key, t)
    return near.withColumn("a", (F.col(value) > loud) & F.coalesce(F.col("near_t") - F.col(t) < early, F.lit(True)))


def binned(samples: DataFrame, bins: int, value: str = "v", key: str = "rec_id", order: str = "t") -> DataFrame:
    """(key, bin, m): mean of each of `bins` equal parts of a long sequence; the last part holds the rest."""
    i = samples.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).alias("i"), F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) / bins).alias("jump"))
    return i.where("jump > 0").groupBy(key, F.least(F.floor(F.col("i") / F.col("jump")), F.lit(bins - 1)).alias("bin")).agg(F.avg(value).alias("m"))


def _in_order(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whitened cross-correlations of rows of a and b, transforms written out as sums in order of samples."""
    length = a.shape[1]
    cos, sin = waves(length + 1, range(length), 2 * length)
    sums = []
    for x in (a, b):
        x = x - added(x)[:, None] / length
        real, imaginary = np.zeros((2, len(x), length + 1))
        for i in range(length):
            real += x[:, i, None] * cos[:, i]
            imaginary += x[:, i, None] * sin[:, i]
        sums += [real, -imaginary]
    ar, ai, br, bi = sums
    return whitened(ar * br + ai * bi, ar * bi - ai * br, most, 2 * length)


def _transformed(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whitened cross-correlations of rows of a and b by fast transforms, without components of rounding alone."""
    n = 2 * a.shape[1]
    a, b = (x - x.mean(1, keepdims=True) for x in (a, b))
    cross = without_noise(np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n), (np.abs(a).sum(1) * np.abs(b).sum(1))[:, None])
    return np.fft.irfft(cross / np.maximum(np.abs(cross), 1e-12), n)[:, np.arange(-most, most + 1)]


def delays(windows: DataFrame, most: int, keys: list[str], in_order: bool = False) -> DataFrame:
    """(keys, lag, c): peak of the whitened cross-correlation (GCC-PHAT) of arrays a and b of each window.

    A window with hardly any variance, or with arrays of different length, has a null lag. One window is one
    row, so the transforms run in Arrow batches without gathering a recording. `in_order` writes the transform out in
    sums and whitens components that are 0 but for rounding with the others, as its SQL does: for short windows.
    """

    def peak(batches):
        for pdf in batches:
            a, b = pdf.pop("a"), pdf.pop("b")
            lag, best = np.zeros(len(pdf), int), np.full(len(pdf), np.nan)
            found = np.zeros(len(pdf), bool)
            long = a.map(len).where(a.map(len) == b.map(len), 0).to_numpy()
            for length in set(long[long > 1]):
                at = np.flatnonzero(long == length)
                x, y = (np.stack([np.asarray(v, float) for v in s.iloc[at]]) for s in (a, b))
                varied = ~((x.std(1) < 1e-9) | (y.std(1) < 1e-9))
                at, x, y = at[varied], x[varied], y[varied]
                c = (_in_order if in_order else _transformed)(x, y, most)
                k = np.abs(c).argmax(1)
                lag[at], best[at], found[at] = k - most, c[np.arange(len(at)), k], True
            yield pdf.assign(lag=pd.arrays.IntegerArray(lag, ~found), c=best)

    kinds = dict(windows.dtypes)
    return windows.select(*keys, "a", "b").mapInPandas(peak, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "lag long", "c double"]))
