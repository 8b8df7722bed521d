"""Linear mixed effects with random slopes: y = X beta + Z b + e, b ~ N(0, D) per group, e ~ N(0, s2).

All that a fit needs of a group is its number of rows and the cross products of (Z, X, y), which are summed before any
group is formed. EM then runs over this table of one row per group; a step sends the driver one row of sums whose number
depends on the columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.session import written


@dataclass
class Fit:
    """Fixed effects, covariance of the random ones, residual variance, and the log-likelihood before each step."""

    beta: np.ndarray
    between: np.ndarray
    within: float
    likelihood: list[float] = field(default_factory=list)


def cross_products(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, n, c0_0, c0_1, ...): rows and sums of products of each two columns. Rows with a null are left out."""
    rows = df.select(group, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna(subset=[f"v{i}" for i in range(len(columns))])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"c{i}_{j}") for i, j in pairs])


def _square(batch: pa.RecordBatch, m: int) -> np.ndarray:
    out = np.empty((batch.num_rows, m, m))
    for i in range(m):
        for j in range(i, m):
            out[:, i, j] = out[:, j, i] = batch.column(f"c{i}_{j}").to_numpy(zero_copy_only=False)
    return out


def _posterior(c: np.ndarray, q: int, p: int, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and covariance of each group's random effects, and Z'r."""
    zr = c[:, :q, -1] - c[:, :q, q : q + p] @ fit.beta
    cov = np.linalg.inv(c[:, :q, :q] / fit.within + np.linalg.inv(fit.between))
    return np.einsum("gij,gj->gi", cov, zr) / fit.within, cov, zr


def _step(groups: DataFrame, q: int, p: int, fit: Fit) -> tuple[Fit, float]:
    """One round: likelihood at `fit`, and the parameters that raise it."""
    m = q + p + 1
    # E[bb'], X'Z E[b], tr(Z'Z E[bb']), E[b]'Z'y, E[b]'Z'X, X'X, X'y, y'y, rows, groups, likelihood
    sizes = [q * q, p, 1, 1, p, p * p, p, 1, 1, 1, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for batch in batches:
            c, n = _square(batch, m), batch.column("n").to_numpy(zero_copy_only=False)
            mean, cov, zr = _posterior(c, q, p, fit)
            second = cov + mean[:, :, None] * mean[:, None, :]
            x, y = c[:, q : q + p, q : q + p], c[:, q : q + p, -1]
            rr = c[:, -1, -1] - 2 * y @ fit.beta + np.einsum("i,gij,j->g", fit.beta, x, fit.beta)
            log_v = n * np.log(fit.within) + np.linalg.slogdet(fit.between)[1] - np.linalg.slogdet(cov)[1]
            fitted = np.einsum("gi,gij,gj->g", zr, cov, zr) / fit.within**2
            xz = np.einsum("gij,gj->gi", c[:, q : q + p, :q], mean)
            parts = [
                second.sum(0).ravel(), xz.sum(0), [np.einsum("gij,gij->", c[:, :q, :q], second)], [np.einsum("gi,gi->", mean, c[:, :q, -1])], xz.sum(0),
                x.sum(0).ravel(), y.sum(0), [c[:, -1, -1].sum()], [n.sum()], [len(n)], [(-0.5 * (n * np.log(2 * np.pi) + log_v + rr / fit.within - fitted)).sum()],
            ]
            total += np.concatenate([np.asarray(v, float).ravel() for v in parts])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=[f"s{i}" for i in range(len(total))])

    names = [f"s{i}" for i in range(sum(sizes))]
    row = groups.mapInArrow(run, ", ".join(f"{s} double" for s in names)).agg(*[F.sum(s).alias(s) for s in names]).first()
    bb, xz, trace, by, _, xx, xy, yy, n, g, likelihood = (np.array(v) for v in np.split(np.array([row[s] for s in names]), np.cumsum(sizes)[:-1]))
    xx = xx.reshape(p, p)
    beta = np.linalg.solve(xx, xy - xz) if p else fit.beta
    # squared residuals under the new fixed effects, over the distribution of the random ones
    rest = yy[0] - 2 * beta @ xy + beta @ xx @ beta - 2 * (by[0] - xz @ beta) + trace[0]
    return Fit(beta, bb.reshape(q, q) / g[0], float(rest / n[0])), float(likelihood[0])


def random_slopes(df: DataFrame, group: str, random: list[str], y: str, fixed: list[str] | None = None, steps: int = 50, tolerance: float = 0.0) -> tuple[DataFrame, Fit]:
    """(group, effects) and the fit: fixed effects, the full covariance of the random ones and the residual variance by EM.

    Name a column of ones for an intercept. EM starts from no fixed effects and unit variances and ends after `steps`, or
    once the likelihood grows by less than `tolerance`; no step lowers it. Rows with a null are left out; a group without
    rows has no effects. Random effects that do not vary end near a singular covariance, where steps are small.
    """
    fixed = fixed or []
    q, p = len(random), len(fixed)
    kind = dict(df.dtypes)[group]
    groups = written(cross_products(df, group, [*random, *fixed, y]), "group-products")
    fit = Fit(np.zeros(p), np.eye(q), 1.0)
    history: list[float] = []
    for _ in range(steps):
        new, likelihood = _step(groups, q, p, fit)
        history.append(likelihood)
        fit = new
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    fit.likelihood = history

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, _, _ = _posterior(_square(batch, q + p + 1), q, p, fit)
            yield pa.RecordBatch.from_arrays([batch.column(group), pa.array(mean.tolist(), pa.list_(pa.float64()))], names=[group, "effects"])

    return groups.mapInArrow(effects, f"{group} {kind}, effects array<double>"), fit
