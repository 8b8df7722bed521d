"""Linear models from sums: ridge and lasso over penalties and folds in one read, and support vector machines by Newton steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadenz.operators.gram import assembled, blocks, first_vector
from kadenz.operators.splits import portable_hash
from kadenz.session import written


def _vector(features: list[str] | str, *more: str) -> Column:
    return F.col(features) if isinstance(features, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in [*features, *more]])


def fold_products(df: DataFrame, features: list[str], y: str, fold: str) -> dict[int, np.ndarray]:
    """Sums of products of (1, features, y) of each fold, about one shift. Rows with a null are left out."""
    rows = df.dropna(subset=[*features, y]).select(F.col(fold).cast("int").alias("fold"), _vector(features, y).alias("v"))
    shift = first_vector(rows, "v")
    if shift is None:
        return {}
    parts: dict[int, list] = {}
    for r in blocks(rows, "v", "fold", shift).collect():
        parts.setdefault((r.k, r.d), []).append((r.i, r.j, r.s))
    return {k: assembled(d, p) for (k, d), p in sorted(parts.items())}


def _about_means(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, centred products of the features, and of the features with y."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    return n, mean, c[:-1, :-1], c[:-1, -1]


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b for symmetric matrices without negative eigenvalues, or stacks of them; directions of none are left at 0."""
    size, base = np.linalg.eigh(a)
    found = np.einsum("...ji,...j->...i", base, b)
    kept = size > 1e-13 * np.maximum(size[..., -1:], 1e-300)
    return np.einsum("...ij,...j->...i", base, np.where(kept, found / np.where(kept, size, 1.0), 0.0))


def ridge(m: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, coefficients) of the least sum of squares + penalty * |coefficients|^2; the intercept is free."""
    _, mean, xx, xy = _about_means(m)
    b = solved(xx + penalty * np.eye(len(xx)), xy)
    return np.concatenate([[mean[-1] - mean[:-1] @ b], b])


def lasso(m: np.ndarray, penalty: float, start: np.ndarray | None = None, sweeps: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """(intercept, coefficients) of the least mean of squares / 2 + penalty * |coefficients|_1 on standardised features."""
    n, mean, xx, xy = _about_means(m)
    scale = np.sqrt(np.diag(xx) / n)
    scale[scale == 0] = 1.0
    g, c = xx / n / np.outer(scale, scale), xy / n / scale
    b = np.zeros(len(c)) if start is None else start[1:] * scale
    for _ in range(sweeps):
        most = 0.0
        for i in range(len(b)):
            if g[i, i] <= 0:
                continue
            rest = c[i] - g[i] @ b + g[i, i] * b[i]
            new = np.sign(rest) * max(abs(rest) - penalty, 0.0) / g[i, i]
            most, b[i] = max(most, abs(new - b[i])), new
        if most < tolerance:
            break
    b = b / scale
    return np.concatenate([[mean[-1] - mean[:-1] @ b], b])


def squared_error(m: np.ndarray, b: np.ndarray) -> float:
    """Mean squared error of a model on the rows that these sums are of."""
    w = np.concatenate([-b, [1.0]])
    return float(max(w @ m @ w, 0.0) / m[0, 0])


FITS = {"ridge": ridge, "lasso": lasso}


def grid_search(df: DataFrame, features: list[str], y: str, fold: str, penalties: list[float], kind: str = "ridge") -> DataFrame:
    """(penalty, fold, training, validation, n): models fitted on all but one fold, and their mean squared errors.

    The table is read once, as one matrix of sums per fold. What a model is fitted on is the sum of all matrices less that of
    its fold, and its errors are quadratic forms of them, so no fit and no score reads rows. Folds are few, by design.
    """
    folds = fold_products(df, features, y, fold)
    out = []
    for k, own in folds.items():
        rest = sum((m for j, m in folds.items() if j != k), np.zeros_like(own))
        if rest[0, 0] == 0:
            continue
        for p in penalties:
            b = FITS[kind](rest, p)
            out.append((float(p), k, squared_error(rest, b), squared_error(own, b), int(own[0, 0])))
    return df.sparkSession.createDataFrame(out, "penalty double, fold int, training double, validation double, n long")


def selected(df: DataFrame, features: list[str], y: str, penalties: list[float], key: str, folds: int = 3, threshold: float = 1e-5) -> tuple[list[str], float]:
    """The features that a lasso keeps, and its penalty, which had the least validation error over folds by the key's hash."""
    rows = df.withColumn("__fold", (portable_hash(key, 7) % folds).cast("int"))
    parts = fold_products(rows, features, y, "__fold")
    total = sum(parts.values())
    held = lambda p: sum(squared_error(own, lasso(total - own, p)) * own[0, 0] for own in parts.values() if own[0, 0] < total[0, 0]) / total[0, 0]
    best = min(penalties, key=lambda p: (held(p), -p))
    b = lasso(total, best)[1:]
    return [f for f, c in zip(features, b, strict=True) if abs(c) >= threshold], best


@dataclass
class Machines:
    """Support vector machines: coefficients [C][class or 1][features + 1], the constant last, and their objectives.

    features: columns, or the name of one array column. mapped: makes of raw rows what the machines weigh, in tasks.
    """

    features: list[str] | str
    cs: list[float]
    classes: list[float] | None
    coefficients: np.ndarray
    objectives: np.ndarray
    mapped: Callable[[np.ndarray], np.ndarray] | None = None

    def predict(self, df: DataFrame, c: float, name: str = "h") -> DataFrame:
        """Adds the prediction of the machine for C = c: the class with the largest margin (of ties the first), or the value."""
        w = self.coefficients[self.cs.index(c)]
        if self.mapped is not None:
            return self._of_mapped(df, w, name)
        if not isinstance(self.features, str):  # plain sums
            margin = lambda k: sum((F.col(f"`{f}`").cast("double") * float(a) for f, a in zip(self.features, w[k][:-1], strict=True)), F.lit(float(w[k][-1])))
            return df.withColumn(name, self._decided(margin))
        x = F.col(self.features)
        weighed = lambda k: F.zip_with(x, F.lit(w[k][:-1].tolist()), lambda a, b: a * b)
        margin = lambda k: F.aggregate(weighed(k), F.lit(float(w[k][-1])), lambda s, v: s + v)
        return df.withColumn(name, self._decided(margin))

    def _decided(self, margin) -> Column:
        if self.classes is None:
            return margin(0)
        if len(self.classes) == 2:
            return F.when(margin(0) > 0, self.classes[1]).otherwise(self.classes[0])
        margins = F.array(*[margin(k) for k in range(len(self.classes))])
        at = F.array_position(margins, F.array_max(margins)).cast("int")
        return F.when(F.array_max(margins).isNotNull(), F.element_at(F.array(*map(F.lit, self.classes)), at))

    def _of_mapped(self, df: DataFrame, w: np.ndarray, name: str) -> DataFrame:
        """Margins from features that exist only while a task works on a batch; they are never columns."""
        kept, kinds = df.columns, dict(df.dtypes)
        inner = [f"__k{i}" for i in range(len(kept))]
        rows = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)], _vector(self.features).alias("__x"))
        mapped = self.mapped

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, max(b.num_rows, 1), 4096):
                    part = b.slice(at, 4096)
                    x = part.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    none = np.isnan(x).any(1)
                    margins = np.full((part.num_rows, len(w)), np.nan)
                    margins[~none] = mapped(x[~none]) @ w[:, :-1].T + w[:, -1]
                    columns = [pa.array(m, mask=none) for m in margins.T]
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in inner], *columns], names=[*inner, *[f"__m{k}" for k in range(len(w))]])

        schema = ", ".join([*[f"{i} {kinds[c]}" for c, i in zip(kept, inner, strict=True)], *[f"__m{k} double" for k in range(len(w))]])
        got = rows.mapInArrow(run, schema)
        return got.select(*[F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)], self._decided(lambda k: F.col(f"__m{k}")).alias(name))


def machines(df: DataFrame, features: list[str] | str, y: str, cs: list[float], classify: bool = True, epsilon: float = 0.1, balanced: bool = False, weight: str | None = None, steps: int = 50, tolerance: float = 1e-8, mapped: Callable[[np.ndarray], np.ndarray] | None = None, stored: bool = False) -> Machines:
    """Linear machines with squared hinge loss, one class against the rest, or with squared epsilon-insensitive loss, for all cs at once.

    The least of |w|^2 / 2 + C * sum of weight * loss, w with the constant. A Newton step needs a loss, a gradient and a matrix
    per machine, which tasks sum over their rows in one read at the step's end; only where a whole step gains too little
    are shorter ones tried, for all machines in one more read. The number of reads does not depend on how many machines
    there are. mapped: makes features of raw rows in each read, so that wide ones are never written; stored: df lies in
    files already. Two classes need one machine. balanced: a class weighs as if all
    were equally frequent. features: columns, or one column of arrays of a length. Rows with a null are left out; features should be of like scale, as for any such machine.
    """
    # a column per feature goes to tasks much faster than an array of them
    x_columns = [F.col(features).cast("array<double>").alias("x")] if isinstance(features, str) else [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.dropna(subset=[*([features] if isinstance(features, str) else features), y, *([weight] if weight else [])]).select(*x_columns, F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    rows = rows if stored else written(rows, "machine-rows")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()} if classify else {}  # one row per class
    classes = sorted(counts) if classify else None
    k = 1 if not classify or len(classes) <= 2 else len(classes)
    share = {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()} if balanced else {}
    first = rows.first()
    if first is None:
        raise ValueError("no rows without nulls to learn from")
    made = mapped or (lambda x: x)
    raw = [first.x] if isinstance(features, str) else [first[: len(features)]]
    d, grid = made(np.array(raw, float)).shape[1] + 1, np.repeat(np.asarray(cs, float), k)
    coefficients = np.zeros((len(grid), d))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features with a constant, signs [rows, machines of one C] or targets, and weights."""
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if not part.num_rows:
                    continue
                if isinstance(features, str):
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                else:
                    x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))])
                x = np.column_stack([made(x), np.ones(part.num_rows)])
                t, w = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
                if balanced:
                    w = w * np.array([share[c] for c in t.tolist()])
                if classify:
                    t = np.where(t[:, None] == np.array(classes[1:] if k == 1 else classes)[None], 1.0, -1.0)[:, :k]
                yield x, t, w

    def losses(margin: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Slack of each row for machines in the columns; the loss is its square."""
        if classify:
            return np.maximum(0.0, 1 - np.tile(t, margin.shape[1] // k) * margin)
        return np.maximum(0.0, np.abs(t[:, None] - margin) - epsilon)

    def summed(partial, size: int) -> np.ndarray:
        """The sums over all rows of what `partial` makes of (x, t, w): `size` numbers from each task, added in Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for part in read(batches):
                total += partial(*part)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

        found = rows.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(size)
        for r in found:
            out[r.i] = r.s
        return out

    def reached(at: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective, gradient and second derivatives of each machine."""

        def partial(x, t, w):
            margin = x @ at.T
            slack = losses(margin, t)
            slope = -np.tile(t, margin.shape[1] // k) * slack if classify else -np.sign(t[:, None] - margin) * slack
            gradient = 2 * (slope * w[:, None]).T @ x
            matrix = np.stack([2 * (x[on] * w[on, None]).T @ x[on] for on in (slack > 0).T])
            return np.concatenate([w @ slack**2, gradient.ravel(), matrix.ravel()])

        m = len(at)
        found = summed(partial, m * (1 + d + d * d))
        loss, gradient, matrix = found[:m], found[m : m + m * d].reshape(m, d), found[m + m * d :].reshape(m, d, d)
        return (at**2).sum(1) / 2 + cost * loss, at + cost[:, None] * gradient, np.eye(d)[None] + cost[:, None, None] * matrix

    lengths = 0.5 ** np.arange(12)

    def along(at: np.ndarray, step: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Objective of each machine for each step length, and for none at all as the last."""
        tried = [*lengths, 0.0]
        loss = summed(lambda x, t, w: np.concatenate([w @ losses(x @ (at + a * step).T, t) ** 2 for a in tried]), len(tried) * len(at)).reshape(len(tried), len(at))
        norms = np.stack([((at + a * step) ** 2).sum(1) / 2 for a in tried])
        return norms + cost[None] * loss

    objectives, slope, curve = reached(coefficients, grid)
    live = np.arange(len(grid))
    for _ in range(steps):
        if classify and k > 1:  # all machines of a C go on together, as they share its signs
            live = np.flatnonzero(np.isin(grid, grid[live]))
        w, cost, before = coefficients[live], grid[live], objectives[live]
        step = -solved(curve[live], slope[live])
        taken = np.ones(len(live))
        found = reached(w + step, cost)
        enough = found[0] <= before + 0.01 * (slope[live] * step).sum(1) + 1e-12 * np.abs(before)
        if not enough.all():
            best = along(w, step, cost).argmin(0)
            taken = np.where(enough, 1.0, np.append(lengths, 0.0)[best])
            found = reached(w + taken[:, None] * step, cost)
        coefficients[live] = w + taken[:, None] * step
        objectives[live], slope[live], curve[live] = found
        done = before - found[0] <= tolerance * np.maximum(before, 1e-12)
        live = live[~done]
        if not len(live):
            break
    return Machines(features, list(cs), classes, coefficients.reshape(len(cs), k, d), objectives.reshape(len(cs), k), mapped)
