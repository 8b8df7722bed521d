"""RBF kernel features by the Nystroem method, with landmarks drawn by their leverage and the error of the kernel measured."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that landmarks are drawn from, on the driver; the sample's bound, whatever the table.
CANDIDATES = 1024


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(square, 0.0))


@dataclass
class Nystroem:
    """Standardised features, landmarks, the map from kernels to features, and how well it does on the candidates."""

    features: list[str]
    means: list[float]
    deviations: list[float]
    gamma: float
    landmarks: np.ndarray
    root: np.ndarray
    error: float

    @property
    def rank(self) -> int:
        return self.root.shape[1]

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Features of raw rows; their inner products are close to the kernel."""
        return kernel((x - np.array(self.means)) / np.array(self.deviations), self.landmarks, self.gamma) @ self.root

    def transform(self, df: DataFrame, name: str = "kernel") -> DataFrame:
        """Adds the features as one array; that of a row with a null is null."""
        kept, kinds = df.columns, dict(df.dtypes)
        inner = [f"__k{i}" for i in range(len(kept))]
        rows = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)], F.array(*[F.col(f"`{c}`").cast("double") for c in self.features]).alias("__x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(self.features))
                none = np.isnan(x).any(1)
                made = self.mapped(x[~none])
                ends = np.concatenate([[0], np.cumsum(~none) * self.rank]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in inner], arrays], names=[*inner, "__f"])

        schema = ", ".join([*[f"{i} {kinds[c]}" for c, i in zip(kept, inner, strict=True)], "__f array<double>"])
        return rows.mapInArrow(run, schema).toDF(*kept, name)

    def as_lists(self) -> dict:
        return asdict(self) | {"landmarks": self.landmarks.tolist(), "root": self.root.tolist()}

    @classmethod
    def of_lists(cls, spec: dict) -> Nystroem:
        return cls(**spec | {"landmarks": np.array(spec["landmarks"]), "root": np.array(spec["root"])})


def learn(df: DataFrame, features: list[str], rank: int = 128, gamma: float | None = None, candidates: int = CANDIDATES, seed: int = 5) -> Nystroem:
    """Landmarks from a table: candidates by hash, drawn without replacement in proportion to their ridge leverage.

    gamma: 1 / number of features where not given, as features are standardised. Fewer landmarks result where the
    candidates are fewer or nearly dependent. Rows with a null are left out. error: |K - F F'| / |K| in the Frobenius norm,
    over all candidates, most of which are no landmarks.
    """
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features]).dropna()
    row = rows.agg(*[e for i, c in enumerate(features) for e in (F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_pop(f"`{c}`").alias(f"d{i}"))]).first()
    if row.m0 is None:
        raise ValueError("no rows without nulls to learn from")
    means = [float(row[f"m{i}"]) for i in range(len(features))]
    deviations = [float(row[f"d{i}"]) or 1.0 for i in range(len(features))]
    gamma = gamma or 1 / len(features)
    found = rows.orderBy(F.xxhash64(*features), *features).limit(candidates).collect()
    x = np.unique((np.array(found, float) - np.array(means)) / np.array(deviations), axis=0)
    k = kernel(x, x, gamma)
    size, base = np.linalg.eigh(k)
    size = np.maximum(size, 0.0)
    leverage = base**2 @ (size / (size + 1e-3))
    noise = np.random.default_rng(seed).gumbel(size=len(x))
    chosen = np.argsort(-(np.log(np.maximum(leverage, 1e-300)) + noise), kind="stable")[:rank]
    values, vectors = np.linalg.eigh(k[np.ix_(chosen, chosen)])
    large = values > 1e-8 * values[-1]
    root = vectors[:, large] / np.sqrt(values[large])
    mapped = k[:, chosen] @ root
    error = float(np.linalg.norm(k - mapped @ mapped.T) / np.linalg.norm(k))
    return Nystroem(features, means, deviations, gamma, x[chosen], root, error)
