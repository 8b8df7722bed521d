"""Sums of outer products of vectors, in blocks of the upper triangle, for vectors of any width up to some thousands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a block's side, and numbers that a task holds before it hands its sums on.
SIDE, HELD = 256, 30_000_000


def _spans(d: int, side: int) -> list[tuple[int, int]]:
    return [(a, min(a + side, d)) for a in range(0, d, side)]


def blocks(df: DataFrame, vector: str, key: str | None = None, shift: np.ndarray | None = None, side: int = SIDE) -> DataFrame:
    """(k, d, i, j, s): per key and block (i, j) of the upper triangle the sums of z z', z being 1 and the vector less `shift`.

    s are doubles as bytes, d is the width of z. A task sums the rows of each key as one matrix product, and blocks are added
    where they meet, so what is shuffled does not grow with the rows. Null vectors are left out; all others must be of one
    length and without nulls.
    """
    kinds = dict(df.dtypes)
    kind = kinds[key] if key else "int"
    rows = df.where(F.col(vector).isNotNull()).select((F.col(key) if key else F.lit(0)).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"k {kind}, d int, i int, j int, s binary"

    def emit(total: dict, kind_: pa.DataType) -> Iterator[pa.RecordBatch]:
        for k, m in total.items():
            spans = _spans(len(m), side)
            for i, (a, b) in enumerate(spans):
                for j, (c, e) in list(enumerate(spans))[i:]:
                    columns = [pa.array([k], kind_), pa.array([len(m)], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(m[a:b, c:e]).tobytes()])]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", "d", "i", "j", "s"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind_ = None
        for b in batches:
            kind_ = b.column("k").type
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = x if shift is None else x - shift
            labels = b.column("k").dictionary_encode()
            codes = labels.indices.to_numpy(zero_copy_only=False) if not labels.indices.null_count else np.array([-1 if c is None else c for c in labels.indices.to_pylist()])
            names = labels.dictionary.to_pylist()
            for c in np.unique(codes).tolist():
                z = np.column_stack([np.ones((codes == c).sum()), x[codes == c]])
                k = None if c < 0 else names[c]
                total[k] = total[k] + z.T @ z if k in total else z.T @ z
            if sum(m.size for m in total.values()) > HELD:
                yield from emit(total, kind_)
                total = {}
        if total:
            yield from emit(total, kind_)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, total, kind_ = None, None, None

        def close() -> pa.RecordBatch:
            k, d, i, j = open_
            columns = [pa.array([k], kind_), pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["k", "d", "i", "j", "s"])

        for b in batches:
            kind_ = b.column("k").type
            for r in range(b.num_rows):
                at = tuple(b.column(c)[r].as_py() for c in ("k", "d", "i", "j"))
                s = np.frombuffer(b.column("s")[r].as_py())
                if open_ is not None and at != open_:
                    yield close()
                    total = None
                open_, total = at, s.copy() if total is None else total + s
        if open_ is not None:
            yield close()

    parts = rows.mapInArrow(sums, schema)
    return parts.repartition("k", "i", "j").sortWithinPartitions("k", "d", "i", "j").mapInArrow(merged, schema)


def assembled(d: int, parts: list[tuple[int, int, bytes]], side: int = SIDE) -> np.ndarray:
    """The whole symmetric matrix from its blocks (i, j, s)."""
    out, spans = np.empty((d, d)), _spans(d, side)
    for i, j, s in parts:
        (a, b), (c, e) = spans[i], spans[j]
        out[a:b, c:e] = np.frombuffer(s).reshape(b - a, e - c)
        out[c:e, a:b] = out[a:b, c:e].T
    return out


def first_vector(df: DataFrame, vector: str) -> np.ndarray | None:
    """A vector near the others, for a shift that keeps the digits of sums."""
    row = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).first()
    return None if row is None else np.array(row.v)


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean (about the shift) and sample covariance from sums of z z'."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return n, mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def covariance(df: DataFrame, vector: str, side: int = SIDE) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance) of all vectors. The driver gets d * d numbers, whatever the rows."""
    shift = first_vector(df, vector)
    if shift is None:
        return 0, np.empty(0), np.empty((0, 0))
    found = blocks(df, vector, shift=shift, side=side).collect()
    n, mean, cov = centred(assembled(found[0].d, [(r.i, r.j, r.s) for r in found], side))
    return int(n), mean + shift, cov


def moments(df: DataFrame, key: str, vector: str, side: int = SIDE) -> DataFrame:
    """(key, n, mean, cov): one row per key, with d * d numbers; no row of the input is collected."""
    kind = dict(df.dtypes)[key]
    shift = first_vector(df, vector)
    whole = blocks(df, vector, key, shift, side).groupBy("k", "d").agg(F.collect_list(F.struct("i", "j", "s")).alias("parts"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                parts = [(p["i"], p["j"], p["s"]) for p in b.column("parts")[r].as_py()]
                n, mean, cov = centred(assembled(b.column("d")[r].as_py(), parts, side))
                lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (mean + shift, cov.ravel())]
                yield pa.RecordBatch.from_arrays([b.column("k").slice(r, 1), pa.array([int(n)], pa.int64()), *lists], names=["k", "n", "mean", "cov"])

    return whole.mapInArrow(finished, f"k {kind}, n long, mean array<double>, cov array<double>").withColumnRenamed("k", key)
