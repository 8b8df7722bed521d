"""Similarities of a set of vectors to all vectors, block by block as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of each side that meet in one matrix.
QUERIES, ROWS = 1024, 2048


def half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded with halves away from 0, as SQL does."""
    at = np.abs(x) * 10.0**digits
    low = np.floor(at)
    return np.copysign((low + (at - low >= 0.5)) / 10.0**digits, x) + 0.0


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in table.column(name).chunks]) if table.num_rows else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)


def rbf(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """exp(-scale * squared distance) of each two rows, from 1e-8 to 1."""
    out = 2 * (x @ y.T)
    out -= (x * x).sum(1)[:, None]
    out -= (y * y).sum(1)[None]
    out *= scale
    np.exp(out, out=out)
    return np.clip(out, 1e-8, 1.0, out=out)


def cosine(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """exp(scale * (cosine - 1)) of each two rows; nan where one has no length."""
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = (x @ y.T) / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1)))
    return np.exp(cos * scale - scale)


def _blocks(queries: DataFrame, rows: DataFrame, vector: str, run, schema: str) -> DataFrame:
    """`run` over every block of queries beside every block of rows; a task holds one of each, whatever the tables' sizes."""
    nq, nr = max(1, -(-queries.count() // QUERIES)), max(1, -(-rows.count() // ROWS))
    dealt = lambda df, n: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")
    # both sides may come from one table; with names of its own a side keeps its columns when a later select prunes them
    known = lambda df: df.where(F.col(vector).isNotNull()).select(*[F.col(c).alias(c) for c in df.columns])
    left = known(queries).withColumn("__q", dealt(queries, nq)).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    right = known(rows).withColumn("__r", dealt(rows, nr)).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        return run(a, b, _matrix(a, vector), _matrix(b, vector))

    return left.groupBy("__q", "__r").cogroup(right.groupBy("__q", "__r")).applyInArrow(met, schema)


def _packed(df: DataFrame, key: str, vector: str, size: int, names: list[str]) -> DataFrame:
    """One row for each `size` rows of a partition, or what is left of it: their keys and their vectors end to end."""
    kinds = dict(df.dtypes)

    def block(table: pa.Table) -> pa.RecordBatch:
        flat = pa.concat_arrays([c.flatten() for c in table.column(vector).chunks])
        keys = table.column(key).combine_chunks()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, flat)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            while table.num_rows >= size:
                yield block(table.slice(0, size))
                table = table.slice(size)
            held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(pack, f"{names[0]} array<{kinds[key]}>, {names[1]} {kinds[vector]}")


def _numbers(x: np.ndarray) -> pa.Array:
    x = x.ravel()
    return pa.array(x, mask=np.isnan(x))


def pairs(queries: DataFrame, rows: DataFrame, key: str, vector: str, scale: float, digits: int) -> DataFrame:
    """(a, b, rbf, cos) of each query and each row, rounded where they are made. Null vectors have no pairs.

    Each side is shuffled once, as blocks, so only the result grows with queries times rows. The pairs of two blocks come in
    order of cos: files of them are less than half as large, since equal numbers stand together.
    """
    kind = dict(rows.dtypes)[key]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nq, nr = queries.count() // QUERIES + 1, rows.count() // ROWS + 1
    # at most about 8 blocks a side in a task
    left = _packed(queries, key, vector, QUERIES, ["__a", "__x"]).repartition(-(-nq // 8))
    right = _packed(rows, key, vector, ROWS, ["__b", "__y"]).repartition(max(min(parts, nr), -(-nr // 8)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, x, b, y = (batch.column(c)[i].values for c in ("__a", "__x", "__b", "__y"))
                x, y = (v.to_numpy(zero_copy_only=False).astype(float).reshape(len(k), -1) for k, v in ((a, x), (b, y)))
                cos = half_away(cosine(x, y, scale), digits).ravel()
                order = np.argsort(cos)
                columns = [a.take(pa.array(order // len(b))), b.take(pa.array(order % len(b))), _numbers(half_away(rbf(x, y, scale), digits).ravel()[order]), _numbers(cos[order])]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "rbf", "cos"])

    return left.crossJoin(right).mapInArrow(met, f"a {kind}, b {kind}, rbf double, cos double")


def predicted(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """(key, h): mean of the other rows' labels, weighted by their similarity to the query. A block gives two sums per query."""
    kind = dict(rows.dtypes)[key]

    def run(a: pa.Table, b: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        sums = np.zeros((len(x), 2))
        if len(x) and len(y):
            labels = b.column("__label").to_numpy().astype(float)
            other = a.column(key).to_numpy()[:, None] != b.column(key).to_numpy()[None]
            s = rbf(x, y, scale) * other
            known = ~np.isnan(labels)
            sums = np.column_stack([s @ np.where(known, labels, 0.0), s.sum(1)])
        return pa.table({key: a.column(key), "__n": pa.array(sums[:, 0]), "__d": pa.array(sums[:, 1])})

    found = _blocks(queries.select(key, vector), rows.select(key, vector, F.col(label).cast("double").alias("__label")), vector, run, f"{key} {kind}, __n double, __d double")
    return found.groupBy(key).agg(F.try_divide(F.sum("__n"), F.sum("__d")).alias("h"))


def mean_similarity(queries: DataFrame, rows: DataFrame, key: str, vector: str, keep: list[str], scale: float) -> DataFrame:
    """(key, keep, s): mean similarity of each row to all queries. A block gives a sum and a count per row."""
    kinds = dict(rows.dtypes)

    def run(a: pa.Table, b: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
        s = rbf(x, y, scale).sum(0) if len(x) and len(y) else np.zeros(len(y))
        return pa.table({**{c: b.column(c) for c in [key, *keep]}, "__s": pa.array(s), "__n": pa.array(np.full(len(y), len(x), dtype=np.int64))})

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in [key, *keep]], "__s double", "__n long"])
    found = _blocks(queries.select(key, vector), rows.select(key, vector, *keep), vector, run, schema)
    return found.groupBy(key, *keep).agg(F.try_divide(F.sum("__s"), F.sum("__n")).alias("s"))
