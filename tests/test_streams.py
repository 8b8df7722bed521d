"""Streams against their batch twins."""

import datetime as dt

import numpy as np
import pytest

from kadenz.session import ship
from kadenz.streaming import segments as ZS

SCHEMA = "rec_id string, ts timestamp, other boolean, active boolean"
BEGIN = dt.datetime(2024, 1, 1)


def started(spark, at, late="1 hour"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out = ZS.merged_segments(stream, 120.0, late=late).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    out.trigger(availableNow=True).start().awaitTermination()


def result(df):
    return sorted((r.rec_id, round(r.begin_t, 3), round(r.end_t, 3)) for r in df.collect())


@pytest.fixture(scope="module")
def samples():
    """Two speakers of three recordings, on and off in turns, each closed at the end."""
    rng = np.random.default_rng(8)
    rows = []
    for k in "xyz":
        for other in (False, True):
            t = np.cumsum(rng.integers(20, 90, 200)) + (0.5 if other else 0.0)
            rows += [(k, BEGIN + dt.timedelta(seconds=float(s)), other, None if rng.random() < 0.05 else bool(rng.random() < (0.15 if other else 0.5))) for s in t[t < 9000]]
            rows.append((k, BEGIN + dt.timedelta(seconds=9500), other, False))
    return rows


def test_a_stream_equals_its_batch_twin_after_a_restart_and_with_late_rows(spark, samples, tmp_path):
    ship(spark)
    want = result(ZS.merged_segments(spark.createDataFrame(samples, SCHEMA), 120.0))
    assert len(want) > 50
    # arrivals by time, but every tenth row comes with the next arrival, up to fifty minutes late
    order = sorted(samples, key=lambda r: r[1])
    cuts = [BEGIN + dt.timedelta(seconds=1500 * i) for i in range(1, 8)]
    arrival = [sum(r[1] >= c for c in cuts) + (i % 10 == 0) for i, r in enumerate(order)]
    beats = [(k, BEGIN + dt.timedelta(days=2), False, False) for k in "xyz"]
    for n in range(9):
        rows = [r for r, a in zip(order, arrival, strict=True) if a == n] + (beats if n == 8 else [])
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (0, 1, 4, 8):
            started(spark, tmp_path)  # each time a new query that goes on from the checkpoint
    assert result(spark.read.schema("rec_id string, begin_t double, end_t double").parquet(f"{tmp_path}/out")) == want


def test_rows_later_than_allowed_are_passed_over(spark, tmp_path):
    ship(spark)
    at = lambda s: BEGIN + dt.timedelta(seconds=s)
    arrivals = [[("x", at(0), False, True), ("x", at(10), False, False), ("x", at(5000), False, False)], [("x", at(20), False, True), ("x", at(30), False, False), ("x", at(99_999), False, False)]]
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        started(spark, tmp_path, late="10 seconds")
    got = spark.read.schema("rec_id string, begin_t double, end_t double").parquet(f"{tmp_path}/out").collect()
    assert [(r.end_t - r.begin_t) for r in got] == [10.0]
