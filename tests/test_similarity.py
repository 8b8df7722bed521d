"""Blockwise similarities against whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadenz.operators import similarity as SI
from kadenz.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize(("queries", "rows"), [(1024, 2048), (3, 7)])
def test_blocks_give_what_whole_matrices_give(spark, monkeypatch, queries, rows):
    monkeypatch.setattr(SI, "QUERIES", queries)
    monkeypatch.setattr(SI, "ROWS", rows)
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 4)) / 2, rng.integers(0, 3, 60)
    x[7] = x[0]
    x[9] = 0
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(60)] + [(99, None, 1)], "id long, v array<float>, label int").repartition(3)
    x = x.astype(np.float32).astype(float)
    few = df.where("id % 10 = 0")
    s = np.clip(np.exp(-2 * ((x[::10, None] - x[None]) ** 2).sum(2)), 1e-8, 1)
    with np.errstate(invalid="ignore"):
        cos = np.exp(2 * (x[::10] @ x.T) / np.sqrt(np.outer((x[::10] ** 2).sum(1), (x**2).sum(1))) - 2)
    got = {(r.a, r.b): (r.rbf, r.cos) for r in SI.pairs(few, df, "id", "v", 2.0, 6).collect()}
    assert len(got) == 6 * 60
    for (a, b), (k, c) in got.items():
        assert k == pytest.approx(s[a // 10, b], abs=6e-7)
        assert c is None if b == 9 else c == pytest.approx(cos[a // 10, b], abs=6e-7)
    other = s * (np.arange(0, 60, 10)[:, None] != np.arange(60)[None])
    h = {r.id: r.h for r in SI.predicted(few, df, "id", "v", "label", 2.0).collect()}
    assert h == pytest.approx(dict(zip(range(0, 60, 10), other @ label / other.sum(1), strict=True)))
    m = {r.id: r.s for r in SI.mean_similarity(few, df, "id", "v", ["label"], 2.0).collect()}
    assert m == pytest.approx(dict(enumerate(s.mean(0))))


def test_pairs_meet_as_matrices(spark):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("v"), F.lit(1).alias("label"))
    plan = SI.mean_similarity(df.where("id % 50 = 0"), df, "id", "v", ["label"], 2.0)._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_pairs_keep_their_columns_under_a_select(spark, tmp_path):
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(120)], "id long, v array<float>").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))  # both sides from one relation
    pairs = SI.pairs(df.where("id % 50 = 0"), df, "id", "v", 2.0, 6)
    assert pairs.count() == 3 * 120
    assert sorted(tuple(r) for r in pairs.select("b", "a").collect()) == sorted((b, a) for a in (0, 50, 100) for b in range(120))


def test_a_side_of_the_pairs_is_shuffled_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(SI, "QUERIES", 5)
    monkeypatch.setattr(SI, "ROWS", 9)
    spark.range(600).select("id", F.array(*[F.rand(k).cast("float") for k in range(8)]).alias("v")).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    pairs = SI.pairs(df.where("id % 50 = 0"), df, "id", "v", 2.0, 6)
    assert "explode" not in pairs._jdf.queryExecution().toString()  # rows are not sent anew for each block that they meet
    for threshold in ("10MB", "-1"):  # by broadcast blocks or by partitions
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = pairs.select("a", "b")
            assert got.count() == got.distinct().count() == 12 * 600
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_halves_go_away_from_zero():
    assert SI.half_away(np.array([0.5, -0.5, 1.4, 2.5, -0.2]), 0).tolist() == [1.0, -1.0, 1.0, 3.0, 0.0]
