import numpy as np
import pytest

from kadenz.llm import ann, queries


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), d[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute(rows, 10, 100)
    vectors = {i: np.array(v, float) for i, v in rows}
    got = queries.op5_nearest_neighbours(spark, f"/root/testdata/{sf}").collect()
    assert ann.recall([(r.query_id, r.vec_id) for r in got], {q: {v for v, _ in n} for q, n in want.items()}) >= 0.9
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.score == pytest.approx(np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum()), rel=1e-12)
    assert by.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in by.values())


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (300, [4.0]), (10, []), (0, [1.0, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 AS part", "'x' AS score", "'y' AS key")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df).collect())
    far = round(2**0.5, 6)
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 100, far), (100, 1, 0, far), (100, 2, 2, far), (100, 3, 3, far), (300, 1, 9, 3.0)]
    assert ann.nearest(df.where("false")).count() == 0


def test_ids_with_several_vectors_count_once(spark):
    rows = [(0, [1.0, 1.0]), (0, [9.0, 9.0]), (1, [1.0, 2.0]), (1, [9.0, 8.5]), (2, [1.0, 4.0]), (1, [50.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.5), (0, 2, 2, 3.0)]


def blobs(n, centres, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 8
    return [(i, v.tolist()) for i, v in enumerate(middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)))]


def test_blocks_and_equal_vectors_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (160, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for name, value in (("ROWS", 16), ("QUERIES", 3), ("PLACED", 50), ("SMALLEST", 40), ("LEAST", 1)):
        monkeypatch.setattr(ann, name, value)
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, mass=1.1).collect()
    want = brute(rows, 10, 20)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted((q, k + 1, v) for q, n in want.items() for k, (v, _) in enumerate(n))


def test_two_levels_on_clusters_read_little_and_find_most(spark, monkeypatch):
    for name, value in (("WIDEST", 8), ("SMALLEST", 32), ("LEAST", 20), ("EPOCHS", 40)):
        monkeypatch.setattr(ann, name, value)
    rows = blobs(6000, 60)  # more rows than the sample of a network
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    job = ann.Search(ann.usable(df, "vec_id", "embedding").distinct(), 10, 50, 1000, ann.MASS)
    job.partition()
    assert job.index.where("part LIKE '%/%/%'").count() > 0  # cut twice
    want = {q: {v for v, _ in n} for q, n in brute(rows, 10, 50).items()}
    got = ann.first(job.found(), "query_id", 10).collect()
    assert ann.recall([(r.query_id, r.vec_id) for r in got], want) >= 0.9
    assert ann.read_share(job) < 0.1


def test_a_table_larger_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SMALLEST", 64)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, every=10, sample=500).collect()
    assert ann.recall([(r.query_id, r.vec_id) for r in got], {q: {v for v, _ in n} for q, n in brute(rows, 10, 10).items()}) >= 0.9
