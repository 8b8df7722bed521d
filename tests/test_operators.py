"""Edge rules on small frames, properties, sources and streams."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadenz.functions import arrays as A
from kadenz.functions.user import Transform, transformed
from kadenz.operators import gram, linear
from kadenz.operators import intervals as I
from kadenz.operators import joins as J
from kadenz.operators import metrics as M
from kadenz.operators import models as L
from kadenz.operators import recordings as RE
from kadenz.operators import resample as R
from kadenz.operators import signal as G
from kadenz.operators import splits as X
from kadenz.operators import stats as S
from kadenz.operators import tables as P
from kadenz.plans import views as V
from kadenz.session import ship
from kadenz.sources import files
from kadenz.streaming import windows as Z

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_containment_at_the_ends_and_empty_intervals(spark):
    p = spark.createDataFrame([("a", float(t)) for t in range(6)] + [("b", 1.0)], "rec_id string, t double")
    i = spark.createDataFrame([("a", 0, 1.0, 3.0), ("a", 1, 3.0, 3.0), ("a", 2, 9.0, 8.0), ("a", 3, 3.2, 3.4), ("b", 4, 2.0, 5.0)], "rec_id string, seg_id int, begin_t double, end_t double")
    assert rows(J.contains(p, i).select("seg_id", "t")) == [(0, 1.0), (0, 2.0), (0, 3.0), (1, 3.0)]
    got = rows(S.aggregate_to_intervals(p.withColumn("v", F.col("t")), i, {"mean": ["v"], "std": ["v"]}, ["rec_id", "seg_id"]).select("seg_id", "v_mean", "v_std"))
    assert got == [(0, 2.0, 1.0), (1, 3.0, 0.0), (2, None, 0.0), (3, None, 0.0), (4, None, 0.0)]


def test_overlap_excludes_touches_and_finds_nested(spark):
    a = spark.createDataFrame([("r", 0, 0.0, 10.0), ("r", 1, 10.0, 12.0)], "rec_id string, a_id int, a_begin double, a_end double")
    b = spark.createDataFrame([("r", 5, 10.0, 11.0), ("r", 6, 2.0, 3.0), ("r", 7, 9.0, 10.5)], "rec_id string, b_id int, b_begin double, b_end double")
    assert rows(J.overlaps(a, b, width=1.5).select("a_id", "b_id")) == [(0, 6), (0, 7), (1, 5), (1, 7)]


@pytest.mark.parametrize("chunk", [1.0, 86400.0])
def test_nearest_ties_and_ends(spark, chunk):
    s = spark.createDataFrame([("r", 1.0, 1), ("r", 3.0, 3), ("r", 10.0, 10)], "rec_id string, t double, v int")
    g = spark.createDataFrame([("r", t) for t in (0.0, 2.0, 3.0, 6.4, 6.5, 6.6, 99.0)] + [("q", 1.0)], "rec_id string, t double")
    near = J.neighbours(g, s, ["v"], chunk=chunk).select("t", F.col("prev.v").alias("p"), F.col("next.v").alias("n"))
    assert rows(near, "t", "p") == [(0.0, None, 1), (1.0, None, None), (2.0, 1, 3), (3.0, 3, 3), (6.4, 3, 10), (6.5, 3, 10), (6.6, 3, 10), (99.0, 10, None)]
    got = rows(J.nearest(g, s, ["v"]).where("rec_id = 'r'").select("t", "near_v"))
    assert got == [(0.0, 1), (2.0, 3), (3.0, 3), (6.4, 3), (6.5, 10), (6.6, 10), (99.0, 10)]


def test_segments_at_the_ends(spark):
    flags = [True, None, True, True, False, True]
    df = spark.createDataFrame([("a", float(k), f) for k, f in enumerate(flags)] + [("b", 0.0, True), ("c", 0.0, False)], "rec_id string, t double, on boolean")
    assert rows(I.segments(df, "on", ["rec_id"]).select("rec_id", "begin_t", "end_t")) == [("a", 0.0, 1.0), ("a", 2.0, 4.0), ("a", 5.0, 6.0), ("b", 0.0, 0.0)]
    assert rows(I.segments(df, "on", ["rec_id"], last_on=True).select("begin_t", "end_t")) == [(0.0, 0.0), (0.0, 0.0), (2.0, 3.0), (5.0, 5.0)]


def test_pauses(spark):
    seg = lambda r: spark.createDataFrame([("r", float(b), float(e)) for b, e in r], "rec_id string, begin_t double, end_t double")
    a, b = seg([(0, 1), (2, 3), (5, 6), (9, 10)]), seg([(3.5, 4), (6.5, 9.5)])
    assert rows(I.pauses(a, b).select("kind", "begin_t", "end_t")) == [("inter", 4.0, 5.0), ("intra", 1.0, 2.0)]
    assert rows(I.merged_pauses(a, b, 3.0).select("begin_t", "end_t")) == [(0.0, 3.0), (5.0, 6.0), (9.0, 10.0)]


def test_metrics_of_constant_columns_and_absent_classes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "y double, h double")
    got = M.interval(df).first()
    assert (got.ccc, got.pcc, got.mse) == (0.0, 0.0, 1.0)
    c = spark.createDataFrame([(0, 1), (0, 0), (2, 1)], "y int, h int")
    per = {r["class"]: (r.precision, r.recall, r.f1) for r in M.per_class(M.confusion(c, 3)).collect()}
    assert per[2] == (0.0, 0.0, 0.0) and per[0][1] == 0.5
    assert M.auc(df.withColumn("score", F.col("h")), F.lit(True)).first().auc is None


def test_alpha_in_one_pass_is_the_pair_form(spark):
    rng = np.random.default_rng(1)
    y, h = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, h, strict=True)], "y double, h double")
    both = np.concatenate([y, h])
    expected = ((both[:, None] - both[None]) ** 2).sum() / (len(both) * (len(both) - 1))
    assert M.interval(df, ["alpha"]).first().alpha == pytest.approx(1 - ((y - h) ** 2).mean() / expected)


def test_upper_tail(spark):
    got = spark.range(1).select(*[M.upper_tail(F.lit(z)).alias(f"z{i}") for i, z in enumerate((0.0, 1.959964, -1.0))]).first()
    assert list(got) == pytest.approx([0.5, 0.025, 0.841345], abs=1e-6)


def test_splits_are_disjoint_and_cover(spark):
    df = spark.range(997).withColumn("label", F.col("id") % 13)
    parts = X.stratified(df, "label", "id", [3, 1, 1], 7)
    n = {r.partition: r["count"] for r in parts.groupBy("partition").count().collect()}
    assert sum(n.values()) == 997 and abs(n[0] - 598) <= 2 and parts.select("id").distinct().count() == 997
    sizes = [r["count"] for r in X.chunks(df, ["id"], 7).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [143] * 3 + [142] * 4
    roles = X.fold_roles(df.withColumn("fold", X.fold_of("id")), "fold").groupBy("id").agg(F.count(F.when(F.col("role") == "test", 1)).alias("t"))
    assert roles.where("t <> 1").count() == 0


def test_bootstrap_is_ordered(spark):
    b = R.bootstrap_mean(V.pred(spark, SF, number=True).limit(500), F.col("y"), "id", 50).first()
    assert b.lower <= b.center <= b.upper


def test_bootstrap_mean_has_the_weights_of_each_draw(spark):
    df = spark.createDataFrame([(i, float(i * i % 37)) for i in range(200)] + [(500, None), (None, 3.0)], "id long, v double")
    long = df.dropna().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("w", R.poisson_weight("id", "draw"))
    means = sorted(r.m for r in long.groupBy("draw").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).collect())
    b = R.bootstrap_mean(df, F.col("v"), "id", 25).first()
    assert np.allclose([b.lower, b.center, b.upper], np.quantile(means, [0.025, 0.5, 0.975]))
    none = R.bootstrap_mean(df.limit(0), F.col("v"), "id", 5).first()
    assert none.lower is None and none.center is None


def test_running_sums_move_rows_once_and_broadcast_a_row_per_range(spark):
    from kadenz.operators import ordering as O

    # one key with most rows, many of one row each, and a null key
    data = [(None if i % 11 == 0 else 7 if i % 3 else i, (i * 7919) % 4001, i % 4) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, x int, w int").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in ([], ["g"]):
            made = O.running(df, ["x"], {"s": "w"}, keys)
            plan = made._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            got = {(r.g, r.x): r.s for r in made.collect()}
            totals, want = {}, {}
            for g, x, w in sorted(data, key=lambda r: r[1]):
                k = g if keys else 0
                want[g, x] = totals.get(k, 0)
                totals[k] = totals.get(k, 0) + w
            assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    want = [(r.id, r.n) for r in df.toPandas().sort_values(["x", "id"]).assign(n=range(1, 5001)).itertuples()]
    for k in (1, 7):
        got = V.numbered(df.repartition(k), ["x", "id"], "n").select("id", "n")
        assert sorted(rows(got)) == sorted(want)


def test_tables(spark):
    df = spark.createDataFrame([(1, 1.0, None, 5.0), (2, 3.0, 4.0, 5.0)], "id int, acoustic_a double, acoustic_b double, vision_c double")
    assert P.without_null_columns(df).columns == ["id", "acoustic_a", "vision_c"]
    assert rows(P.imputed(df, ["acoustic_b"]).select("acoustic_b")) == [(4.0,), (4.0,)]
    t = Transform(lambda d: P.learn(d, ["acoustic_a", "vision_c"]), P.apply, lambda d, s: d.withColumn("acoustic_a", P.revert(F.col("acoustic_a"), s["acoustic_a"]))).fit(df)
    assert set(t.learned) == {"acoustic_a"}
    assert rows(t.revert(t.apply(df)).select("acoustic_a")) == [(1.0,), (3.0,)]
    assert transformed(df, [lambda d: d.where("id = 1"), lambda d: d.select("id")]).count() == 1


def test_models(spark):
    ship(spark)
    wide = V.wide(spark, SF).withColumn("label", (F.col("y") > 20).cast("double"))
    features = ["acoustic_qty", "vision_disc"]
    for name, target in (("huber", "y"), ("forest", "y"), ("forest_class", "label")):
        model = L.fitted(name, wide, features, target)
        assert model.transform(L.assembled(wide.limit(20), features)).count() == 20
    mlp = L.fitted("mlp", wide, features, "label", layers=[2, 3, 2], maxIter=5, seed=1)
    assert mlp.transform(L.assembled(wide.limit(5), features)).count() == 5
    assert 0.9 < L.canonical_correlation(wide, ["acoustic_qty"], ["y", "vision_tax"]) <= 1
    z = np.zeros(2)
    assert L.frechet(z, np.eye(2), z + 3, np.eye(2)) == pytest.approx(18)


def test_delay_is_found(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    a = rng.normal(size=64)
    w = spark.createDataFrame([(0, a.tolist(), np.roll(a, 3).tolist()), (1, [1.0] * 64, a.tolist()), (2, [1.0], a.tolist())], "k int, a array<double>, b array<double>")
    assert [r.lag for r in G.delays(w, 5, ["k"]).orderBy("k").collect()] == [3, None, None]


def test_nuclei_and_path(spark):
    ship(spark)
    v = [0, 30, 29, 29.5, 0, 20, 0]
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "rec_id string, k int, db double")
    assert rows(RE.nuclei(df).select("k")) == [(1,), (5,)]
    c = spark.createDataFrame([("r", t, float(s), 1.0 if s == 2 else 0.4) for t in range(4) for s in (0, 2, 9)], "rec_id string, k int, lag double, c double")
    assert [r.lag for r in RE.smooth_path(c, "rec_id", "k", "lag", "c", 9.0).orderBy("k").collect()] == [2.0] * 4


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    got = df.select(A.interaction(F.col("a"), F.col("b")).alias("i"), A.padded(F.col("b"), 3).alias("p"), A.transposed(F.array("a", "b"), 2).alias("t")).first()
    assert got.i == [3.0, 1.0, 6.0, 2.0, 3.0] and got.p == [3.0, 0.0, 0.0] and got.t == [[1.0, 3.0], [2.0, None]]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, y double")
    for fold in (0, 1):
        df.coalesce(1).toPandas().to_csv(tmp_path / f"ds_sent_{fold}_test.csv", index=False)
    got = files.read_csv_family(spark, [str(tmp_path / f"ds_sent_{f}_test.csv") for f in (0, 1)], "id int, y double")
    assert rows(got.select("id", "dataset", "fold", "split")) == [(1, "ds", 0, "test"), (1, "ds", 1, "test"), (2, "ds", 0, "test"), (2, "ds", 1, "test")]
    files.write_partitioned(got, str(tmp_path / "wide"), ["dataset", "fold", "split"], "csv")
    assert spark.read.csv(str(tmp_path / "wide"), header=True).count() == 4
    files.write_frames({"a": df}, str(tmp_path / "frames"))
    assert files.read_frame(spark, str(tmp_path / "frames"), "a").count() == 2
    assert files.cached(spark, str(tmp_path / "none"), None, only_stored=True) is None
    assert files.cached(spark, str(tmp_path / "c"), lambda: df).count() == files.cached(spark, str(tmp_path / "c"), None).count() == 2
    (tmp_path / "l.json").write_text('{"features": [{"layers": [{"values": [1, 2]}, {"values": [3, 4]}]}]}\n')
    assert files.read_layers(spark, str(tmp_path / "l.json")).first().layers == [[1.0, 2.0], [3.0, 4.0]]
    out = df.select(F.lit("d").alias("dataset"), F.lit(1).alias("run"), F.lit(2).alias("epoch"), "y", F.col("y").alias("h"))
    files.write_predictions(out, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).where("Actual = 0.5").count() == 1
    segs = spark.createDataFrame([("r", 1.5, 3.25, "hi"), ("r", 0.0, 1.0, "yo")], "rec_id string, begin_t double, end_t double, value string")
    files.write_subtitles(segs, str(tmp_path / "srt"))
    text = spark.read.text(str(tmp_path / "srt"), wholetext=True).first()[0]
    assert text == "1\n00:00:00,000 --> 00:00:01,000\nyo\n\n2\n00:00:01,500 --> 00:00:03,250\nhi\n\n"
    (tmp_path / "a.xml").write_text(
        '<D><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="s1" TIME_VALUE="500"/><TIME_SLOT TIME_SLOT_ID="s2" TIME_VALUE="1500"/></TIME_ORDER><TIER TIER_ID="words">'
        '<ANNOTATION><ALIGNABLE_ANNOTATION TIME_SLOT_REF1="s1" TIME_SLOT_REF2="s2"><ANNOTATION_VALUE>hey</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>'
        '<ANNOTATION><ALIGNABLE_ANNOTATION TIME_SLOT_REF1="s2" TIME_SLOT_REF2="s2"/></ANNOTATION></TIER></D>'
    )
    assert rows(files.read_annotations(spark, str(tmp_path / "a.xml"))) == [("words", 0.5, 1.5, "hey"), ("words", 1.5, 1.5, "")]


@pytest.mark.parametrize("form", ["hop", "session"])
def test_streams_give_the_batch_result(spark, tmp_path, form):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    far = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("value", F.lit(99.0))
    events.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    make = (lambda df: Z.hop_windows(df, "12 hours", "6 hours")) if form == "hop" else (lambda df: Z.sessions(df, "12 hours", F.col("value") > 50))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{form}"
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    far.coalesce(1).write.parquet(str(tmp_path / "in/b"))  # moves the watermark past all windows
    time.sleep(1)
    q.processAllAvailable()
    q.stop()
    want = {r for r in map(tuple, make(events).collect())}
    got = {r for r in map(tuple, spark.table(name).collect())}
    strip = lambda s: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in s}
    assert strip(got) == strip(want)


def test_p_of_a_correlation():
    assert M.pearson_p(0.5, 10) == pytest.approx(0.141111, abs=1e-5)
    assert M.pearson_p(0.0, 30) == pytest.approx(1.0, abs=1e-9) and M.pearson_p(None, 9) == 1.0 and M.pearson_p(1.0, 9) == 0.0


def test_selection_and_synthetic_tables(spark):
    ship(spark)
    df = L.synthetic(spark, 400).withColumn("vision_noise", F.randn(99))
    cols = ["vision_s0", "vision_s1", "vision_noise"]
    assert set(L.selected_univariate(df, cols, "y", 0.67)) == {"vision_s0", "vision_s1"}
    assert set(linear.selected(df, cols, "y", [0.3, 0.2], "id")[0]) == {"vision_s0", "vision_s1"}
    other = L.synthetic(spark, 50, additive=False).first()
    assert other.y == pytest.approx(other.vision_s0 * other.vision_s1 + other.vision_s2**2)


def test_cka_takes_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 1, (400, 5))
    x[:, 3:] += 0.5 * x[:, :2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)]
    df = spark.createDataFrame(rows, "vec_id int, v array<double>").repartition(7)
    h = np.eye(400) - 1 / 400
    k, l = (h @ m @ m.T @ h for m in (x[:, :3], x[:, 3:]))  # noqa: E741
    assert L.linear_cka(df, "v", 3).first()[0] == pytest.approx((k * l).sum() / np.sqrt((k * k).sum() * (l * l).sum()), abs=1e-12)
    assert L.linear_cka(df.where("false"), "v", 3).first()[0] is None


def test_running_sums_over_many_ranges(spark, monkeypatch):
    from kadenz.operators import ordering as O

    rng = np.random.default_rng(2)
    data = [(int(g), None if x > 0.97 else round(float(x), 2), int(i), int(i % 5)) for i, (g, x) in enumerate(zip(rng.integers(0, 2, 3000), rng.random(3000), strict=True))]
    df = spark.createDataFrame(data, "g int, x double, id int, w int").repartition(7)
    key = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    for tree, parts in ((64, "8"), (3, "40")):  # one tree of bounds, and a tree over slots of bounds
        monkeypatch.setattr(O, "TREE", tree)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            ranges = O.with_range(df, ["g", "x"])
            assert ranges.select("__b").distinct().count() > 5  # two values of g do not mean two ranges
            got = {r.id: r.n for r in O.numbered(df, ["x", "id"], "n").collect()}
            kept = {r.id: r.s for r in O.running(df, ["x", "id"], {"s": "w"}, ["g"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {r[2]: i + 1 for i, r in enumerate(sorted(data, key=key))}
        for g in (0, 1):
            total = 0
            for r in sorted((r for r in data if r[0] == g), key=key):
                assert kept[r[2]] == total
                total += r[3]


def test_intervals_of_very_different_length(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 1e6, 300))
    spans = [(i, float(b), float(b + n)) for i, (b, n) in enumerate(zip(rng.uniform(0, 1e6, 60), 10 ** rng.uniform(-3, 6, 60), strict=True))] + [(60, 5.0, 5.0), (61, 9.0, 8.0)]
    points = spark.createDataFrame([("r", float(x), i) for i, x in enumerate(t)], "rec_id string, t double, n int")
    a = spark.createDataFrame([("r", *s) for s in spans], "rec_id string, seg_id int, begin_t double, end_t double")
    got = {(r.n, r.seg_id) for r in J.contains(points, a).collect()}
    assert got == {(i, s) for i, x in enumerate(t) for s, b, e in spans if b <= x <= e}
    left, right = a.toDF("rec_id", "a", "a_begin", "a_end"), a.toDF("rec_id", "b", "b_begin", "b_end")
    pairs = [(r.a, r.b) for r in J.overlaps(left, right).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, b, e in spans for j, c, f in spans if b <= e and c <= f and b < f and e > c}


def test_signed_rank_test_is_exact_for_few_pairs(spark):
    def tail(n, w):
        sums = [sum(k for k in range(1, n + 1) if m >> (k - 1) & 1) for m in range(1 << n)]
        return sum(s >= w for s in sums) / len(sums)

    for d in ([1.0, -2.0, 3.0, 4.0, -5.0, 6.0], [0.5], [-0.5, -1.5], [2.0, 0.0, 1.0]):
        r = M.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double"), F.col("d")).first()
        n = sum(x != 0 for x in d)
        assert r.n == n and r.p == pytest.approx(tail(n, r.w or 0.0), abs=1e-12)
    many = spark.range(60).select((F.col("id") - 20.5).alias("d"))
    assert 0 < M.wilcoxon(many, F.col("d")).first().p < 0.05


def test_moments_and_distances_of_clusters(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    x = {k: rng.normal(k, 1 + k, (50, 3)) for k in (0, 1, 2)}
    df = spark.createDataFrame([(k, v.tolist()) for k, m in x.items() for v in m] + [(1, None)], "label int, v array<double>").repartition(5)
    for r in gram.moments(df, "label", "v").collect():
        assert r.n == 50 and np.allclose(r.mean, x[r.label].mean(0)) and np.allclose(np.reshape(r.cov, (3, 3)), np.cov(x[r.label].T))
    got = {(r.a, r.b): r.distance for r in L.frechet_distances(df, "label", "v").collect()}
    for (a, b), d in got.items():
        ca, cb = np.cov(x[a].T), np.cov(x[b].T)
        root = np.sqrt(np.linalg.eigvals(ca @ cb).astype(complex)).real.sum()  # trace of the root of the product
        assert d == pytest.approx(((x[a].mean(0) - x[b].mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * root, abs=1e-9)
    assert sorted(got) == [(0, 1), (0, 2), (1, 2)]


def test_models_are_kept_and_measured(spark, tmp_path):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 500))
    rows = [(float(p), float(q), float(p * p + q * q < 1.2), float(2 * p - q)) for p, q in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, inside double, line double")
    for kind, options, floor in (("rbf", {}, 0.9), ("ensemble", {"layers": [2, 8, 2], "maxIter": 60}, 0.85), ("svm", {}, 0.0)):
        m = L.Model(kind, ["a", "b"], "inside", members=2, **options).fit(df)
        assert m.metric(df, ["accuracy"], classes=2).first().accuracy >= floor  # no line separates a disc
        m.save(str(tmp_path / kind))
        again = L.Model.load(str(tmp_path / kind))
        assert rows_of(again.predict(df)) == rows_of(m.predict(df))
    line = L.Model("linear", ["a", "b"], "line").fit(df)
    assert line.metric(df, ["rmse"]).first().rmse < 1e-6


def rows_of(df):
    return sorted((r.a, r.b, r.h) for r in df.collect())


def test_many_samples_within_a_day(spark):
    """Work per sample stays the same: frames that grow towards the front only."""
    n = 200_000
    samples = spark.range(n).select(F.lit("r").alias("rec_id"), (F.col("id") * 0.4).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("v"))
    grid = spark.range(n).select(F.lit("r").alias("rec_id"), (F.col("id") * 0.4 + 0.1).alias("t"))
    began = time.time()
    assert J.nearest(grid, samples, ["v"]).where("abs(near_t - t) > 0.11").count() == 0
    assert S.filled(samples, ["v"]).where("v IS NULL").count() == 0
    assert time.time() - began < 60  # a frame read anew for each row would take hours
