"""Round trips of sources and sinks, matrix statistics of clusters, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from kadenz.functions.user import Transform, transformed
from kadenz.operators import linear as LI
from kadenz.operators import models as L
from kadenz.operators import nystroem as NY
from kadenz.plans import views as V
from kadenz.plans.registry import query, rounded
from kadenz.session import scratch, ship, table, written
from kadenz.sources import files

SPLIT = "CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'validation' ELSE 'training' END"


@query("s1_csv_family", V.sql(f"SELECT 'lines' AS dataset, 'quantity' AS label, 0 AS fold, {SPLIT} AS split, id, y::DOUBLE AS y, round(h, 6) AS h FROM pred", "pred"))
def s1(spark, sf_dir):
    """The three splits of a fold, one CSV each, read as one table."""
    rows, root = written(V.pred(spark, sf_dir, number=True).select("id", "y", "h", "fold"), "numbered"), scratch(spark, "csv-family")  # numbered once
    paths = {s: f"{root}/lines_quantity_0_{s}.csv" for s in ("test", "validation", "training")}
    for s, path in paths.items():
        rows.where(f"{SPLIT} = '{s}'").select("id", F.col("y").cast("double"), "h").write.csv(path, header=True)
    got = files.read_csv_family(spark, list(paths.values()), "id long, y double, h double")
    return rounded(got.select("dataset", "label", "fold", "split", "id", "y", "h"))


@query("s2_csv_per_split", V.sql(f"SELECT fold, {SPLIT} AS split, count(*) AS n, sum(h::DECIMAL(20, 5))::DOUBLE AS total FROM pred GROUP BY fold, split", "pred"))
def s2(spark, sf_dir):
    path = scratch(spark, "csv-per-split")
    files.write_partitioned(V.pred(spark, sf_dir, number=True).selectExpr("id", "CAST(y AS DOUBLE) AS y", "h", "fold", f"{SPLIT} AS split"), path, ["fold", "split"], "csv")
    got = spark.read.csv(path, header=True, schema="id long, y double, h double, fold int, split string")
    return got.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20, 5)")).cast("double").alias("total"))


@query("s4_json_layers", "SELECT round(embedding[1]::DOUBLE, 6) AS first, round(embedding[17]::DOUBLE, 6) AS second, round(embedding[64]::DOUBLE, 6) AS last, 4 AS layers FROM embeddings")
def s4(spark, sf_dir):
    """Vectors written as JSON lines of four layers of 16 values."""
    path = scratch(spark, "layers")
    v = F.col("embedding").cast("array<double>")
    layers = F.array(*[F.struct(F.slice(v, 16 * i + 1, 16).alias("values")) for i in range(4)])
    table(spark, sf_dir, "embeddings").select(F.array(F.struct(layers.alias("layers"))).alias("features")).write.json(path)
    at = lambda i, j: F.get(F.get("layers", F.lit(i)), F.lit(j))
    return rounded(files.read_layers(spark, path).select(at(0, 0).alias("first"), at(1, 0).alias("second"), at(3, 15).alias("last"), F.size("layers").alias("layers")))


@query("s5_frame_store", V.sql("SELECT rec_id, seg_id, round(begin_t, 3) AS begin_t, round(end_t, 3) AS end_t, (SELECT count(*) FROM series) AS samples FROM intervals", "intervals", "series"))
def s5(spark, sf_dir):
    root = scratch(spark, "frames")
    files.write_frames({"samples": V.series(spark, sf_dir), "intervals": V.intervals(spark, sf_dir)}, root)
    n = files.read_frame(spark, root, "samples").agg(F.count(F.lit(1)).alias("samples"))
    rows = files.read_frame(spark, root, "intervals").select("rec_id", "seg_id", F.round("begin_t", 3).alias("begin_t"), F.round("end_t", 3).alias("end_t"))
    return rows.crossJoin(F.broadcast(n))  # one row


@query("s6_cached_table", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def s6(spark, sf_dir):
    """The first call stores the table, the second one reads it without computing."""
    path = scratch(spark, "cached")
    files.cached(spark, path, lambda: table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")))
    return files.cached(spark, path, None, only_stored=True)


@query("s8_annotation_tiers", "SELECT role AS tier, conv_id * 100.0::DOUBLE + turn * 1.5 AS begin, conv_id * 100.0::DOUBLE + turn * 1.5 + 1.5 AS \"end\", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS value FROM conversations")
def s8(spark, sf_dir):
    """Turns as annotations, with a tier per role, through annotation XML and back."""
    path = scratch(spark, "annotations")
    begin = F.col("conv_id") * 100.0 + F.col("turn") * 1.5
    value = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("n"), F.col("role").alias("tier"), begin.alias("begin"), (begin + 1.5).alias("end"), value.alias("value"))
    files.write_annotations(rows, path)
    return files.read_annotations(spark, path)


@query("s15_predictions", V.sql("SELECT fold AS run, printf('%.4f', y::DOUBLE / 8) AS \"Prediction\", printf('%.4f', y::DOUBLE) AS \"Actual\" FROM pred", "pred"))
def s15(spark, sf_dir):
    path = scratch(spark, "predictions")
    rows = V.pred(spark, sf_dir).select(F.lit("lines").alias("dataset"), F.col("fold").alias("run"), F.lit(1).alias("epoch"), "y", (F.col("y").cast("double") / 8).alias("h"))
    files.write_predictions(rows, path)
    return spark.read.csv(path, header=True, schema="Prediction string, Actual string, dataset string, run int, epoch int").select("run", "Prediction", "Actual")


def _parts(spark, sf_dir, n):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("label", *[F.get(v, F.lit(i)).alias(f"v{i}") for i in range(n)], F.slice(v, 1, n).alias("v"))


@query("v11_correlation_of_one_pair", "SELECT round(abs(covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE)) / sqrt((var_samp(embedding[1]::DOUBLE) + 1e-4) * (var_samp(embedding[2]::DOUBLE) + 1e-4)), 6) AS cca FROM embeddings")
def v11_one(spark, sf_dir):
    """With one column on each side the mean canonical correlation is the ridged correlation."""
    ship(spark)
    return rounded(spark.createDataFrame([(L.canonical_correlation(_parts(spark, sf_dir, 2), ["v0"], ["v1"]),)], "cca double"))


@query("v11_canonical_correlation")
def v11(spark, sf_dir):
    """The first half of the vectors against the second, over all elements and rows."""
    ship(spark)
    return rounded(spark.createDataFrame([(L.canonical_of(table(spark, sf_dir, "embeddings"), "embedding", 32),)], "cca double"))


@query("v13_frechet_in_one_dimension", "WITH m AS (SELECT label, avg(embedding[1]::DOUBLE) AS m, stddev_samp(embedding[1]::DOUBLE) AS s FROM embeddings GROUP BY label) SELECT a.label AS a, b.label AS b, round((a.m - b.m) ** 2 + (a.s - b.s) ** 2, 6) AS distance FROM m a JOIN m b ON a.label < b.label")
def v13_one(spark, sf_dir):
    ship(spark)
    return rounded(L.frechet_distances(_parts(spark, sf_dir, 1), "label", "v"))


@query("v13_frechet_distances")
def v13(spark, sf_dir):
    ship(spark)
    return rounded(L.frechet_distances(table(spark, sf_dir, "embeddings"), "label", "embedding"))


FEATURES = ["acoustic_qty", "acoustic_price", "vision_disc", "vision_tax", "language_size", "language_retail"]


def _wide(spark, sf_dir, number=True):
    """Features and targets; numbering sorts all rows, so what learns does without."""
    return V.wide(spark, sf_dir, number=number).select(*(["id"] if number else []), "meta_id", *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("y").cast("double").alias("y")).withColumn("large", (F.col("y") > 25).cast("double"))


def _predictions(spark, sf_dir, model, y):
    """Learned from groups 2 and on modulo 5, predicted for all rows."""
    fitted = model.fit(_wide(spark, sf_dir, number=False).where("meta_id % 5 > 1"))
    rows = _wide(spark, sf_dir).select("id", *dict.fromkeys([*model.spec["features"], y]))
    return rounded(fitted.predict(rows).select("id", F.col(y).alias("y"), "h"))


@query("m6_selected_by_model")
def m6(spark, sf_dir):
    ship(spark)
    kept, penalty = LI.selected(_wide(spark, sf_dir), FEATURES, "y", [0.01, 0.1, 0.5, 2.0], "id")
    return spark.createDataFrame([(f, f in kept, penalty) for f in FEATURES], "feature string, kept boolean, penalty double")


@query("m7_linear_svm")
def m7(spark, sf_dir):
    ship(spark)
    return _predictions(spark, sf_dir, L.Model("svm", FEATURES, "large"), "large")


def _scaled(rows):
    """Features and target with like scales, by fixed divisors."""
    return rows.select(*(["id"] if "id" in rows.columns else []), "meta_id", *[(F.col(c) / s).alias(c) for c, s in zip(FEATURES, (50, 1e5, 0.1, 0.1, 50, 2e3), strict=True)], (F.col("y") / 50).alias("y"), F.least(F.floor(F.col("y") / 17), F.lit(2)).cast("double").alias("band"))


@query("m7_machines_over_c")
def m7_c(spark, sf_dir):
    """Three classes, weighed as if equally frequent, for all C in the same reads: (c, class, objective, accuracy on the groups left out)."""
    ship(spark)
    rows = _scaled(_wide(spark, sf_dir, number=False))
    fit = LI.machines(rows.where("meta_id % 5 > 1"), FEATURES, "band", [0.001, 0.1, 10.0], balanced=True)
    held = rows.where("meta_id % 5 <= 1")
    for i, c in enumerate(fit.cs):
        held = fit.predict(held, c, f"h{i}")
    hits = held.agg(*[F.avg((F.col(f"h{i}") == F.col("band")).cast("double")) for i in range(len(fit.cs))]).first()
    out = [(c, k, float(o), hit) for c, objectives, hit in zip(fit.cs, fit.objectives, hits, strict=True) for k, o in zip(fit.classes, objectives, strict=True)]
    return rounded(spark.createDataFrame(out, "c double, class double, objective double, accuracy double"), "c")


@query("m7_support_vector_regression")
def m7_r(spark, sf_dir):
    ship(spark)
    fit = LI.machines(_scaled(_wide(spark, sf_dir, number=False)).where("meta_id % 5 > 1"), FEATURES, "y", [1.0], classify=False, epsilon=0.05)
    return rounded(fit.predict(_scaled(_wide(spark, sf_dir)), 1.0).select("id", "y", "h"))


@query("m8_rbf_svm")
def m8(spark, sf_dir):
    ship(spark)
    return _predictions(spark, sf_dir, L.Model("rbf", FEATURES, "large"), "large")


@query("m8_kernel_error")
def m8_error(spark, sf_dir):
    """(landmarks, rank, error): how near the features of some numbers of landmarks come to the kernel."""
    rows = _wide(spark, sf_dir, number=False)
    found = [(n, f.rank, f.error) for n in (16, 64, 256) for f in [NY.learn(rows, FEATURES, n)]]
    return rounded(spark.createDataFrame(found, "landmarks int, rank int, error double"))


@query("m9_random_forest")
def m9(spark, sf_dir):
    return _predictions(spark, sf_dir, L.Model("forest", FEATURES, "y", numTrees=10, maxDepth=6, seed=3), "y")


@query("m10_network_ensemble")
def m10(spark, sf_dir):
    return _predictions(spark, sf_dir, L.Model("ensemble", FEATURES[:1] + FEATURES[2:4], "large", members=3, layers=[3, 6, 2], maxIter=30), "large")


@query("f5_model_of_one_feature", V.sql(", t AS (SELECT regr_slope(y::DOUBLE, acoustic_price::DOUBLE) AS b, regr_intercept(y::DOUBLE, acoustic_price::DOUBLE) AS a FROM wide WHERE meta_id % 5 > 1) SELECT round(sqrt(avg((y::DOUBLE - a - b * acoustic_price::DOUBLE) ** 2)), 6) AS rmse, round(corr(y::DOUBLE, a + b * acoustic_price::DOUBLE), 6) AS pcc FROM wide, t WHERE meta_id % 5 <= 1", "wide"))
def f5_one(spark, sf_dir):
    """Fitted on some groups, saved, loaded, and measured on the others, against the least squares line."""
    rows, path = _wide(spark, sf_dir, number=False), scratch(spark, "model")
    L.Model("linear", ["acoustic_price"], "y").fit(rows.where("meta_id % 5 > 1")).save(path)
    return rounded(L.Model.load(path).metric(rows.where("meta_id % 5 <= 1"), ["rmse", "pcc"]))


@query("f5_model_protocol")
def f5(spark, sf_dir):
    """Fitted, saved, loaded, and measured on the groups left out."""
    rows, path = _wide(spark, sf_dir, number=False), scratch(spark, "model")
    L.Model("linear", FEATURES, "y").fit(rows.where("meta_id % 5 > 1")).save(path)
    return rounded(L.Model.load(path).metric(rows.where("meta_id % 5 <= 1"), ["rmse", "pcc"]))


@query("f3_transforms_in_order", V.sql("SELECT rec_id, seq, round(v * 2 + 1, 6) AS v FROM series WHERE v > 50", "series"))
def f3(spark, sf_dir):
    steps = [lambda d: d.where("v > 50"), lambda d: d.withColumn("v", F.col("v") * 2), lambda d: d.withColumn("v", F.col("v") + 1)]
    return rounded(transformed(V.series(spark, sf_dir).select("rec_id", "seq", "v"), steps))


@query("f4_learn_apply_revert", V.sql(", s AS (SELECT avg(acoustic_qty) AS m, stddev_pop(acoustic_qty) AS s FROM wide WHERE meta_id % 5 > 1) SELECT id, round((acoustic_qty - m) / s, 6) AS scaled, acoustic_qty::DOUBLE AS back FROM wide, s", "wide"))
def f4(spark, sf_dir):
    rows = V.wide(spark, sf_dir, number=True).select("id", "meta_id", F.col("acoustic_qty").cast("double").alias("x"))
    learn = lambda df: df.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    t = Transform(learn, lambda df, k: df.withColumn("x", (F.col("x") - k.m) / k.s), lambda df, k: df.withColumn("x", F.col("x") * k.s + k.m))
    scaled = t.fit(rows.where("meta_id % 5 > 1")).apply(rows)
    back = t.revert(scaled).select("id", F.col("x").alias("back"))
    return rounded(scaled.select("id", F.col("x").alias("scaled")).join(back, "id"))
