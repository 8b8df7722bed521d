"""Model steps: selection, mixed effects, Spark ML estimators on wide tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.operators.gram import covariance, moments
from kadenz.operators.joins import all_pairs_of
from kadenz.operators.linear import Machines, machines
from kadenz.operators.nystroem import Nystroem, learn
from kadenz.session import written


def f_statistics(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(feature, f): F of each feature's linear fit to y, all in one pass."""
    r2 = lambda c: F.try_divide(F.pow(F.covar_pop(c, y), F.lit(2)), F.var_pop(c) * F.var_pop(y))
    wide = df.agg(*[r2(c).alias(c) for c in features], F.count(y).alias("__n"))
    long = wide.unpivot(["__n"], features, "feature", "r2")
    return long.select("feature", (F.try_divide(F.col("r2"), 1 - F.col("r2")) * (F.col("__n") - 2)).alias("f"))


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f): variance of each feature between classes over that within them. Each class gives one row of sums; rows with
    a null label, and null values, are left out. Null where nothing varies within classes."""
    sums = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[e for i, c in enumerate(features) for e in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), (F.var_pop(c) * F.count(c)).alias(f"q{i}"))])

    def ratio(i: int):
        n, m, q = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"q{i}")
        between = F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)
        k = F.count(m)
        return F.try_divide(F.try_divide(between, (k - 1).cast("double")), F.try_divide(F.sum(q), (F.sum(n) - k).cast("double")))

    found = sums.agg(F.array(*[F.struct(F.lit(c).alias("feature"), ratio(i).alias("f")) for i, c in enumerate(features)]).alias("found"))
    return found.select(F.inline("found"))


def random_intercepts(df: DataFrame, group: str, residual: str, steps: int = 10) -> DataFrame:
    """(group, n, s, q, effect) by EM on each group's count, sum and sum of squares; rows are read once.

    A step sends two numbers to the driver, the variances within and between groups.
    """
    g = written(df.groupBy(group).agg(F.count(residual).alias("n"), F.sum(residual).alias("s"), F.sum(F.col(residual) * F.col(residual)).alias("q")), "group-sums")
    within, between = 1.0, 1.0
    for _ in range(steps):
        d, s2 = F.lit(between), F.lit(within)
        b, v = d * F.col("s") / (s2 + F.col("n") * d), d * s2 / (s2 + F.col("n") * d)
        row = g.agg((F.sum(F.col("q") - 2 * b * F.col("s") + F.col("n") * (b * b + v)) / F.sum("n")).alias("s2"), F.avg(b * b + v).alias("d")).first()
        within, between = row.s2, row.d
    return g.withColumn("effect", F.lit(between) * F.col("s") / (F.lit(within) + F.col("n") * F.lit(between)))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def fitted(name: str, df: DataFrame, features: list[str], y: str, weight: str | None = None, **options):
    """A fitted Spark ML model by name."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    kinds = {"huber": lambda **o: LinearRegression(loss="huber", **o), "linear": LinearRegression, "forest": RandomForestRegressor, "forest_class": RandomForestClassifier, "mlp": MultilayerPerceptronClassifier}
    options |= {"weightCol": weight} if weight else {}
    return kinds[name](featuresCol="features", labelCol=y, **options).fit(assembled(df, features))


def canonical_correlation(df: DataFrame, left: list[str], right: list[str], ridge: float = 1e-4) -> float:
    """Mean canonical correlation of two sets of columns."""
    vector = F.array(*[F.col(c).cast("double") for c in [*left, *right]])
    return canonical_of(df.select(vector.alias("v")), "v", len(left), ridge)


def canonical_of(df: DataFrame, vector: str, split: int, ridge: float = 1e-4) -> float:
    """Mean canonical correlation of a vector's first `split` elements with the rest, both covariances with a ridge.

    Covariances are summed in blocks over all rows, so a vector may have some thousands of elements; the d x d eigen
    step runs on the driver. Null vectors are left out; nan without rows.
    """
    _, _, c = covariance(df, vector)
    if not len(c):
        return float("nan")
    inv = lambda m: (lambda v, u: (u * v**-0.5) @ u.T)(*np.linalg.eigh(m + ridge * np.eye(len(m))))
    s = np.linalg.svd(inv(c[:split, :split]) @ c[:split, split:] @ inv(c[split:, split:]), compute_uv=False)
    return float(np.clip(s, 0, 1).mean())


def frechet(a_mean: np.ndarray, a_cov: np.ndarray, b_mean: np.ndarray, b_cov: np.ndarray) -> float:
    v, u = np.linalg.eigh(a_cov)
    root = u @ np.diag(np.sqrt(np.maximum(v, 0))) @ u.T
    middle = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b_cov @ root), 0)).sum()
    return float(((a_mean - b_mean) ** 2).sum() + np.trace(a_cov) + np.trace(b_cov) - 2 * middle)


def frechet_distances(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, distance) of every two clusters, from their means and covariances.

    Clusters meet in blocks by number, so no side of the join is broadcast; a pair is one row of d * d numbers each.
    """
    m = written(moments(df, key, vector), "cluster-moments")
    a, b = (m.select(F.col(key).alias(s), F.col("mean").alias(f"m{s}"), F.col("cov").alias(f"c{s}")) for s in ("a", "b"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in range(t.num_rows):
                ma, mb, ca, cb = (np.array(t.column(n)[r].as_py()) for n in ("ma", "mb", "ca", "cb"))
                found = frechet(ma, ca.reshape(len(ma), -1), mb, cb.reshape(len(mb), -1))
                yield pa.RecordBatch.from_arrays([t.column("a").slice(r, 1), t.column("b").slice(r, 1), pa.array([found], pa.float64())], names=["a", "b", "distance"])

    return all_pairs_of(a, b, "a", "b", block=64).where("a < b").mapInArrow(run, f"a {kind}, b {kind}, distance double")


class Model:
    """fit, predict, metric, save and load of a model by name; predict adds the column h.

    Kinds are those of fitted(), and: svm and svr, linear machines on standardised features; rbf, such a machine on
    Nystroem features; and ensemble, the mean of several networks that start apart. Options of machines are c, epsilon
    and balanced, and rank for rbf.
    """

    MACHINES = ("svm", "svr", "rbf")

    def __init__(self, kind: str, features: list[str], y: str, weight: str | None = None, members: int = 3, **options):
        self.spec = {"kind": kind, "features": features, "y": y, "weight": weight, "members": members, "options": options}
        self.parts: list = []

    def _prepared(self, df: DataFrame) -> tuple[DataFrame, list[str] | str]:
        s = self.spec
        if s["kind"] in self.MACHINES and s["kind"] != "rbf":
            scaled = [((F.col(f"`{c}`") - m) / d).alias(f"__z{i}") for i, (c, m, d) in enumerate(zip(s["features"], s["means"], s["deviations"], strict=True))]
            return df.select("*", *scaled), [f"__z{i}" for i in range(len(scaled))]
        return df, s["features"]

    def fit(self, df: DataFrame) -> Model:
        s = self.spec
        if s["kind"] in self.MACHINES:
            return self._fit_machine(df)
        if s["kind"] != "linear":  # read many times
            df = written(df.select(*dict.fromkeys([*s["features"], s["y"], *([s["weight"]] if s["weight"] else [])])), "training-rows")
        ready, columns = self._prepared(df)
        name = {"ensemble": "mlp"}.get(s["kind"], s["kind"])
        seeds = [{"seed": i + 1} for i in range(s["members"])] if s["kind"] == "ensemble" else [{}]
        self.parts = [fitted(name, ready, columns, s["y"], s["weight"], **s["options"], **seed) for seed in seeds]
        return self

    def _fit_machine(self, df: DataFrame) -> Model:
        s = self.spec
        options = dict(s["options"])
        c, rank = float(options.pop("c", 1.0)), options.pop("rank", 128)
        df = written(df.select(*dict.fromkeys([*s["features"], s["y"], *([s["weight"]] if s["weight"] else [])])), "training-rows")  # the only read of what df is made of
        if s["kind"] == "rbf":
            s["nystroem"] = learn(df, s["features"], rank).as_lists()
        else:
            row = df.agg(*[e for i, c_ in enumerate(s["features"]) for e in (F.avg(c_).alias(f"m{i}"), F.stddev_pop(c_).alias(f"d{i}"))]).first()
            s["means"] = [float(row[f"m{i}"]) for i in range(len(s["features"]))]
            s["deviations"] = [float(row[f"d{i}"]) or 1.0 for i in range(len(s["features"]))]
        ready, columns = self._prepared(df)
        found = machines(ready, columns, s["y"], [c], s["kind"] != "svr", weight=s["weight"], mapped=self._mapped(), stored=True, **options)
        s["machine"] = {"features": columns, "cs": [c], "classes": found.classes, "coefficients": found.coefficients.tolist(), "objectives": found.objectives.tolist()}
        return self

    def _mapped(self):
        """Kernel features of raw rows, in tasks."""
        return Nystroem.of_lists(self.spec["nystroem"]).mapped if self.spec["kind"] == "rbf" else None

    def predict(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        ready, columns = self._prepared(df)
        if self.spec["kind"] in self.MACHINES:
            m = self.spec["machine"]
            fit = Machines(m["features"], m["cs"], m["classes"], np.array(m["coefficients"]), np.array(m["objectives"]), self._mapped())
            return fit.predict(ready, m["cs"][0]).select(*df.columns, F.col("h").cast("double").alias("h"))
        out = assembled(ready, columns)
        if self.spec["kind"] != "ensemble":
            return self.parts[0].transform(out).select(*df.columns, F.col("prediction").cast("double").alias("h"))
        chances = []
        for i, m in enumerate(self.parts):
            m.setPredictionCol(f"__p{i}").setProbabilityCol(f"__c{i}").setRawPredictionCol(f"__r{i}")
            out = m.transform(out)
            chances.append(vector_to_array(f"__c{i}"))
        mean = F.transform(chances[0], lambda x, i: (x + sum((F.get(c, i) for c in chances[1:]), F.lit(0.0))) / len(chances))
        return out.select(*df.columns, mean.alias("chances")).withColumn("h", F.array_position("chances", F.array_max("chances")).cast("double") - 1).select(*df.columns, "h")

    def metric(self, df: DataFrame, names: list[str] | None = None, classes: int | None = None) -> DataFrame:
        """Interval metrics of the predictions, or nominal ones for a number of classes."""
        from kadenz.operators import metrics as M

        out = self.predict(df).withColumn("__y", F.col(self.spec["y"]).cast("double"))
        found = M.interval(out, names, y="__y") if classes is None else M.nominal(out, classes, "__y")
        return found.select(*(names or found.columns))

    def save(self, path: str) -> None:
        _session().createDataFrame([(json.dumps(self.spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
        for i, m in enumerate(self.parts):
            m.write().overwrite().save(f"{path}/part-{i}")

    @classmethod
    def load(cls, path: str) -> Model:
        from pyspark.ml.util import DefaultParamsReader

        spec = json.loads(_session().read.text(f"{path}/spec").first().value)
        out = cls("", [], "")
        out.spec = spec
        count = spec["members"] if spec["kind"] == "ensemble" else 0 if spec["kind"] in cls.MACHINES else 1
        out.parts = [DefaultParamsReader.loadParamsInstance(f"{path}/part-{i}", _session()) for i in range(count)]
        return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def selected_univariate(df: DataFrame, features: list[str], y: str, percent: float, classes: bool = False) -> list[str]:
    """The features with the highest F statistics, `percent` of them."""
    from pyspark.ml.feature import UnivariateFeatureSelector

    s = UnivariateFeatureSelector(featuresCol="features", labelCol=y, selectionMode="percentile")
    s = s.setFeatureType("continuous").setLabelType("categorical" if classes else "continuous").setSelectionThreshold(percent)
    return [features[i] for i in s.fit(assembled(df, features)).selectedFeatures]


def synthetic(spark, rows: int, additive: bool = True, seed: int = 0) -> DataFrame:
    """A table with a known target of standard-normal sources: their sum, or a product and a square."""
    draws = spark.range(rows).select("id", *[F.randn(seed * 10 + k).alias(f"vision_s{k}") for k in range(4)])
    a, b, c, d = (F.col(f"vision_s{k}") for k in range(4))
    return draws.withColumn("y", a + b + c + d if additive else a * b + c * c)


def linear_cka(df: DataFrame, vector: str, split: int) -> DataFrame:
    """(cka): CKA with linear kernels of the first `split` elements against the rest, over all rows.

    The sum of products of two centred gram matrices is the squared Frobenius norm of X'Y over centred columns,
    so sums over rows replace the pairs. Each task gives one matrix of sums. Null vectors are left out; without
    rows, or where a half does not vary, the result is null.
    """
    v = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    means = v.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    middle = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e.m).alias("m"))
    centred = v.crossJoin(F.broadcast(middle)).select(F.zip_with("v", "m", lambda x, m: x - m).alias("v"))  # one row

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "s"])

    cov = centred.mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    part = lambda cond: F.sum(F.when(cond, F.col("s") * F.col("s")))
    left, right = F.col("i") < split, F.col("j") < split
    return cov.agg(F.try_divide(part(left & ~right), F.sqrt(part(left & right) * part(~left & ~right))).alias("cka"))
