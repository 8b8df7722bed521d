"""Models, moments and resampling against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadenz.operators import bootstrap as B
from kadenz.operators import gram, linear, mixed, nystroem
from kadenz.operators import models as L
from kadenz.operators import resample as R
from kadenz.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*columns.values(), strict=True)], names).repartition(4)


def local_em(groups, steps):
    """EM over (Z, X, y) of each group, written with the groups' own rows."""
    q, p = groups[0][0].shape[1], groups[0][1].shape[1]
    beta, d, s2 = np.zeros(p), np.eye(q), 1.0
    for _ in range(steps):
        post = []
        for z, x, y in groups:
            v = np.linalg.inv(z.T @ z / s2 + np.linalg.inv(d))
            post.append((v @ z.T @ (y - x @ beta) / s2, v))
        xx, xr = sum(x.T @ x for _, x, _ in groups), sum(x.T @ (y - z @ b) for (z, x, y), (b, _) in zip(groups, post, strict=True))
        beta = np.linalg.solve(xx, xr)
        s2 = sum(((y - x @ beta - z @ b) ** 2).sum() + np.trace(z @ v @ z.T) for (z, x, y), (b, v) in zip(groups, post, strict=True)) / sum(len(y) for *_, y in groups)
        d = sum(np.outer(b, b) + v for b, v in post) / len(post)
    return beta, d, s2


def test_random_slopes_estimate_all_variances(spark):
    rng = np.random.default_rng(4)
    true = np.array([[1.0, 0.5], [0.5, 0.8]])
    g = np.repeat(np.arange(60), rng.integers(1, 40, 60))
    b = rng.multivariate_normal([0, 0], true, 60)
    x = rng.normal(size=len(g))
    y = 2 + 3 * x + b[g, 0] + b[g, 1] * x + rng.normal(0, 0.5, len(g))
    df = frame(spark, g=g, one=np.ones(len(g)), x=x, y=y)
    effects, fit = mixed.random_slopes(df, "g", ["one", "x"], "y", fixed=["one", "x"], steps=25)
    local = [(np.column_stack([np.ones((g == k).sum()), x[g == k]]),) * 2 + (y[g == k],) for k in np.unique(g)]
    beta, d, s2 = local_em(local, 25)
    assert fit.beta == pytest.approx(beta, abs=1e-6) and fit.within == pytest.approx(s2, abs=1e-6) and fit.between == pytest.approx(d, abs=1e-6)
    assert all(b >= a - 1e-7 for a, b in zip(fit.likelihood, fit.likelihood[1:], strict=False)) and fit.within == pytest.approx(0.25, rel=0.2)
    assert {r.g: len(r.effects) for r in effects.collect()} == {int(k): 2 for k in np.unique(g)}
    # the likelihood is that of y under its marginal covariance
    first = sum(-0.5 * (len(yy) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + yy @ np.linalg.solve(c, yy)) for z, _, yy in local for c in [np.eye(len(yy)) + z @ z.T])
    assert fit.likelihood[0] == pytest.approx(first)


def test_covariance_of_wide_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2048)) + 1000
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)] + [(0, None)], "k int, v array<double>").repartition(3)
    n, mean, cov = gram.covariance(df, "v")
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    small = df.select("k", F.slice("v", 1, 5).alias("v"))
    for r in gram.moments(small, "k", "v", side=2).collect():
        own = x[np.arange(300) % 3 == r.k, :5]
        assert r.n == 100 and np.allclose(r.mean, own.mean(0)) and np.allclose(np.reshape(r.cov, (5, 5)), np.cov(own.T))
    assert gram.covariance(df.where("v IS NULL"), "v")[0] == 0


def test_canonical_correlation_of_all_elements(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    y = x[:, :4] @ rng.normal(size=(4, 4)) + 0.5 * rng.normal(size=(500, 4))
    v = np.column_stack([x, y])
    c, inv = np.cov(v.T), lambda m: np.linalg.inv(np.linalg.cholesky(m + 1e-4 * np.eye(len(m))))
    want = np.linalg.svd(inv(c[:6, :6]) @ c[:6, 6:] @ inv(c[6:, 6:]).T, compute_uv=False).mean()
    df = spark.createDataFrame([(r.tolist(),) for r in v], "v array<double>")
    assert L.canonical_of(df, "v", 6) == pytest.approx(want, abs=1e-9)


def descended(loss_and_slope, d, steps=60_000, rate=None):
    """A plain accelerated gradient descent."""
    w = z = np.zeros(d)
    for i in range(steps):
        _, g = loss_and_slope(z)
        new = z - rate * g
        z, w = new + i / (i + 3) * (new - w), new
    return loss_and_slope(w)[0]


@pytest.mark.parametrize("balanced", [False, True])
def test_machines_reach_the_least_objective(spark, balanced):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    band = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.8).astype(float) + (x[:, 1] > 0)
    fit = linear.machines(frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], band=band), ["a", "b", "c"], "band", [0.01, 1.0], balanced=balanced)
    one = np.column_stack([x, np.ones(400)])
    weight = {k: 400 / (3 * (band == k).sum()) if balanced else 1.0 for k in (0.0, 1.0, 2.0)}
    for c, objectives in zip(fit.cs, fit.objectives, strict=True):
        for k, found in zip(fit.classes, objectives, strict=True):
            sign, u = np.where(band == k, 1.0, -1.0), c * np.array([weight[b] for b in band])

            def cost(w, sign=sign, u=u):
                slack = np.maximum(0, 1 - sign * (one @ w))
                return w @ w / 2 + u @ slack**2, w - 2 * (u * sign * slack) @ one

            best = descended(cost, 4, 3000, 1 / (1 + 2 * np.linalg.eigvalsh(one.T @ (u[:, None] * one))[-1]))
            assert found == pytest.approx(best, rel=1e-4)


def test_regression_machines_reach_the_least_objective(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = x @ [1.0, -2.0] + 0.5 + 0.2 * rng.normal(size=300)
    df = frame(spark, a=x[:, 0], b=x[:, 1], y=y)
    fit = linear.machines(df, ["a", "b"], "y", [0.1, 10.0], classify=False, epsilon=0.1)
    one = np.column_stack([x, np.ones(300)])
    for c, found in zip(fit.cs, fit.objectives[:, 0], strict=True):

        def cost(w, c=c):
            r = y - one @ w
            slack = np.maximum(0, np.abs(r) - 0.1)
            return w @ w / 2 + c * slack @ slack, w - 2 * c * (np.sign(r) * slack) @ one

        assert found == pytest.approx(descended(cost, 3, 5000, 1 / (1 + 2 * c * np.linalg.eigvalsh(one.T @ one)[-1])), rel=1e-4)
    assert fit.predict(df, 10.0).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("h"), F.lit(2)))).alias("e")).first().e < 0.25


def conjugate(a, b):
    """a^-1 b by conjugate gradients."""
    x, r = np.zeros(len(b)), b.copy()
    p = r.copy()
    for _ in range(500):
        ap = a @ p
        step = r @ r / (p @ ap)
        x, new = x + step * p, r - step * ap
        if np.sqrt(new @ new) < 1e-9:
            break
        p, r = new + (new @ new) / (r @ r) * p, new
    return x


def test_rbf_machine_is_near_the_exact_kernel_machine(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 2))
    label = ((x**2).sum(1) + 0.3 * rng.normal(size=2000) > 1.4).astype(float)
    held = rng.normal(size=(2000, 2))
    truth = ((held**2).sum(1) > 1.4).astype(float)
    model = L.Model("rbf", ["a", "b"], "label", rank=64).fit(frame(spark, a=x[:, 0], b=x[:, 1], label=label))
    got = model.predict(frame(spark, a=held[:, 0], b=held[:, 1], label=truth)).agg(F.avg((F.col("h") == F.col("label")).cast("double")).alias("a")).first().a
    # the exact machine, over one coefficient per row, by Newton steps
    m, s = x.mean(0), x.std(0)
    k, sign = nystroem.kernel((x - m) / s, (x - m) / s, 0.5) + 1, 2 * label - 1
    beta = np.zeros(2000)
    for _ in range(30):
        on = sign * (k @ beta) < 1
        new = np.zeros(2000)
        new[on] = conjugate(k[np.ix_(on, on)] + 0.5 * np.eye(on.sum()), sign[on])
        if np.allclose(new, beta, atol=1e-4):
            break
        beta = new
    exact = (((nystroem.kernel((held - m) / s, (x - m) / s, 0.5) + 1) @ beta > 0) == (truth == 1)).mean()
    assert got >= exact - 0.01 and exact > 0.9
    spec = model.spec["nystroem"]
    assert spec["error"] < 0.01 and len(spec["root"][0]) <= 64


def test_more_landmarks_come_nearer_to_the_kernel(spark):
    x = np.random.default_rng(8).normal(size=(1500, 4))
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], d=x[:, 3])
    errors = [nystroem.learn(df, ["a", "b", "c", "d"], n).error for n in (8, 32, 128)]
    assert errors[0] > errors[1] > errors[2]
    out = nystroem.learn(df, ["a", "b"], 8).transform(df.withColumn("a", F.when(F.col("b") > 0, F.col("a"))))
    assert out.count() == 1500 and out.where("(a IS NULL) <> (kernel IS NULL)").count() == 0


def test_grid_search_equals_fits_on_rows(spark):
    rng = np.random.default_rng(9)
    x, fold = rng.normal(size=(200, 3)) + 50, rng.integers(0, 4, 200)
    y = x @ [1.0, 0.0, -1.0] + rng.normal(size=200)
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y, fold=fold)
    for r in linear.grid_search(df, ["a", "b", "c"], "y", "fold", [0.0, 5.0]).collect():
        tx, ty = x[fold != r.fold], y[fold != r.fold]
        b = np.linalg.solve((tx - tx.mean(0)).T @ (tx - tx.mean(0)) + r.penalty * np.eye(3), (tx - tx.mean(0)).T @ (ty - ty.mean()))
        own = ((y - ty.mean() - (x - tx.mean(0)) @ b)[fold == r.fold] ** 2).mean()
        assert r.validation == pytest.approx(own) and r.n == (fold == r.fold).sum()
    kept, penalty = linear.selected(df.withColumn("id", F.monotonically_increasing_id()), ["a", "b", "c"], "y", [0.01, 0.3, 50.0], "id")
    assert set(kept) >= {"a", "c"} and penalty < 50
    assert linear.grid_search(df.where("false"), ["a"], "y", "fold", [1.0]).count() == 0


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 5)) * [1, 5, 1, 2, 1]
    y = x @ [1.0, 0.0, 0.5, 0.0, 0.0] + rng.normal(size=300)
    z = np.column_stack([np.ones(300), x, y])
    b = linear.lasso(z.T @ z, 0.2)
    s = x.std(0)
    slope = ((x - x.mean(0)) / s).T @ (y - b[0] - x @ b[1:]) / 300
    for g, c in zip(slope, b[1:] * s, strict=True):
        assert abs(g) <= 0.2 + 1e-9 if c == 0 else g == pytest.approx(0.2 * np.sign(c))


def test_model_protocol_of_machines(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=300)
    df = frame(spark, a=x, b=rng.normal(size=300), y=2 * x + 1, k=(x > 0).astype(float))
    for kind, y in (("svm", "k"), ("svr", "y"), ("rbf", "k")):
        model = L.Model(kind, ["a", "b"], y, rank=20, c=10.0) if kind == "rbf" else L.Model(kind, ["a", "b"], y, c=10.0)
        model.fit(df).save(f"{tmp_path}/{kind}")
        same = L.Model.load(f"{tmp_path}/{kind}")
        assert sorted(map(tuple, same.predict(df).collect())) == sorted(map(tuple, model.predict(df).collect()))
        score = same.metric(df, ["accuracy"], 2).first()[0] if y == "k" else 1 - same.metric(df, ["rmse"]).first()[0]
        assert score > 0.9


def test_bootstrap_weights_and_scores(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("h"), (F.col("id") % 3 == 0).alias("p"))
    long = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", R.poisson_weight("id", "draw"))
    want = {(r.draw, r.id): r.w for r in long.collect()}
    got = B.weights(np.arange(500), 20)
    assert all(got[d, i] == w for (d, i), w in want.items())
    auc = {r.draw: r.value for r in B.auc_scores(df.repartition(5), "id", F.col("p"), {"1": "h"}, 20).collect()}
    ids = np.arange(500)
    for d, w in enumerate(got):
        s, p = ids % 5, ids % 3 == 0
        order = (s[:, None] > s[None]) + (s[:, None] == s[None]) / 2
        won = (w * p) @ order @ (w * ~p)
        assert auc[d] == pytest.approx(won / ((w * p).sum() * (w * ~p).sum()))
    assert B.intervals(B.interval_scores(df.where("false"), "id", "y", {"1": "h"}, 5)).count() == 0
    one = B.intervals(B.interval_scores(df, "id", "y", {"1": "h"}, 50)).collect()
    assert {r.model for r in one} == {"1"} and all(r.lower <= r.center <= r.upper for r in one)


def test_forest_and_networks_find_what_is_planted(spark):
    """Steps and their product on two of four features: held-out rows are told apart nearly as well as noise allows."""
    rng = np.random.default_rng(12)
    make = lambda n: rng.uniform(size=(n, 4))
    steps = lambda x: 3 * (x[:, 0] > 0.5) + 2 * (x[:, 1] > 0.7) * (x[:, 0] > 0.5)
    train, held = make(3000), make(1000)
    columns = lambda x, **more: frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], d=x[:, 3], **more)
    model = L.Model("forest", ["a", "b", "c", "d"], "y", numTrees=20, maxDepth=6, seed=3, featureSubsetStrategy="all", maxBins=512).fit(columns(train, y=steps(train) + rng.normal(0, 0.2, 3000)))
    assert model.metric(columns(held, y=steps(held).astype(float)), ["rmse"]).first().rmse < 0.3
    weight = model.parts[0].featureImportances.toArray()
    assert weight[:2].sum() > 0.95
    rings = lambda x: (np.hypot(x[:, 0] - 0.5, x[:, 1] - 0.5) < 0.35).astype(float)
    net = L.Model("ensemble", ["a", "b"], "y", members=3, layers=[2, 10, 2], maxIter=100).fit(columns(train, y=rings(train)))
    assert net.metric(columns(held, y=rings(held)), ["accuracy"], 2).first().accuracy > 0.95
