"""Interval, ordinal and nominal metrics as one aggregate plan each; keys give the grouped form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadenz.operators.ordering import running
from kadenz.operators.stats import weighted_mean
from kadenz.session import written


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def interval_metrics(y: str = "y", h: str = "h") -> dict[str, Column]:
    """Metrics of targets y and predictions h, by name, as aggregates."""
    d = F.col(y) - F.col(h)
    vy, vh, cov = F.var_pop(y), F.var_pop(h), F.covar_pop(y, h)
    gap = F.avg(y) - F.avg(h)
    n = F.count(d).cast("double")
    # two raters: mean squares of rows, raters and rest from sums
    row_ss = 2 * (F.sum((F.col(y) + F.col(h)) * (F.col(y) + F.col(h))) / 4 - n * F.pow((F.avg(y) + F.avg(h)) / 2, F.lit(2)))
    rater_ss = n * gap * gap / 2
    rest_ss = F.sum(d * d) / 2 - rater_ss
    msr, mse, msc = F.try_divide(row_ss, n - 1), F.try_divide(rest_ss, n - 1), rater_ss
    pooled = F.try_divide(F.sum(F.col(y) * F.col(y) + F.col(h) * F.col(h)) - F.pow(F.sum(F.col(y) + F.col(h)), F.lit(2)) / (2 * n), 2 * n - 1)
    return {
        "mse": F.avg(d * d), "mse_baseline": vy, "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)),
        "ccc": _ratio(2 * cov, vy + vh + gap * gap), "pcc": _ratio(cov, F.sqrt(vy * vh)),
        "icc_c1": _ratio(msr - mse, msr + mse), "icc_a1": _ratio(msr - mse, msr + mse + 2 * (msc - mse) / n),
        "alpha": 1 - _ratio(F.avg(d * d), 2 * pooled),
    }


def interval(df: DataFrame, names: list[str] | None = None, keys: list[str] | None = None, y: str = "y", h: str = "h") -> DataFrame:
    """The named metrics (all, if none are named; a name may be a prefix)."""
    found = interval_metrics(y, h)
    return df.groupBy(*(keys or [])).agg(*[e.alias(n) for n, e in found.items() if not names or n.startswith(tuple(names))])


def median_baseline(df: DataFrame, y: str = "y") -> DataFrame:
    """Mean absolute error of the median predictor. The median comes from running counts of distinct targets, nulls left out."""
    counts = written(df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("c")), "targets")
    placed = running(counts, [y], {"before": "c"}).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))  # one row
    at = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("c")), F.col(y).cast("double")))
    m = placed.agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("m"))
    return df.crossJoin(F.broadcast(m)).agg(F.avg(F.abs(F.col(y) - F.col("m"))).alias("mae_baseline"))  # one row


def spearman(df: DataFrame, y: str = "y", h: str = "h") -> DataFrame:
    """Rank correlation with mean ranks of ties; pairs with a null are left out.

    The rows are read once, as counts of distinct pairs; both rankings run over distinct values and meet the pairs again.
    """
    pairs = written(df.select(F.col(y).alias("y"), F.col(h).alias("h")).dropna().groupBy("y", "h").agg(F.count(F.lit(1)).alias("n")), "pairs")
    ranks = {}
    for c in ("y", "h"):
        values = written(pairs.groupBy(c).agg(F.sum("n").alias("n")), "pair-values")
        ranks[c] = running(values, [c], {"before": "n"}).select(c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))
    centre = F.broadcast(pairs.agg(((F.sum("n") + 1) / 2.0).alias("centre")))  # one row
    ranked = pairs.join(ranks["y"], "y").join(ranks["h"], "h").crossJoin(centre)
    a, b, n = F.col("ry") - F.col("centre"), F.col("rh") - F.col("centre"), F.col("n").cast("double")
    return ranked.agg(_ratio(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b))).alias("spearman"))


#: Pairs up to which the signed-rank test is exact, unless differences tie.
EXACT = 50


def wilcoxon(df: DataFrame, d: Column) -> DataFrame:
    """One-sided signed-rank test of d: n, w (rank sum of the positive), p.

    p is exact for up to EXACT pairs without ties, else from the tie-corrected normal approximation.
    """
    a = F.abs("d").alias("a")
    counts = df.select(d.alias("d")).where("d <> 0").groupBy(a).agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    ranked = running(written(counts, "differences"), ["a"], {"before": "c"})  # one row per distinct difference
    c = F.col("c").cast("double")
    out = ranked.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("up") > 0, F.col("up") * (F.col("before") + (F.col("c") + 1) / 2.0))).alias("w"), F.sum(c * c * c - c).alias("t"))
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, sd)
    few = (F.col("n") > 0) & (F.col("n") <= EXACT) & (F.col("t") == 0)
    return out.select("n", "w", F.when(few, signed_rank_tail(F.col("n"), F.coalesce("w", F.lit(0.0)))).otherwise(upper_tail(z)).alias("p"))


def signed_rank_tail(n: Column, w: Column) -> Column:
    """Chance that the positive ranks of n pairs sum to w or more: subsets of 1..n counted by their sum."""
    most = (n * (n + 1) / 2).cast("int")
    none = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), most))
    longer = lambda counts, k: F.transform(counts, lambda x, i: x + F.when(i >= k, F.get(counts, i - k.cast("int"))).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1).cast("long"), n), none, longer)
    tail = F.slice(counts, F.ceil(w).cast("int") + 1, most + 1)
    return F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n)


def upper_tail(z: Column) -> Column:
    """Of the standard normal; the rational approximation of erf by Abramowitz and Stegun, error below 2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    c = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)  # fixed values
    poly = t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def confusion(df: DataFrame, k: int, y: str = "y", h: str = "h", keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, n): all k * k cells, zero where empty."""
    keys = keys or []
    spark = df.sparkSession
    cells = spark.range(k * k).select((F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    if keys:
        cells = df.select(*keys).distinct().crossJoin(cells)
    got = df.groupBy(*keys, F.col(y).cast("int").alias("i"), F.col(h).cast("int").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(got, [*keys, "i", "j"], "left").fillna(0, ["n"])


def per_class(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, class, support, precision, recall, f1) from a confusion table; zero denominators give 0."""
    keys = keys or []
    true = cells.groupBy(*keys, F.col("i").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(*keys, F.col("j").alias("class")).agg(F.sum("n").alias("said"))
    out = true.join(said, [*keys, "class"])
    p, r = _ratio(F.col("tp"), F.col("said")), _ratio(F.col("tp"), F.col("support"))
    return out.select(*keys, "class", "support", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def nominal(df: DataFrame, k: int, y: str = "y", h: str = "h", keys: list[str] | None = None) -> DataFrame:
    """accuracy, balanced, majority, macro and weighted precision, recall and f1."""
    return nominal_of(confusion(df, k, y, h, keys), keys)


def nominal_of(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same from a confusion table (keys, i, j, n); counts may be weights."""
    keys = keys or []
    c = per_class(cells, keys)
    total, there = F.sum("support"), F.count(F.when(F.col("support") > 0, 1))
    macro = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return c.groupBy(*keys).agg(
        _ratio(F.sum(F.col("recall") * F.col("support")), total).alias("accuracy"), _ratio(F.sum("recall"), there).alias("balanced"),
        _ratio(F.max("support"), total).alias("majority"), *macro, *weighted,
    )


def agreement(cells: DataFrame, ordinal: bool) -> DataFrame:
    """Cohen's kappa and Krippendorff's alpha of two raters from a confusion table."""
    total = cells.agg(F.sum("n").alias("total"))
    rows = cells.groupBy("i").agg(F.sum("n").alias("a"))
    cols = cells.groupBy(F.col("j").alias("i")).agg(F.sum("n").alias("b"))
    margins = rows.join(cols, "i").withColumn("m", F.col("a") + F.col("b"))
    w = Window.orderBy("i")  # one row per class
    margins = margins.withColumn("upto", F.sum("m").over(w))
    a = margins.select("i", "a", F.col("m").alias("mi"), F.col("upto").alias("ui"))
    b = margins.select(F.col("i").alias("j"), "b", F.col("m").alias("mj"), F.col("upto").alias("uj"))
    grid = cells.join(a, "i").join(b, "j").crossJoin(total)
    between = F.abs(F.col("ui") - F.col("uj")) + F.when(F.col("i") < F.col("j"), F.col("mi") - F.col("mj")).otherwise(F.col("mj") - F.col("mi")) / 2
    kappa_w = F.pow((F.col("i") - F.col("j")).cast("double"), F.lit(2)) if ordinal else (F.col("i") != F.col("j")).cast("double")
    alpha_w = F.pow(between, F.lit(2)) if ordinal else (F.col("i") != F.col("j")).cast("double")
    return grid.groupBy("total").agg(
        F.sum(kappa_w * F.col("n")).alias("ko"), F.sum(kappa_w * F.col("a") * F.col("b")).alias("ke"), F.sum(alpha_w * F.col("n")).alias("ao"), F.sum(alpha_w * F.col("mi") * F.col("mj")).alias("ae"),
    ).select(
        (1 - _ratio(F.col("ko"), F.col("ke") / F.col("total"))).alias("kappa"),
        (1 - _ratio(2 * F.col("ao") * (2 * F.col("total") - 1), F.col("ae"))).alias("alpha"),
    )


def auc(df: DataFrame, positive: Column, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """(keys, auc): ties count half; null where one class is absent. Scores are counted first, so ranks run over distinct ones."""
    keys = keys or []
    by = written(df.groupBy(*keys, score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q")), "scores")
    won = running(by, [score], {"below": "q"}, keys).withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2.0))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q").cast("double")).alias("auc"))


def auc_one_vs_rest(df: DataFrame, k: int, y: str = "y", score: str = "score") -> DataFrame:
    """(class, auc) of classes 0 to k - 1 against the rest. Scores are counted once, with one column per class, and ordered once."""
    own = [f"__c{i}" for i in range(k)]
    by = written(df.groupBy(score).agg(F.count(F.lit(1)).alias("__all"), *[F.count(F.when(F.col(y) == i, 1)).alias(c) for i, c in enumerate(own)]), "scores")
    below = running(by, [score], {"__below": "__all"} | {f"{c}b": c for c in own})
    won = lambda c: F.sum(F.col(c) * (F.col("__below") - F.col(f"{c}b") + (F.col("__all") - F.col(c)) / 2.0))
    pairs = lambda c: F.sum(c).cast("double") * (F.sum("__all") - F.sum(c)).cast("double")
    found = below.agg(F.array(*[F.struct(F.lit(i).alias("class"), F.try_divide(won(c), pairs(c)).alias("auc")) for i, c in enumerate(own)]).alias("found"))
    return found.select(F.inline("found"))


def equal_error_rate(df: DataFrame, positive: Column, score: str = "score") -> DataFrame:
    """Mean of both error rates at the first threshold where they are nearest; scores at or above it are positive."""
    by = written(df.groupBy(score).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q")), "scores")
    rates = running(by, [score], {"below_p": "p", "below_q": "q"}).crossJoin(F.broadcast(by.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))))  # one row
    rates = rates.select(score, (F.col("below_p") / F.col("tp")).alias("fnr"), (1 - F.col("below_q") / F.col("tq")).alias("fpr"))
    gap = F.round(F.pow(F.col("fnr") - F.col("fpr"), F.lit(2)), 12)
    return rates.agg(F.min_by(F.struct("fnr", "fpr"), F.struct(gap, score)).alias("m")).select(((F.col("m.fnr") + F.col("m.fpr")) / 2).alias("eer"))


def losses(y: str = "y", h: str = "h") -> dict[str, Column]:
    m = interval_metrics(y, h)
    return {"mse": m["mse"], "l1": m["mae"], "one_minus_pcc": 1 - m["pcc"], "one_minus_ccc": 1 - m["ccc"], "l1_pcc": 0.9 * m["mae"] + 0.1 * (1 - m["pcc"]), "l1_ccc": 0.9 * m["mae"] + 0.1 * (1 - m["ccc"])}


def over_clusters(per: DataFrame, names: list[str], n: str = "n") -> DataFrame:
    """Null-skipping mean of per-cluster metrics, plain and by the clusters' shares."""
    return per.agg(*[F.avg(m).alias(m) for m in names], *[weighted_mean(F.col(m), F.col(n)).alias(f"{m}_proportional") for m in names])


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a correlation, for a result of one row: 1 for null r or fewer than three rows."""
    if r is None or n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return _beta((n - 2) / 2, 0.5, 1 - r * r)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d) if abs(1 + term * d) > 1e-300 else 1e300
        c = 1 + term / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if i and abs(c * d - 1) < 1e-12:
            break
    return front * (f - 1)
