"""Queries of the time operators: joins, interval statistics, segments, windows, markers, signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kadenz.operators import intervals as I
from kadenz.operators import joins as J
from kadenz.operators import signal as G
from kadenz.operators import stats as S
from kadenz.plans import views as V
from kadenz.plans.registry import query, r6, rounded
from kadenz.session import table

STATS = {"mean": ["v"], "std": ["v"], "median": ["v"], "iqr": ["v"]}
_STAT_SQL = "round(avg(v), 6) AS v_mean, round(coalesce(stddev_samp(v), 0), 6) AS v_std, round(quantile_cont(v, 0.5), 6) AS v_median, round(coalesce(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 0), 6) AS v_iqr"
#: Runs of samples over 50 per user and channel, as segments.
SEGMENTS_SQL = """
    on_ AS (SELECT *, v > 50 AS a, lead(t) OVER w AS nt, t - lag(t) OVER w AS d, coalesce(lag(v > 50) OVER w, false) AS pa FROM series WINDOW w AS (PARTITION BY rec_id, channel ORDER BY t)),
    run_ AS (SELECT *, sum(CASE WHEN a AND NOT pa THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel ORDER BY t) AS seg_id FROM on_),
    step_ AS (SELECT rec_id, channel, coalesce(quantile_cont(d, 0.5), 0) AS step FROM on_ GROUP BY ALL),
    segs AS (SELECT r.rec_id, r.channel, seg_id::BIGINT AS seg_id, min(t) AS begin_t, coalesce(arg_max(nt, t), max(t) + any_value(step)) AS end_t FROM (SELECT *, CASE WHEN nt IS NULL THEN NULL ELSE nt END AS nt2 FROM run_) r JOIN step_ s USING (rec_id, channel) WHERE a GROUP BY r.rec_id, r.channel, seg_id)
"""


def active(spark, sf_dir):
    return V.series(spark, sf_dir).withColumn("on", F.col("v") > 50)


def segs(spark, sf_dir):
    return I.segments(active(spark, sf_dir), "on", ["rec_id", "channel"])


def segs_of(spark, sf_dir, channel):
    return segs(spark, sf_dir).where(F.col("channel") == channel).select("rec_id", "seg_id", "begin_t", "end_t")


def series_of(spark, sf_dir, channel):
    return V.series(spark, sf_dir).where(F.col("channel") == channel)


def segments_sql(body):
    return f"WITH series AS ({V.SQL['series']}), {SEGMENTS_SQL.replace('coalesce(arg_max(nt, t), max(t) + any_value(step))', 'CASE WHEN max(CASE WHEN nt IS NULL THEN 1 ELSE 0 END) = 1 THEN max(t) + any_value(step) ELSE max(nt) END')} {body}"


@query("j1_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j2_left_join_keeps_rows", "SELECT l_partkey, count(*) AS n, count(p_name) AS named FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY l_partkey")
def j2(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size > 10")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count("p_name").alias("named"))


@query("j3_semi_join", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def j3(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j4_anti_join", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey")
def j4(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("j5_interval_containment", V.sql("SELECT s.rec_id, seq, seg_id FROM series s JOIN intervals i ON s.rec_id = i.rec_id AND t >= begin_t AND t <= end_t", "series", "intervals"))
def j5(spark, sf_dir):
    return J.contains(V.series(spark, sf_dir), V.intervals(spark, sf_dir)).select("rec_id", "seq", "seg_id")


@query("j6_interval_overlap", V.sql("SELECT a.rec_id, a.seg_id AS a_id, b.seg_id AS b_id FROM intervals a JOIN intervals b ON a.rec_id = b.rec_id AND a.seg_id < b.seg_id AND a.begin_t < b.end_t AND a.end_t > b.begin_t", "intervals"))
def j6(spark, sf_dir):
    i = V.intervals(spark, sf_dir)
    a = i.select("rec_id", F.col("seg_id").alias("a_id"), F.col("begin_t").alias("a_begin"), F.col("end_t").alias("a_end"))
    b = i.select("rec_id", F.col("seg_id").alias("b_id"), F.col("begin_t").alias("b_begin"), F.col("end_t").alias("b_end"))
    return J.overlaps(a, b).where("a_id < b_id").select("rec_id", "a_id", "b_id")


_NEAREST = """
    (SELECT c.rec_id, c.seq, s.v AS near_v, row_number() OVER (PARTITION BY c.seq ORDER BY abs(s.t - c.t), s.t DESC) AS rn, abs(s.t - c.t) AS dt FROM series c LEFT JOIN series s ON s.rec_id = c.rec_id AND s.channel = 'view' WHERE c.channel = 'click')
"""


@query("j7_nearest_sample", V.sql(f"SELECT rec_id, seq, near_v FROM {_NEAREST} WHERE rn = 1", "series"))
def j7(spark, sf_dir):
    out = J.nearest(series_of(spark, sf_dir, "click").select("rec_id", "t", "seq"), series_of(spark, sf_dir, "view").select("rec_id", "t", "v"), ["v"])
    return out.select("rec_id", "seq", "near_v")


@query("j8_lookup_without_overlap", V.sql("""
    , w AS (SELECT *, lead(begin_t) OVER o AS nb, lead(end_t) OVER o AS ne, lag(begin_t) OVER o AS pb, lag(end_t) OVER o AS pe, row_number() OVER o - 1 AS n FROM intervals WINDOW o AS (PARTITION BY rec_id ORDER BY begin_t, seg_id))
    SELECT rec_id, seg_id, n AS interval_number, round(CASE WHEN pe > begin_t THEN (pb + end_t) / 2 ELSE begin_t END, 3) AS cut_begin, round(CASE WHEN nb < end_t THEN (begin_t + ne) / 2 ELSE end_t END, 3) AS cut_end FROM w
""", "intervals"))  # fmt: skip
def j8(spark, sf_dir):
    out = J.without_overlap(V.intervals(spark, sf_dir))
    return out.select("rec_id", "seg_id", F.col("interval_number").cast("long").alias("interval_number"), F.round("cut_begin", 3).alias("cut_begin"), F.round("cut_end", 3).alias("cut_end"))


@query("j9_synchronised_sources", V.sql("""
    , span AS (SELECT rec_id, min(t) AS lo, max(t) AS hi FROM series GROUP BY rec_id),
    grid AS (SELECT rec_id, k, lo + k * 43200.0 AS t FROM (SELECT *, unnest(range(0, floor((hi - lo) / 43200.0)::BIGINT + 1)) AS k FROM span)),
    c AS (SELECT g.rec_id, g.k, s.channel, s.v, row_number() OVER (PARTITION BY g.rec_id, g.k, s.channel ORDER BY abs(s.t - g.t), s.t DESC) AS rn FROM grid g JOIN series s ON s.rec_id = g.rec_id AND s.channel IN ('click', 'view'))
    SELECT g.rec_id, g.k, max(v) FILTER (channel = 'click') AS click_v, max(v) FILTER (channel = 'view') AS view_v FROM grid g LEFT JOIN (SELECT * FROM c WHERE rn = 1) c ON c.rec_id = g.rec_id AND c.k = g.k GROUP BY g.rec_id, g.k
""", "series"))  # fmt: skip
def j9(spark, sf_dir):
    s = V.series(spark, sf_dir)
    span = s.groupBy("rec_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / 43200.0).cast("long"))
    out = span.select("rec_id", "lo", F.explode(steps).alias("k")).select("rec_id", "k", (F.col("lo") + F.col("k") * 43200.0).alias("t"))
    for channel in ("click", "view"):
        near = J.nearest(out, s.where(F.col("channel") == channel).select("rec_id", "t", "v"), ["v"])
        out = near.withColumnRenamed("near_v", f"{channel}_v").drop("near_t")
    return out.select("rec_id", "k", "click_v", "view_v")


@query("j10_nearest_within_tolerance", V.sql(f"SELECT rec_id, seq, CASE WHEN dt < 3600 THEN near_v END AS near_v FROM {_NEAREST} WHERE rn = 1", "series"))
def j10(spark, sf_dir):
    out = J.nearest(series_of(spark, sf_dir, "click").select("rec_id", "t", "seq"), series_of(spark, sf_dir, "view").select("rec_id", "t", "v"), ["v"], tolerance=3600)
    return out.select("rec_id", "seq", "near_v")


@query("a2_statistics_per_interval", V.sql(f"SELECT i.rec_id, i.seg_id, {_STAT_SQL} FROM intervals i LEFT JOIN series s ON s.rec_id = i.rec_id AND t >= begin_t AND t <= end_t GROUP BY ALL", "series", "intervals"))
def a2(spark, sf_dir):
    return rounded(S.aggregate_to_intervals(V.series(spark, sf_dir), V.intervals(spark, sf_dir), STATS, ["rec_id", "seg_id"]))


@query("a1_statistic_map", V.sql("SELECT meta_id, round(avg(acoustic_qty), 6) AS acoustic_qty_mean, round(avg(language_size), 6) AS language_size_mean, round(coalesce(stddev_samp(acoustic_price), 0), 6) AS acoustic_price_std, round(coalesce(var_samp(acoustic_qty), 0), 6) AS acoustic_qty_var, round(quantile_cont(vision_disc, 0.5), 6) AS vision_disc_median, round(quantile_cont(vision_tax, 0.75) - quantile_cont(vision_tax, 0.25), 6) AS vision_tax_iqr, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM wide GROUP BY meta_id", "wide"))
def a1(spark, sf_dir):
    wanted = {"mean": ["acoustic_qty", "language_size", "absent"], "std": ["acoustic_price"], "var": ["acoustic_qty"], "median": ["vision_disc"], "iqr": ["vision_tax"], "min": ["y"], "max": ["y"]}
    return rounded(S.aggregate(V.wide(spark, sf_dir), wanted, ["meta_id"]))


@query("a3_suggested_statistics", V.sql("SELECT meta_id, round(avg(acoustic_qty), 6) AS acoustic_qty_mean, round(coalesce(stddev_samp(acoustic_qty), 0), 6) AS acoustic_qty_std, round(quantile_cont(vision_disc, 0.5), 6) AS vision_disc_median, round(quantile_cont(vision_disc, 0.75) - quantile_cont(vision_disc, 0.25), 6) AS vision_disc_iqr, round(avg(language_size), 6) AS language_size_mean, round(avg(y), 6) AS y_mean FROM wide GROUP BY meta_id", "wide"))
def a3(spark, sf_dir):
    return rounded(S.aggregate(V.wide(spark, sf_dir), S.suggest(["acoustic_qty", "vision_disc", "language_size", "y"]), ["meta_id"]))


@query("w1_rolling_statistics", V.sql("""
    SELECT seq, CASE WHEN count(v) OVER w >= 3 THEN round(avg(v) OVER w, 6) END AS v_mean, coalesce(CASE WHEN count(v) OVER w >= 3 THEN round(stddev_samp(v) OVER w, 6) END, 0) AS v_std,
    CASE WHEN count(v) OVER w >= 3 THEN round(quantile_cont(v, 0.5) OVER w, 6) END AS v_median FROM series WINDOW w AS (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""", "series"))  # fmt: skip
def w1(spark, sf_dir):
    return rounded(S.rolling(V.series(spark, sf_dir), "v", 12, ["mean", "std", "median"]).select("seq", "v_mean", "v_std", "v_median"))


@query("w2_first_difference", V.sql("SELECT seq, round(v - lag(v) OVER w, 6) AS d, round(abs(v - lag(v) OVER w), 6) AS ad FROM series WINDOW w AS (PARTITION BY rec_id, channel ORDER BY t)", "series"))
def w2(spark, sf_dir):
    d = F.col("v") - F.lag("v").over(Window.partitionBy("rec_id", "channel").orderBy("t"))
    return rounded(V.series(spark, sf_dir).select("seq", d.alias("d"), F.abs(d).alias("ad")))


@query("w3_median_step", V.sql("SELECT rec_id, round(quantile_cont(d, 0.5), 6) AS step FROM (SELECT rec_id, t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) AS d FROM series) GROUP BY rec_id", "series"))
def w3(spark, sf_dir):
    return rounded(S.median_step(V.series(spark, sf_dir)))


@query("w4_fill_forward_backward", V.sql("""
    , n AS (SELECT rec_id, seq, t, CASE WHEN seq % 3 = 0 THEN v END AS v FROM series)
    SELECT seq, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM n
""", "series"))  # fmt: skip
def w4(spark, sf_dir):
    rows = V.series(spark, sf_dir).withColumn("v", F.when(F.col("seq") % 3 == 0, F.col("v")))
    return S.filled(rows, ["v"]).select("seq", "v")


@query("w5_hop_windows", V.sql("""
    , i AS (SELECT rec_id, t, v, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i FROM series),
    k AS (SELECT *, unnest(range(greatest(0, ceil((i - 9) / 4.0))::BIGINT, i // 4 + 1)) AS k FROM i)
    SELECT rec_id, k, round((min(t) + max(t)) / 2, 3) AS centre, round(avg(v), 6) AS m FROM k GROUP BY rec_id, k HAVING count(*) = 10
""", "series"))  # fmt: skip
def w5(spark, sf_dir):
    w = S.hop_windows(V.series(spark, sf_dir), 10, 4, "v")
    return w.groupBy("rec_id", "k").agg(F.round((F.min("t") + F.max("t")) / 2, 3).alias("centre"), r6(F.avg("v")).alias("m"))


@query("w6_median_filter", V.sql("""
    , l AS (SELECT seq, list(v) OVER (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM series)
    SELECT seq, list_sort(list_concat(l, list_resize([]::DOUBLE[], (5 - len(l))::BIGINT, 0.0)))[3] AS v_median FROM l
""", "series"))  # fmt: skip
def w6(spark, sf_dir):
    return S.median_filtered(V.series(spark, sf_dir), "v", 5).select("seq", "v_median")


@query("w7_erosion", V.sql("SELECT seq, min((v > 20)::INT) OVER w = 1 AND count(*) OVER w = 5 AS e FROM series WINDOW w AS (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "series"))
def w7(spark, sf_dir):
    return S.eroded(V.series(spark, sf_dir).withColumn("f", F.col("v") > 20), "f", 2).select("seq", F.col("f_eroded").alias("e"))


@query("w9_positional_groups", V.sql("SELECT seq, (row_number() OVER w - 1) // 12 AS g12, (row_number() OVER w - 1) // 3 AS g3 FROM series WINDOW w AS (PARTITION BY rec_id ORDER BY t)", "series"))
def w9(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("rec_id").orderBy("t")) - 1
    return V.series(spark, sf_dir).select("seq", F.floor(i / 12).alias("g12"), F.floor(i / 3).alias("g3"))


@query("w11_bounded_label_shift", V.sql("SELECT seg_id, round(begin_t - 1, 3) AS b, round(least(begin_t + 29, lead(begin_t) OVER (PARTITION BY rec_id ORDER BY begin_t) - 1), 3) AS e FROM intervals", "intervals"))
def w11(spark, sf_dir):
    nxt = F.lead("begin_t").over(Window.partitionBy("rec_id").orderBy("begin_t")) - 1
    return V.intervals(spark, sf_dir).select("seg_id", F.round(F.col("begin_t") - 1, 3).alias("b"), F.round(F.least(F.col("begin_t") + 29, nxt), 3).alias("e"))


@query("i1_segments", segments_sql("SELECT rec_id, channel, seg_id, round(begin_t, 3) AS begin_t, round(end_t, 3) AS end_t FROM segs"))
def i1(spark, sf_dir):
    return segs(spark, sf_dir).select("rec_id", "channel", "seg_id", F.round("begin_t", 3).alias("begin_t"), F.round("end_t", 3).alias("end_t"))


@query("i2_long_segments", segments_sql("SELECT rec_id, channel, seg_id FROM segs WHERE end_t - begin_t > 43200"))
def i2(spark, sf_dir):
    return I.longer(segs(spark, sf_dir), 43200).select("rec_id", "channel", "seg_id")


_AB = "a AS (SELECT * FROM segs WHERE channel = 'click'), b AS (SELECT * FROM segs WHERE channel = 'view')"


@query("i3_merged_pauses", segments_sql(f"""
    , {_AB}, g AS (SELECT *, lag(end_t) OVER w AS pe, row_number() OVER w AS rn FROM a WINDOW w AS (PARTITION BY rec_id ORDER BY begin_t, end_t)),
    s AS (SELECT *, CASE WHEN pe IS NULL OR begin_t - pe >= 86400 OR (begin_t > pe AND EXISTS (SELECT 1 FROM b WHERE b.rec_id = g.rec_id AND b.begin_t < g.begin_t AND b.end_t > g.pe)) THEN 1 ELSE 0 END AS n FROM g),
    m AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY begin_t, end_t) AS run FROM s)
    SELECT rec_id, run::BIGINT AS run, round(min(begin_t), 3) AS begin_t, round(max(end_t), 3) AS end_t FROM m GROUP BY rec_id, run
"""))  # fmt: skip
def i3(spark, sf_dir):
    out = I.merged_pauses(segs_of(spark, sf_dir, "click"), segs_of(spark, sf_dir, "view"), 86400)
    return out.select("rec_id", F.col("seg_id").alias("run"), F.round("begin_t", 3).alias("begin_t"), F.round("end_t", 3).alias("end_t"))


PAUSES_SQL = f"""
    , {_AB}, g AS (SELECT rec_id, end_t AS gb, lead(begin_t) OVER (PARTITION BY rec_id ORDER BY begin_t, end_t) AS ge FROM a),
    l AS (SELECT g.rec_id, gb, ge, max(b.end_t) AS be FROM g LEFT JOIN b ON b.rec_id = g.rec_id AND gb < b.end_t AND ge > b.begin_t WHERE ge > gb GROUP BY g.rec_id, gb, ge),
    pauses AS (SELECT rec_id, CASE WHEN be IS NULL THEN 'intra' ELSE 'inter' END AS kind, coalesce(be, gb) AS begin_t, ge AS end_t FROM l WHERE be IS NULL OR be < ge)
"""


def pauses(spark, sf_dir):
    return I.pauses(segs_of(spark, sf_dir, "click"), segs_of(spark, sf_dir, "view"))


@query("i4_pauses", segments_sql(PAUSES_SQL + "SELECT rec_id, kind, round(begin_t, 3) AS begin_t, round(end_t, 3) AS end_t FROM pauses"))
def i4(spark, sf_dir):
    return pauses(spark, sf_dir).select("rec_id", "kind", F.round("begin_t", 3).alias("begin_t"), F.round("end_t", 3).alias("end_t"))


@query("i5_threshold", V.sql("SELECT seq, coalesce(CASE WHEN seq % 5 > 0 THEN v END > 50, false) AS v_threshold FROM series", "series"))
def i5(spark, sf_dir):
    v = F.when(F.col("seq") % 5 > 0, F.col("v"))
    return V.series(spark, sf_dir).select("seq", F.coalesce(v > 50, F.lit(False)).alias("v_threshold"))


@query("i6_norms", V.sql("SELECT id, round(sqrt(acoustic_qty ** 2 + language_size ** 2), 6) AS norm, round(sqrt((acoustic_qty - lag(acoustic_qty) OVER w) ** 2 + (language_size - lag(language_size) OVER w) ** 2), 6) AS step FROM wide WINDOW w AS (PARTITION BY meta_id ORDER BY id)", "wide"))
def i6(spark, sf_dir):
    w = Window.partitionBy("meta_id").orderBy("id")
    cols = ["acoustic_qty", "language_size"]
    square = lambda c: F.pow(c.cast("double"), F.lit(2.0))
    norm = F.sqrt(sum((square(F.col(c)) for c in cols[1:]), square(F.col(cols[0]))))
    step = F.sqrt(sum((square(F.col(c) - F.lag(c).over(w)) for c in cols[1:]), square(F.col(cols[0]) - F.lag(cols[0]).over(w))))
    return rounded(V.wide(spark, sf_dir, number=True).select("id", norm.alias("norm"), step.alias("step")))


@query("i7_masking", V.sql("SELECT seq, CASE WHEN channel <> 'error' AND v >= 0.5 THEN v END AS v FROM series", "series"))
def i7(spark, sf_dir):
    return I.masked(V.series(spark, sf_dir), ["v"], (F.col("channel") != "error") & (F.col("v") >= 0.5)).select("seq", "v")


@query("i8_alignment_pipeline", V.sql(f"""
    , m AS (SELECT rec_id, t, CASE WHEN channel <> 'error' THEN v END AS v FROM series),
    a AS (SELECT i.rec_id, i.seg_id, i.begin_t, {_STAT_SQL} FROM intervals i LEFT JOIN m ON m.rec_id = i.rec_id AND t >= begin_t AND t <= end_t GROUP BY ALL)
    SELECT rec_id AS meta_id, seg_id, coalesce(last_value(v_mean IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v_mean IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS acoustic_mean, v_std AS acoustic_std FROM a WINDOW w AS (PARTITION BY rec_id ORDER BY begin_t)
""", "series", "intervals"))  # fmt: skip
def i8(spark, sf_dir):
    """Mask, summarise per interval, fill gaps, rename: all recordings in one plan."""
    samples = I.masked(V.series(spark, sf_dir), ["v"], F.col("channel") != "error")
    got = rounded(S.aggregate_to_intervals(samples, V.intervals(spark, sf_dir), STATS, ["rec_id", "seg_id", "begin_t"]), "begin_t")
    got = S.filled(got, ["v_mean"], order="begin_t")
    return got.withColumnsRenamed({"rec_id": "meta_id", "v_mean": "acoustic_mean", "v_std": "acoustic_std"}).select("meta_id", "seg_id", "acoustic_mean", "acoustic_std")


@query("b1_marker_statistics", V.sql(f"SELECT rec_id, channel, {_STAT_SQL} FROM series GROUP BY rec_id, channel", "series"))
def b1(spark, sf_dir):
    return rounded(S.aggregate(V.series(spark, sf_dir), STATS, ["rec_id", "channel"]))


@query("b2_event_rate", segments_sql(", sp AS (SELECT rec_id, max(t) - min(t) AS s FROM series GROUP BY rec_id) SELECT sp.rec_id, round(coalesce(n, 0) / nullif(s, 0) * 86400, 6) AS per_day FROM sp LEFT JOIN (SELECT rec_id, count(*) AS n FROM segs WHERE channel = 'click' AND end_t - begin_t > 0.2 GROUP BY rec_id) USING (rec_id)"))
def b2(spark, sf_dir):
    span = V.series(spark, sf_dir).groupBy("rec_id").agg((F.max("t") - F.min("t")).alias("seconds"))
    return I.event_rate(segs_of(spark, sf_dir, "click"), span).select("rec_id", r6(F.col("rate") * 86400).alias("per_day"))


@query("b3_mean_segment_duration", segments_sql("SELECT r.rec_id, round(coalesce(d, 0), 3) AS d FROM (SELECT DISTINCT rec_id FROM series) r LEFT JOIN (SELECT rec_id, avg(end_t - begin_t) AS d FROM segs WHERE channel = 'click' GROUP BY rec_id) USING (rec_id)"))
def b3(spark, sf_dir):
    d = segs_of(spark, sf_dir, "click").groupBy("rec_id").agg(F.avg(F.col("end_t") - F.col("begin_t")).alias("d"))
    return V.series(spark, sf_dir).select("rec_id").distinct().join(d, "rec_id", "left").select("rec_id", F.round(F.coalesce("d", F.lit(0.0)), 3).alias("d"))


@query("b4_joint_activation", segments_sql(", j AS (SELECT s.rec_id, s.seg_id, avg(v.v) AS m FROM segs s LEFT JOIN series v ON v.rec_id = s.rec_id AND v.channel = 'view' AND v.t >= s.begin_t AND v.t <= s.end_t WHERE s.channel = 'click' GROUP BY s.rec_id, s.seg_id) SELECT rec_id, round(avg((coalesce(m, 0) > 40)::INT), 6) AS share FROM j GROUP BY rec_id"))
def b4(spark, sf_dir):
    clicks = segs_of(spark, sf_dir, "click")
    m = J.contains(series_of(spark, sf_dir, "view").select("rec_id", "t", "v"), clicks).groupBy("rec_id", "seg_id").agg(F.avg("v").alias("m"))
    both = clicks.join(m, ["rec_id", "seg_id"], "left")
    return both.groupBy("rec_id").agg(r6(F.avg((F.coalesce("m", F.lit(0.0)) > 40).cast("int"))).alias("share"))


@query("b5_pause_markers", segments_sql(PAUSES_SQL + "SELECT rec_id, kind, round(avg(end_t - begin_t), 3) AS mean, round(stddev_pop(end_t - begin_t), 3) AS std FROM pauses GROUP BY rec_id, kind"))
def b5(spark, sf_dir):
    d = F.col("end_t") - F.col("begin_t")
    return pauses(spark, sf_dir).groupBy("rec_id", "kind").agg(F.round(F.avg(d), 3).alias("mean"), F.round(F.stddev_pop(d), 3).alias("std"))


@query("b7_null_policy", V.sql("SELECT seq, coalesce(CASE WHEN channel = 'view' THEN v END, 0) AS v FROM series", "series"))
def b7(spark, sf_dir):
    return V.series(spark, sf_dir).select("seq", F.coalesce(F.when(F.col("channel") == "view", F.col("v")), F.lit(0.0)).alias("v"))


@query("g1_volume", V.sql("""
    , i AS (SELECT rec_id, v, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i FROM series),
    k AS (SELECT *, unnest(range(greatest(0, ceil((i - 15) / 8.0))::BIGINT, i // 8 + 1)) AS k FROM i)
    SELECT rec_id, k, round(10 * log10(avg((0.5 - 0.5 * cos(2 * pi() * (i - k * 8) / 15)) * (v * v + 1e-10))), 6) AS db FROM k GROUP BY rec_id, k HAVING count(*) = 16
""", "series"))  # fmt: skip
def g1(spark, sf_dir):
    return rounded(G.volume(V.series(spark, sf_dir), 16, 8))


@query("g2_signal_to_noise", V.sql("SELECT a.channel AS a, b.channel AS b, round(a.m - b.m, 6) AS snr FROM (SELECT channel, quantile_cont(v, 0.5) AS m FROM series GROUP BY channel) a, (SELECT channel, quantile_cont(v, 0.5) AS m FROM series GROUP BY channel) b WHERE a.channel <> b.channel", "series"))
def g2(spark, sf_dir):
    return rounded(G.signal_to_noise(V.series(spark, sf_dir), "channel", "v"))


@query("g7_cross_correlation", V.sql("""
    , i AS (SELECT rec_id, v, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n FROM series WHERE channel = 'click'),
    j AS (SELECT rec_id, v, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS n FROM series WHERE channel = 'view')
    SELECT rec_id, lag, round(sum(i.v * j.v), 4) AS c FROM i JOIN (SELECT unnest(range(-3, 4)) AS lag) ON true JOIN j USING (rec_id) WHERE j.n = i.n + lag GROUP BY rec_id, lag
""", "series"))  # fmt: skip
def g7(spark, sf_dir):
    out = G.cross_correlation(series_of(spark, sf_dir, "click"), series_of(spark, sf_dir, "view"), 3)
    return out.select("rec_id", F.col("lag").cast("long").alias("lag"), F.round("c", 4).alias("c"))


@query("g12_peak_normalised", V.sql("SELECT seq, round(v / nullif(max(abs(v)) OVER (PARTITION BY rec_id, channel), 0), 6) AS v FROM series", "series"))
def g12(spark, sf_dir):
    peak = F.max(F.abs("v")).over(Window.partitionBy("rec_id", "channel"))
    return rounded(V.series(spark, sf_dir).select("seq", F.try_divide("v", peak).alias("v")))


@query("g14_ten_bins", V.sql("""
    , i AS (SELECT rec_id, v, row_number() OVER (PARTITION BY rec_id ORDER BY t) AS p, count(*) OVER (PARTITION BY rec_id) // 10 AS jump FROM series)
    SELECT rec_id, least((p - 1) // jump, 9) AS bin, round(avg(v), 6) AS m FROM i WHERE jump > 0 GROUP BY ALL
""", "series"))  # fmt: skip
def g14(spark, sf_dir):
    return rounded(G.binned(V.series(spark, sf_dir), 10))


@query("g10_loudest_speaker", V.sql("SELECT rec_id, floor(t / 3600)::BIGINT AS h, arg_max(channel, v) AS loudest, round(max(v), 6) AS v FROM (SELECT rec_id, t, channel, CASE WHEN v > 5 THEN v ELSE -500 END AS v FROM series) GROUP BY ALL HAVING count(*) = count(DISTINCT v)", "series"))
def g10(spark, sf_dir):
    voiced = V.series(spark, sf_dir).withColumn("v", F.when(F.col("v") > 5, F.col("v")).otherwise(-500.0))
    out = voiced.groupBy("rec_id", F.floor(F.col("t") / 3600).alias("h")).agg(F.max_by("channel", "v").alias("loudest"), r6(F.max("v")).alias("v"), F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"))
    return out.where("n = d").drop("n", "d")


@query("g11_labelled_speech", segments_sql("SELECT rec_id, channel, seg_id, row_number() OVER (PARTITION BY rec_id ORDER BY begin_t, channel) AS turn FROM segs WHERE channel IN ('click', 'view')"))
def g11(spark, sf_dir):
    both = segs(spark, sf_dir).where("channel IN ('click', 'view')")
    return both.select("rec_id", "channel", "seg_id", F.row_number().over(Window.partitionBy("rec_id").orderBy("begin_t", "channel")).cast("long").alias("turn"))
