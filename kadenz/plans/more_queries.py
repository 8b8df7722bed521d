"""Queries of streams' batch forms, remaining joins, nested data, experiment tables and user functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kadenz.functions import text as K
from kadenz.operators import metrics as M
from kadenz.operators import mixed as MX
from kadenz.operators import models as L
from kadenz.operators import recordings as RE
from kadenz.operators import signal as G
from kadenz.operators import stats as S
from kadenz.operators import tables as P
from kadenz.plans import views as V
from kadenz.plans.metric_queries import grid
from kadenz.plans.registry import query, r6, rounded, signed6
from kadenz.plans.time_queries import series_of
from kadenz.session import scratch, ship, table
from kadenz.streaming import segments as ZS
from kadenz.streaming import windows as Z


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("z1_hop_windows", "SELECT user_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS begin, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(k * 6) AS b, ts FROM events, (SELECT unnest(range(2)) AS k)) WHERE b <= ts AND ts < b + INTERVAL 12 HOUR GROUP BY user_id, b")
def z1(spark, sf_dir):
    out = Z.hop_windows(events(spark, sf_dir), "12 hours", "6 hours")
    return rounded(out.select("user_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"), "n", "mean"))


@query("z2_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE value > 50 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin FROM s GROUP BY user_id, s")
def z2(spark, sf_dir):
    out = Z.sessions(events(spark, sf_dir), "12 hours", F.col("value") > 50)
    return out.select("user_id", "n", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin"))


_CLOSED = """
    , e AS (SELECT max(t) + 2592000 AS t FROM series WHERE channel IN ('click', 'view')),
    s AS (SELECT rec_id, channel, t, v > 50 AS o FROM series WHERE channel IN ('click', 'view') UNION ALL SELECT DISTINCT rec_id, c, e.t, false FROM series, e, (SELECT unnest(['click', 'view']) AS c) WHERE channel IN ('click', 'view')),
    w AS (SELECT *, lag(o) OVER u AS was, lead(t) OVER u AS nxt FROM s WINDOW u AS (PARTITION BY rec_id, channel ORDER BY t)),
    n AS (SELECT *, sum((o AND NOT coalesce(was, false))::INT) OVER (PARTITION BY rec_id, channel ORDER BY t) AS run FROM w),
    segs AS (SELECT rec_id, channel, run, min(t) AS begin_t, max(nxt) AS end_t FROM n WHERE o GROUP BY ALL), a AS (SELECT * FROM segs WHERE channel = 'click'), b AS (SELECT * FROM segs WHERE channel = 'view'),
    g AS (SELECT *, lag(end_t) OVER x AS pe FROM a WINDOW x AS (PARTITION BY rec_id ORDER BY begin_t)),
    j AS (SELECT *, CASE WHEN pe IS NULL OR begin_t - pe >= 86400 OR EXISTS (SELECT 1 FROM b WHERE b.rec_id = g.rec_id AND b.begin_t < g.begin_t AND b.end_t > g.pe) THEN 1 ELSE 0 END AS new FROM g),
    m AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY begin_t) AS part FROM j)
    SELECT rec_id, round(min(begin_t), 3) AS begin_t, round(max(end_t), 3) AS end_t FROM m GROUP BY rec_id, part"""


@query("z2_merged_segments_on_a_stream", V.sql(_CLOSED, "series"))
def z2_merged(spark, sf_dir):
    """Clicks above a bar as one speaker's runs and views as the other's, as a stream that is closed by off samples a month later."""
    ship(spark)
    at, rows = scratch(spark, "stream"), V.series(spark, sf_dir).where("channel IN ('click', 'view')")
    rows = rows.select("rec_id", F.col("t"), (F.col("channel") == "view").alias("other"), (F.col("v") > 50).alias("active"))
    end = F.broadcast(rows.agg((F.max("t") + 2592000).alias("t")))  # one row
    close = rows.select("rec_id").distinct().crossJoin(end).withColumns({"other": F.explode(F.array(F.lit(False), F.lit(True))), "active": F.lit(False)})
    # what comes later still only moves the watermark on
    both = rows.unionByName(close).unionByName(close.withColumn("t", F.col("t") + 3 * 86400))
    both.select("rec_id", F.timestamp_micros((F.round(F.col("t") * 1e6)).cast("long")).alias("ts"), "other", "active").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("rec_id long, ts timestamp, other boolean, active boolean").parquet(f"{at}/in")
    run = ZS.merged_segments(stream, 86400.0).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema("rec_id long, begin_t double, end_t double").parquet(f"{at}/out")
    return out.select("rec_id", F.round("begin_t", 3).alias("begin_t"), F.round("end_t", 3).alias("end_t"))


@query("i9_whole_dataset_alignment", V.sql(", a AS (SELECT i.rec_id, i.seg_id, avg(v) AS m FROM intervals i LEFT JOIN series s ON s.rec_id = i.rec_id AND s.channel = 'view' AND t >= begin_t AND t <= end_t GROUP BY ALL) SELECT rec_id, seg_id, round(coalesce(m, (SELECT avg(m) FROM a)), 6) AS m FROM a", "series", "intervals"))
def i9(spark, sf_dir):
    got = S.aggregate_to_intervals(series_of(spark, sf_dir, "view").select("rec_id", "t", "v"), V.intervals(spark, sf_dir), {"mean": ["v"]}, ["rec_id", "seg_id"])
    return rounded(P.imputed(got, ["v_mean"]).withColumnRenamed("v_mean", "m"))


@query("j14_unknown_words_by_position", "WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations) SELECT conv_id, turn, pos, word FROM w WHERE (conv_id + turn + pos) % 11 = 0")
def j14(spark, sf_dir):
    """Masks some words and fills them from a transcript with as many words that agrees everywhere else."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    gaps = rows.withColumn("known", F.when((F.col("conv_id") + F.col("turn") + F.col("pos")) % 11 > 0, F.col("word")))
    both = gaps.join(rows.withColumnRenamed("word", "said"), ["conv_id", "turn", "pos"])
    fits = both.groupBy("conv_id", "turn").agg(F.bool_and(F.col("known").isNull() | (F.col("known") == F.col("said"))).alias("fits")).where("fits")
    return both.join(fits, ["conv_id", "turn"], "left_semi").where("known IS NULL").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("said").alias("word"))


@query("k4_edge_stripped", "SELECT conv_id, turn, list_filter(flatten([string_split(regexp_replace(regexp_replace(w, '^[^-\\w'']+', ''), '[^-\\w'']+$', ''), '-') FOR w IN string_split(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), ' ')]), lambda w: w NOT IN ('', '-', '''')) AS w FROM conversations")
def k4(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.edge_stripped(F.split(ascii_only, " ")).alias("w"))


@query("v2_context_pool", "WITH m AS (SELECT conv_id, turn, length(text) AS x FROM conversations) SELECT a.conv_id, a.turn, round(avg(b.x), 6) AS pooled FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 2 GROUP BY a.conv_id, a.turn")
def v2(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rounded(S.context_pool(rows, F.length("text"), 2, "pooled", "conv_id", "turn").select("conv_id", "turn", "pooled"))


@query("v4_nested_by_lengths", "SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def v4(spark, sf_dir):
    """A flat list of turns split back by running lengths."""
    c = table(spark, sf_dir, "conversations")
    flat = V.numbered(c.select("conv_id", "turn"), ["conv_id", "turn"], "i").select("i", "turn")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return P.nested_by_lengths(flat, n, "conv_id", "i", "turn").withColumnRenamed("turn", "turns")


_CKA = "WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.x, b.x) AS k, list_inner_product(a.y, b.y) AS l FROM e a, e b), c AS (SELECT k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k, l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS l FROM p) SELECT round(sum(k * l) / sqrt(sum(k * k) * sum(l * l)), 6) AS cka FROM c"


@query("v12_cka", _CKA)
@query("v12_cka_all_rows", _CKA)
def v12_all(spark, sf_dir):
    """All rows without pairs: the SQL twin has them, for comparison on small tables."""
    ship(spark)
    return rounded(L.linear_cka(table(spark, sf_dir, "embeddings"), "embedding", 32))


@query("v14_rows_by_index", "SELECT event_id, value, event_type FROM events WHERE event_id % 100 < 3")
def v14(spark, sf_dir):
    return events(spark, sf_dir).where("event_id % 100 < 3").select("event_id", "value", "event_type")


@query("a11_mean_over_groups", V.sql(", g AS (SELECT cluster, CASE WHEN cluster % 3 > 0 THEN avg(abs(y - h)) END AS m, count(*) AS n FROM pred GROUP BY cluster) SELECT round(avg(m), 6) AS m, round(sum(m * n) / sum(n) FILTER (m IS NOT NULL), 6) AS m_proportional FROM g", "pred"))
def a11(spark, sf_dir):
    per = V.pred(spark, sf_dir).groupBy("cluster").agg(F.avg(F.abs(F.col("y") - F.col("h"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return rounded(M.over_clusters(per.withColumn("m", F.when(F.col("cluster") % 3 > 0, F.col("m"))), ["m"]))


@query("a13_concatenated_batches", V.sql("SELECT id, y, h FROM pred", "pred"))
def a13(spark, sf_dir):
    rows = V.pred(spark, sf_dir, number=True)
    return S.union_all([rows.where(f"fold = {k}") for k in range(5)]).select("id", "y", "h")


@query("b6_speech_rate_markers", V.sql(", k AS (SELECT rec_id, v, count(*) OVER w AS n, avg(v) OVER w AS r FROM series WINDOW w AS (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT rec_id, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr FROM k WHERE n > 3 GROUP BY rec_id", "series"))
def b6(spark, sf_dir):
    k = S.centred_means(V.series(spark, sf_dir), "v", 2, 4)
    return rounded(k.groupBy("rec_id").agg(F.avg("r").alias("mean"), (F.percentile("r", 0.75) - F.percentile("r", 0.25)).alias("iqr")))


@query("g4_sliding_rate", V.sql("SELECT seq, round(sum((v > 50)::INT) OVER w / (count(*) OVER w / 9.0 * 4.0), 6) AS rate FROM series WINDOW w AS (PARTITION BY rec_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)", "series"))
def g4(spark, sf_dir):
    return rounded(S.sliding_rate(V.series(spark, sf_dir), F.col("v") > 50, 4, 4.0).select("seq", "rate"))


@query("g9_speaker_by_delay", V.sql(f", n AS (SELECT c.rec_id, c.seq, c.t, c.v, s.t AS st, row_number() OVER (PARTITION BY c.seq ORDER BY abs(s.t - c.t), s.t DESC) AS rn FROM series c LEFT JOIN series s ON s.rec_id = c.rec_id AND s.channel = 'view' WHERE c.channel = 'click') SELECT seq, v > 20 AND coalesce(st - t < 7200, true) AS a FROM n WHERE rn = 1", "series"))
def g9(spark, sf_dir):
    samples, delays = (series_of(spark, sf_dir, c).select("rec_id", "t", "seq", "v") for c in ("click", "view"))
    return G.speaker_by_delay(samples, delays, 20, 7200).select("seq", "a")


@query("g13_clip_windows", "SELECT conv_id, unnest(range(0, n - 1)) AS clip FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) WHERE n >= 2")
def g13(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return G.clip_windows(n, "conv_id", 2)


def _window_pairs(spark, sf_dir, length):
    """Arrays a and b of two channels per recording and window."""
    out = None
    for name, channel in (("a", "click"), ("b", "view")):
        w = S.hop_windows(series_of(spark, sf_dir, channel), length, length, "v")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e.v)
        one = w.groupBy("rec_id", "k").agg(listed.alias(name))
        out = one if out is None else out.join(one, ["rec_id", "k"])
    return out


def _delay_sql(length: int, most: int, keys: str, where: str = "true") -> str:
    """The whitened cross-correlation of each window with its discrete Fourier transform written out as sums."""
    n = 2 * length
    return V.sql(
        f"""
        , r AS (SELECT rec_id, channel, row_number() OVER (PARTITION BY rec_id, channel ORDER BY t) - 1 AS i, v FROM series WHERE channel IN ('click', 'view')),
        q AS (SELECT rec_id, channel, i // {length} AS k, i % {length} AS p, v, count(*) OVER u AS c, avg(v) OVER u AS m, stddev_pop(v) OVER u AS s FROM r WINDOW u AS (PARTITION BY rec_id, channel, i // {length})),
        w AS (SELECT a.rec_id, a.k, a.p, a.v - a.m AS a, b.v - b.m AS b, a.s AS sa, b.s AS sb FROM q a JOIN q b ON a.rec_id = b.rec_id AND a.k = b.k AND a.p = b.p AND a.channel = 'click' AND b.channel = 'view' WHERE a.c = {length} AND b.c = {length} AND {where.replace("k ", "a.k ")}),
        f AS (SELECT rec_id, k, f, sum(a * cos(2 * pi() * f * p / {n})) AS ar, -sum(a * sin(2 * pi() * f * p / {n})) AS ai, sum(b * cos(2 * pi() * f * p / {n})) AS br, -sum(b * sin(2 * pi() * f * p / {n})) AS bi, min(sa) AS sa, min(sb) AS sb FROM w, (SELECT unnest(range({length + 1})) AS f) GROUP BY rec_id, k, f),
        x AS (SELECT rec_id, k, f, ar * br + ai * bi AS xr, ar * bi - ai * br AS xi, sa, sb FROM f),
        y AS (SELECT rec_id, k, f, xr / greatest(sqrt(xr * xr + xi * xi), 1e-12) AS xr, xi / greatest(sqrt(xr * xr + xi * xi), 1e-12) AS xi, sa, sb FROM x),
        c AS (SELECT rec_id, k, lag, sum(CASE WHEN f IN (0, {length}) THEN 1 ELSE 2 END * (xr * cos(2 * pi() * f * lag / {n}) - CASE WHEN f IN (0, {length}) THEN 0 ELSE xi * sin(2 * pi() * f * lag / {n}) END)) / {n} AS c, least(min(sa), min(sb)) AS s FROM y, (SELECT unnest(range({-most}, {most + 1})) AS lag) GROUP BY rec_id, k, lag),
        z AS (SELECT *, row_number() OVER (PARTITION BY rec_id, k ORDER BY abs(c) DESC, lag) AS rn FROM c)
        SELECT {keys}, CASE WHEN s >= 1e-9 THEN lag END AS lag, CASE WHEN s >= 1e-9 THEN round(c, 6) END AS c FROM z WHERE rn = 1""",
        "series",
    )


@query("g5_delay_per_window", _delay_sql(4, 2, "rec_id, k"))
def g5(spark, sf_dir):
    ship(spark)
    return rounded(G.delays(_window_pairs(spark, sf_dir, 4), 2, ["rec_id", "k"], in_order=True))


def _recording_delay_sql(most: int) -> str:
    """Direct sums over all samples for each lag, then the whitened spectrum of these sums written out."""
    n = 2 * most + 1
    return V.sql(
        f"""
        , r AS (SELECT rec_id, channel, row_number() OVER (PARTITION BY rec_id, channel ORDER BY t, v) - 1 AS i, v - avg(v) OVER u AS v, stddev_pop(v) OVER u AS s FROM series WHERE channel IN ('click', 'view') WINDOW u AS (PARTITION BY rec_id, channel)),
        d AS (SELECT rec_id, min(s) AS s FROM r GROUP BY rec_id HAVING count(DISTINCT channel) = 2), l AS (SELECT rec_id, s, lag FROM d, (SELECT unnest(range({-most}, {most + 1})) AS lag)),
        p AS (SELECT a.rec_id, b.i - a.i AS lag, sum(a.v * b.v) AS c FROM r a JOIN r b ON a.rec_id = b.rec_id AND a.channel = 'click' AND b.channel = 'view' AND b.i BETWEEN a.i - {most} AND a.i + {most} GROUP BY a.rec_id, b.i - a.i),
        c AS (SELECT rec_id, lag, s, coalesce(c, 0) AS c FROM l LEFT JOIN p USING (rec_id, lag)),
        x AS (SELECT rec_id, f, sum(c * cos(2 * pi() * f * lag / {n})) AS xr, -sum(c * sin(2 * pi() * f * lag / {n})) AS xi FROM c, (SELECT unnest(range({most + 1})) AS f) GROUP BY rec_id, f),
        y AS (SELECT rec_id, f, xr / greatest(sqrt(xr * xr + xi * xi), 1e-12) AS xr, xi / greatest(sqrt(xr * xr + xi * xi), 1e-12) AS xi FROM x),
        w AS (SELECT rec_id, s, lag, (SELECT sum(CASE WHEN f = 0 THEN xr ELSE 2 * (xr * cos(2 * pi() * f * l.lag / {n}) - xi * sin(2 * pi() * f * l.lag / {n})) END) / {n} FROM y WHERE y.rec_id = l.rec_id) AS c FROM l),
        z AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(abs(c), 12) DESC, lag) AS rn FROM w)
        SELECT rec_id, CASE WHEN s >= 1e-9 THEN lag END AS lag, CASE WHEN s >= 1e-9 THEN round(c, 6) END AS c FROM z WHERE rn = 1""",
        "series",
    )


@query("g6_delay_of_recordings", _recording_delay_sql(5))
def g6(spark, sf_dir):
    ship(spark)
    a, b = (series_of(spark, sf_dir, c) for c in ("click", "view"))
    return rounded(RE.delay(a, b, 5, in_order=True))


_PATH = """
    , n AS (SELECT rec_id, floor(t / 86400)::BIGINT AS k, (seq % 7)::DOUBLE AS lag, max(v + 1) AS c FROM series GROUP BY ALL),
    s AS (SELECT *, dense_rank() OVER (PARTITION BY rec_id ORDER BY k) AS j FROM n),
    r AS (SELECT rec_id, j, lag, c AS total, [lag] AS path FROM s WHERE j = 1
        UNION ALL SELECT s.rec_id, s.j, s.lag, max(r.total + ln(greatest(2.1 * 7 - abs(r.lag - s.lag), 1e-12))) + ln(greatest(max(s.c), 1e-12)), list_append(arg_max(r.path, (r.total + ln(greatest(2.1 * 7 - abs(r.lag - s.lag), 1e-12)), -r.lag)), s.lag)
        FROM r JOIN s ON s.rec_id = r.rec_id AND s.j = r.j + 1 GROUP BY s.rec_id, s.j, s.lag),
    e AS (SELECT rec_id, arg_max(path, (total, -lag)) AS path FROM r WHERE (rec_id, j) IN (SELECT rec_id, max(j) FROM s GROUP BY rec_id) GROUP BY rec_id)
    SELECT rec_id, k, lag FROM (SELECT rec_id, unnest(path) AS lag, unnest(range(1, len(path) + 1)) AS j FROM e) JOIN (SELECT DISTINCT rec_id, k, j FROM s) USING (rec_id, j)"""


@query("g8_smooth_path", V.sql(_PATH, "series").replace("WITH", "WITH RECURSIVE", 1))
def g8(spark, sf_dir):
    ship(spark)
    c = V.series(spark, sf_dir).select("rec_id", F.floor(F.col("t") / 86400).alias("k"), (F.col("seq") % 7).cast("double").alias("lag"), (F.col("v") + 1).alias("c"))
    return RE.smooth_path(c.groupBy("rec_id", "k", "lag").agg(F.max("c").alias("c")), "rec_id", "k", "lag", "c", 7.0)


_NUCLEI = """
    , w AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1 AS i, v FROM series),
    h AS (SELECT rec_id, i, v, unnest(range(greatest(0, (i - 6) // 2), i // 2 + 1)) AS k FROM w),
    d AS (SELECT rec_id, k, 10 * log10(avg((0.5 - 0.5 * cos(2 * pi() * (i - 2 * k) / 7)) * (v * v + 1e-10))) AS db FROM h WHERE i - 2 * k BETWEEN 0 AND 7 GROUP BY rec_id, k HAVING count(*) = 8),
    p AS (SELECT *, quantile_cont(db, 0.99) OVER (PARTITION BY rec_id) - 25 AS bar, db > coalesce(lag(db) OVER o, '-inf') AND db >= coalesce(lead(db) OVER o, '-inf') AS peak FROM d WINDOW o AS (PARTITION BY rec_id ORDER BY k)),
    l AS (SELECT a.rec_id, a.k, coalesce(max(CASE WHEN b.db > a.db THEN b.k END), -1) AS base FROM p a LEFT JOIN p b ON a.rec_id = b.rec_id AND b.k < a.k WHERE a.peak AND a.db > a.bar GROUP BY a.rec_id, a.k)
    SELECT l.rec_id, l.k FROM l JOIN p a ON a.rec_id = l.rec_id AND a.k = l.k JOIN p b ON b.rec_id = l.rec_id AND b.k > l.base AND b.k <= l.k GROUP BY l.rec_id, l.k HAVING max(a.db) - min(b.db) > 2"""


@query("g3_nuclei", V.sql(_NUCLEI, "series"))
def g3(spark, sf_dir):
    ship(spark)
    return RE.nuclei(G.volume(V.series(spark, sf_dir), 8, 2))


_EM = """
    , g AS (SELECT meta_id, count(*) AS n, sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS d, sum(x * y) AS p, sum(z * y) AS q, sum(y * y) AS s FROM (SELECT meta_id, acoustic_qty::DOUBLE AS x, vision_disc::DOUBLE AS z, y::DOUBLE AS y FROM wide) GROUP BY meta_id),
    e(k, s2, d0, d1, d2) AS (SELECT 0, 1::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE UNION ALL
        SELECT k + 1, sum(s - 2 * (m0 * p + m1 * q) + a * (m0 * m0 + v0) + 2 * b * (m0 * m1 + v1) + d * (m1 * m1 + v2)) / sum(n), avg(m0 * m0 + v0), avg(m0 * m1 + v1), avg(m1 * m1 + v2)
        FROM (SELECT *, (v0 * p + v1 * q) / s2 AS m0, (v1 * p + v2 * q) / s2 AS m1 FROM
            (SELECT *, a2 / (a0 * a2 - a1 * a1) AS v0, -a1 / (a0 * a2 - a1 * a1) AS v1, a0 / (a0 * a2 - a1 * a1) AS v2 FROM
                (SELECT *, a / s2 + d2 / (d0 * d2 - d1 * d1) AS a0, b / s2 - d1 / (d0 * d2 - d1 * d1) AS a1, d / s2 + d0 / (d0 * d2 - d1 * d1) AS a2 FROM e, g WHERE k < 6))) GROUP BY k),
    l AS (SELECT * FROM e WHERE k = 6), t AS (SELECT *, a / s2 + d2 / (d0 * d2 - d1 * d1) AS a0, b / s2 - d1 / (d0 * d2 - d1 * d1) AS a1, d / s2 + d0 / (d0 * d2 - d1 * d1) AS a2 FROM l, g)
    SELECT meta_id, [round((a2 * p - a1 * q) / s2 / (a0 * a2 - a1 * a1), 6), round((a0 * q - a1 * p) / s2 / (a0 * a2 - a1 * a1), 6)] AS effects, round(s2, 6) AS within, round(d0, 6) AS between_slope FROM t"""


@query("m13_random_slopes", V.sql(_EM, "wide").replace("WITH", "WITH RECURSIVE", 1))
def m13(spark, sf_dir):
    """Two slopes per group; six steps of EM estimate the variances."""
    ship(spark)
    out, fit = MX.random_slopes(V.wide(spark, sf_dir), "meta_id", ["acoustic_qty", "vision_disc"], "y", steps=6)
    fitted = {"within": r6(F.lit(fit.within)), "between_slope": r6(F.lit(float(fit.between[0, 0])))}
    return out.withColumn("effects", F.transform("effects", signed6)).withColumns(fitted)


@query("m2_learned_scaling", V.sql(", s AS (SELECT avg(vision_tax) AS m, stddev_pop(vision_tax) AS s FROM wide WHERE meta_id % 5 > 1) SELECT id, round(greatest(least((vision_tax - m) / s, 3), -3), 6) AS vision_tax FROM wide, s", "wide"))
def m2(spark, sf_dir):
    rows = V.wide(spark, sf_dir, number=True).select("id", "meta_id", "vision_tax")
    learned = P.learn(V.wide(spark, sf_dir).where("meta_id % 5 > 1"), ["vision_tax"])  # no numbers needed
    return rounded(P.apply(rows, learned).select("id", "vision_tax"))


@query("p14_column_profile", V.sql("SELECT modality, n, (SELECT count(DISTINCT y) FROM wide) AS targets FROM (VALUES ('acoustic', 2), ('language', 2), ('vision', 2)) t(modality, n)", "wide"))
def p14(spark, sf_dir):
    rows = V.wide(spark, sf_dir)
    groups = spark.createDataFrame([(m, len(c)) for m, c in P.modalities(rows.columns).items()], "modality string, n int")
    return groups.crossJoin(rows.agg(F.count_distinct("y").alias("targets")))


@query("t1_sorted_by_start", V.sql("SELECT rec_id, seg_id, row_number() OVER (PARTITION BY rec_id ORDER BY begin_t, seg_id) AS place FROM intervals", "intervals"))
def t1(spark, sf_dir):
    return V.intervals(spark, sf_dir).select("rec_id", "seg_id", F.row_number().over(Window.partitionBy("rec_id").orderBy("begin_t", "seg_id")).cast("long").alias("place"))


@query("x3_shared_columns", V.sql("SELECT id, cluster, y, h FROM pred", "pred"))
def x3(spark, sf_dir):
    a, b = V.pred(spark, sf_dir, number=True), V.classes(spark, sf_dir)
    return a.select(*[c for c in a.columns if c in set(b.columns)])


@query("h5_can_skip", V.sql(", g AS (SELECT shrink, fold, round(avg((y - h * shrink) ** 2), 6) AS m FROM pred, (SELECT unnest([0.5, 0.75, 1.0]::DOUBLE[]) AS shrink) GROUP BY shrink, fold) SELECT count(*) = 0 AS skip FROM (SELECT * FROM g EXCEPT SELECT * FROM g WHERE fold < 4)", "pred"))
def h5(spark, sf_dir):
    g = rounded(M.interval(grid(spark, sf_dir), ["mse"], ["shrink", "fold"]).select("shrink", "fold", F.col("mse").alias("m")), "shrink")
    stored = g.where("fold < 4")
    return g.join(stored, ["shrink", "fold"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("skip"))


@query("h6_configured_runs", V.sql("SELECT 'c' || k AS config, round(avg(abs(y - h * s)), 6) AS mae FROM pred, (VALUES (1, 0.5::DOUBLE), (2, 1.0::DOUBLE)) c(k, s) GROUP BY k", "pred"))
def h6(spark, sf_dir):
    configs = spark.createDataFrame([("c1", 0.5), ("c2", 1.0)], "config string, s double")
    rows = V.pred(spark, sf_dir).crossJoin(F.broadcast(configs))  # two rows
    return rounded(rows.groupBy("config").agg(F.avg(F.abs(F.col("y") - F.col("h") * F.col("s"))).alias("mae")))


@query("f1_user_metric", V.sql("SELECT cluster, round(max(abs(y - h)), 6) AS value FROM pred GROUP BY cluster", "pred"))
def f1(spark, sf_dir):
    from kadenz.functions.user import metric

    worst = lambda df, keys: df.groupBy(*keys).agg(F.max(F.abs(F.col("y") - F.col("h"))).alias("value"))
    return rounded(metric(V.pred(spark, sf_dir), ["cluster"], {"worst": worst}).drop("metric"))


@query("f2_statistic_by_name", V.sql("SELECT cluster, round(coalesce(var_samp(h), 0), 6) AS h_var FROM pred GROUP BY cluster", "pred"))
def f2(spark, sf_dir):
    return rounded(S.aggregate(V.pred(spark, sf_dir), {"var": ["h"]}, ["cluster"]))


@query("f6_map_over_recordings", V.sql("SELECT rec_id, round(max(v) - min(v), 6) AS span FROM series GROUP BY rec_id", "series"))
def f6(spark, sf_dir):
    from kadenz.functions.user import per_recording

    ship(spark)
    span = lambda pdf: pdf.groupby("rec_id", as_index=False).agg(span=("v", lambda v: v.max() - v.min()))
    return rounded(per_recording(V.series(spark, sf_dir).select("rec_id", "v"), "rec_id", span, "rec_id long, span double"))
