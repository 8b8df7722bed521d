"""Queries of tables, text, arrays, sources, aggregations and model steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kadenz.functions import arrays as A
from kadenz.functions import text as K
from kadenz.operators import joins as J
from kadenz.operators import models as L
from kadenz.operators import similarity as SI
from kadenz.operators import stats as S
from kadenz.operators import tables as P
from kadenz.operators.gram import moments
from kadenz.operators.ordering import running
from kadenz.plans import views as V
from kadenz.plans.registry import query, r6, rounded, signed6
from kadenz.session import ship, table, written



def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("p1_modalities", V.sql("SELECT id, [acoustic_qty::DOUBLE, acoustic_price::DOUBLE] AS acoustic, [language_size::DOUBLE, language_retail::DOUBLE] AS language, [vision_disc::DOUBLE, vision_tax::DOUBLE] AS vision FROM wide", "wide"))
def p1(spark, sf_dir):
    return P.packed(V.wide(spark, sf_dir, number=True), ["id"])


@query("p2_columns_without_nulls", V.sql("SELECT id, acoustic_qty, y FROM wide", "wide"))
def p2(spark, sf_dir):
    rows = V.wide(spark, sf_dir, number=True).select("id", "acoustic_qty", "y", F.when(F.col("id") % 9 > 0, F.col("vision_tax")).alias("holes"))
    return P.without_null_columns(rows).select("id", "acoustic_qty", "y")


@query("p3_renamed", V.sql("SELECT id, acoustic_qty AS audio_qty, meta_id AS speaker FROM wide", "wide"))
def p3(spark, sf_dir):
    return V.wide(spark, sf_dir, number=True).withColumnsRenamed({"acoustic_qty": "audio_qty", "meta_id": "speaker"}).select("id", "audio_qty", "speaker")


@query("p4_without_text_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer")
def p4(spark, sf_dir):
    return P.without_text_columns(table(spark, sf_dir, "customer"), ("c_name",))


@query("p5_default_columns", V.sql("SELECT id, y, 0.0::DOUBLE AS meta_begin, 60.0::DOUBLE AS meta_end FROM wide", "wide"))
def p5(spark, sf_dir):
    return P.with_defaults(V.wide(spark, sf_dir, number=True).select("id", "y"), {"y": 1.0, "meta_begin": 0.0, "meta_end": 60.0})


@query("p6_categorical_codes", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def p6(spark, sf_dir):
    return P.codes(table(spark, sf_dir, "part"), "p_brand").select("p_partkey", "code")


@query("p7_name_keys", "SELECT p_partkey, split_part(p_name, ' ', 1) AS stem, left(p_name, 5) AS five, array_to_string(string_split(p_type, '_')[1:2], '_') AS head FROM part")
def p7(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("stem"), F.substring("p_name", 1, 5).alias("five"), F.array_join(F.slice(F.split("p_type", "_"), 1, 2), "_").alias("head"))


@query("p8_numeric_coercion", "SELECT event_id, TRY_CAST(trim(split_part(props, ':', 2), ' }') AS DOUBLE) AS x FROM events WHERE TRY_CAST(trim(split_part(props, ':', 2), ' }') AS DOUBLE) IS NOT NULL")
def p8(spark, sf_dir):
    x = F.btrim(F.split_part("props", F.lit(":"), F.lit(2)), F.lit(" }")).try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", x.alias("x")).dropna(subset=["x"])


@query("p9_casts", V.sql("SELECT id, meta_id::INT AS meta_id, acoustic_qty::FLOAT::DOUBLE AS q FROM wide", "wide"))
def p9(spark, sf_dir):
    return V.wide(spark, sf_dir, number=True).select("id", F.col("meta_id").cast("int").alias("meta_id"), F.col("acoustic_qty").cast("float").cast("double").alias("q"))


@query("p11_instruction_text", "SELECT conv_id, turn, text || '<SEP> Task: Given the input, ' || CASE role WHEN 'user' THEN 'answer.' ELSE 'rate it.' END AS prompt FROM conversations")
def p11(spark, sf_dir):
    which = F.when(F.col("role") == "user", "answer.").otherwise("rate it.")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("<SEP> Task: Given the input, "), which).alias("prompt"))


@query("p12_label_format", "SELECT doc_id, printf('%.2f', quality * 1.0) AS quality, CASE toxic WHEN 1 THEN 'toxic' ELSE 'fine' END AS toxic FROM labels")
def p12(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.format_string("%.2f", F.col("quality") * F.lit(1.0)).alias("quality"), F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("toxic"))


@query("p13_one_hot", "SELECT vec_id, [(i = label)::INT FOR i IN range(10)] AS hot FROM embeddings")
def p13(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.one_hot(F.col("label"), 10).alias("hot"))


@query("p15_varying_columns", V.sql("SELECT id, acoustic_qty, vision_tax FROM wide", "wide"))
def p15(spark, sf_dir):
    rows = V.wide(spark, sf_dir, number=True).withColumn("vision_flat", F.lit(2.0))
    return rows.select("id", *P.varying(rows, ["acoustic_qty", "vision_tax", "vision_flat"]))


@query("s3_keyed_json", "SELECT conv_id::VARCHAR AS id, count(*)::INT AS n, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id")
def s3(spark, sf_dir):
    """A conversation folded to one JSON object, read back with a schema."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    raw = turns.select(F.to_json(F.map_from_arrays(F.array(F.col("conv_id").cast("string")), F.array("t"))).alias("json"))
    kept = raw.select(F.explode(F.from_json("json", "map<string, array<struct<turn: long, text: string>>>")).alias("id", "t"))
    return kept.select("id", F.size("t").alias("n"), F.element_at("t", 1).text.alias("first"))


@query("s7_import_last_of_time", "SELECT user_id, h, arg_max(value, (ts, event_id)) AS value FROM (SELECT *, epoch(date_trunc('hour', ts))::BIGINT AS h FROM events) GROUP BY user_id, h")
def s7(spark, sf_dir):
    rows = V.series(spark, sf_dir).withColumn("h", (F.floor(F.col("t") / 3600) * 3600).cast("long"))
    return rows.groupBy(F.col("rec_id").alias("user_id"), "h").agg(F.max_by("v", F.struct("t", "seq")).alias("value"))


@query("s9_wide_intervals", "SELECT user_id, h, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM (SELECT *, floor(epoch(ts) / 21600)::BIGINT AS h FROM events) GROUP BY user_id, h")
def s9(spark, sf_dir):
    rows = V.series(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 21600))
    return rows.groupBy(F.col("rec_id").alias("user_id"), "h").pivot("channel", ["click", "view"]).agg(F.max("v"))


@query("s10_tiers_on_a_grid", V.sql(", g AS (SELECT rec_id, lo + k * 86400.0 AS t, k FROM (SELECT rec_id, lo, unnest(range(0, floor((hi - lo) / 86400.0)::BIGINT + 1)) AS k FROM (SELECT rec_id, min(t) AS lo, max(t) AS hi FROM series GROUP BY rec_id))) SELECT g.rec_id, g.k, bool_or(i.seg_id IS NOT NULL) AS on_ FROM g LEFT JOIN intervals i ON i.rec_id = g.rec_id AND t >= begin_t AND t <= end_t GROUP BY g.rec_id, g.k", "series", "intervals"))
def s10(spark, sf_dir):
    span = V.series(spark, sf_dir).groupBy("rec_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / 86400.0).cast("long"))
    points = span.select("rec_id", "lo", F.explode(steps).alias("k")).select("rec_id", "k", (F.col("lo") + F.col("k") * 86400.0).alias("t"))
    hit = J.contains(points, V.intervals(spark, sf_dir)).select("rec_id", "k").distinct().withColumn("on_", F.lit(True))
    return points.select("rec_id", "k").join(hit, ["rec_id", "k"], "left").fillna(False, ["on_"])


@query("s11_subtitles", V.sql("SELECT rec_id, seg_id, row_number() OVER (PARTITION BY rec_id ORDER BY begin_t) || chr(10) || printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS block FROM (SELECT *, round((begin_t - min(begin_t) OVER (PARTITION BY rec_id)) * 1000)::BIGINT AS ms FROM intervals)", "intervals"))
def s11(spark, sf_dir):
    w = Window.partitionBy("rec_id")
    n = F.row_number().over(w.orderBy("begin_t"))
    return V.intervals(spark, sf_dir).select("rec_id", "seg_id", F.concat_ws("\n", n, K.clock(F.col("begin_t") - F.min("begin_t").over(w))).alias("block"))


@query("s12_block_text", "SELECT doc_id, i - 1 AS i, split_part(p, ' ', 1) AS name, length(p) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def s12(spark, sf_dir):
    parts = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    return parts.select("doc_id", F.col("i").cast("long").alias("i"), F.substring_index("p", " ", 1).alias("name"), F.length("p").cast("long").alias("n"))


@query("s13_texts_with_labels", "SELECT d.doc_id, length(text) AS n, printf('%.2f', quality * 1.0) AS label FROM documents d JOIN labels l USING (doc_id)")
def s13(spark, sf_dir):
    both = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return both.select("doc_id", F.length("text").cast("long").alias("n"), F.format_string("%.2f", F.col("quality") * F.lit(1.0)).alias("label"))


@query("s14_missing_inventory", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def s14(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("a4_group_mean", "SELECT o_custkey, round(avg(o_totalprice), 6) AS m FROM orders GROUP BY o_custkey")
def a4(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")))


@query("a5_distinct_lists", "SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s FROM orders GROUP BY o_custkey")
def a5(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))


@query("a6_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a6(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a7_moments", V.sql("SELECT round(avg(y), 6) AS y_mean, round(stddev_pop(y), 6) AS y_std, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(avg(vision_tax), 6) AS vision_tax_mean, round(stddev_pop(vision_tax), 6) AS vision_tax_std, round(min(vision_tax), 6) AS vision_tax_min, round(max(vision_tax), 6) AS vision_tax_max FROM wide", "wide"))
def a7(spark, sf_dir):
    return rounded(S.moments(V.wide(spark, sf_dir), ["y", "vision_tax"]))


@query("a8_inverse_label_frequency", "SELECT quality, round(1 - count(*) / sum(count(*)) OVER (), 6) AS w FROM labels GROUP BY quality")
def a8(spark, sf_dir):
    n = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.crossJoin(n.agg(F.sum("n").alias("t"))).select("quality", (1 - F.col("n") / F.col("t")).alias("w")))


@query("a9_sample_weights", V.sql(", n AS (SELECT cluster, count(*) AS n FROM pred GROUP BY cluster) SELECT cluster, round(1 / n / (SELECT avg(1 / n) FROM n), 6) AS weight FROM n", "pred"))
def a9(spark, sf_dir):
    return rounded(S.inverse_frequency_weights(V.pred(spark, sf_dir), "cluster").select("cluster", "weight"))


@query("a10_clipped_weights", V.sql(", n AS (SELECT cluster, count(*) AS n FROM pred GROUP BY cluster), q AS (SELECT quantile_cont(n, 0.5) AS m, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS i FROM n), c AS (SELECT cluster, floor(greatest(least(n, m + 1.5 * i), m - 1.5 * i)) AS n FROM n, q) SELECT cluster, round(1 / n / (SELECT avg(1 / n) FROM c), 6) AS weight FROM c", "pred"))
def a10(spark, sf_dir):
    n = V.pred(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    q = n.agg(F.percentile("n", 0.5).alias("m"), (F.percentile("n", 0.75) - F.percentile("n", 0.25)).alias("i"))
    c = n.crossJoin(q).select("cluster", F.floor(F.greatest(F.least(F.col("n"), F.col("m") + 1.5 * F.col("i")), F.col("m") - 1.5 * F.col("i"))).alias("n"))
    return rounded(c.crossJoin(c.agg(F.avg(1 / F.col("n")).alias("a"))).select("cluster", (1 / F.col("n") / F.col("a")).alias("weight")))


@query("a14_mean_imputation", V.sql(", h AS (SELECT id, CASE WHEN id % 4 > 0 THEN acoustic_qty END AS q FROM wide) SELECT id, round(coalesce(q, (SELECT avg(q) FROM h)), 6) AS q FROM h", "wide"))
def a14(spark, sf_dir):
    rows = V.wide(spark, sf_dir, number=True).select("id", F.when(F.col("id") % 4 > 0, F.col("acoustic_qty")).alias("q"))
    return rounded(P.imputed(rows, ["q"]))


@query("a15_zero_imputation", V.sql("SELECT id, coalesce(CASE WHEN id % 4 > 0 THEN acoustic_qty END, 0) AS q FROM wide", "wide"))
def a15(spark, sf_dir):
    return V.wide(spark, sf_dir, number=True).select("id", F.when(F.col("id") % 4 > 0, F.col("acoustic_qty")).alias("q")).fillna(0)


@query("a16_group_covariance", "WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings), p AS (SELECT label, i - 1 AS i, j - 1 AS j, v[i]::DOUBLE AS x, v[j]::DOUBLE AS y FROM e, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j)) SELECT label, i::INT AS i, j::INT AS j, round(covar_samp(x, y) + CASE WHEN i = j THEN 0.001 ELSE 0 END, 6) AS cov FROM p GROUP BY label, i, j")
def a16(spark, sf_dir):
    """All elements of the vectors; a cluster's covariance is summed as a matrix and then listed."""
    ship(spark)
    m = moments(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("d", F.size("mean"))
    cells = m.select("label", "d", F.posexplode("cov").alias("at", "cov")).withColumns({"i": F.floor(F.col("at") / F.col("d")).cast("int"), "j": (F.col("at") % F.col("d")).cast("int")})
    return rounded(cells.select("label", "i", "j", (F.col("cov") + F.when(F.col("i") == F.col("j"), 0.001).otherwise(0.0)).alias("cov")))


@query("a18_best_over_epochs", V.sql(", e AS (SELECT channel, floor(t / 86400) AS d, avg(v) AS m, stddev_pop(v) AS s FROM series GROUP BY channel, d) SELECT channel, round(max(m), 6) AS best, round(min(s), 6) AS least FROM e GROUP BY channel", "series"))
def a18(spark, sf_dir):
    e = V.series(spark, sf_dir).groupBy("channel", F.floor(F.col("t") / 86400).alias("d")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return rounded(e.groupBy("channel").agg(F.max("m").alias("best"), F.min("s").alias("least")))


@query("a19_average_of_three", V.sql("SELECT rec_id, g, round(avg(v), 6) AS m FROM (SELECT rec_id, v, (row_number() OVER (PARTITION BY rec_id ORDER BY t) - 1) // 3 AS g FROM series) GROUP BY rec_id, g", "series"))
def a19(spark, sf_dir):
    g = F.floor((F.row_number().over(Window.partitionBy("rec_id").orderBy("t")) - 1) / 3)
    return rounded(V.series(spark, sf_dir).select("rec_id", "v", g.alias("g")).groupBy("rec_id", "g").agg(F.avg("v").alias("m")))


def _lexicon(spark, sf_dir):
    """Words of the benchmark with two categories by length."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(K.lexicon_tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", (F.length("word") > 5).cast("int").alias("long"), (F.length("word") < 4).cast("int").alias("short")).where("long + short > 0")


_TOK = "list_filter(regexp_split_to_array(trim(lower(text), ' .,-'''), '[ ,]'), lambda w: w <> '')"
_LEX = f"lex AS (SELECT word, (length(word) > 5)::INT AS long, (length(word) < 4)::INT AS short FROM (SELECT DISTINCT unnest({_TOK}) AS word FROM benchmark) WHERE length(word) > 5 OR length(word) < 4)"


@query("a20_lexicon_shares", f"WITH {_LEX}, t AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents) SELECT d.doc_id, coalesce(round(sum(long) / count(lex.word), 6), 0) AS long, coalesce(round(sum(short) / count(lex.word), 6), 0) AS short FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN lex USING (word) GROUP BY d.doc_id")
def a20(spark, sf_dir):
    return rounded(P.lexicon_shares(docs(spark, sf_dir), "doc_id", K.lexicon_tokens(F.col("text")), _lexicon(spark, sf_dir), ["long", "short"]))


@query("a21_vocabulary", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(string_split({K.cleaned_sql('text')}, ' '), lambda x: x <> '')) AS w FROM conversations) GROUP BY w")
def a21(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(K.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("a22_first_row_per_key", "SELECT user_id, min(event_id) AS pos, arg_min(value, event_id) AS v FROM events GROUP BY user_id")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("pos"), F.min_by("value", "event_id").alias("v"))


@query("w10_cumulative_offsets", "SELECT conv_id, n, sum(n) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def w10(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return running(n, ["conv_id"], {"before": "n"}).select("conv_id", "n", (F.col("before") + F.col("n")).alias("upto"))


@query("j11_lookup_with_fallback", f"WITH {_LEX}, t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM conversations), c AS (SELECT w, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS k FROM t) SELECT w, coalesce(a.long, b.long) AS long FROM c LEFT JOIN lex a ON a.word = w LEFT JOIN lex b ON a.word IS NULL AND k <> w AND b.word = k")
def j11(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    out = J.with_fallback(words, _lexicon(spark, sf_dir), "word", F.lower(F.regexp_replace("word", "[^A-Za-z]", "")), ["long"])
    return out.select(F.col("word").alias("w"), "long")


@query("j12_ratings_across_types", "SELECT user_id, max(value) FILTER (event_type = 'purchase') AS both, max(value) FILTER (event_type = 'click') AS audio, max(value) FILTER (event_type = 'view') AS video FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0")
def j12(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    of = lambda k, n: best.where(F.col("event_type") == k).select("user_id", F.col("v").alias(n))
    return of("purchase", "both").join(of("click", "audio"), "user_id", "left").join(of("view", "video"), "user_id", "left")


@query("j13_words_to_segments", "SELECT conv_id, turn // 2 AS seg, string_agg(split_part(text, ' ', 1), ' ' ORDER BY turn) AS words FROM conversations GROUP BY ALL")
def j13(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("seg"), F.substring_index("text", " ", 1).alias("w"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "w")))
    return rows.groupBy("conv_id", "seg").agg(F.array_join(F.transform(listed, lambda e: e.w), " ").alias("words"))


@query("j15_permutation", "SELECT a.o_orderkey, a.i AS i, b.i AS j FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) b USING (o_orderkey)")
def j15(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = V.numbered(o, ["o_totalprice", "o_orderkey"], "i").select("o_orderkey", (F.col("i") - 1).alias("i"))
    b = V.numbered(o, ["o_orderkey"], "j").select("o_orderkey", (F.col("j") - 1).alias("j"))
    return a.join(b, "o_orderkey")


@query("j16_parameter_grid", "SELECT l_linestatus AS a, o_orderstatus AS b FROM (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT DISTINCT o_orderstatus FROM orders)")
def j16(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("a")).distinct()
    return a.crossJoin(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("b")).distinct())


@query("j17_known_group_effect", V.sql("SELECT id, round(coalesce(m, 0), 6) AS effect FROM pred LEFT JOIN (SELECT cluster, avg(y - h) AS m FROM pred WHERE fold = 0 AND cluster % 2 = 0 GROUP BY cluster) USING (cluster)", "pred"))
def j17(spark, sf_dir):
    rows = V.pred(spark, sf_dir, number=True)
    known = rows.where("fold = 0 AND cluster % 2 = 0").groupBy("cluster").agg(F.avg(F.col("y") - F.col("h")).alias("m"))
    return rounded(rows.join(known, "cluster", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("effect")))


@query("k1_cleaned_text", f"SELECT doc_id, {K.cleaned_sql('text')} AS t FROM documents")
def k1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", K.cleaned(F.col("text")).alias("t"))


@query("k2_word_tokens", f"SELECT doc_id, len(list_filter(string_split({K.cleaned_sql('text')}, ' '), lambda x: x <> '')) AS n FROM documents")
def k2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(K.tokens(F.col("text"))).cast("long").alias("n"))


@query("k3_lexicon_tokens", f"SELECT doc_id, {_TOK} AS w FROM documents")
def k3(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", K.lexicon_tokens(F.col("text")).alias("w"))


@query("k5_fixed_length", "SELECT conv_id, list_resize(list(coalesce(CASE WHEN turn % 3 < 2 THEN turn::INT END, 1) ORDER BY turn), 6, 0)::INT[] AS ids FROM conversations GROUP BY conv_id")
def k5(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 < 2, F.col("turn").cast("int")).alias("x")))), lambda e: e.x)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(K.fixed_length(ids, 6).alias("ids"))


@query("k6_latest_context", "SELECT a.conv_id, a.turn, coalesce(list(b.turn ORDER BY b.turn) FILTER (b.turn IS NOT NULL), []) AS context FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 3 GROUP BY a.conv_id, a.turn")
def k6(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.collect_list("turn").over(before).alias("context"))


@query("k7_parameter_hash", "SELECT p_partkey, sha256(lower(replace(p_name || '=' || p_retailprice::VARCHAR, '.', '-'))) AS h FROM part")
def k7(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", K.parameter_hash(F.concat_ws("=", "p_name", F.col("p_retailprice").cast("string"))).alias("h"))


@query("k8_compact_name", "SELECT p_partkey, translate('brand=' || p_brand || CASE WHEN p_size > 25 THEN '_size=' || p_size ELSE '' END, ', .', '') AS name FROM part")
def k8(spark, sf_dir):
    size = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", K.compact_name(F.create_map(F.lit("size"), size, F.lit("brand"), F.col("p_brand"))).alias("name"))


@query("k9_prefix_in_list", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'w'))) > 0 AS f FROM part")
def k9(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.exists(F.split("p_name", " "), lambda w: F.startswith(w, F.lit("w"))).alias("f"))


@query("k10_answer_match", "SELECT event_id, CASE lower(event_type) WHEN 'view' THEN 'click' ELSE lower(event_type) END = 'click' AS hit FROM events")
def k10(spark, sf_dir):
    word = F.lower("event_type")
    return table(spark, sf_dir, "events").select("event_id", (F.when(word == "view", "click").otherwise(word) == "click").alias("hit"))


def _vec(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query("v1_mean_pool", "SELECT label, i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 6) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")
def v1(spark, sf_dir):
    pooled = A.mean_pool(_vec(spark, sf_dir), ["label"], "embedding")
    return rounded(pooled.select("label", F.posexplode("pooled").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), "m"))


@query("v3_mean_of_layers", "SELECT vec_id, [round((embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE + embedding[i + 48]::DOUBLE) / 4, 6) FOR i IN range(1, 17)] AS m FROM embeddings")
def v3(spark, sf_dir):
    layers = [F.slice("embedding", 1 + 16 * k, 16) for k in range(4)]
    return _vec(spark, sf_dir).select("vec_id", F.transform(A.elementwise_mean(layers), signed6).alias("m"))


@query("v5_padded_ragged", "SELECT vec_id, list_resize([round(x::DOUBLE, 6) FOR x IN embedding[1:(vec_id % 7 + 1)]], 7, 0.0) AS p FROM embeddings")
def v5(spark, sf_dir):
    ragged = F.slice("embedding", F.lit(1), (F.col("vec_id") % 7 + 1).cast("int"))
    rows = _vec(spark, sf_dir).select("vec_id", F.transform(ragged, signed6).alias("v"))
    longest = rows.agg(F.max(F.size("v")).alias("n"))
    return rows.crossJoin(F.broadcast(longest)).select("vec_id", A.padded(F.col("v"), F.col("n")).alias("p"))  # one row


@query("v6_concatenated", "SELECT vec_id, [round(x::DOUBLE, 6) FOR x IN list_concat(embedding[1:3], embedding[60:64])] AS c FROM embeddings")
def v6(spark, sf_dir):
    return _vec(spark, sf_dir).select("vec_id", F.transform(F.concat(F.slice("embedding", 1, 3), F.slice("embedding", 60, 5)), signed6).alias("c"))


@query("v7_interactions", "SELECT vec_id, [round(x, 6) FOR x IN flatten([[a * b FOR b IN [embedding[3]::DOUBLE, embedding[4]::DOUBLE, 1.0::DOUBLE]] FOR a IN [embedding[1]::DOUBLE, embedding[2]::DOUBLE, 1.0::DOUBLE]])][1:8] AS v FROM embeddings")
def v7(spark, sf_dir):
    return _vec(spark, sf_dir).select("vec_id", F.transform(A.interaction(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2)), signed6).alias("v"))


@query("v8_pools", V.sql("SELECT rec_id, max(v) AS mx, arg_max(v, t) AS last, round(coalesce(var_samp(v), 0), 6) AS var, round(avg(v), 6) AS mean FROM series GROUP BY rec_id", "series"))
def v8(spark, sf_dir):
    return rounded(V.series(spark, sf_dir).groupBy("rec_id").agg(F.max("v").alias("mx"), F.max_by("v", "t").alias("last"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"), F.avg("v").alias("mean")))


@query("v9_softmax_weighted", V.sql(", w AS (SELECT rec_id, v, exp(v / 50 - max(v / 50) OVER (PARTITION BY rec_id)) AS w FROM series) SELECT rec_id, round(sum(w * v) / sum(w), 6) AS pooled FROM w GROUP BY rec_id", "series"))
def v9(spark, sf_dir):
    return rounded(A.softmax_weighted(V.series(spark, sf_dir).withColumn("s", F.col("v") / 50), ["rec_id"], "s", "v"))


_DOT = "list_sum([x::DOUBLE * y::DOUBLE FOR x, y IN list_zip({}, {})])"
_PAIRS = "FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"


def _reference(spark, sf_dir):
    """A reference set of every fiftieth vector, and all vectors."""
    ship(spark)
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0"), e


@query("v10_similarities", "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(exp(-2 * list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2), 1e-8), 6) AS rbf, round(exp(2 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 2), 6) AS cos " + _PAIRS)
def v10(spark, sf_dir):
    return SI.pairs(*_reference(spark, sf_dir), "vec_id", "embedding", 2.0, 6)


@query("m11_similarity_prediction", "WITH s AS (SELECT a.vec_id, b.label, greatest(exp(-2 * list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2), 1e-8) AS s " + _PAIRS + " AND a.vec_id <> b.vec_id) SELECT vec_id, round(sum(s * label) / sum(s), 6) AS h FROM s GROUP BY vec_id")
def m11(spark, sf_dir):
    return rounded(SI.predicted(*_reference(spark, sf_dir), "vec_id", "embedding", "label", 2.0))


@query("m15_importance_weights", "WITH s AS (SELECT b.vec_id, b.label, avg(greatest(exp(-2 * list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2), 1e-8)) AS s " + _PAIRS + " GROUP BY ALL) SELECT vec_id, round(greatest(least(s / avg(s) OVER (PARTITION BY label), 10), 0.1), 6) AS w FROM s")
def m15(spark, sf_dir):
    s = SI.mean_similarity(*_reference(spark, sf_dir), "vec_id", "embedding", ["label"], 2.0)
    m = s.groupBy("label").agg(F.avg("s").alias("m"))
    return rounded(s.join(m, "label").select("vec_id", F.greatest(F.least(F.col("s") / F.col("m"), F.lit(10.0)), F.lit(0.1)).alias("w")))


@query("m1_z_scores", V.sql("SELECT id, round((acoustic_qty - avg(acoustic_qty) OVER ()) / (stddev_samp(acoustic_qty) OVER () + 1e-5), 6) AS acoustic_qty, round((vision_tax - avg(vision_tax) OVER ()) / (stddev_samp(vision_tax) OVER () + 1e-5), 6) AS vision_tax FROM wide", "wide"))
def m1(spark, sf_dir):
    return rounded(P.z_scored(V.wide(spark, sf_dir, number=True).select("id", "acoustic_qty", "vision_tax"), ["acoustic_qty", "vision_tax"]))


@query("m3_learned_and_clipped", V.sql(", s AS (SELECT avg(acoustic_price) AS m, stddev_pop(acoustic_price) AS s FROM wide WHERE id % 5 < 3) SELECT id, round(greatest(least((acoustic_price - m) / s, 1.5), -1.5), 6) AS acoustic_price FROM wide, s WHERE id % 5 >= 3", "wide"))
def m3(spark, sf_dir):
    rows = written(V.wide(spark, sf_dir, number=True).select("id", "acoustic_price", F.lit(1.0).alias("vision_flat")), "numbered")  # numbered once
    learned = P.learn(rows.where("id % 5 < 3"), ["acoustic_price", "vision_flat"])
    return rounded(P.apply(rows.where("id % 5 >= 3"), learned, 1.5))


@query("m4_reverted_scaling", V.sql("SELECT id, round(y, 6) AS y FROM pred", "pred"))
def m4(spark, sf_dir):
    rows = V.pred(spark, sf_dir, number=True).select("id", "y")
    learned = P.learn(V.pred(spark, sf_dir), ["y"])["y"]
    return rounded(rows.select("id", P.revert((F.col("y") - learned[0]) / learned[1], learned).alias("y")))


@query("m5_f_statistic", V.sql(", r AS (SELECT 'acoustic_qty' AS f, covar_pop(acoustic_qty, y) / sqrt(var_pop(acoustic_qty) * var_pop(y)) AS r, count(*) AS n FROM wide UNION ALL SELECT 'vision_disc', covar_pop(vision_disc, y) / sqrt(var_pop(vision_disc) * var_pop(y)), count(*) FROM wide) SELECT f AS feature, round(r * r / (1 - r * r) * (n - 2), 3) AS f FROM r", "wide"))
def m5(spark, sf_dir):
    return L.f_statistics(V.wide(spark, sf_dir), ["acoustic_qty", "vision_disc"], "y").select("feature", F.round("f", 3).alias("f"))


_ANOVA = "SELECT '{0}' AS feature, round((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1) / (sum(q) / (sum(n) - count(*))), 3) AS f FROM (SELECT meta_id % 4 AS k, count(*) AS n, avg({0}) AS m, var_pop({0}) * count(*) AS q FROM wide GROUP BY k)"


@query("m5_f_of_classes", V.sql(" " + " UNION ALL ".join(_ANOVA.format(c) for c in ("acoustic_qty", "vision_disc", "y")), "wide"))
def m5_classes(spark, sf_dir):
    rows = V.wide(spark, sf_dir).withColumn("k", F.col("meta_id") % 4)
    return L.anova_f(rows, ["acoustic_qty", "vision_disc", "y"], "k").select("feature", F.round("f", 3).alias("f"))


@query("m12_random_intercepts", V.sql(", g AS (SELECT cluster, count(*) AS n, sum(y - h) AS s, sum((y - h) ** 2) AS q FROM pred GROUP BY cluster), p0 AS (SELECT 1.0::DOUBLE AS s2, 1.0::DOUBLE AS d)" + "".join(f", b{k} AS (SELECT g.*, d * s / (s2 + n * d) AS b, d * s2 / (s2 + n * d) AS v FROM g, p{k}), p{k + 1} AS (SELECT sum(q - 2 * b * s + n * (b * b + v)) / sum(n) AS s2, avg(b * b + v) AS d FROM b{k})" for k in range(5)) + " SELECT cluster, round(p5.d * s / (p5.s2 + n * p5.d), 6) AS effect FROM g, p5", "pred"))
def m12(spark, sf_dir):
    return rounded(L.random_intercepts(V.pred(spark, sf_dir).withColumn("r", F.col("y") - F.col("h")), "cluster", "r", 5).select("cluster", "effect"))


@query("m14_late_fusion", V.sql(", p AS (SELECT id, unnest([1, 2, 3]) AS m, unnest([h, h * 0.9, h * 1.2]) AS h, unnest([0.1, 0.5, 1.0]::DOUBLE[]) AS a FROM pred) SELECT id, round(avg(h), 6) AS mean, round(sum(exp(-a) * h) / sum(exp(-a)), 6) AS weighted FROM p GROUP BY id", "pred"))
def m14(spark, sf_dir):
    experts = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).alias("a")) for w, a in ((1.0, 0.1), (0.9, 0.5), (1.2, 1.0))]))
    rows = V.pred(spark, sf_dir, number=True).select("id", "h", experts.alias("e")).select("id", (F.col("h") * F.col("e.w")).alias("h"), F.col("e.a").alias("a"))
    return rounded(rows.groupBy("id").agg(F.avg("h").alias("mean"), S.weighted_mean(F.col("h"), F.exp(-F.col("a"))).alias("weighted")))


@query("m16_speaker_one_hot", "SELECT conv_id, turn, [(role = r)::INT FOR r IN (SELECT list(DISTINCT role ORDER BY role) FROM conversations)] AS hot FROM conversations")
def m16(spark, sf_dir):
    rows = P.codes(table(spark, sf_dir, "conversations"), "role")
    k = rows.agg(F.max("code").alias("k")).first().k + 1
    return rows.select("conv_id", "turn", A.one_hot(F.col("code"), k).alias("hot"))


@query("a12_scalar_names", V.sql(", f AS (SELECT fold, avg(abs(y - h)) AS m FROM pred GROUP BY fold) SELECT round(max(m) FILTER (fold = 0), 6) AS mae_0, round(max(m) FILTER (fold = 1), 6) AS mae_1, round(avg(m), 6) AS mae FROM f", "pred"))
def a12(spark, sf_dir):
    per = V.pred(spark, sf_dir).groupBy("fold").agg(F.avg(F.abs(F.col("y") - F.col("h"))).alias("m"))
    of = lambda k: F.max(F.when(F.col("fold") == k, F.col("m"))).alias(f"mae_{k}")
    return rounded(per.agg(of(0), of(1), F.avg("m").alias("mae")))


_SHARED = "(SELECT max(i) FROM (SELECT unnest(range(0, (SELECT length(min({0})) + 1 FROM {1}))) AS i) WHERE left((SELECT min({0}) FROM {1}), i) = left((SELECT max({0}) FROM {1}), i))"


@query("a17_common_prefix", f"SELECT left(min(s_name), {_SHARED.format('s_name', 'supplier')}) AS prefix, reverse(left(min(reverse(s_name)), {_SHARED.format('reverse(s_name)', 'supplier')})) AS suffix, left(min(url), {_SHARED.format('url', 'pages')}) AS url_prefix, reverse(left(min(reverse(url)), {_SHARED.format('reverse(url)', 'pages')})) AS url_suffix FROM supplier, pages")
def a17(spark, sf_dir):
    names = P.common_ends(table(spark, sf_dir, "supplier"), "s_name")
    urls = P.common_ends(table(spark, sf_dir, "pages"), "url").select(F.col("prefix").alias("url_prefix"), F.col("suffix").alias("url_suffix"))
    return names.crossJoin(urls)  # one row each


@query("h8_modality_pairs", V.sql(", m AS (SELECT unnest(['acoustic', 'language', 'vision']) AS m) SELECT a.m AS a, b.m AS b, (SELECT count(*) FROM wide) AS rows FROM m a, m b WHERE a.m < b.m", "wide"))
def h8(spark, sf_dir):
    rows = V.wide(spark, sf_dir)
    names = spark.createDataFrame([(m,) for m in P.modalities(rows.columns)], "a string")
    pairs = names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))
    return pairs.crossJoin(rows.agg(F.count(F.lit(1)).alias("rows")))
