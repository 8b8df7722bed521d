"""The opN_ queries: thin digests of the operators' outputs, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadenz.llm import ann as op5
from kadenz.llm import bpe as op8
from kadenz.llm import chat_format as op12
from kadenz.llm import exact_dedup as op6
from kadenz.llm import html_extract as op7
from kadenz.llm import importance as op11
from kadenz.llm import lm_score as op9
from kadenz.llm import merkle as op13
from kadenz.llm import near_dedup as op2
from kadenz.llm import packing as op3
from kadenz.llm import substring_dedup as op4
from kadenz.llm import toxicity as op1
from kadenz.llm import twins
from kadenz.llm import url_filter as op10
from kadenz.session import ship, table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, name)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(op6.normalised(F.col("text")), 256))
    return op6.exact_dedup(docs, columns=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op4.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _crc(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op1.learn(docs, _table(spark, sf_dir, "labels").where(_crc() != 0))
    digest = op1.score(docs, model).select("doc_id", F.coalesce(_crc() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"))
    return digest.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = op3.pieces(_table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN)
    return op3.pack(cut)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    both = op8.encode(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN, decoded_col="decoded", columns=["doc_id"])
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7.extract(_table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = op9.held_out(F.col("doc_id"))
    out = op9.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), ~held, columns=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.url_filter(_table(spark, sf_dir, "pages"), columns=["page_id"])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = op11.resample(docs, _table(spark, sf_dir, "benchmark"), percent=5, seed=42, columns=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(op12.LOSS_ROLE).alias("role"), F.lit(op12.PLANTED).alias("text"),
    )
    vocabulary = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    return op12.digests(op12.format_chats(turns.unionByName(planted), *vocabulary), *vocabulary)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    other = op13.digest(*[F.col(c) for c in fields[:-1]], op13.lowered(F.col("text")))
    out = op13.manifest(docs, fields, claims={"other": F.when(_crc() == 0, other)})
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(op13.siblings(F.col("steps")), 256).alias("proof_sha256"),
        op13.fold(F.coalesce("other", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op11_importance_resampling": op11_importance_resampling,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_merkle_manifest": op13_merkle_manifest,
    "op9_lm_scoring": op9_lm_scoring,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op7_html_extraction": op7_html_extraction,
    "op10_url_filter": op10_url_filter,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op1_toxicity": op1_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
}

#: A-Z only are lowered; DuckDB's lower() would lower other letters too.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words as the contracts define them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op11_importance_resampling": twins.importance(op11.BUCKETS, 5, op11.LEAST_WORDS, 42),
    "op12_chat_formatting": twins.chats(),
    "op13_merkle_manifest": twins.manifest(),
    "op10_url_filter": op10.oracle(),
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
        k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM p),
        l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM l WHERE rn > 1),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM w ANTI JOIN g USING (doc_id, j) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
}
