"""A training-data pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Nulls, empty texts and repeated rows are handled as the operators' docstrings say; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadenz.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from kadenz.llm.staging import stage
from kadenz.session import ship, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon, learned from the table labels, scores 0.5 or more. Held-out rows are not learned from."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.where("toxicity < 0.5").select(*docs.columns)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) keeps the row with the largest doc_id."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles keeps the smallest doc_id."""
    ship(spark)
    gone = stage(near_dedup.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out windows of 20 words that also start earlier; the document stays, with what is left of its text."""
    ship(spark)
    out = substring_dedup.substring_dedup(docs, tidy=False)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    ship(spark)
    cut = packing.pieces(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN)
    return packing.pack(cut)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("substring_dedup", remove_repeats),
    ("packing", pack),
]

#: The stages learn, follow links and pack; SQL cannot express that. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
