"""The five fixture views over the given tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadenz.operators.ordering import numbered
from kadenz.session import table

#: Seconds since 1970 of a zone-less timestamp; the session's zone plays no part.
SECONDS = "CAST(CAST(ts - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6))"
#: Length of the labelled intervals in seconds.
SIX_HOURS = 21600
LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

SQL = {
    "series": "SELECT user_id AS rec_id, event_type AS channel, event_id AS seq, epoch_us(ts) / 1e6 AS t, value AS v FROM events",
    "intervals": f"SELECT user_id AS rec_id, event_id AS seg_id, epoch_us(ts) / 1e6 AS begin_t, epoch_us(ts) / 1e6 + {SIX_HOURS} AS end_t FROM events WHERE event_type = 'purchase'",
    "pred": f"SELECT row_number() OVER (ORDER BY {LINES}) AS id, l_suppkey AS cluster, (l_orderkey % 5)::INT AS fold, l_quantity AS y, l_extendedprice / 1000 AS h FROM lineitem",
    "class": "SELECT event_id AS id, user_id AS cluster, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS y, ((event_id * 7 + user_id) % 5)::INT AS h, value / 100 AS score FROM events",
    "wide": f"SELECT row_number() OVER (ORDER BY {LINES}) AS id, l_suppkey AS meta_id, l_quantity AS acoustic_qty, l_extendedprice AS acoustic_price, l_discount AS vision_disc, l_tax AS vision_tax, p_size AS language_size, p_retailprice AS language_retail, l_quantity * (1 - l_discount) AS y FROM lineitem JOIN part ON l_partkey = p_partkey",
}


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, channel, seq, t, v): irregular samples in long form."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS rec_id", "event_type AS channel", "event_id AS seq", f"CAST({SECONDS} AS DOUBLE) AS t", "value AS v")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, seg_id, begin_t, end_t): overlapping intervals of six hours after each purchase."""
    rows = series(spark, sf_dir).where("channel = 'purchase'")
    return rows.select("rec_id", F.col("seq").alias("seg_id"), F.col("t").alias("begin_t"), (F.col("t") + SIX_HOURS).alias("end_t"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table lineitem with an id in a fixed order."""
    return numbered(table(spark, sf_dir, "lineitem"), LINES.split(", "))


def pred(spark: SparkSession, sf_dir: str, number: bool = False) -> DataFrame:
    """(cluster, fold, y, h), and id before them if asked for: regression targets and predictions. Numbering all rows sorts them."""
    rows = _lines(spark, sf_dir) if number else table(spark, sf_dir, "lineitem")
    return rows.selectExpr(*(["id"] if number else []), "l_suppkey AS cluster", "CAST(l_orderkey % 5 AS INT) AS fold", "l_quantity AS y", "l_extendedprice / 1000 AS h")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, y, h, score): five classes and one score."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS cluster", "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS y",
        "CAST((event_id * 7 + user_id) % 5 AS INT) AS h", "value / 100 AS score",
    )


def wide(spark: SparkSession, sf_dir: str, number: bool = False) -> DataFrame:
    """Feature columns with modality prefixes, a group and a target; with an id, if asked for."""
    rows = (_lines(spark, sf_dir) if number else table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(
        *(["id"] if number else []), "l_suppkey AS meta_id", "l_quantity AS acoustic_qty", "l_extendedprice AS acoustic_price", "l_discount AS vision_disc", "l_tax AS vision_tax",
        "p_size AS language_size", "p_retailprice AS language_retail", "l_quantity * (1 - l_discount) AS y",
    )


def sql(body: str, *views: str) -> str:
    """The body after the CTEs of the named views."""
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    return f"WITH {head} {body.strip()}" if views else body
