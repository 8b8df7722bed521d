"""Rounding as SQL does it, and files whose number does not grow with recordings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kadenz.operators import splits as X
from kadenz.plans import catalog
from kadenz.plans.registry import r6, signed6
from kadenz.sources import files


def test_halves_as_in_sql(spark):
    values = [(2 * k + 1) / 2e6 for k in range(3000)] + [-0.0000135, 1.0000005, 5e-324, 1e305, float("nan"), -2.5e-7]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(r6("v")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(v, 6) + 0.0 FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()]
    assert list(map(str, got)) == list(map(str, want))


def test_signs_of_zero_as_in_sql(spark):
    values = [0.0, -0.0, 3e-7, -3e-7, 5e-7, -5e-7, -5e-324, 5e-324, -1.25, -1e305, float("nan"), float("-inf"), None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(signed6("v")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(v, 6) FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()]
    assert list(map(str, got)) == list(map(str, want))


@pytest.mark.parametrize("name", ["v3_mean_of_layers", "v5_padded_ragged", "v6_concatenated", "v7_interactions"])
def test_lists_keep_the_signs_of_zero(spark, tmp_path, name):
    vectors = [[0.0] * 64, [-0.0] * 64, [-1e-7] * 64, [1e-7, -1e-7] * 32, [-0.3, 1e-7, 1e-7, -0.2] * 16, [1e-3, -2e-4] * 32, [0.25, -3e-7, -0.75, 1e-6] * 16]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    sql = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    want = sorted(map(str, sql.fetchall()))
    assert "-0.0" in "".join(want)
    assert sorted(str(tuple(r)) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()) == want


def test_recordings_share_annotation_files(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("rec_id"), F.lit(1).alias("n"), F.lit("words").alias("tier"), F.col("id").cast("double").alias("begin"), (F.col("id") + 0.5).alias("end"), F.concat(F.lit("<a> & "), F.col("id")).alias("value"))
    files.write_annotations(rows, str(tmp_path / "x"))
    assert len([p for p in (tmp_path / "x").rglob("part-*")]) < 100
    got = {(r.begin, r.end, r.value) for r in files.read_annotations(spark, str(tmp_path / "x")).collect()}
    assert got == {(float(i), i + 0.5, f"<a> & {i}") for i in range(300)}


def test_a_large_value_is_written_by_many_tasks(spark, tmp_path):
    plan = "advisoryPartitionSizeInBytes"
    spark.conf.set(f"spark.sql.adaptive.{plan}", "64k")
    try:
        files.write_partitioned(spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"), F.lit(1).alias("k")).repartition(8), str(tmp_path / "p"), ["k"], "csv")
    finally:
        spark.conf.unset(f"spark.sql.adaptive.{plan}")
    assert len(list((tmp_path / "p" / "k=1").glob("*.csv"))) > 1
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 200_000


def test_chunks_of_rows_that_have_numbers(spark):
    rows = spark.range(1, 24).select("id")
    got = X.chunks_of_numbered(rows, "id", 23, 7)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert [r.chunk for r in got.orderBy("id").collect()] == [r.chunk for r in X.chunks(rows, ["id"], 7).orderBy("id").collect()]


def test_names_of_a_family_are_not_matched_for_each_row(spark, tmp_path):
    (tmp_path / "ds_sent_3_test.csv").write_text("id,y\n1,0.5\n")
    got = files.read_csv_family(spark, [str(tmp_path / "ds_sent_3_test.csv")], "id int, y double")
    assert "regexp_extract" not in got._jdf.queryExecution().toString()
    assert tuple(got.first()) == (1, 0.5, "ds", "sent", 3, "test")
