"""Tables written to the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from kadenz.session import shared_dir

#: Where a session keeps the name of its folder.
FOLDER = "spark.kadenz.staging"


def run_folder(spark: SparkSession) -> str:
    """The session's folder of written tables."""
    found = spark.conf.get(FOLDER, None)
    if not found:
        found = f"{shared_dir(spark)}/kadenz/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        spark.conf.set(FOLDER, found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the session's folder and returns the written table.

    The files stay until clear(), because results are lazy.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the session's written tables. Call it once the results that read them are written."""
    found = spark.conf.get(FOLDER, None)
    if found:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset(FOLDER)


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """A run of its own: what it stages is deleted at its end, so write the results inside."""
    before = spark.conf.get(FOLDER, None)
    spark.conf.unset(FOLDER)
    try:
        yield
    finally:
        clear(spark)
        if before:
            spark.conf.set(FOLDER, before)
