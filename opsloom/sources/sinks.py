"""Written forms of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    """Snappy Parquet, replaced as a whole; returns the table read back."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Staging models are views: recomputed by every reader."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def publish_table(df: DataFrame, path: str, name: str) -> DataFrame:
    """Marts are tables: dropped and written again on every run, read under ``name``."""
    stored = write_parquet(df, path)
    stored.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def append_status(df: DataFrame, path: str, run: str) -> None:
    """Adds the rows of a run; a run that is repeated replaces its own rows and no others."""
    (
        df.withColumn("run", F.lit(run))
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("run")
        .parquet(path)
    )
