"""Cutting lineage so that a lost executor never forces a whole job to restart.

Everything goes through ``checkpoint()`` or a written table below the folder named by
``spark.checkpoint.dir``: executors only ever hold copies that can be read again.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's setting for removing a query's shuffle files at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only in local mode, where one machine runs all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or local_folder(context.master))
    return named or context._jsc.sc().getCheckpointDir().get()


def local_folder(master: str) -> str:
    """A fresh temporary folder for local mode; elsewhere executors could not read it."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(
            f"master is {master}: set spark.checkpoint.dir to a folder that all executors share"
        )
    return tempfile.mkdtemp(prefix="opsloom-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, and continue from the written copy."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table next to the checkpoints."""
    return f"{checkpoint_root(spark).rstrip('/')}/opsloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as each of them has ended.

    Otherwise they stay until the driver happens to collect its garbage, and those of a job of
    many steps add up to many times its input.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The same through a written table.

    A checkpoint keeps the optimiser's estimate and constraints of the plan it came from; in a loop
    that joins a table with itself they double each round. A table that is read has its own size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
