"""The topic as a table: partition, offset, high watermark, incremental reads and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.functions.hashing import md5_modulo
from opsloom.plans.ranking import arrival_rank


def with_partition(df: DataFrame, key: str = "service_name", partitions: int = 4) -> DataFrame:
    return df.withColumn("partition", md5_modulo(F.col(key), partitions))


def with_offsets(df: DataFrame, seq: str = "seq", split: bool | None = None) -> DataFrame:
    """Append order inside a partition, counted from 0.

    A topic has few partitions, so ranking by a plain window would use a few tasks.
    """
    ranked = arrival_rank(df, ["partition"], seq, "_rank", split=split)
    return ranked.withColumn("offset", F.col("_rank") - 1).drop("_rank")


def high_watermarks(df: DataFrame, partitions: int = 4) -> DataFrame:
    """Records per partition, empty partitions included as 0."""
    counts = df.groupBy("partition").agg(F.count(F.lit(1)).alias("records"))
    every = df.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select(
        "partition", F.coalesce("records", F.lit(0)).alias("high_watermark")
    )


def read_range(
    topic: DataFrame, positions: DataFrame, max_records_per_partition: int = 100
) -> DataFrame:
    """Rows at ``current <= offset < current + max`` of each partition.

    ``positions`` has (partition, current); a partition without a position starts at 0.
    """
    start = F.coalesce("current", F.lit(0))
    return (
        topic.join(positions, "partition", "left")
        .where((F.col("offset") >= start) & (F.col("offset") < start + max_records_per_partition))
        .drop("current")
    )


def next_positions(
    watermarks: DataFrame, positions: DataFrame, max_records_per_partition: int = 100
) -> DataFrame:
    """Where each partition is read next, after ``read_range``."""
    start = F.coalesce("current", F.lit(0))
    return watermarks.join(positions, "partition", "left").select(
        "partition",
        F.greatest(start, F.least("high_watermark", start + max_records_per_partition)).alias(
            "next_position"
        ),
    )


def consumer_lag(watermarks: DataFrame, commits: DataFrame, partitions: int = 4) -> DataFrame:
    """Lag per (group, partition); a partition the group never committed counts from 0."""
    assigned = (
        commits.select("group_id")
        .distinct()
        .select("group_id", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("partition"))
    )
    committed = commits.groupBy("group_id", "partition").agg(F.max("committed").alias("committed"))
    behind = F.col("high_watermark") - F.coalesce("committed", F.lit(0))
    return (
        assigned.join(watermarks, "partition")
        .join(committed, ["group_id", "partition"], "left")
        .select(
            "group_id",
            "partition",
            "high_watermark",
            F.coalesce("committed", F.lit(0)).alias("committed"),
            F.greatest(F.lit(0), behind).alias("lag"),
        )
    )


def group_lag(lag: DataFrame) -> DataFrame:
    """Total lag per group and whether it may be handed to the next stage."""
    return lag.groupBy("group_id").agg(F.sum("lag").alias("total_lag")).withColumn(
        "zero_lag_verified", F.col("total_lag") == 0
    )
