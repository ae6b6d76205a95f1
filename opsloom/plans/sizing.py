"""Size checks made on the plan, before any job runs.

An operator that has a cheap form for small input and a distributed form for large input
asks here which one to take. The estimate is Catalyst's own; where it is unavailable the
answer is "large", so the distributed form is the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.plans.durable import durable

# Rows and bytes (as JSON text) up to which every executor gets a copy of a join side.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Scanned bytes up to which one task can hold any single group of the input.
ONE_TASK_BYTES = 128 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for the optimised plan, or None when it cannot be read."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except Exception:
        return None


def fits_one_task(df: DataFrame, limit: int = ONE_TASK_BYTES) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= limit


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own broadcast threshold in bytes, whatever unit it was set in; below 0: never."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join side that is expected, not known, to be small.

    Spark estimates an aggregate to be as large as its input, so a few rows per service,
    derived from a huge table, would make it shuffle the huge table for the join. Where the
    estimate exceeds Spark's own broadcast limit the side is written down and measured:
    within ``rows`` and ``BROADCAST_BYTES`` it is broadcast, otherwise the join shuffles.
    A session that switches broadcasts off (threshold -1) never gets one.
    """
    limit = broadcast_limit(df.sparkSession)
    size = planned_bytes(df)
    if limit < 0 or (size is not None and size <= limit):
        return df
    frozen = durable(df)
    if frozen.count() > rows:
        return frozen
    width = F.octet_length(F.to_json(F.struct("*")))
    total = frozen.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(frozen) if total <= BROADCAST_BYTES else frozen
