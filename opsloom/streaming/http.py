"""Request-rate windows over a stream of access-log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.streaming.telemetry import WATERMARK


def request_rate_stream(
    log: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK
) -> DataFrame:
    """Requests per endpoint in ``(t - window, t]``; ``t`` in microseconds as in the batch form.

    Spark's windows are closed at the start, so the event time is moved by its smallest unit.
    """
    shifted = log.withColumn("ts", F.col("ts") - F.expr("interval 1 microsecond"))
    counts = (
        shifted.withWatermark("ts", watermark)
        .groupBy("endpoint", F.window("ts", window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counts.select("endpoint", F.unix_micros("w.end").alias("t"), "requests")
