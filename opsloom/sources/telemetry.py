"""Telemetry readers with a declared schema, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TELEMETRY_SCHEMA = (
    "event_id string, service_name string, cpu_percent double, memory_percent double, "
    "latency_ms double, status_code int, timestamp timestamp, metadata map<string,string>"
)
# The two rows a standalone run starts from.
DEFAULT_EVENTS = (
    ("evt-01", "api-gateway", 35.0, 42.0, 14.2, 200),
    ("evt-02", "rag-retrieval", 78.5, 82.1, 120.4, 200),
)


def scan_telemetry(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Telemetry files as a table or a stream; without a path, the default rows."""
    if path is None:
        return spark.createDataFrame(
            [(*row, None, {}) for row in DEFAULT_EVENTS], TELEMETRY_SCHEMA
        )
    reader = spark.readStream if streaming else spark.read
    return reader.schema(TELEMETRY_SCHEMA).options(**options).format(fmt).load(path)


def scan_payloads(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    """Raw JSON lines, one payload per row, not yet validated."""
    reader = spark.readStream if streaming else spark.read
    return reader.options(**options).text(path).withColumnRenamed("value", "payload")
