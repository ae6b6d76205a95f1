"""Run tracking: one row per run name, the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_runs(logged: DataFrame, seq: str = "seq") -> DataFrame:
    latest = F.max_by(F.struct("params", "metrics", "tags"), seq)
    no_tags = F.create_map().cast("map<string,string>")
    return (
        logged.groupBy("run_name")
        .agg(latest.alias("_run"), F.count(F.lit(1)).alias("runs_logged"))
        .select(
            "run_name",
            F.col("_run.params").alias("params"),
            F.col("_run.metrics").alias("metrics"),
            F.coalesce("_run.tags", no_tags).alias("tags"),
            "runs_logged",
        )
    )


def get_run(latest: DataFrame, run_name: str) -> DataFrame:
    """The run with this name; no rows when it is unknown."""
    return latest.where(F.col("run_name") == run_name)
