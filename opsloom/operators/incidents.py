"""Incident records: latest version per ticket, staging clean-up and the reliability mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.numeric import tidy

# Target minutes per severity and the tier limits.
TARGET_MINUTES = {"P1": 15, "P2": 60, "P3": 240, "P4": 240}
OTHER_TARGET_MINUTES = 240
EXCELLENT_MTTR = 15.0
ACCEPTABLE_MTTR = 60.0

INCIDENT_COLUMNS = ("service_name", "severity", "started_at", "resolved_at")
# Seconds, their fraction and the zone (Z or an offset) may be missing; no zone means UTC.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm[:ss][.SSSSSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSSSSSSSS][XXX]",
    "yyyy-MM-dd",
)


def _complete() -> Column:
    complete = F.lit(True)
    for name in INCIDENT_COLUMNS:
        complete = complete & F.col(name).isNotNull()
    return complete


def upsert_incidents(feed: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest complete arrival per ticket.

    ``max_by`` combines before the shuffle, so a ticket that arrives a billion times costs
    one row per task. Rows without a ticket id cannot replace each other and all stay.
    """
    complete = feed.where(_complete())
    latest = (
        complete.where(F.col("ticket_id").isNotNull())
        .groupBy("ticket_id")
        .agg(F.max_by(F.struct(*INCIDENT_COLUMNS), seq).alias("_row"))
        .select("ticket_id", *[F.col(f"_row.{c}").alias(c) for c in INCIDENT_COLUMNS])
    )
    unkeyed = complete.where(F.col("ticket_id").isNull()).select("ticket_id", *INCIDENT_COLUMNS)
    return latest.unionByName(unkeyed)


def reject_incidents(feed: DataFrame) -> DataFrame:
    """Arrivals that miss a required column, with the names of what is missing."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in INCIDENT_COLUMNS])
    )
    return feed.where(~_complete()).withColumn("missing", F.array_join(missing, ","))


def parse_time(text: Column) -> Column:
    """Text to a timestamp in seconds; null when no known format fits."""
    return F.date_trunc(
        "second", F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])
    )


def stage_incidents(raw: DataFrame) -> DataFrame:
    """Clean severity and times, duration in minutes, target and breach flag."""
    severity = F.upper(F.trim("severity"))
    cleaned = raw.where(F.col("ticket_id").isNotNull()).select(
        "ticket_id",
        "service_name",
        severity.alias("severity"),
        parse_time(F.col("started_at")).alias("started_at"),
        parse_time(F.col("resolved_at")).alias("resolved_at"),
    )
    seconds = F.unix_seconds("resolved_at") - F.unix_seconds("started_at")
    target = F.lit(OTHER_TARGET_MINUTES)
    for name, minutes in reversed(TARGET_MINUTES.items()):
        target = F.when(F.col("severity") == name, minutes).otherwise(target)
    return (
        cleaned.withColumn("duration_minutes", tidy(seconds / 60.0, 2))
        .withColumn("sla_target_minutes", target)
        .withColumn(
            "is_sla_breached",
            F.when(F.col("duration_minutes") > F.col("sla_target_minutes"), 1).otherwise(0),
        )
    )


def service_reliability(staged: DataFrame) -> DataFrame:
    """Incident volume, MTTR, breaches and tier per service. A null MTTR is a risk."""
    mttr = F.col("mttr_minutes")
    breaches = F.col("total_sla_breaches")
    tier = (
        F.when((breaches == 0) & (mttr <= EXCELLENT_MTTR), "EXCELLENT")
        .when((breaches <= 1) & (mttr <= ACCEPTABLE_MTTR), "ACCEPTABLE")
        .otherwise("SLA_BREACH_RISK")
    )
    return (
        staged.groupBy("service_name")
        .agg(
            F.count("ticket_id").alias("total_incidents"),
            F.count_if(F.col("severity") == "P1").alias("p1_incident_count"),
            F.count_if(F.col("severity") == "P2").alias("p2_incident_count"),
            tidy(F.avg("duration_minutes"), 2).alias("mttr_minutes"),
            F.sum("is_sla_breached").alias("total_sla_breaches"),
        )
        .withColumn("reliability_tier", tier)
    )
