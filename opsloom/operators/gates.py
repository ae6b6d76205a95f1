"""Gates over the SLA and reliability tables, and the published status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.numeric import printed

MIN_AVAILABILITY = 99.0
MAX_MTTR_MINUTES = 60.0


class SLABreach(Exception):
    """Raised on request when a gate fails."""


def _column_or(df: DataFrame, name: str, default: float) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(default)


def availability_violations(sla: DataFrame, minimum: float = MIN_AVAILABILITY) -> DataFrame:
    value = _column_or(sla, "availability_sla", 100.0)
    text = F.format_string(
        "Availability SLA Breach on '%s': %s%% < %s%%",
        "service_name",
        printed(value, 2),
        printed(F.lit(float(minimum)), 2),
    )
    return sla.where(value < minimum).select("service_name", text.alias("violation"))


def mttr_violations(mart: DataFrame, maximum: float = MAX_MTTR_MINUTES) -> DataFrame:
    value = _column_or(mart, "mttr_minutes", 0.0)
    text = F.format_string(
        "MTTR SLA Breach on '%s': %sm > %sm",
        "service_name",
        printed(value, 1),
        printed(F.lit(float(maximum)), 1),
    )
    return mart.where(value > maximum).select("service_name", text.alias("violation"))


def sla_gate(
    sla: DataFrame,
    mart: DataFrame,
    min_availability: float = MIN_AVAILABILITY,
    max_mttr_minutes: float = MAX_MTTR_MINUTES,
) -> DataFrame:
    """One row: PASSED or FAILED, the thresholds, the service count and the message.

    The message lists one short text per breaching service, so its size is that of the
    service dimension, not of the telemetry.
    """
    found = (
        availability_violations(sla, min_availability)
        .withColumn("_gate", F.lit(1))
        .unionByName(
            mttr_violations(mart, max_mttr_minutes).withColumn("_gate", F.lit(2))
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("_gate", "service_name", "violation")))
    joined = F.array_join(F.transform(ordered, lambda s: s["violation"]), " | ")
    summary = found.agg(F.count(F.lit(1)).alias("violation_count"), joined.alias("_text"))
    services = sla.agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("violation_count") > 0
    return summary.select(
        F.when(failed, "FAILED").otherwise("PASSED").alias("status"),
        F.lit(float(min_availability)).alias("min_availability_verified"),
        F.lit(float(max_mttr_minutes)).alias("max_mttr_verified"),
        services.select("n").scalar().alias("evaluated_services_count"),
        "violation_count",
        F.when(failed, F.concat(F.lit("SLA Gates Failed: "), "_text")).alias("violations"),
    )


def require_passed(gate: DataFrame) -> None:
    """The one driver-side step: raise when the one-row gate failed."""
    row = gate.select("status", "violations").first()
    if row["status"] != "PASSED":
        raise SLABreach(row["violations"])


def publish_status(gate: DataFrame, as_of: Column) -> DataFrame:
    """Status row for downstream readers; a breach is an outcome, not an error."""
    passed = F.col("status") == "PASSED"
    return gate.select(
        F.when(passed, "PUBLISHED").otherwise("SLA_BREACH").alias("status"),
        F.col("status").alias("gate_status"),
        as_of.alias("published_at"),
    )
