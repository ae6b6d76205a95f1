"""Root-cause reports from correlated logs, commits and the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.faults import RUNBOOKS, UNKNOWN, by_fault, fault_name, fault_rank
from opsloom.functions.hashing import short_id
from opsloom.plans.sizing import small_side

# Lines shown, levels counted as errors, limits of a P1.
SHOWN_LOGS = 5
SHOWN_COMMITS = 2
ERROR_LEVELS = ("ERROR", "CRITICAL")
P1_LATENCY_MS = 1000.0
P1_ERROR_LOGS = 3


def error_lines(logs: DataFrame) -> DataFrame:
    """ERROR and CRITICAL lines; a line without a level counts, an explicit null does not."""
    level = F.when(F.col("has_level"), F.col("level")).otherwise("ERROR")
    text = F.concat(F.lit("["), level, F.lit("] "), F.coalesce("message", F.lit("")))
    return logs.where(level.isin(*ERROR_LEVELS)).select(
        F.col("service").alias("service_name"), "seq", text.alias("line")
    )


def correlate_logs(logs: DataFrame) -> DataFrame:
    """Per service: the first lines, how many there are, and the fault they speak of.

    The fault of all lines joined is the first rule any single line matches, so it is a
    minimum over lines and no service's log is ever collected; the shown lines come from a
    limited rank that keeps a few rows per task.
    """
    lines = error_lines(logs)
    totals = lines.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("error_log_count"), F.min(fault_rank(F.col("line"))).alias("_fault")
    )
    w = W.partitionBy("service_name").orderBy("seq")
    shown = (
        lines.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= SHOWN_LOGS)
        .groupBy("service_name")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "line"))).alias("_lines"))
    )
    return totals.join(shown, "service_name").select(
        "service_name",
        F.transform("_lines", lambda x: x["line"]).alias("correlated_logs"),
        "error_log_count",
        fault_name(F.col("_fault")).alias("fault_type"),
    )


def correlate_commits(commits: DataFrame) -> DataFrame:
    """The first commits per service; the first one is the culprit."""
    w = W.partitionBy("service").orderBy("seq")
    return (
        commits.where("service is not null")
        .withColumn("commit_no", F.row_number().over(w))
        .where(F.col("commit_no") <= SHOWN_COMMITS)
        .withColumnRenamed("service", "service_name")
    )


def incident_severity(observed: Column, anomaly_severity: Column, error_logs: Column) -> Column:
    urgent = (
        (F.coalesce(anomaly_severity, F.lit("")) == "CRITICAL")
        | (F.coalesce(observed, F.lit(0.0)) > P1_LATENCY_MS)
        | (F.coalesce(error_logs, F.lit(0)) >= P1_ERROR_LOGS)
    )
    return F.when(urgent, "P1").otherwise("P2")


def anomaly_severity(observed: Column) -> Column:
    return F.when(observed > P1_LATENCY_MS, "CRITICAL").otherwise("WARNING")


def reports(
    requests: DataFrame,
    logs: DataFrame,
    commits: DataFrame,
    impacted: DataFrame,
    request_key: str | None = None,
) -> DataFrame:
    """One report per request (service_name, observed_value and, if named, a ``request_key``).

    Logs, commits and blast radius shrink to one row per service before they meet the
    requests. The id is a hash, so a re-run yields the same report; with a request key it is
    unique per request, also among equal readings of one service. Its visible part is short,
    ``report_key`` holds the whole hash.
    """
    by_log = correlate_logs(logs)
    ordered = F.array_sort(
        F.collect_list(F.struct("commit_no", "commit_hash", "author", "message"))
    )
    by_commit = correlate_commits(commits).groupBy("service_name").agg(ordered.alias("correlated_commits"))
    radius = impacted.groupBy("service").agg(F.array_sort(F.collect_list("impacted")).alias("_hit"))
    joined = (
        requests.join(small_side(by_log), "service_name", "left")
        .join(small_side(by_commit), "service_name", "left")
        .join(radius.withColumnRenamed("service", "service_name"), "service_name", "left")
    )
    culprit = F.col("correlated_commits")[0]
    has_commit = F.col("correlated_commits").isNotNull()
    service = F.col("service_name")
    fault = F.coalesce("fault_type", F.lit(UNKNOWN))
    regression = F.format_string(
        "Deployment regression in commit '%s' by %s: '%s'. Triggered resource exhaustion in %s.",
        culprit["commit_hash"], culprit["author"], culprit["message"], service,
    )
    contention = F.concat(
        F.lit("Downstream service dependency bottleneck or query contention in "), service,
        F.lit(". Observed value: "), F.col("observed_value").cast("string"), F.lit("ms."),
    )
    rollback_plan = F.array(
        F.concat(F.lit("Initiate canary rollback for commit "), culprit["commit_hash"], F.lit(".")),
        F.concat(F.lit("Scale up "), service, F.lit(" replicas by 50% to absorb pending request buffer.")),
        F.lit("Drain connection pool and verify P95 latency returns under 60ms."),
    )
    inspect_plan = F.array(
        F.concat(F.lit("Inspect active connections on "), service, F.lit(" backing store.")),
        F.lit("Flush stale session caches in Redis cluster."),
        F.lit("Verify database lock contention on customer-facing tables."),
    )
    fallback = F.when(has_commit, RUNBOOKS["ERROR_BURST"]).otherwise(RUNBOOKS["LATENCY_SPIKE"])
    observed = F.col("observed_value")
    no_text = F.array().cast("array<string>")
    parts = [service, observed.cast("string")]
    whole_key = []
    if request_key is not None:
        parts.append(F.col(request_key).cast("string"))
        whole_key = [F.col(request_key), F.sha2(F.concat_ws("|", *parts), 256).alias("report_key")]
    return joined.select(
        *whole_key,
        short_id("INC-", *parts).alias("incident_id"),
        "service_name",
        incident_severity(observed, anomaly_severity(observed), F.col("error_log_count")).alias("severity"),
        fault.alias("fault_type"),
        F.when(has_commit, regression).otherwise(contention).alias("root_cause_summary"),
        F.coalesce("correlated_logs", no_text).alias("correlated_logs"),
        "correlated_commits",
        F.concat(F.array(service), F.coalesce("_hit", no_text)).alias("blast_radius"),
        by_fault(fault, RUNBOOKS, fallback).alias("recommended_runbook"),
        F.when(has_commit, rollback_plan).otherwise(inspect_plan).alias("action_plan"),
    )
