"""Redaction, injection scan and tool authorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.barrier import evaluated_once
from opsloom.functions.text import injection_reason, redaction

CLEAN = "Clean input"

# Tools each role may call.
ROLE_TOOLS = {
    "triage_agent": (),
    "research_agent": ("search_it_knowledge_base", "get_service_topology"),
    "rca_agent": ("query_prometheus_metrics", "search_application_logs"),
    "action_agent": ("execute_container_restart", "execute_deployment_rollback"),
}


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean_text, redacted_count and detected_entities (kinds in pattern order)."""
    judged = evaluated_once(df, "_redaction", redaction(F.col(text)))
    return judged.select(
        *df.columns,
        F.col("_redaction.text").alias("clean_text"),
        F.col("_redaction.matches").alias("redacted_count"),
        F.col("_redaction.kinds").alias("detected_entities"),
    )


def scan_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds is_adversarial and attack_reason."""
    reason = injection_reason(F.col(text))
    return df.select(
        "*", reason.isNotNull().alias("is_adversarial"), F.coalesce(reason, F.lit(CLEAN)).alias("attack_reason")
    )


def inspect_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Injection scan and redaction of the raw text in one projection."""
    return redact(scan_injection(df, text), text)


def authorized(role: Column, tool: Column) -> Column:
    """Whether the role lists the tool; unknown roles may call nothing."""
    allowed = F.lit(False)
    for name, tools in ROLE_TOOLS.items():
        if tools:
            allowed = allowed | ((role == name) & tool.isin(*tools))
    return F.coalesce(allowed, F.lit(False))


def authorize_tools(calls: DataFrame) -> DataFrame:
    return calls.withColumn("allowed", authorized(F.col("role"), F.col("tool")))
