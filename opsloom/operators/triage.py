"""Tickets: security gate, triage, diagnosis and the planned action, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.barrier import evaluated_once
from opsloom.functions.faults import DIAGNOSIS, SEVERITY, by_fault, classify_fault
from opsloom.functions.text import injection_reason, redaction
from opsloom.operators.textsafety import authorized
from opsloom.plans.sizing import small_side

ROLLBACK = "execute_deployment_rollback"
PLANNER_ROLE = "action_agent"
TARGET_COMMIT = "prev_stable"


def security_gate(tickets: DataFrame) -> DataFrame:
    """Flags attacks and redacts the rest; a flagged ticket keeps its text and goes no further."""
    reason = injection_reason(F.col("description"))
    judged = evaluated_once(tickets, "_reason", reason)
    flagged = F.col("_reason").isNotNull()
    kept = [c for c in tickets.columns if c != "description"]
    return judged.select(
        *kept,
        flagged.alias("security_flagged"),
        F.when(flagged, F.col("description")).otherwise(redaction(F.col("description"))["text"]).alias("description"),
        F.when(flagged, "escalated").otherwise("pending").alias("review_status"),
        F.when(flagged, F.concat(F.lit("QUARANTINED: "), "_reason")).alias("resolution_notes"),
    )


def triage(gated: DataFrame) -> DataFrame:
    """Severity, category, approval need and summary of tickets that passed the gate."""
    passed = ~F.col("security_flagged")
    fault = evaluated_once(
        gated, "fault_type", F.when(passed, classify_fault(F.col("description")))
    )
    urgent = F.lower("description").contains("critical")
    severity = F.when(passed & urgent, "P1").otherwise(by_fault(F.col("fault_type"), SEVERITY))
    return (
        fault.withColumn("severity", severity)
        .withColumn("category", F.lower("fault_type"))
        .withColumn("requires_human_approval", F.col("severity").isin("P1", "P2"))
        .withColumn(
            "summary",
            F.format_string("Triaged as %s incident (fault type: %s).", "severity", "fault_type"),
        )
        .withColumn("summary", F.when(passed, F.col("summary")))
    )


def diagnose(triaged: DataFrame, answers: DataFrame, topology: DataFrame) -> DataFrame:
    """Adds the knowledge-base text, the topology line and the diagnosis.

    ``answers`` (query_id, answer) holds one row per distinct ticket text, named by its digest
    as in ``distinct_descriptions``, since tickets repeat the same words; ``topology`` (service,
    topology) one row per service.
    """
    passed = ~F.col("security_flagged")
    research = F.concat("answer", F.lit("\nTopology: "), "topology")
    return (
        triaged.withColumn("query_id", F.sha2("description", 256))
        .join(small_side(answers), "query_id", "left")
        .join(small_side(topology.withColumnRenamed("service", "service_name")), "service_name", "left")
        .withColumn("kb_research", F.when(passed, research))
        .withColumn("rca_diagnosis", by_fault(F.col("fault_type"), DIAGNOSIS))
        .drop("query_id", "answer", "topology")
    )


def distinct_descriptions(gated: DataFrame) -> DataFrame:
    """Each different ticket text once, as queries for the knowledge base."""
    texts = gated.where(~F.col("security_flagged")).select("description").distinct()
    return texts.select(F.sha2("description", 256).alias("query_id"), F.col("description").alias("query"))


def plan_actions(triaged: DataFrame, role: str = PLANNER_ROLE, tool: str = ROLLBACK) -> DataFrame:
    """The planned action: none for P3 and quarantined tickets, rejected when unauthorised."""
    wants = F.coalesce(F.col("severity").isin("P1", "P2"), F.lit(False))
    allowed = authorized(F.lit(role), F.lit(tool))
    status = (
        F.when(~wants, None)
        .when(~allowed, "rejected")
        .when(F.col("requires_human_approval"), "pending")
        .otherwise("approved")
    )
    denied = F.when(wants & ~allowed, F.lit(f"Tool access denied for role {role}."))
    return triaged.withColumns(
        {
            "action_type": F.when(wants, F.lit(tool)),
            "target_commit": F.when(wants & allowed, F.lit(TARGET_COMMIT)),
            "action_status": status,
            "action_result": denied,
        }
    )


def awaiting() -> Column:
    """Whether a planned action needs a decision before anything runs."""
    return F.coalesce(F.col("action_status") == "pending", F.lit(False))
