"""Decisions on planned actions, their outcome and the incident view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.triage import awaiting
from opsloom.plans.ranking import arrival_rank

DEFAULT_REVIEWER = "SRE_Lead"


def first_decisions(decisions: DataFrame, key: str = "ticket_id", seq: str = "seq") -> DataFrame:
    """The decision that counts: the earliest per incident, combined before the shuffle."""
    first = F.min_by(F.struct("approved", "reviewer", F.col(seq).alias("decided_seq")), seq)
    return decisions.groupBy(key).agg(first.alias("_d")).select(key, "_d.*")


def apply_decisions(planned: DataFrame, decisions: DataFrame) -> DataFrame:
    """Turns pending actions into approved or rejected ones; undecided incidents stay paused."""
    joined = planned.join(first_decisions(decisions), "ticket_id", "left")
    decided = awaiting() & F.col("decided_seq").isNotNull()
    approved = F.coalesce("approved", F.lit(False))
    reviewer = F.coalesce("reviewer", F.lit(DEFAULT_REVIEWER))
    status = F.when(decided & approved, "approved").when(decided, "rejected")
    result = F.when(decided & approved, F.concat(F.lit("Approved by "), reviewer)).when(
        decided, "Denied by reviewer."
    )
    out = joined.select(
        *planned.columns, awaiting().alias("paused_for_human"), status.alias("_s"), result.alias("_r")
    )
    return out.withColumns(
        {
            "action_status": F.coalesce("_s", "action_status"),
            "action_result": F.coalesce("_r", "action_result"),
        }
    ).drop("_s", "_r")


def decision_answers(planned: DataFrame, decisions: DataFrame) -> DataFrame:
    """The answer to every decision: 200, 404 for an unknown incident, 409 when it is not,
    or no longer, awaiting approval."""
    state = planned.select("ticket_id", awaiting().alias("_awaiting"))
    first = first_decisions(decisions).select("ticket_id", "decided_seq")
    joined = decisions.join(first, "ticket_id").join(state, "ticket_id", "left")
    answer = (
        F.when(F.col("_awaiting").isNull(), 404)
        .when(~F.col("_awaiting") | (F.col("seq") > F.col("decided_seq")), 409)
        .otherwise(200)
    )
    return joined.select(*decisions.columns, answer.alias("answer"))


def execute(decided: DataFrame) -> DataFrame:
    """Runs approved actions (a text only) and closes or escalates every incident that is
    not paused or quarantined."""
    status = F.col("action_status")
    open_ = F.col("security_flagged") | awaiting()
    done = ~open_ & (status == "approved")
    text = F.format_string(
        "[SIMULATED] SUCCESS: Rolled back %s to commit %s.", "service_name", "target_commit"
    )
    return decided.withColumns(
        {
            "action_result": F.when(done, text).otherwise(F.col("action_result")),
            "review_status": F.when(open_, F.col("review_status"))
            .when(done, "resolved")
            .otherwise("escalated"),
            "resolution_notes": F.when(open_, F.col("resolution_notes"))
            .when(status.isNull(), "No automated remediation for this severity; routed to on-call.")
            .when(done, "Mitigation applied successfully.")
            .otherwise("Action was rejected."),
            "action_status": F.when(done, "executed").otherwise(status),
        }
    )


def action_history(reports: DataFrame, seq: str = "seq", split: bool | None = None) -> DataFrame:
    """One row per action of a ticket with its latest status, in order of first report.

    ``reports`` has (ticket_id, action_type, target, status, seq).
    """
    merged = reports.groupBy("ticket_id", "action_type", "target").agg(
        F.min(seq).alias("first_seq"), F.max_by("status", seq).alias("status")
    )
    return arrival_rank(merged, ["ticket_id"], "first_seq", "position", split=split)


def incident_view(executed: DataFrame) -> DataFrame:
    """The wide row a reader of one incident sees."""
    prompt = F.format_string("Authorize remediation rollback for %s?", "service_name")
    shown = awaiting()
    return executed.withColumns(
        {
            "status": F.when(shown, "AWAITING_APPROVAL").otherwise("COMPLETED"),
            "pending_approval": F.when(shown, prompt),
            # A paused action is not part of the incident's actions yet.
            "action_type": F.when(~shown, F.col("action_type")),
            "target_commit": F.when(~shown, F.col("target_commit")),
            "action_status": F.when(~shown, F.col("action_status")),
            "action_result": F.when(~shown, F.col("action_result")),
        }
    )


def active_incidents(view: DataFrame) -> DataFrame:
    """Open incidents per service and severity."""
    return (
        view.where(F.col("status") != "COMPLETED")
        .groupBy("service_name", "severity")
        .agg(F.count(F.lit(1)).alias("active"))
    )
