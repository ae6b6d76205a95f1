"""Rule-based fault classification and the texts that follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword rules in order, and the severity, diagnosis and runbook per fault.
FAULT_RULES = {
    "OOM_CRASH": r"\b(oom|out of memory|oomkilled|memory leak|cuda)\b",
    "LATENCY_SPIKE": r"\b(timeout|timed out|high latency|latency spike|slow|p99|connection pool)\b",
    "ERROR_BURST": r"\b(5\d\d|error burst|exception|crashloop|regression)\b",
}
UNKNOWN = "UNKNOWN"
SEVERITY = {"OOM_CRASH": "P1", "ERROR_BURST": "P1", "LATENCY_SPIKE": "P2", "UNKNOWN": "P3"}
DIAGNOSIS = {
    "OOM_CRASH": "Root Cause: Batch size allocation exceeded GPU memory limits.",
    "LATENCY_SPIKE": "Root Cause: Database connection pool saturation.",
    "ERROR_BURST": "Root Cause: Recent deployment regression raising 5xx errors.",
    "UNKNOWN": "Root Cause: Undetermined. Needs manual investigation.",
}
RUNBOOKS = {
    "LATENCY_SPIKE": "runbooks/mitigate_db_pool_exhaustion.md",
    "OOM_CRASH": "runbooks/remediate_memory_leak.md",
    "ERROR_BURST": "runbooks/rollback_canary_deployment.md",
}


def fault_rank(text: Column) -> Column:
    """Position of the first rule that matches; one past the last when none does."""
    rank = None
    for i, pattern in enumerate(FAULT_RULES.values()):
        hit = text.rlike(f"(?iU){pattern}")
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return rank.otherwise(len(FAULT_RULES))


def fault_name(rank: Column) -> Column:
    names = [*FAULT_RULES, UNKNOWN]
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank + 1)


def classify_fault(text: Column) -> Column:
    return fault_name(fault_rank(F.coalesce(text, F.lit(""))))


def by_fault(fault: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The entry of ``table`` for a fault column."""
    chosen = None
    for name, value in table.items():
        hit = fault == name
        chosen = F.when(hit, F.lit(value)) if chosen is None else chosen.when(hit, F.lit(value))
    return chosen if default is None else chosen.otherwise(default)
