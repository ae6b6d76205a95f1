"""The daily job: aggregate, export, model, gate, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from opsloom.operators.gates import publish_status, sla_gate
from opsloom.operators.incidents import service_reliability, stage_incidents, upsert_incidents
from opsloom.operators.sla import service_sla
from opsloom.sources.sinks import publish_table, publish_view, write_parquet


@dataclass
class DailyRun:
    metrics: DataFrame
    marts: DataFrame
    gate: DataFrame
    publication: DataFrame


def run_daily(
    telemetry: DataFrame,
    incidents: DataFrame,
    out_dir: str,
    as_of: Column,
    min_availability: float = 99.0,
    max_mttr_minutes: float = 60.0,
) -> DailyRun:
    """One shuffle for the SLA table, two for the mart; later stages read what was written."""
    metrics = write_parquet(service_sla(telemetry), f"{out_dir}/daily_service_metrics")
    staged = publish_view(stage_incidents(upsert_incidents(incidents)), "stg_incidents")
    marts = publish_table(
        service_reliability(staged), f"{out_dir}/fct_service_reliability", "fct_service_reliability"
    )
    gate = sla_gate(metrics, marts, min_availability, max_mttr_minutes)
    return DailyRun(metrics, marts, gate, publish_status(gate, as_of))
