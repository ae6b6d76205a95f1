"""Validation of JSON payloads against rule profiles, the dead-letter table and its replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.barrier import evaluated_once
from opsloom.functions.hashing import md5_modulo
from opsloom.functions.rules import FieldRule, event_time, reason_text, typed, violations

# Bounds of the request and event schemas.
TOPIC_PROFILE = (
    FieldRule("event_id", "text"),
    FieldRule("service_name", "text"),
    FieldRule("cpu_percent", "float", 0, 100),
    FieldRule("memory_percent", "float", 0, 100),
    FieldRule("latency_ms", "float", 0),
    FieldRule("status_code", "int", 100, 599),
    FieldRule("timestamp", "time", required=False),
    FieldRule("metadata", "map", required=False),
)
API_PROFILE = (
    FieldRule("service_name", "text", 1, 100),
    FieldRule("cpu_percent", "float", 0, 100, finite=True),
    FieldRule("memory_percent", "float", 0, 100, finite=True),
    FieldRule("latency_ms", "float", 0, 600_000, finite=True),
    FieldRule("status_code", "int", 100, 599),
)
DIAGNOSE_PROFILE = (
    FieldRule("service_name", "text", 1, 100),
    FieldRule("observed_latency_ms", "float", 0, 600_000, finite=True),
    FieldRule("error_logs", "list", high=100, required=False),
    FieldRule("recent_commits", "list", high=100, required=False),
)
INCIDENT_PROFILE = (
    FieldRule("service_name", "text", 1, 100),
    FieldRule("description", "text", 1, 4000),
)
DECISION_PROFILE = (
    FieldRule("approved", "bool"),
    FieldRule("reviewer", "text", 1, 100),
)
SEARCH_PROFILE = (
    FieldRule("query", "text", 1, 1000),
    FieldRule("top_k", "int", 1, 10, required=False),
)
INSPECT_PROFILE = (FieldRule("text", "text", 1, 10_000),)
TRIAGE_OUTPUT_PROFILE = (
    FieldRule(
        "category",
        "enum",
        values=("hardware", "software", "access_control", "billing", "security"),
    ),
    FieldRule("urgency", "enum", values=("low", "medium", "high", "critical")),
    FieldRule("recommended_tool", "text"),
    FieldRule("requires_human_approval", "bool"),
    FieldRule("reasoning", "text"),
)
NOT_AN_OBJECT = "payload is not an object"
NOT_REPLAYABLE = "Non-dict payload cannot be auto-replayed"


def checked(df: DataFrame, profile: tuple[FieldRule, ...], payload: str = "payload") -> DataFrame:
    """Adds ``fields`` (the parsed object), ``is_object`` and ``errors``."""
    parsed = evaluated_once(df, "fields", F.from_json(payload, "map<string,string>"))
    looks_like_object = F.col("fields").isNotNull() & F.ltrim(F.col(payload)).startswith("{")
    # A map of texts cannot tell a number from a quoted one; the variant keeps the types.
    parsed = evaluated_once(parsed, "_json", F.try_parse_json(payload))
    errors = violations(profile, lambda name: F.col("fields")[name], json_type)
    judged = F.struct(
        looks_like_object.alias("is_object"), F.when(looks_like_object, errors).alias("errors")
    )
    return evaluated_once(parsed, "_judged", judged).select(
        *df.columns,
        "fields",
        F.col("_judged.is_object").alias("is_object"),
        F.col("_judged.errors").alias("errors"),
    )


def json_type(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_json", f"$.{name}", "variant"))


def is_valid() -> Column:
    return F.col("is_object") & (F.size("errors") == 0)


def valid_rows(df: DataFrame, profile=TOPIC_PROFILE, as_of: Column | None = None) -> DataFrame:
    """Typed rows that break no rule. A missing timestamp becomes ``as_of``."""
    keep = [c for c in df.columns if c not in ("payload", "fields", "is_object", "errors")]
    typed_fields = [
        typed(r, F.col("fields")[r.name]).alias(r.name) for r in profile if r.kind not in ("time", "map")
    ]
    given = event_time(F.col("fields")["timestamp"])
    arrived = F.coalesce(given, as_of) if as_of is not None else given
    metadata = F.coalesce(
        F.from_json(F.col("fields")["metadata"], "map<string,string>"),
        F.create_map().cast("map<string,string>"),
    )
    return (
        checked(df, profile)
        .where(is_valid())
        .select(*keep, *typed_fields, arrived.alias("event_time"), metadata.alias("metadata"))
    )


def reason() -> Column:
    return F.when(F.col("is_object"), reason_text(F.col("errors"))).otherwise(NOT_AN_OBJECT)


def dead_letters(df: DataFrame, profile=TOPIC_PROFILE) -> DataFrame:
    """Rejected rows with the raw payload, all reasons and the error type."""
    keep = [c for c in df.columns if c != "payload"]
    return (
        checked(df, profile)
        .where(~is_valid())
        .select(
            *keep,
            F.col("payload").alias("raw_payload"),
            F.coalesce("errors", F.array().cast("array<struct<field:string,rule:string,value:string>>")).alias("errors"),
            reason().alias("reason"),
            F.when(F.col("is_object"), "ValidationError").otherwise("TypeError").alias("error_type"),
        )
    )


def replay_dead_letters(dlq: DataFrame, profile=TOPIC_PROFILE, partitions: int = 4) -> DataFrame:
    """Tries every dead letter exactly once; ``resolved`` rows go to the topic."""
    kept = [c for c in dlq.columns if c not in ("raw_payload", "errors", "reason", "error_type")]
    tried = checked(dlq.select(*kept, F.col("raw_payload").alias("payload")), profile)
    target = F.when(is_valid(), md5_modulo(F.col("fields")["service_name"], partitions))
    message = (
        F.when(is_valid(), F.concat(F.lit("Event accepted into partition "), target.cast("string")))
        .when(F.col("is_object"), F.concat(F.lit("Event diverted to DLQ: "), reason()))
        .otherwise(NOT_REPLAYABLE)
    )
    return tried.select(
        *kept,
        F.col("payload").alias("raw_payload"),
        is_valid().alias("resolved"),
        message.alias("message"),
        target.alias("partition"),
    )
