"""Text safety queries over the whole texts of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.text import INJECTION_SIGNATURES, PII_PATTERNS
from opsloom.operators import textsafety
from opsloom.registry import Views, query

# The check names every pattern again, on the engine's own regular expressions.
REDACT_SQL = "t0 as (select TEXTKEY as key, TEXTCOL as x0 from TEXTTABLE)"
for _i, (_kind, _pattern) in enumerate(PII_PATTERNS.items()):
    REDACT_SQL += f""", t{_i + 1} as (select *, len(regexp_extract_all(x{_i}, '{_pattern}', 0, 'i')) as n{_i},
      regexp_replace(x{_i}, '{_pattern}', '<REDACTED_{_kind}>', 'gi') as x{_i + 1} from t{_i})"""
_kinds = ", ".join(f"case when n{i} > 0 then '{k}' end" for i, k in enumerate(PII_PATTERNS))
REDACT_SQL += f""", redacted as (select key, x0 as raw_text, x{len(PII_PATTERNS)} as clean_text,
  {" + ".join(f"n{i}" for i in range(len(PII_PATTERNS)))} as redacted_count,
  concat_ws(',', {_kinds}) as detected_entities from t{len(PII_PATTERNS)})"""
SCAN_SQL = (
    "case "
    + " ".join(
        f"when regexp_matches(TEXTCOL, '{s}', 'i') then 'Adversarial signature detected: ''{s}'''"
        for s in INJECTION_SIGNATURES
    )
    + " else 'Clean input' end"
)


def redact_sql(table: str, key: str, text: str) -> str:
    return REDACT_SQL.replace("TEXTKEY", key).replace("TEXTCOL", text).replace("TEXTTABLE", table)


def scan_sql(text: str) -> str:
    return SCAN_SQL.replace("TEXTCOL", text)


@query(
    "pii_redact",
    f"""with {redact_sql("documents", "doc_id", "text")}
    select key as doc_id, clean_text, redacted_count, detected_entities from redacted""",
)
def pii_redact(v: Views):
    rows = textsafety.redact(v.documents.select("doc_id", "text"))
    return rows.select(
        "doc_id", "clean_text", "redacted_count", F.array_join("detected_entities", ",").alias("detected_entities")
    )


@query(
    "injection_scan",
    f"""select ticket_id, reason <> 'Clean input' as is_adversarial, reason as attack_reason
    from (select ticket_id, {scan_sql("description")} as reason from {{tickets}})""",
)
def injection_scan(v: Views):
    rows = textsafety.scan_injection(v.tickets, "description")
    return rows.select("ticket_id", "is_adversarial", "attack_reason")


@query(
    "text_inspect",
    f"""with {redact_sql("conversations", "conv_id * 1000 + turn", "text")},
    scanned as (select *, {scan_sql("raw_text")} as reason from redacted)
    select key as text_id, reason <> 'Clean input' as is_adversarial, reason as attack_reason, clean_text,
      redacted_count, detected_entities from scanned""",
)
def text_inspect(v: Views):
    texts = v.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    rows = textsafety.inspect_text(texts)
    return rows.select(
        "text_id",
        "is_adversarial",
        "attack_reason",
        "clean_text",
        "redacted_count",
        F.array_join("detected_entities", ",").alias("detected_entities"),
    )


@query(
    "tool_authorize",
    """select call_id, role, tool, (role, tool) in (
      ('research_agent', 'search_it_knowledge_base'), ('research_agent', 'get_service_topology'),
      ('rca_agent', 'query_prometheus_metrics'), ('rca_agent', 'search_application_logs'),
      ('action_agent', 'execute_container_restart'), ('action_agent', 'execute_deployment_rollback')) as allowed
    from {tool_calls}""",
)
def tool_authorize(v: Views):
    return textsafety.authorize_tools(v.tool_calls).select("call_id", "role", "tool", "allowed")
