"""Ticket, decision and root-cause queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.faults import DIAGNOSIS, FAULT_RULES, RUNBOOKS, SEVERITY, classify_fault
from opsloom.operators import rca, remediation, retrieval, topology, triage
from opsloom.plans.sizing import small_side
from opsloom.registry import Views, query
from opsloom.registry.retrieval import RRF_SQL, index_sql
from opsloom.registry.safety import redact_sql, scan_sql
from opsloom.registry.topology import SERVICE_CLOSURE


def fault_sql(text: str) -> str:
    arms = " ".join(f"when regexp_matches({text}, '{p}', 'i') then '{f}'" for f, p in FAULT_RULES.items())
    return f"case {arms} else 'UNKNOWN' end"


def map_sql(column: str, table: dict[str, str], default: str = "null") -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {default} end"


GATED_SQL = f"""{redact_sql("{tickets}", "ticket_id", "description")},
gated as (select ticket_id, service_name, expected_route, reason <> 'Clean input' as security_flagged,
    case when reason <> 'Clean input' then raw_text else clean_text end as description,
    case when reason <> 'Clean input' then 'escalated' else 'pending' end as review_status,
    case when reason <> 'Clean input' then 'QUARANTINED: ' || reason end as resolution_notes
  from (select ticket_id, service_name, expected_route, raw_text, clean_text, {scan_sql("raw_text")} as reason
    from tickets join redacted on redacted.key = tickets.ticket_id)),
faulted as (select *, case when not security_flagged then {fault_sql("description")} end as fault_type from gated),
triaged as (select *, severity in ('P1', 'P2') as requires_human_approval, lower(fault_type) as category,
    case when not security_flagged then 'Triaged as ' || severity || ' incident (fault type: ' || fault_type || ').' end as summary
  from (select *, case when security_flagged then null when lower(description) like '%critical%' then 'P1'
    else {map_sql("fault_type", SEVERITY)} end as severity from faulted)),
planned as (select *, case when severity in ('P1', 'P2') then 'execute_deployment_rollback' end as action_type,
    case when severity in ('P1', 'P2') then 'prev_stable' end as target_commit,
    case when severity in ('P1', 'P2') then 'pending' end as action_status from triaged),
first_dec as (select * from {{decisions}} qualify row_number() over (partition by ticket_id order by seq) = 1),
decided as (select p.* exclude (action_status), coalesce(p.action_status = 'pending', false) as paused_for_human,
    case when p.action_status = 'pending' and d.seq is not null then
      case when d.approved then 'approved' else 'rejected' end else p.action_status end as action_status,
    case when p.action_status = 'pending' and d.approved then 'Approved by ' || coalesce(d.reviewer, 'SRE_Lead')
      when p.action_status = 'pending' and not d.approved then 'Denied by reviewer.' end as action_result
  from planned p left join first_dec d using (ticket_id)),
executed as (select * replace (
    case when action_status = 'approved' then 'executed' else action_status end as action_status,
    case when action_status = 'approved' then '[SIMULATED] SUCCESS: Rolled back ' || service_name || ' to commit prev_stable.'
      else action_result end as action_result,
    case when security_flagged or action_status = 'pending' then review_status
      when action_status = 'approved' then 'resolved' else 'escalated' end as review_status,
    case when security_flagged or action_status = 'pending' then resolution_notes
      when action_status is null then 'No automated remediation for this severity; routed to on-call.'
      when action_status = 'approved' then 'Mitigation applied successfully.' else 'Action was rejected.' end as resolution_notes)
  from decided)"""


def gated(v: Views):
    return triage.security_gate(v.tickets)


def planned(v: Views):
    return triage.plan_actions(triage.triage(gated(v)))


def executed(v: Views):
    return remediation.execute(remediation.apply_decisions(planned(v), v.decisions))


@query(
    "classify_fault",
    f"""select seq as text_id, {fault_sql("coalesce(message, '')")} as fault_type from {{service_logs}}
    union all select -1 - doc_id as text_id, {fault_sql("coalesce(text, '')")} as fault_type from documents""",
)
def classify(v: Views):
    lines = v.service_logs.select(F.col("seq").alias("text_id"), F.col("message").alias("text"))
    docs = v.documents.select((-1 - F.col("doc_id")).alias("text_id"), "text")
    return lines.unionByName(docs).select("text_id", classify_fault(F.col("text")).alias("fault_type"))


GATE_COLUMNS = "ticket_id service_name security_flagged description review_status resolution_notes".split()


@query("security_gate", f"with {GATED_SQL} select {', '.join(GATE_COLUMNS)} from gated")
def security_gate(v: Views):
    return gated(v).select(*GATE_COLUMNS)


TRIAGE_COLUMNS = "ticket_id fault_type severity category requires_human_approval summary".split()


@query("triage", f"with {GATED_SQL} select {', '.join(TRIAGE_COLUMNS)} from triaged")
def triage_tickets(v: Views):
    return triage.triage(gated(v)).select(*TRIAGE_COLUMNS)


ASKED = "select distinct sha256(description) as query_id, description as query from gated where not security_flagged"


@query(
    "ticket_diagnosis",
    SERVICE_CLOSURE + f""", {GATED_SQL}, {index_sql(ASKED)}, {RRF_SQL},
    answers as (select q.query as description, coalesce(answer, 'No matching runbook found.') as answer from q left join (
      select query_id, string_agg('[' || doc_id || '] ' || text, chr(10) || '---' || chr(10) order by rank) as answer
      from hits join documents using (doc_id) where rank <= 2 group by query_id) using (query_id)),
    need as (select src, '[' || string_agg('''' || dst || '''', ', ' order by dst) || ']' as t from pairs group by src),
    hit as (select dst, '[' || string_agg('''' || src || '''', ', ' order by src) || ']' as t from pairs group by dst)
    select ticket_id, {map_sql("fault_type", DIAGNOSIS)} as rca_diagnosis, length(research) as research_chars,
      md5(research) as research_md5
    from (select ticket_id, fault_type, answer || chr(10) || 'Topology: Service: ' || service_name || ' | Dependencies: '
        || coalesce(need.t, '[]') || ' | Impacted If Failed: ' || coalesce(hit.t, '[]') as research
      from triaged left join answers using (description)
        left join need on need.src = service_name left join hit on hit.dst = service_name)""",
)
def ticket_diagnosis(v: Views):
    triaged = triage.triage(gated(v))
    asked = triage.distinct_descriptions(gated(v))
    index = retrieval.build_index(v.documents)
    answers = retrieval.kb_answers(asked, v.documents, index)
    services = v.tickets.select(F.col("service_name").alias("service")).distinct()
    lines = topology.topology_text(
        services, topology.dependencies(v.service_edges), topology.blast_radius(v.service_edges)
    )
    rows = triage.diagnose(triaged, answers, lines)
    return rows.select(
        "ticket_id",
        "rca_diagnosis",
        F.char_length("kb_research").alias("research_chars"),
        F.md5("kb_research").alias("research_md5"),
    )


PLAN_COLUMNS = "ticket_id action_type target_commit action_status".split()


@query("plan_actions", f"with {GATED_SQL} select {', '.join(PLAN_COLUMNS)} from planned")
def plan_actions(v: Views):
    return planned(v).select(*PLAN_COLUMNS)


DECIDED_COLUMNS = "ticket_id paused_for_human action_status action_result".split()


@query("apply_decisions", f"with {GATED_SQL} select {', '.join(DECIDED_COLUMNS)} from decided")
def apply_decisions(v: Views):
    return remediation.apply_decisions(planned(v), v.decisions).select(*DECIDED_COLUMNS)


@query(
    "decision_answers",
    f"""with {GATED_SQL}, ranked as (select *, row_number() over (partition by ticket_id order by seq) as n from decisions)
    select d.ticket_id, d.seq, case when p.ticket_id is null then 404
      when p.action_status is null or d.n > 1 then 409 else 200 end as answer
    from ranked d left join planned p using (ticket_id)""",
)
def decision_answers(v: Views):
    rows = remediation.decision_answers(planned(v), v.decisions)
    return rows.select("ticket_id", "seq", "answer")


OUTCOME_COLUMNS = "ticket_id action_status action_result review_status resolution_notes".split()


@query("execute_outcome", f"with {GATED_SQL} select {', '.join(OUTCOME_COLUMNS)} from executed")
def execute_outcome(v: Views):
    return executed(v).select(*OUTCOME_COLUMNS)


@query(
    "action_history",
    """select ticket_id, action_type, target, status, first_seq,
      row_number() over (partition by ticket_id order by first_seq) as position
    from (select ticket_id, action_type, target, min(seq) as first_seq, max_by(status, seq) as status
      from {action_events} group by all)""",
)
def action_history(v: Views):
    return remediation.action_history(v.action_events)


VIEW_SQL = GATED_SQL + """,
viewed as (select ticket_id, service_name, severity, security_flagged, description, category, review_status, resolution_notes,
    case when coalesce(action_status = 'pending', false) then 'AWAITING_APPROVAL' else 'COMPLETED' end as status,
    case when action_status = 'pending' then 'Authorize remediation rollback for ' || service_name || '?' end as pending_approval,
    case when coalesce(action_status, '') <> 'pending' then action_type end as action_type,
    case when coalesce(action_status, '') <> 'pending' then action_status end as action_status,
    case when coalesce(action_status, '') <> 'pending' then action_result end as action_result
  from executed)"""
VIEW_COLUMNS = (
    "ticket_id service_name severity security_flagged description category review_status "
    "resolution_notes status pending_approval action_type action_status action_result"
).split()


@query("incident_view", f"with {VIEW_SQL} select * from viewed")
def incident_view(v: Views):
    return remediation.incident_view(executed(v)).select(*VIEW_COLUMNS)


@query(
    "active_incidents",
    f"""with {VIEW_SQL} select service_name, severity, count(*) as active from viewed
    where status <> 'COMPLETED' group by all""",
)
def active_incidents(v: Views):
    return remediation.active_incidents(remediation.incident_view(executed(v)))


LINES_SQL = """lines as (select service as service_name, seq, '[' || lvl || '] ' || message as line, row_number() over (partition by service order by seq) as n
  from (select *, case when has_level then level else 'ERROR' end as lvl from {service_logs}) where lvl in ('ERROR', 'CRITICAL')),
FAULTS""".replace(
    "FAULTS",
    f"""by_log as (select service_name, string_agg(line, '|' order by seq) filter (where n <= 5) as correlated_logs,
  count(*) as error_log_count, {fault_sql("string_agg(line, ' ' order by seq)")} as fault_type from lines group by service_name)""",
)


@query("correlate_logs", f"with {LINES_SQL} select * from by_log")
def correlate_logs(v: Views):
    rows = rca.correlate_logs(v.service_logs)
    return rows.withColumn("correlated_logs", F.array_join("correlated_logs", "|"))


@query(
    "correlate_commits",
    """select service as service_name, commit_hash, author, message, seq,
      cast(row_number() over (partition by service order by seq) as int) as commit_no
    from {service_commits} qualify commit_no <= 2""",
)
def correlate_commits(v: Views):
    return rca.correlate_commits(v.service_commits)


@query(
    "incident_severity",
    f"""with {LINES_SQL} select seq, service_name,
      case when latency_ms > 1000 or coalesce(error_log_count, 0) >= 3 then 'P1' else 'P2' end as severity,
      case when latency_ms > 1000 then 'CRITICAL' else 'WARNING' end as anomaly_severity
    from {{telemetry}} left join by_log using (service_name)""",
)
def incident_severity(v: Views):
    counts = small_side(rca.correlate_logs(v.service_logs).select("service_name", "error_log_count"))
    rows = v.telemetry.select("seq", "service_name", "latency_ms").join(counts, "service_name", "left")
    anomaly = rca.anomaly_severity(F.col("latency_ms"))
    return rows.select(
        "seq",
        "service_name",
        rca.incident_severity(F.col("latency_ms"), anomaly, F.col("error_log_count")).alias("severity"),
        anomaly.alias("anomaly_severity"),
    )


@query(
    "rca_report",
    SERVICE_CLOSURE + f""", {LINES_SQL},
    commit as (select service as service_name, commit_hash, author, message, seq from {{service_commits}}
      qualify row_number() over (partition by service order by seq) <= 2),
    by_commit as (select service_name, first(commit_hash order by seq) as h, first(author order by seq) as a,
      first(message order by seq) as m, string_agg(commit_hash, '|' order by seq) as commits from commit group by service_name),
    req as (select service_name, max(latency_ms) as observed_value from {{telemetry}} group by service_name),
    hit as (select dst as service_name, string_agg(src, '|' order by src) as impacted from pairs group by dst)
    select 'req-' || service_name as request_id,
      sha256(service_name || '|' || cast(observed_value as varchar) || '|req-' || service_name) as report_key,
      'INC-' || upper(substr(sha256(service_name || '|' || cast(observed_value as varchar) || '|req-' || service_name), 1, 8)) as incident_id,
      service_name, case when observed_value > 1000 or coalesce(error_log_count, 0) >= 3 then 'P1' else 'P2' end as severity,
      coalesce(fault_type, 'UNKNOWN') as fault_type,
      case when h is not null then 'Deployment regression in commit ''' || h || ''' by ' || a || ': ''' || m
          || '''. Triggered resource exhaustion in ' || service_name || '.'
        else 'Downstream service dependency bottleneck or query contention in ' || service_name || '. Observed value: '
          || cast(observed_value as varchar) || 'ms.' end as root_cause_summary,
      coalesce(correlated_logs, '') as correlated_logs, coalesce(commits, '') as commits,
      concat_ws('|', service_name, impacted) as blast_radius,
      {map_sql("fault_type", RUNBOOKS, "case when h is not null then 'runbooks/rollback_canary_deployment.md' else 'runbooks/mitigate_db_pool_exhaustion.md' end")} as recommended_runbook,
      case when h is not null then 'Initiate canary rollback for commit ' || h || '.|Scale up ' || service_name
          || ' replicas by 50% to absorb pending request buffer.|Drain connection pool and verify P95 latency returns under 60ms.'
        else 'Inspect active connections on ' || service_name || ' backing store.|Flush stale session caches in Redis cluster.|Verify database lock contention on customer-facing tables.' end as action_plan
    from req left join by_log using (service_name) left join by_commit using (service_name) left join hit using (service_name)""",
)
def rca_report(v: Views):
    requests = v.telemetry.groupBy("service_name").agg(F.max("latency_ms").alias("observed_value"))
    requests = requests.withColumn("request_id", F.concat(F.lit("req-"), "service_name"))
    impacted = topology.blast_radius(v.service_edges)
    rows = rca.reports(requests, v.service_logs, v.service_commits, impacted, request_key="request_id")
    none = F.array().cast("array<string>")
    commits = F.coalesce(F.transform("correlated_commits", lambda c: c["commit_hash"]), none)
    return rows.withColumn("commits", F.array_join(commits, "|")).withColumns(
        {c: F.array_join(c, "|") for c in ("correlated_logs", "blast_radius", "action_plan")}
    ).drop("correlated_commits")
