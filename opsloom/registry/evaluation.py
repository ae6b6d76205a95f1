"""Evaluation metric queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions.faults import RUNBOOKS, by_fault, classify_fault
from opsloom.operators import anomaly, evaluation
from opsloom.registry import Views, exactly_rounded, query, rounded
from opsloom.registry.anomaly import FOREST_SQL, SCORED_SQL, forest_flagged
from opsloom.registry.response import GATED_SQL, executed, fault_sql, map_sql
from opsloom.sources.tables import TICKET_TEMPLATES

STOP = ", ".join(f"'{w}'" for w in evaluation.STOPWORDS)


def words_sql(text: str) -> str:
    return f"""list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+(?:\\.[0-9]+)?'),
      lambda w: w not in ({STOP})),
      lambda w: case when length(w) > 4 and w like '%ing' then w[:-4] when length(w) > 4 and w like '%ed' then w[:-3]
        when length(w) > 4 and w like '%es' then w[:-3] when length(w) > 4 and w like '%s' then w[:-2] else w end))"""


@query("content_words", f"select doc_id, array_to_string(list_sort({words_sql('text')}), ' ') as words from documents")
def content_words(v: Views):
    words = F.array_sort(evaluation.content_words(F.col("text")))
    return v.documents.select("doc_id", F.array_join(words, " ").alias("words"))


SCORES_SQL = f"""words as (select sample_id, {words_sql("context_a || ' ' || context_b")} as c, {words_sql("answer")} as a,
    {words_sql("ground_truth")} as t, {words_sql("context_a")} as c1, {words_sql("context_b")} as c2 from {{rag_samples}}),
shares as (select sample_id, len(list_intersect(a, c)) / greatest(1, len(a)) as f, len(list_intersect(t, c)) / greatest(1, len(t)) as r,
    len(list_intersect(t, a)) / greatest(1, len(t)) as v, (list_has_any(c1, t)::int + list_has_any(c2, t)::int) / 2 as p from words),
scores as (select sample_id, {exactly_rounded("f")} as faithfulness, {exactly_rounded("r")} as context_recall,
    {exactly_rounded("v")} as answer_relevance, {exactly_rounded("p")} as context_precision from shares)"""
SCORE_COLUMNS = "faithfulness context_recall answer_relevance context_precision".split()


def _scores(v: Views):
    samples = v.rag_samples.withColumn("contexts", F.array("context_a", "context_b"))
    return evaluation.overlap_scores(samples)


@query("rag_overlap_scores", f"with {SCORES_SQL} select * from scores")
def rag_overlap_scores(v: Views):
    return _scores(v).select("sample_id", *SCORE_COLUMNS)


@query(
    "rag_gate",
    f"""with {SCORES_SQL}, means as (select {", ".join(f"{exactly_rounded(f'sum(cast(round({c} * 1000) as bigint))::double / 1000.0::double / count(*)')} as {c}" for c in SCORE_COLUMNS)} from scores)
    select *, faithfulness >= 0.85 and context_recall >= 0.80 as passed_gate from means""",
)
def rag_gate(v: Views):
    return evaluation.grounding_gate(_scores(v))


def detection_sql(flagged: str) -> str:
    """Check SQL of the detection rates, from CTEs ending in ``scored`` and the CTE ``flagged``."""
    return f""", flagged as ({flagged}),
    cases as (select detected, case when latency_ms > 1500 then 'LATENCY_SPIKE' else 'HEALTHY' end as kind,
        {map_sql(fault_sql("message"), RUNBOOKS)} = '{RUNBOOKS["LATENCY_SPIKE"]}' as triage_correct
      from telemetry join flagged using (seq) join {{service_logs}} l using (seq)),
    rates as (select count(*) filter (where kind <> 'HEALTHY') as total_faults, count(*) filter (where kind = 'HEALTHY') as total_controls,
        avg(detected::int) filter (where kind <> 'HEALTHY') * 100 as d,
        avg(coalesce(triage_correct, false)::int) filter (where kind <> 'HEALTHY') * 100 as t,
        avg(detected::int) filter (where kind = 'HEALTHY') * 100 as f from cases)
    select total_faults, total_controls, {rounded("d", 1)} as detection_rate, {rounded("t", 1)} as triage_accuracy,
      {rounded("f", 1)} as false_positive_rate, d >= 95 and t >= 95 and f <= 10 as passed from rates"""


def detection_rates(v: Views, scored, fired):
    fault = classify_fault(F.col("message"))
    right = by_fault(fault, RUNBOOKS) == RUNBOOKS["LATENCY_SPIKE"]
    cases = scored.join(v.service_logs.select("seq", "message"), "seq").select(
        F.when(F.col("latency_ms") > 1500, "LATENCY_SPIKE").otherwise("HEALTHY").alias("kind"),
        (F.size(fired) > 0).alias("detected"),
        right.alias("triage_correct"),
    )
    return evaluation.detection_summary(cases)


@query("detection_eval", SCORED_SQL + detection_sql("select seq, bool_or(is_anomaly) as detected from scored group by seq"))
def detection_eval(v: Views):
    scored = anomaly.zscore_score(v.telemetry, anomaly.baseline_stats(v.telemetry))
    return detection_rates(v, scored, anomaly.detectors_fired(F.col("scores")))


@query(
    "detection_eval_forest",
    FOREST_SQL + ", " + SCORED_SQL.removeprefix("with ") + detection_sql(
        "select seq, bool_or(is_anomaly) as detected from (select seq, is_anomaly from scored union all select seq, is_anomaly from forest) group by seq"
    ),
)
def detection_eval_forest(v: Views):
    """The same rates with the forest among the detectors."""
    forest = forest_flagged(v)
    scored = anomaly.zscore_score(forest, anomaly.baseline_stats(forest))
    return detection_rates(v, scored, anomaly.detectors_fired(F.col("scores"), F.col("forest_flag")))


PATH = ", ".join(f"'{s}'" for s in evaluation.FULL_PATH)
OUTCOMES_SQL = GATED_SQL + f""",
pathed as (select *, case when security_flagged then ['security_node'] when action_status = 'pending' then [{PATH}][:4]
    else [{PATH}] end as nodes from executed),
outcomes as (select ticket_id, expected_route, paused_for_human, array_to_string(nodes, '>') as nodes_visited,
    case when security_flagged then 'QUARANTINE' else severity end as actual_route,
    coalesce(action_status = 'executed', false) as rollback_executed,
    nodes = case when expected_route = 'QUARANTINE' then ['security_node'] else [{PATH}] end as path_correct
  from pathed),
judged as (select *, actual_route = expected_route as correct,
    path_correct and case when expected_route in ('P1', 'P2') then paused_for_human else not rollback_executed end as hitl_compliant
  from outcomes)"""


@query(
    "routing_eval",
    f"""with {OUTCOMES_SQL}, rates as (select count(*) as total_scenarios,
      {rounded("avg(correct::int)", 3)} as routing_accuracy, {rounded("avg(path_correct::int) * 100", 1)} as trajectory_efficiency_pct,
      {rounded("avg(hitl_compliant::int) * 100", 1)} as hitl_compliance_pct from judged)
    select *, routing_accuracy >= 0.9 and hitl_compliance_pct = 100.0 as passed_gate from rates""",
)
def routing_eval(v: Views):
    return evaluation.routing_summary(evaluation.scenario_outcomes(executed(v)))


@query(
    "scenario_outcomes",
    f"""with {OUTCOMES_SQL} select ticket_id, actual_route, expected_route, paused_for_human, rollback_executed,
      correct, hitl_compliant from judged""",
)
def scenario_outcomes(v: Views):
    return evaluation.scenario_outcomes(executed(v)).select(
        "ticket_id", "actual_route", "expected_route", "paused_for_human", "rollback_executed",
        "correct", "hitl_compliant",
    )


@query(
    "scenario_grid",
    "with t(pos, description, expected_route) as (values "
    + ", ".join(f"({i}, '{d}', '{r}')" for i, (d, r) in enumerate(TICKET_TEMPLATES))
    + """), s as (select service_name as service, row_number() over (order by service_name) - 1 as no
      from (select distinct service_name from {telemetry}))
    select printf('EVAL-%03d', no * 10 + pos + 1) as scenario_id, service, description, expected_route from s, t""",
)
def scenario_grid(v: Views):
    services = v.telemetry.select(F.col("service_name").alias("service")).distinct()
    # A handful of service names, already distinct: one small sort.
    numbered = services.withColumn(
        "service_no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("service")) - 1
    )
    return evaluation.scenario_grid(numbered, TICKET_TEMPLATES)


@query("trajectory", f"with {OUTCOMES_SQL} select ticket_id, nodes_visited, path_correct from judged")
def trajectory(v: Views):
    rows = evaluation.with_trajectory(executed(v))
    return rows.select("ticket_id", F.array_join("nodes_visited", ">").alias("nodes_visited"), "path_correct")
