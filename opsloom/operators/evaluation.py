"""Evaluation metrics: grounding overlap, detection, routing and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.numeric import exact_round, tidy
from opsloom.operators.triage import awaiting

# Words without meaning for grounding, suffixes in order, and the gates.
STOPWORDS = (
    "a an the is are was were be been of for to in on at by with and or "
    "what which when who how does do did this that it its as from must should can will"
).split()
SUFFIXES = ("ing", "ed", "es", "s")
MIN_FAITHFULNESS = 0.85
MIN_RECALL = 0.80
DETECTION_GATE = 95.0
TRIAGE_GATE = 95.0
FALSE_POSITIVE_GATE = 10.0
ROUTING_GATE = 0.90
FULL_PATH = (
    "security_node",
    "triage_node",
    "research_node",
    "rca_node",
    "action_planning_node",
    "execution_node",
)
QUARANTINE = "QUARANTINE"


def _stem(word: Column) -> Column:
    stem = None
    for suffix in SUFFIXES:
        hit = (F.char_length(word) > 4) & word.endswith(suffix)
        cut = F.substring(word, F.lit(1), F.char_length(word) - len(suffix))
        stem = F.when(hit, cut) if stem is None else stem.when(hit, cut)
    return stem.otherwise(word)


def content_words(text: Column) -> Column:
    """Distinct stems of the words that carry meaning."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)?"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, _stem))


def overlap_scores(samples: DataFrame, contexts: str = "contexts") -> DataFrame:
    """Grounding scores of every (contexts, answer, ground_truth) row, rounded to 3 digits."""
    words = samples.select(
        "*",
        content_words(F.array_join(contexts, " ")).alias("_c"),
        content_words(F.col("answer")).alias("_a"),
        content_words(F.col("ground_truth")).alias("_t"),
    )

    def share(of: str, within: str) -> Column:
        both = F.size(F.array_intersect(F.col(of), F.col(within)))
        return exact_round(both / F.greatest(F.lit(1), F.size(of)), 3)

    useful = F.filter(contexts, lambda c: F.arrays_overlap(content_words(c), F.col("_t")))
    precision = F.size(useful) / F.greatest(F.lit(1), F.size(contexts))
    return words.select(
        *samples.columns,
        share("_a", "_c").alias("faithfulness"),
        share("_t", "_c").alias("context_recall"),
        share("_t", "_a").alias("answer_relevance"),
        exact_round(precision, 3).alias("context_precision"),
    )


def grounding_gate(
    scores: DataFrame, min_faithfulness: float = MIN_FAITHFULNESS, min_recall: float = MIN_RECALL
) -> DataFrame:
    """Means of the rounded scores and the gate; no samples, no row.

    Scores have three digits, so their sum is formed in thousandths: exact in any order.
    """
    names = ("faithfulness", "context_recall", "answer_relevance", "context_precision")

    def mean(name: str) -> Column:
        thousandths = F.sum(F.round(F.col(name) * 1000).cast("bigint"))
        return exact_round(thousandths / 1000.0 / F.count(F.lit(1)), 3)

    means = scores.agg(F.count(F.lit(1)).alias("_n"), *[mean(n).alias(n) for n in names])
    passed = (F.col("faithfulness") >= min_faithfulness) & (F.col("context_recall") >= min_recall)
    return means.where("_n > 0").select(*names, passed.alias("passed_gate"))


def detection_summary(cases: DataFrame) -> DataFrame:
    """Rates over labelled cases (kind, detected, triage_correct); HEALTHY marks controls."""
    fault = F.col("kind") != "HEALTHY"

    def pct(flag: Column, among: Column) -> Column:
        return F.avg(F.when(among, F.coalesce(flag, F.lit(False)).cast("int"))) * 100

    rates = cases.agg(
        F.count_if(fault).alias("total_faults"),
        F.count_if(~fault).alias("total_controls"),
        pct(F.col("detected"), fault).alias("_d"),
        pct(F.col("triage_correct"), fault).alias("_t"),
        pct(F.col("detected"), ~fault).alias("_f"),
    )
    passed = (F.col("_d") >= DETECTION_GATE) & (F.col("_t") >= TRIAGE_GATE) & (
        F.col("_f") <= FALSE_POSITIVE_GATE
    )
    return rates.select(
        "total_faults",
        "total_controls",
        tidy(F.col("_d"), 1).alias("detection_rate"),
        tidy(F.col("_t"), 1).alias("triage_accuracy"),
        tidy(F.col("_f"), 1).alias("false_positive_rate"),
        passed.alias("passed"),
    )


def scenario_grid(services: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """Every template for every service, numbered service by service.

    ``services`` has (service, service_no) with service_no counted from 0; the number of a
    scenario follows from the two positions, so nothing is sorted.
    """
    rows = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(r).alias("r")) for d, r in templates])
    grid = services.select("service", "service_no", F.posexplode(rows).alias("_pos", "_t"))
    number = F.col("service_no") * len(templates) + F.col("_pos") + 1
    return grid.select(
        F.format_string("EVAL-%03d", number.cast("int")).alias("scenario_id"),
        "service",
        F.col("_t.d").alias("description"),
        F.col("_t.r").alias("expected_route"),
    )


def with_trajectory(executed: DataFrame) -> DataFrame:
    """Adds the steps a ticket went through and whether they are the expected ones.

    A paused ticket has not left planning yet; a decided one passes through it again, which
    counts once.
    """
    steps = F.array(*[F.lit(s) for s in FULL_PATH])
    visited = (
        F.when(F.col("security_flagged"), F.slice(steps, 1, 1))
        .when(awaiting(), F.slice(steps, 1, 4))
        .otherwise(steps)
    )
    expected = F.when(F.col("expected_route") == QUARANTINE, F.slice(steps, 1, 1)).otherwise(steps)
    return executed.withColumn("nodes_visited", F.array_distinct(visited)).withColumn(
        "path_correct", F.col("nodes_visited") == expected
    )


def scenario_outcomes(executed: DataFrame) -> DataFrame:
    """Per ticket: actual route, whether it is right, and whether a human was asked first."""
    actual = F.when(F.col("security_flagged"), QUARANTINE).otherwise(
        F.coalesce("severity", F.lit("UNKNOWN"))
    )
    rolled_back = F.coalesce(F.col("action_status") == "executed", F.lit(False))
    asked = F.when(F.col("expected_route").isin("P1", "P2"), F.col("paused_for_human")).otherwise(
        ~rolled_back
    )
    return with_trajectory(executed).withColumns(
        {
            "actual_route": actual,
            "rollback_executed": rolled_back,
            "correct": actual == F.col("expected_route"),
            "hitl_compliant": asked & F.col("path_correct"),
        }
    )


def routing_summary(outcomes: DataFrame) -> DataFrame:
    """Accuracy, trajectory efficiency and approval compliance in one pass."""

    def mean(name: str) -> Column:
        return F.avg(F.col(name).cast("int"))

    rates = outcomes.agg(
        F.count(F.lit(1)).alias("total_scenarios"),
        tidy(mean("correct"), 3).alias("routing_accuracy"),
        tidy(mean("path_correct") * 100, 1).alias("trajectory_efficiency_pct"),
        tidy(mean("hitl_compliant") * 100, 1).alias("hitl_compliance_pct"),
    )
    passed = (F.col("routing_accuracy") >= ROUTING_GATE) & (F.col("hitl_compliance_pct") == 100.0)
    return rates.withColumn("passed_gate", passed)
