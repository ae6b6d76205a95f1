"""Request metrics and alert rules over an access-log table.

Rates count events in ``(t - range, t]``. Rows are first summed per step, so a sliding
window multiplies a few sums per step and key instead of every log row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.plans.joins import match
from opsloom.plans.ranking import arrival_rank
from opsloom.plans.sizing import small_side

# The served routes, histogram bounds, probe endpoints and the request limit.
ROUTES = (
    "/",
    "/health",
    "/metrics",
    "/v1/services/status",
    "/v1/telemetry/ingest",
    "/v1/incidents/diagnose",
    "/v1/rag/search",
    "/v1/rag/topology",
    "/v1/security/inspect",
    "/v1/eval/chaos",
    "/v1/eval/agents",
    "/v1/eval/ragas",
    "/v1/airflow/run-etl",
    "/v1/spark/aggregate",
    "/v1/agent/incidents",
    "/v1/agent/incidents/{thread_id}",
    "/v1/agent/incidents/{thread_id}/decision",
)
UNMATCHED = "unmatched"
BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
PROBE_ENDPOINTS = ("/health", "/metrics")
NOT_INTERACTIVE = "^/v1/(eval|airflow)/"
REQUESTS_PER_MINUTE = 10
# Fixed values of the alert rules: limits, and the minutes that a condition must hold.
ERROR_PCT, ERROR_HOLD = 1.0, 5
LATENCY_P95_S, LATENCY_HOLD = 0.5, 10
LIMITED_PER_SECOND, LIMITED_HOLD = 1.0, 10

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


def route_template(path: Column) -> Column:
    """The route a path belongs to; paths with ids share one label, unknown ones another."""
    label = F.when(path.isin(*[r for r in ROUTES if "{" not in r]), path)
    for route in ROUTES:
        if "{" in route:
            pattern = "^" + route.replace("{thread_id}", "[^/]+") + "$"
            label = label.when(path.rlike(pattern), F.lit(route))
    return label.otherwise(UNMATCHED)


def with_endpoint(log: DataFrame) -> DataFrame:
    return log.withColumn("endpoint", route_template(F.col("path")))


def requests_total(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "endpoint", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def _bucket_counts() -> list[Column]:
    return [F.count_if(F.col("duration_s") <= b).alias(f"le_{i}") for i, b in enumerate(BUCKETS)]


def duration_histogram(log: DataFrame) -> DataFrame:
    """Cumulative buckets in long form with sum and count, one shuffle of fixed-size rows."""
    wide = log.groupBy("endpoint").agg(
        *_bucket_counts(),
        F.count(F.lit(1)).alias("duration_count"),
        F.sum("duration_s").alias("duration_sum"),
    )
    rows = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("bucket_count"))
        for i, b in enumerate(BUCKETS)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("duration_count").alias("bucket_count")))
    return wide.select("endpoint", F.inline(F.array(*rows)), "duration_count", "duration_sum")


def sliding(
    log: DataFrame, keys: Sequence[str], sums: dict[str, Column], range_us: int, step_us: int
) -> DataFrame:
    """Sums over ``(t - range, t]`` at every step ``t`` (microseconds) that has data."""
    if range_us % step_us:
        raise ValueError("the range must be a multiple of the step")
    own_step = F.ceil(F.unix_micros("ts") / F.lit(step_us)) * step_us
    per_step = log.groupBy(*keys, own_step.alias("_step")).agg(
        *[value.alias(name) for name, value in sums.items()]
    )
    last = F.col("_step") + (range_us - step_us)
    ends = F.sequence(F.col("_step"), last, F.lit(step_us).cast("bigint"))
    return (
        per_step.withColumn("t", F.explode(ends))
        .groupBy(*keys, "t")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def request_rate(log: DataFrame, range_us: int = 5 * MINUTE, step_us: int = MINUTE) -> DataFrame:
    """Requests per second and endpoint."""
    counts = sliding(log, ["endpoint"], {"requests": F.count(F.lit(1))}, range_us, step_us)
    return counts.withColumn("per_second", F.col("requests") / (range_us / SECOND))


def error_ratio(log: DataFrame, range_us: int = 5 * MINUTE, step_us: int = MINUTE) -> DataFrame:
    """Percentage of 5xx answers over all endpoints."""
    sums = {
        "errors": F.count_if(F.col("status_code").between(500, 599)),
        "requests": F.count(F.lit(1)),
    }
    counts = sliding(log, [], sums, range_us, step_us)
    total = F.greatest(F.col("requests").cast("double"), F.lit(1e-9))
    return counts.withColumn("error_pct", F.col("errors") * 100.0 / total)


def limited_rate(log: DataFrame, range_us: int = 5 * MINUTE, step_us: int = MINUTE) -> DataFrame:
    """429 answers per second."""
    sums = {"limited": F.count_if(F.col("status_code") == 429)}
    counts = sliding(log, [], sums, range_us, step_us)
    return counts.withColumn("per_second", F.col("limited") / (range_us / SECOND))


def bucket_quantile(q: float, counts: Sequence[Column], total: Column) -> Column:
    """Quantile by linear interpolation inside the first bucket that reaches the rank."""
    rank = total * q
    chosen = None
    for i, bound in enumerate(BUCKETS):
        below = counts[i - 1] if i else F.lit(0)
        start = BUCKETS[i - 1] if i else 0.0
        inside = F.lit(start) + (bound - start) * (rank - below) / (counts[i] - below)
        chosen = F.when(counts[i] >= rank, inside) if chosen is None else chosen.when(counts[i] >= rank, inside)
    return chosen.otherwise(F.lit(BUCKETS[-1]))


def latency_quantile(
    log: DataFrame,
    q: float = 0.95,
    keys: Sequence[str] = ("endpoint",),
    range_us: int = 5 * MINUTE,
    step_us: int = MINUTE,
    interactive_only: bool = False,
) -> DataFrame:
    """Quantile of request duration per window, from histogram buckets."""
    rows = log.where(~F.col("endpoint").rlike(NOT_INTERACTIVE)) if interactive_only else log
    sums = {f"le_{i}": F.count_if(F.col("duration_s") <= b) for i, b in enumerate(BUCKETS)}
    sums["requests"] = F.count(F.lit(1))
    counts = sliding(rows, list(keys), sums, range_us, step_us)
    buckets = [F.col(f"le_{i}") for i in range(len(BUCKETS))]
    return counts.select(
        *keys, "t", "requests", bucket_quantile(q, buckets, F.col("requests")).alias("quantile_s")
    )


def critical_anomalies(
    scored: DataFrame, range_us: int = 10 * MINUTE, step_us: int = MINUTE, above: int = 5
) -> DataFrame:
    """CRITICAL verdicts per window and whether there are too many."""
    sums = {"criticals": F.count_if(F.col("severity") == "CRITICAL")}
    return sliding(scored, [], sums, range_us, step_us).withColumn(
        "alert", F.col("criticals") > above
    )


def alert_streaks(
    series: DataFrame, condition: Column, step_us: int, for_us: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Unbroken runs of a condition over evaluation steps: pending, then firing.

    The series has one row per step, so its length is the time range divided by the step
    and does not grow with the log.
    """
    w = W.partitionBy(*keys).orderBy("t") if keys else W.partitionBy(F.lit(0)).orderBy("t")
    island = F.col("t") - F.row_number().over(w).cast("bigint") * F.lit(step_us)
    runs = (
        series.where(condition)
        .withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count(F.lit(1)).alias("steps"))
        .drop("_island")
    )
    held = F.col("ended") - F.col("started")
    return runs.withColumn("state", F.when(held >= for_us, "firing").otherwise("pending")).withColumn(
        "firing_from", F.when(held >= for_us, F.col("started") + for_us)
    )


def error_rate_rule(log: DataFrame) -> DataFrame:
    """More than 1 % of requests fail over 5 minutes, for 5 minutes."""
    return alert_streaks(
        error_ratio(log), F.col("error_pct") > ERROR_PCT, MINUTE, ERROR_HOLD * MINUTE
    )


def latency_rule(log: DataFrame) -> DataFrame:
    """The 95th percentile of interactive endpoints is above 0.5 s over 5 minutes, for 10 minutes."""
    quantiles = latency_quantile(log, keys=(), interactive_only=True)
    return alert_streaks(
        quantiles, F.col("quantile_s") > LATENCY_P95_S, MINUTE, LATENCY_HOLD * MINUTE
    )


def rate_limited_rule(log: DataFrame) -> DataFrame:
    """More than one 429 answer a second over 5 minutes, for 10 minutes."""
    return alert_streaks(
        limited_rate(log), F.col("per_second") > LIMITED_PER_SECOND, MINUTE, LIMITED_HOLD * MINUTE
    )


def target_down(log: DataFrame, step_us: int = 2 * MINUTE, for_us: int = 2 * MINUTE) -> DataFrame:
    """Runs of steps without any request between the first and the last one."""
    present = sliding(log, [], {"requests": F.count(F.lit(1))}, step_us, step_us).select("t")
    span = present.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = span.where("a is not null").select(
        F.explode(F.sequence("a", "b", F.lit(step_us).cast("bigint"))).alias("t")
    )
    missing = spine.join(present, "t", "left_anti")
    return alert_streaks(missing, F.lit(True), step_us, for_us)


def fixed_window_limit(
    log: DataFrame, limit: int = REQUESTS_PER_MINUTE, period: str = "minute", order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """Flags requests beyond the first ``limit`` of a client in each period.

    The cut-off request per client and period is found with a limited rank, which keeps at
    most ``limit`` rows per task before the shuffle; all rows are then compared with it. A
    client that sends a third of all requests is never sorted in one task. A null client or
    time is a client or period of its own, so every request gets an answer.
    """
    windowed = log.withColumn("window_start", F.date_trunc(period, "ts"))
    w = W.partitionBy("client", "window_start").orderBy(*order)
    cut = (
        windowed.select("client", "window_start", *order)
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= limit)
        .groupBy("client", "window_start")
        .agg(F.max(F.struct(*order)).alias("_last"))
    )
    return (
        match(windowed, small_side(cut), ["client", "window_start"])
        .withColumn("limited", F.struct(*order) > F.col("_last"))
        .withColumn("answer", F.when(F.col("limited"), 429).otherwise(200))
        .drop("_last")
    )


def request_trace(log: DataFrame, seq: str = "event_id", split: bool | None = None) -> DataFrame:
    """Log lines with their position inside their request, probes left out."""
    lines = log.where(~F.col("endpoint").isin(*PROBE_ENDPOINTS))
    return arrival_rank(lines, ["request_id"], seq, "line_no", split=split)
