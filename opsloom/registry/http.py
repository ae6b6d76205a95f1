"""Request metric and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import anomaly, httpmetrics
from opsloom.operators.httpmetrics import HOUR, MINUTE
from opsloom.registry import Views, query, rounded
from opsloom.registry.anomaly import ROLLING_SQL

LOG_SQL = """log as (
  select *, case when path in ('/health', '/v1/rag/search', '/v1/telemetry/ingest') then path
    when regexp_full_match(path, '/v1/agent/incidents/[^/]+') then '/v1/agent/incidents/{thread_id}'
    when regexp_full_match(path, '/v1/agent/incidents/[^/]+/decision') then '/v1/agent/incidents/{thread_id}/decision'
    else 'unmatched' end as endpoint from ACCESS)""".replace(
    "{thread_id}", "' || chr(123) || 'thread_id' || chr(125) || '"
).replace("ACCESS", "{access_log}")


def ends_sql(range_us: int, step_us: int, source: str) -> str:
    """Every evaluation step a row falls into, found by unnesting the steps it can reach."""
    n = range_us // step_us
    return f"""(select r.*, ((epoch_us(ts) + {step_us} - 1) // {step_us} + k) * {step_us} as t
      from {source} r, range(0, {n}) steps(k))"""


def _log(v: Views):
    return httpmetrics.with_endpoint(v.access_log)


def _time(name: str):
    return F.date_format(F.timestamp_micros(name), "yyyy-MM-dd HH:mm:ss").alias(name)


def time_sql(name: str) -> str:
    return f"strftime(make_timestamp({name}), '%Y-%m-%d %H:%M:%S') as {name}"


@query("route_template", f"with {LOG_SQL} select event_id, endpoint from log")
def route_template(v: Views):
    return _log(v).select("event_id", "endpoint")


@query(
    "http_requests_total",
    f"with {LOG_SQL} select method, endpoint, status_code, count(*) as requests from log group by all",
)
def http_requests_total(v: Views):
    return httpmetrics.requests_total(_log(v))


BOUNDS = {str(b): b for b in httpmetrics.BUCKETS}
HISTOGRAM_SQL = " union all ".join(
    f"select endpoint, '{le}' as le, count(*) filter (where duration_s <= {b}) as bucket_count, "
    f"count(*) as duration_count, {rounded('sum(duration_s)', 4)} as duration_sum from log group by endpoint"
    for le, b in [*BOUNDS.items(), ("+Inf", "'infinity'::double")]
)


@query("http_duration_histogram", f"with {LOG_SQL} {HISTOGRAM_SQL}")
def http_duration_histogram(v: Views):
    rows = httpmetrics.duration_histogram(_log(v))
    return rows.withColumn("duration_sum", F.round(F.round("duration_sum", 9), 4))


@query(
    "request_rate_5m",
    f"""with {LOG_SQL} select endpoint, {time_sql("t")}, requests, round(requests / 300.0, 6) as per_second
    from (select endpoint, t, count(*) as requests from {ends_sql(5 * MINUTE, MINUTE, "log")} group by all)""",
)
def request_rate_5m(v: Views):
    rows = httpmetrics.request_rate(_log(v))
    return rows.select("endpoint", _time("t"), "requests", F.round("per_second", 6).alias("per_second"))


ERRORS_SQL = f"""errs as (select t, errors, requests, errors * 100.0 / requests as error_pct from (
  select t, count(*) filter (where status_code between 500 and 599) as errors, count(*) as requests
  from RANGED group by t))"""


@query(
    "error_ratio_5m",
    f"""with {LOG_SQL}, {ERRORS_SQL.replace("RANGED", ends_sql(5 * MINUTE, MINUTE, "log"))}
    select {time_sql("t")}, errors, requests, {rounded("error_pct", 4)} as error_pct,
      error_pct > 1 as breached from errs""",
)
def error_ratio_5m(v: Views):
    rows = httpmetrics.error_ratio(_log(v))
    return rows.select(
        _time("t"),
        "errors",
        "requests",
        F.round("error_pct", 4).alias("error_pct"),
        (F.col("error_pct") > 1).alias("breached"),
    )


def quantile_sql(keys: str, range_us: int, step_us: int, where: str = "true") -> str:
    group = f"{keys}, t" if keys else "t"
    lead = f"{keys}, " if keys else ""
    arms = []
    for i, b in enumerate(httpmetrics.BUCKETS):
        low = httpmetrics.BUCKETS[i - 1] if i else 0.0
        below = f"c{i - 1}" if i else "0"
        arms.append(f"when c{i} >= 0.95 * requests then {low} + ({b} - {low}) * (0.95 * requests - {below}) / (c{i} - {below})")
    counts = ", ".join(
        f"count(*) filter (where duration_s <= {b}) as c{i}" for i, b in enumerate(httpmetrics.BUCKETS)
    )
    return f"""select {lead}{time_sql("t")}, requests,
      {rounded("case " + " ".join(arms) + " else 5.0 end", 6)} as quantile_s
    from (select {group}, count(*) as requests, {counts} from {ends_sql(range_us, step_us, "log")}
      where {where} group by {group})"""


@query("histogram_quantile", f"with {LOG_SQL} {quantile_sql('endpoint', HOUR, 15 * MINUTE)}")
def histogram_quantile(v: Views):
    rows = httpmetrics.latency_quantile(_log(v), range_us=HOUR, step_us=15 * MINUTE)
    return rows.select("endpoint", _time("t"), "requests", F.round(F.round("quantile_s", 9), 6).alias("quantile_s"))


@query(
    "high_latency_p95",
    f"with {LOG_SQL} " + quantile_sql("", HOUR, 15 * MINUTE, "endpoint not like '/v1/eval/%' and endpoint not like '/v1/airflow/%'"),
)
def high_latency_p95(v: Views):
    rows = httpmetrics.latency_quantile(
        _log(v), keys=(), range_us=HOUR, step_us=15 * MINUTE, interactive_only=True
    )
    return rows.select(_time("t"), "requests", F.round(F.round("quantile_s", 9), 6).alias("quantile_s"))


STREAKS_SQL = """streaks as (
  select min(t) as started, max(t) as ended, count(*) as steps from (
    select t, t - row_number() over (order by t) * STEP as island from series where CONDITION)
  group by island)
select strftime(make_timestamp(started), '%Y-%m-%d %H:%M:%S') as started,
  strftime(make_timestamp(ended), '%Y-%m-%d %H:%M:%S') as ended, steps,
  case when ended - started >= HOLD then 'firing' else 'pending' end as state,
  case when ended - started >= HOLD
    then strftime(make_timestamp(started + HOLD), '%Y-%m-%d %H:%M:%S') end as firing_from
from streaks"""


def streaks_sql(condition: str, step_us: int, hold_us: int) -> str:
    return (
        STREAKS_SQL.replace("CONDITION", condition).replace("STEP", str(step_us)).replace("HOLD", str(hold_us))
    )


def _shown(streaks):
    return streaks.select(_time("started"), _time("ended"), "steps", "state", _time("firing_from"))


@query(
    "rate_limited_alert",
    f"""with {LOG_SQL}, series as (select t, count(*) filter (where status_code = 429) / 3600.0 as per_second
      from {ends_sql(HOUR, 15 * MINUTE, "log")} group by t),
    {streaks_sql("per_second > 0.0002", 15 * MINUTE, 30 * MINUTE)}""",
)
def rate_limited_alert(v: Views):
    rate = httpmetrics.limited_rate(_log(v), HOUR, 15 * MINUTE)
    streaks = httpmetrics.alert_streaks(rate, F.col("per_second") > 0.0002, 15 * MINUTE, 30 * MINUTE)
    return _shown(streaks)


@query(
    "critical_anomaly_alert",
    ROLLING_SQL + f""", timed as (select r.severity, t.ts from rolled r join telemetry t using (seq))
    select {time_sql("t")}, criticals, criticals > 5 as alert from (
      select t, count(*) filter (where severity = 'CRITICAL') as criticals
      from {ends_sql(24 * HOUR, HOUR, "timed")} group by t)""",
)
def critical_anomaly_alert(v: Views):
    timed = anomaly.rolling_ingest(v.telemetry, carry=["ts"])
    return httpmetrics.critical_anomalies(timed, 24 * HOUR, HOUR).select(_time("t"), "criticals", "alert")


@query(
    "alert_for_duration",
    f"""with {LOG_SQL}, {ERRORS_SQL.replace("RANGED", ends_sql(HOUR, 15 * MINUTE, "log")).replace("errs as", "series as")},
    {streaks_sql("error_pct > 20", 15 * MINUTE, 30 * MINUTE)}""",
)
def alert_for_duration(v: Views):
    ratio = httpmetrics.error_ratio(_log(v), HOUR, 15 * MINUTE)
    return _shown(
        httpmetrics.alert_streaks(ratio, F.col("error_pct") > 20, 15 * MINUTE, 30 * MINUTE)
    )


# The alert rules with their own windows, limits and holds, over the dense log.
DENSE_SQL = LOG_SQL.replace("{access_log}", "{dense_log}")


def _dense(v: Views):
    return httpmetrics.with_endpoint(v.dense_log)


@query(
    "error_rate_rule",
    f"""with {DENSE_SQL}, series as (
      select t, count(*) filter (where status_code between 500 and 599) * 100.0 / count(*) as error_pct
      from {ends_sql(300_000_000, 60_000_000, "log")} group by t),
    {streaks_sql("error_pct > 1", 60_000_000, 300_000_000)}""",
)
def error_rate_rule(v: Views):
    return _shown(httpmetrics.error_rate_rule(_dense(v)))


@query(
    "high_latency_rule",
    f"""with {DENSE_SQL}, numbered as ({quantile_sql("", 300_000_000, 60_000_000, "endpoint not like '/v1/eval/%' and endpoint not like '/v1/airflow/%'")}),
    series as (select epoch_us(strptime(t, '%Y-%m-%d %H:%M:%S')) as t, quantile_s from numbered),
    {streaks_sql("quantile_s > 0.5", 60_000_000, 600_000_000)}""",
)
def high_latency_rule(v: Views):
    return _shown(httpmetrics.latency_rule(_dense(v)))


@query(
    "rate_limited_rule",
    f"""with {DENSE_SQL}, series as (select t, count(*) filter (where status_code = 429) / 300.0 as per_second
      from {ends_sql(300_000_000, 60_000_000, "log")} group by t),
    {streaks_sql("per_second > 1", 60_000_000, 600_000_000)}""",
)
def rate_limited_rule(v: Views):
    return _shown(httpmetrics.rate_limited_rule(_dense(v)))


@query(
    "critical_anomaly_rule",
    ROLLING_SQL + f""", timed as (select r.severity, t.ts from rolled r join dense_telemetry t using (seq))
    select {time_sql("t")}, criticals, criticals > 5 as alert from (
      select t, count(*) filter (where severity = 'CRITICAL') as criticals
      from {ends_sql(600_000_000, 60_000_000, "timed")} group by t) -- {{dense_telemetry}}
    """,
)
def critical_anomaly_rule(v: Views):
    timed = anomaly.rolling_ingest(v.dense_telemetry, carry=["ts"])
    return httpmetrics.critical_anomalies(timed).select(_time("t"), "criticals", "alert")


@query(
    "requests_per_minute_rule",
    """with placed as (select event_id, client, date_trunc('minute', ts) as minute,
        row_number() over (partition by client, date_trunc('minute', ts) order by ts, event_id) as place
      from {dense_log})
    select event_id, client, strftime(minute, '%Y-%m-%d %H:%M:%S') as window_start,
      place > 10 as limited, case when place > 10 then 429 else 200 end as answer from placed""",
)
def requests_per_minute_rule(v: Views):
    rows = httpmetrics.fixed_window_limit(v.dense_log)
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.select("event_id", "client", start, "limited", "answer")


@query(
    "target_down",
    f"""with present as (select distinct (epoch_us(ts) + {2 * MINUTE} - 1) // {2 * MINUTE} * {2 * MINUTE} as t from {{access_log}}),
    series as (select t from (select unnest(range(min(t), max(t) + 1, {2 * MINUTE})) as t from present)
      where t not in (select t from present)),
    {streaks_sql("true", 2 * MINUTE, 2 * MINUTE)}""",
)
def target_down(v: Views):
    return _shown(httpmetrics.target_down(v.access_log))


@query(
    "fixed_window_rate_limit",
    """select event_id, client, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start,
      row_number() over (partition by client, date_trunc('day', ts) order by ts, event_id) > 5 as limited,
      case when row_number() over (partition by client, date_trunc('day', ts) order by ts, event_id) > 5
        then 429 else 200 end as answer
    from {access_log}""",
)
def fixed_window_rate_limit(v: Views):
    rows = httpmetrics.fixed_window_limit(v.access_log, limit=5, period="day")
    return rows.select(
        "event_id",
        "client",
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "limited",
        "answer",
    )


@query(
    "request_trace",
    f"""with {LOG_SQL} select request_id, event_id, endpoint, status_code,
      row_number() over (partition by request_id order by event_id) as line_no
    from log where endpoint not in ('/health', '/metrics')""",
)
def request_trace(v: Views):
    return httpmetrics.request_trace(_log(v)).select(
        "request_id", "event_id", "endpoint", "status_code", "line_no"
    )
