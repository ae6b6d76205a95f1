"""Telemetry, topic, SLA, incident and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import gates, incidents, runs, sla, topic, validation
from opsloom.plans.daily import run_daily
from opsloom.plans.durable import scratch_path
from opsloom.registry import Views, query, rounded
from opsloom.sources import logs, sinks, telemetry
from opsloom.sources.keyed import KeyedTable
from opsloom.sources.topiclog import TopicLog

EVENT_COLUMNS = (
    "event_id service_name cpu_percent memory_percent latency_ms status_code".split()
)


@query(
    "telemetry_scan",
    """select event_id, service_name, round(cpu_percent, 4) as cpu_percent, memory_percent,
      round(latency_ms, 4) as latency_ms, status_code from {raw_telemetry}""",
)
def telemetry_scan(v: Views):
    path = scratch_path(v.spark, "telemetry")
    v.raw_telemetry.select(*EVENT_COLUMNS, F.col("ts").alias("timestamp")).write.parquet(path)
    rows = telemetry.scan_telemetry(v.spark, path)
    return rows.select(
        "event_id",
        "service_name",
        F.round("cpu_percent", 4).alias("cpu_percent"),
        "memory_percent",
        F.round("latency_ms", 4).alias("latency_ms"),
        "status_code",
    )


# Payload fields read back with JSON functions, and the broken rule of each.
PARSED = """
parsed as (
  select seq, ts, payload, payload not like '{{%' as garbled,
    case when payload like '{{%' then json_extract_string(payload, '$.event_id') end as id_text,
    case when payload like '{{%' then json_extract_string(payload, '$.service_name') end as service_name,
    case when payload like '{{%' then json_extract_string(payload, '$.cpu_percent') end as cpu_text,
    case when payload like '{{%' then json_extract_string(payload, '$.memory_percent') end as mem_text,
    case when payload like '{{%' then json_extract_string(payload, '$.latency_ms') end as lat_text,
    case when payload like '{{%' then json_extract_string(payload, '$.status_code') end as st_text,
    case when payload like '{{%' then json_type(payload, '$.event_id') end as id_type,
    case when payload like '{{%' then json_extract_string(payload, '$.timestamp') end as time_text,
    case when payload like '{{%' then json_type(payload, '$.metadata') end as meta_type,
    case when payload like '{{%' then cast(json_extract(payload, '$.metadata') as varchar) end as meta
  from raw_payloads),
numbers as (
  select *, try_cast(cpu_text as double) as cpu, try_cast(mem_text as double) as mem,
    try_cast(lat_text as double) as lat, try_cast(st_text as double) as st,
    case when try_cast(time_text as bigint) is not null then make_timestamp(time_text::bigint * 1000000)
      else try_cast(time_text as timestamptz) at time zone 'UTC' end as given from parsed),
judged as (
  select *,
    case when ANY and id_text is null then 'missing' when ANY and id_type <> 'VARCHAR' then 'string_type' end as id_rule,
    case when ANY and time_text is not null and given is null then 'datetime_parsing' end as time_rule,
    case when ANY and meta_type <> 'OBJECT' then 'dict_type' end as meta_rule,
    case when cpu_text is null then 'missing' when cpu is null then 'float_parsing'
      when cpu < 0 then 'greater_than_equal' when cpu > 100 then 'less_than_equal' end as cpu_rule,
    case when mem_text is null then 'missing' when mem is null then 'float_parsing'
      when mem < 0 then 'greater_than_equal' when mem > 100 then 'less_than_equal' end as mem_rule,
    case when lat_text is null then 'missing' when lat is null then 'float_parsing'
      when lat < 0 then 'greater_than_equal' when lat > LATMAX then 'less_than_equal' end as lat_rule,
    case when st_text is null then 'missing' when st is null or st <> floor(st) then 'int_parsing'
      when st < 100 then 'greater_than_equal' when st > 599 then 'less_than_equal' end as st_rule
  from numbers),
reasons as (
  select *, (id_rule is not null)::int + (time_rule is not null)::int + (meta_rule is not null)::int
      + (cpu_rule is not null)::int + (mem_rule is not null)::int + (lat_rule is not null)::int + (st_rule is not null)::int as n_errors,
    concat_ws('; ', 'event_id ' || id_rule, 'cpu_percent ' || cpu_rule, 'memory_percent ' || mem_rule,
      'latency_ms ' || lat_rule, 'status_code ' || st_rule,
        'timestamp ' || time_rule, 'metadata ' || meta_rule) as listed
  from judged)""".replace("{{", "{")
TOPIC_PARSED = PARSED.replace("LATMAX", "'infinity'::double").replace("ANY", "true")
API_PARSED = PARSED.replace("LATMAX", "600000").replace("ANY", "false")
USE_PAYLOADS = "-- from {raw_payloads}\n"
MD5_PART = """cast(list_reduce(list_transform(range(0, 8),
  lambda i: ('0x' || substr(md5(service_name), i * 4 + 1, 4))::bigint),
  lambda a, b: (a * 65536 + b) % 4, 0::bigint) as int)"""
TOPIC_SQL = f"""topic as (
  select seq, service_name, {MD5_PART} as "partition" from {{telemetry}}),
offsets as (
  select *, row_number() over (partition by "partition" order by seq) - 1 as "offset" from topic),
marks as (
  select cast(p as int) as "partition", count(t.seq) as high_watermark
  from range(0, 4) r(p) left join topic t on t."partition" = p group by 1),
commits as (
  select 'reporting' as group_id, "partition", high_watermark - high_watermark % 7 as committed
    from marks where "partition" < 3
  union all select 'archive' as group_id, "partition", high_watermark as committed from marks)"""


@query(
    "telemetry_validate",
    "with " + TOPIC_PARSED + """
    select seq, id_text as event_id, service_name, cpu as cpu_percent, mem as memory_percent,
      lat as latency_ms, cast(st as int) as status_code,
      strftime(coalesce(given, ts), '%Y-%m-%d %H:%M:%S') as event_time,
      case when meta is null then 0 else 2 end as metadata_size
    from reasons where not garbled and n_errors = 0 """ + USE_PAYLOADS,
)
def telemetry_validate(v: Views):
    rows = validation.valid_rows(v.raw_payloads, as_of=F.col("ts"))
    return rows.select(
        "seq",
        *EVENT_COLUMNS,
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.size("metadata").alias("metadata_size"),
    )


@query(
    "telemetry_dlq",
    "with " + TOPIC_PARSED + """
    select seq, payload as raw_payload,
      case when garbled then 'payload is not an object'
        else n_errors || ' validation error(s): ' || listed end as reason,
      case when garbled then 'TypeError' else 'ValidationError' end as error_type,
      case when garbled then 0 else n_errors end as n_errors
    from reasons where garbled or n_errors > 0 """ + USE_PAYLOADS,
)
def telemetry_dlq(v: Views):
    rows = validation.dead_letters(v.raw_payloads)
    return rows.select(
        "seq", "raw_payload", "reason", "error_type", F.size("errors").alias("n_errors")
    )


@query(
    "telemetry_validate_api",
    "with " + API_PARSED + """
    select seq, not garbled and n_errors = 0 as accepted,
      case when garbled then 'payload is not an object'
        when n_errors > 0 then n_errors || ' validation error(s): ' || listed else '' end as reason
    from reasons """ + USE_PAYLOADS,
)
def telemetry_validate_api(v: Views):
    rows = validation.checked(v.raw_payloads, validation.API_PROFILE)
    ok = validation.is_valid()
    return rows.select(
        "seq", ok.alias("accepted"), F.when(ok, "").otherwise(validation.reason()).alias("reason")
    )


REPAIRED = """regexp_replace(payload, '"status_code":700', '"status_code":503')"""


@query(
    "dlq_replay",
    "with " + TOPIC_PARSED + f""",
    again as (
      select seq, garbled, service_name, id_rule, cpu_rule, mem_rule, lat_rule, time_rule, meta_rule,
        case when st_text = '700' then null else st_rule end as st_rule
      from reasons where garbled or n_errors > 0),
    counted as (
      select *, (id_rule is not null)::int + (time_rule is not null)::int + (meta_rule is not null)::int
          + (cpu_rule is not null)::int + (mem_rule is not null)::int + (lat_rule is not null)::int + (st_rule is not null)::int as n_errors,
        concat_ws('; ', 'event_id ' || id_rule, 'cpu_percent ' || cpu_rule, 'memory_percent ' || mem_rule,
          'latency_ms ' || lat_rule, 'status_code ' || st_rule,
        'timestamp ' || time_rule, 'metadata ' || meta_rule) as listed,
        {MD5_PART} as part
      from again)
    select seq, not garbled and n_errors = 0 as resolved,
      case when garbled then 'Non-dict payload cannot be auto-replayed'
        when n_errors > 0 then 'Event diverted to DLQ: ' || n_errors || ' validation error(s): ' || listed
        else 'Event accepted into partition ' || part end as message,
      case when not garbled and n_errors = 0 then part end as "partition"
    from counted """ + USE_PAYLOADS,
)
def dlq_replay(v: Views):
    dlq = validation.dead_letters(v.raw_payloads)
    repaired = dlq.withColumn(
        "raw_payload", F.regexp_replace("raw_payload", '"status_code":700', '"status_code":503')
    )
    rows = validation.replay_dead_letters(repaired)
    return rows.select("seq", "resolved", "message", "partition")


@query("telemetry_partition", f"with {TOPIC_SQL} select seq, \"partition\" from topic")
def telemetry_partition(v: Views):
    return topic.with_partition(v.telemetry).select("seq", "partition")


@query("topic_offsets", f"with {TOPIC_SQL} select seq, \"partition\", \"offset\" from offsets")
def topic_offsets(v: Views):
    rows = topic.with_partition(v.telemetry.select("seq", "service_name"))
    return topic.with_offsets(rows).select("seq", "partition", "offset")


@query("topic_high_watermark", f"with {TOPIC_SQL} select \"partition\", high_watermark from marks")
def topic_high_watermark(v: Views):
    return topic.high_watermarks(topic.with_partition(v.telemetry))


def _commits(marks):
    kept = F.col("high_watermark") - F.col("high_watermark") % 7
    first = marks.where("partition < 3").select(
        F.lit("reporting").alias("group_id"), "partition", kept.alias("committed")
    )
    second = marks.select(
        F.lit("archive").alias("group_id"), "partition", F.col("high_watermark").alias("committed")
    )
    return first.unionByName(second)


OFFSET_RANGE_SQL = f"""with {TOPIC_SQL},
    pos as (select "partition", cast(floor(high_watermark / 2) as bigint) as cur from marks
      where "partition" <> 1)
    select o.seq, o."partition", o."offset",
      greatest(coalesce(cur, 0), least(high_watermark, coalesce(cur, 0) + 100)) as next_position
    from offsets o join marks m using ("partition") left join pos using ("partition")
    where o."offset" >= coalesce(cur, 0) and o."offset" < coalesce(cur, 0) + 100"""


def _positions(marks):
    return marks.where("partition <> 1").select(
        "partition", F.floor(F.col("high_watermark") / 2).alias("current")
    )


@query("topic_poll", OFFSET_RANGE_SQL)
def topic_poll(v: Views):
    """The same poll from a stored log that was appended to in three batches."""
    log = TopicLog(v.spark, scratch_path(v.spark, "topic"))
    rows = v.telemetry.select("seq", "service_name")
    third = rows.agg(F.max("seq").alias("last")).first()["last"] // 3 + 1
    for batch in range(3):
        log.append(rows.where(F.floor(F.col("seq") / third) == batch), batch)
    marks = log.high_watermarks()
    following = topic.next_positions(marks, _positions(marks))
    polled = log.poll(_positions(marks))
    return polled.join(following, "partition").select("seq", "partition", "offset", "next_position")


@query("topic_offset_range", OFFSET_RANGE_SQL)
def topic_offset_range(v: Views):
    rows = topic.with_offsets(topic.with_partition(v.telemetry.select("seq", "service_name")))
    marks = topic.high_watermarks(rows)
    positions = _positions(marks)
    batch = topic.read_range(rows, positions)
    following = topic.next_positions(marks, positions)
    return batch.join(following, "partition").select("seq", "partition", "offset", "next_position")


@query(
    "consumer_lag",
    f"""with {TOPIC_SQL},
    lags as (
      select g.group_id, m."partition", high_watermark, coalesce(committed, 0) as committed,
        greatest(0, high_watermark - coalesce(committed, 0)) as lag
      from (select distinct group_id from commits) g cross join marks m
        left join commits c on c.group_id = g.group_id and c."partition" = m."partition")
    select *, cast(sum(lag) over (partition by group_id) as bigint) as total_lag,
      sum(lag) over (partition by group_id) = 0 as zero_lag_verified from lags""",
)
def consumer_lag(v: Views):
    marks = topic.high_watermarks(topic.with_partition(v.telemetry))
    lag = topic.consumer_lag(marks, _commits(marks))
    return lag.join(topic.group_lag(lag), "group_id")


SLA_SELECT = f"""
    count(*) as total_requests, count(*) filter (where status_code >= 500) as total_errors_5xx,
    {rounded("(count(*) - count(*) filter (where status_code >= 500)) / count(*) * 100.0", 4)} as availability_sla,
    {rounded("quantile_cont(latency_ms, 0.5)", 2)} as latency_p50_ms,
    {rounded("quantile_cont(latency_ms, 0.95)", 2)} as latency_p95_ms,
    {rounded("quantile_cont(latency_ms, 0.99)", 2)} as latency_p99_ms,
    {rounded("avg(cpu_percent)", 2)} as avg_cpu_percent, {rounded("avg(memory_percent)", 2)} as avg_memory_percent"""
SLA_SQL = f"select service_name, {SLA_SELECT} from {{telemetry}} where service_name is not null group by service_name"


@query("service_sla", SLA_SQL)
def service_sla(v: Views):
    return sla.service_sla(v.telemetry).orderBy("service_name")


@query("service_sla_split", SLA_SQL)
def service_sla_split(v: Views):
    """The form large input takes, forced so that it is checked on the same rows."""
    return sla.service_sla(v.telemetry, split=True).orderBy("service_name")


@query("service_sla_approx")
def service_sla_approx(v: Views):
    return sla.service_sla_approx(v.telemetry)


BOUND_SQL = """select service_name, count(*) as total_requests,
      count(*) filter (where status_code >= 500) as total_errors_5xx,
      count(latency_ms) > 0 as latency_p50_ms_close, count(latency_ms) > 0 as latency_p95_ms_close,
      count(latency_ms) > 0 as latency_p99_ms_close
    from {telemetry} where service_name is not null group by service_name"""


@query("service_sla_rollup_bound", BOUND_SQL)
def service_sla_rollup_bound(v: Views):
    """Stored daily sketches rolled up over all days, held to their promised ranks."""
    days = sinks.write_parquet(sla.sla_sketches(v.telemetry), scratch_path(v.spark, "sketches"))
    rolled = sla.rolled_up(days)
    close = sla.approx_within_bound(v.telemetry, rolled, 1 / sla.SKETCH_RANK_ERROR)
    return rolled.select("service_name", "total_requests", "total_errors_5xx").join(close, "service_name")


@query("service_sla_approx_bound", BOUND_SQL)
def service_sla_approx_bound(v: Views):
    """The sketch's counts, and whether its quantiles keep to their promised ranks."""
    approx = sla.service_sla_approx(v.telemetry)
    close = sla.approx_within_bound(v.telemetry, approx)
    counts = approx.select("service_name", "total_requests", "total_errors_5xx")
    return counts.join(close, "service_name")


@query(
    "service_sla_daily",
    f"""select service_name, strftime(ts, '%Y-%m-%d') as day, {SLA_SELECT} from {{telemetry}}
    where service_name is not null group by 1, 2""",
)
def service_sla_daily(v: Views):
    rows = sla.service_sla_daily(v.telemetry)
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("sla_parquet_sink", SLA_SQL)
def sla_parquet_sink(v: Views):
    return sinks.write_parquet(sla.service_sla(v.telemetry), scratch_path(v.spark, "sla"))


UPSERT_SQL = """select ticket_id, service_name, severity, started_at, resolved_at from {incident_feed}
    where resolved_at is not null
    qualify row_number() over (partition by ticket_id order by seq desc) = 1"""


@query("incident_upsert", UPSERT_SQL)
def incident_upsert(v: Views):
    return incidents.upsert_incidents(v.incident_feed)


@query("incident_merge", UPSERT_SQL)
def incident_merge(v: Views):
    """The same table kept by merges of three batches, the newest arrivals first, one of them twice."""
    feed = v.incident_feed.where("resolved_at is not null")
    feed = feed.select("ticket_id", *incidents.INCIDENT_COLUMNS, "seq")
    schema = ", ".join(f"{name} {kind}" for name, kind in feed.dtypes)
    table = KeyedTable(v.spark, scratch_path(v.spark, "incidents"), schema, "ticket_id", "seq")
    for batch in (2, 0, 1, 0):
        table.merge(feed.where(F.col("seq") % 3 == batch), f"batch-{batch}")
    return table.read().drop("seq")


@query(
    "incident_rejects",
    """select seq, ticket_id, 'resolved_at' as missing from {incident_feed} where resolved_at is null""",
)
def incident_rejects(v: Views):
    return incidents.reject_incidents(v.incident_feed).select("seq", "ticket_id", "missing")


STAGED_SQL = """cleaned as (
  select ticket_id, service_name, upper(trim(severity)) as severity,
    try_strptime(started_at, '%Y-%m-%d %H:%M:%S') as started_at,
    try_strptime(resolved_at, '%Y-%m-%d %H:%M:%S') as resolved_at
  from {raw_incidents} where ticket_id is not null),
timed as (
  select *, round((epoch_us(resolved_at) - epoch_us(started_at)) / 60000000.0, 2) as duration_minutes,
    case severity when 'P1' then 15 when 'P2' then 60 else 240 end as sla_target_minutes
  from cleaned),
staged as (
  select *, case when duration_minutes > sla_target_minutes then 1 else 0 end as is_sla_breached
  from timed)"""
MART_SQL = """summed as (
  select service_name, count(ticket_id) as total_incidents,
    count(*) filter (where severity = 'P1') as p1_incident_count,
    count(*) filter (where severity = 'P2') as p2_incident_count,
    round(avg(duration_minutes), 2) as mttr_minutes, cast(sum(is_sla_breached) as bigint) as total_sla_breaches
  from staged group by service_name),
mart as (
  select *, case when total_sla_breaches = 0 and mttr_minutes <= 15.0 then 'EXCELLENT'
    when total_sla_breaches <= 1 and mttr_minutes <= 60.0 then 'ACCEPTABLE'
    else 'SLA_BREACH_RISK' end as reliability_tier
  from summed)"""


@query(
    "stg_incidents",
    f"""with {STAGED_SQL} select * replace (strftime(started_at, '%Y-%m-%d %H:%M:%S') as started_at,
      strftime(resolved_at, '%Y-%m-%d %H:%M:%S') as resolved_at) from staged""",
)
def stg_incidents(v: Views):
    shown = {
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "resolved_at")
    }
    return incidents.stage_incidents(v.raw_incidents).withColumns(shown)


@query("fct_service_reliability", f"with {STAGED_SQL}, {MART_SQL} select * from mart")
def fct_service_reliability(v: Views):
    return incidents.service_reliability(incidents.stage_incidents(v.raw_incidents))


@query("mart_materialize", f"with {STAGED_SQL}, {MART_SQL} select * from mart")
def mart_materialize(v: Views):
    staged = sinks.publish_view(incidents.stage_incidents(v.raw_incidents), "stg_incidents")
    mart = incidents.service_reliability(staged)
    return sinks.publish_table(mart, scratch_path(v.spark, "mart"), "fct_service_reliability")


GATE_SQL = f"""with {STAGED_SQL}, {MART_SQL}, sla as ({SLA_SQL}),
a_bad as (select service_name, 1 as gate, printf('Availability SLA Breach on ''%s'': %.2f%% < %.2f%%',
    service_name, availability_sla, 99.0::double) as violation from sla where availability_sla < 99.0),
m_bad as (select service_name, 2 as gate, printf('MTTR SLA Breach on ''%s'': %.1fm > %.1fm',
    service_name, mttr_minutes, 60.0::double) as violation from mart where mttr_minutes > 60.0),
found as (select * from a_bad union all select * from m_bad),
gated as (select case when count(*) > 0 then 'FAILED' else 'PASSED' end as status,
    99.0::double as min_availability_verified, 60.0::double as max_mttr_verified,
    (select count(*) from sla) as evaluated_services_count, count(*) as violation_count,
    case when count(*) > 0 then 'SLA Gates Failed: '
      || string_agg(violation, ' | ' order by gate, service_name) end as violations from found)"""


@query("availability_violations", GATE_SQL + " select service_name, violation from a_bad")
def availability_violations(v: Views):
    return gates.availability_violations(sla.service_sla(v.telemetry))


@query("mttr_violations", GATE_SQL + " select service_name, violation from m_bad")
def mttr_violations(v: Views):
    staged = incidents.stage_incidents(v.raw_incidents)
    return gates.mttr_violations(incidents.service_reliability(staged))


def _gate(v: Views):
    mart = incidents.service_reliability(incidents.stage_incidents(v.raw_incidents))
    return gates.sla_gate(sla.service_sla(v.telemetry), mart)


@query("sla_gate", GATE_SQL + " select * from gated")
def sla_gate(v: Views):
    return _gate(v)


@query(
    "publish_status",
    GATE_SQL + """ select case when status = 'PASSED' then 'PUBLISHED' else 'SLA_BREACH' end as status,
      status as gate_status, (select strftime(max(ts), '%Y-%m-%d %H:%M:%S') from telemetry) as published_at
    from gated""",
)
def publish_status(v: Views):
    latest = v.telemetry.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"))
    return gates.publish_status(_gate(v), latest.select("at").scalar())


@query(
    "daily_pipeline",
    GATE_SQL.replace("{raw_incidents}", """(select ticket_id, service_name, severity, started_at, resolved_at
      from {incident_feed} where resolved_at is not null
      qualify row_number() over (partition by ticket_id order by seq desc) = 1)""")
    + """ select s.*, m.mttr_minutes, m.reliability_tier, g.status as gate_status
      from sla s left join mart m using (service_name), gated g""",
)
def daily_pipeline(v: Views):
    out = scratch_path(v.spark, "daily")
    run = run_daily(v.telemetry, v.incident_feed, out, F.lit("run"))
    marts = run.marts.select("service_name", "mttr_minutes", "reliability_tier")
    return run.metrics.join(marts, "service_name", "left").withColumn(
        "gate_status", run.gate.select("status").scalar()
    )


@query(
    "log_json_parse",
    """select seq, line ->> '$.ts' as ts, line ->> '$.level' as level, line ->> '$.logger' as logger,
      line ->> '$.message' as message, coalesce(line ->> '$.request_id', '-') as request_id,
      line ->> '$.method' as method, line ->> '$.path' as path, line ->> '$.status' as status,
      3 as n_extras, json_array_length(json_keys(line::json)) >= 7 as has_all
    from {log_lines}""".replace("json_array_length(json_keys(line::json)) >= 7", "len(json_keys(line::json)) >= 7"),
)
def log_json_parse(v: Views):
    parsed = logs.parse_lines(v.log_lines, "line")
    again = logs.format_lines(parsed, "line")
    kept = F.size(F.from_json("line", "map<string,string>")) >= 7
    return again.select(
        "seq",
        "ts",
        "level",
        "logger",
        "message",
        "request_id",
        *[F.col("extras")[k].alias(k) for k in ("method", "path", "status")],
        F.size("extras").alias("n_extras"),
        kept.alias("has_all"),
    )


@query(
    "nonfinite_sanitize",
    """select seq, case when isnan(reading) then 'nan' when isinf(reading) then
      case when reading > 0 then 'inf' else '-inf' end end as reading_text,
      case when not isnan(reading) and not isinf(reading) then reading end as reading
    from {readings}""",
)
def nonfinite_sanitize(v: Views):
    return logs.sanitize_nonfinite(v.readings, ["reading"])


@query(
    "structured_output_validate",
    """with f as (
      select seq, payload ->> '$.category' as category, payload ->> '$.urgency' as urgency,
        payload ->> '$.requires_human_approval' as approval, payload ->> '$.reasoning' as reasoning
      from {model_outputs}),
    e as (
      select *, case when category not in ('hardware', 'software', 'access_control', 'billing', 'security')
          then 'category literal_error' end as c1,
        case when urgency not in ('low', 'medium', 'high', 'critical') then 'urgency literal_error' end as c2,
        case when approval is null then 'requires_human_approval missing' end as c3,
        case when reasoning is null then 'reasoning missing' end as c4 from f)
    select seq, category, urgency, c1 is null and c2 is null and c3 is null and c4 is null as accepted,
      case when c1 is null and c2 is null and c3 is null and c4 is null then ''
        else ((c1 is not null)::int + (c2 is not null)::int + (c3 is not null)::int + (c4 is not null)::int)
          || ' validation error(s): ' || concat_ws('; ', c1, c2, c3, c4) end as reason
    from e""",
)
def structured_output_validate(v: Views):
    rows = validation.checked(v.model_outputs, validation.TRIAGE_OUTPUT_PROFILE)
    ok = validation.is_valid()
    return rows.select(
        "seq",
        F.col("fields")["category"].alias("category"),
        F.col("fields")["urgency"].alias("urgency"),
        ok.alias("accepted"),
        F.when(ok, "").otherwise(validation.reason()).alias("reason"),
    )


@query(
    "run_log",
    """select run_name, param_k, metric_value, tag, runs_logged from (
      select *, count(*) over (partition by run_name) as runs_logged,
        row_number() over (partition by run_name order by seq desc) as rn from {run_events})
    where rn = 1""",
)
def run_log(v: Views):
    logged = v.run_events.select(
        "run_name",
        "seq",
        F.create_map(F.lit("k"), "param_k").alias("params"),
        F.create_map(F.lit("value"), "metric_value").alias("metrics"),
        F.create_map(F.lit("type"), "tag").alias("tags"),
    )
    latest = runs.latest_runs(logged)
    return latest.select(
        "run_name",
        F.col("params")["k"].alias("param_k"),
        F.col("metrics")["value"].alias("metric_value"),
        F.col("tags")["type"].alias("tag"),
        "runs_logged",
    )
