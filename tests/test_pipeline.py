"""Golden values of the telemetry, SLA, incident and gate operators."""

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsloom.functions.hashing import md5_modulo
from opsloom.operators import gates, incidents, runs, sla, topic, validation
from opsloom.plans.daily import run_daily
from opsloom.plans.quantiles import exact_quantiles
from opsloom.plans.ranking import arrival_rank, ordered_rank
from opsloom.sources import logs
from opsloom.sources.telemetry import scan_payloads, scan_telemetry

SLA_ROWS = [
    ("api-gateway", 200, 14.5, 34.0, 41.0),
    ("api-gateway", 200, 18.2, 36.0, 43.0),
    ("api-gateway", 500, 120.0, 45.0, 48.0),
    ("rag-retrieval", 200, 95.0, 75.0, 80.0),
    ("rag-retrieval", 503, 2500.0, 95.0, 91.0),
    (None, 200, 1.0, 1.0, 1.0),
]
SLA_SCHEMA = "service_name string, status_code int, latency_ms double, cpu_percent double, memory_percent double"


@pytest.mark.parametrize("split", [False, True])
def test_service_sla_golden(spark, split):
    got = rows(sla.service_sla(spark.createDataFrame(SLA_ROWS, SLA_SCHEMA), split=split), "service_name")
    assert list(got[0]) == sla.SLA_COLUMNS
    assert tuple(got[0].values()) == ("api-gateway", 3, 1, 66.6667, 18.2, 109.82, 117.96, 38.33, 44.0)
    assert tuple(got[1].values())[:7] == ("rag-retrieval", 2, 1, 50.0, 1297.5, 2379.75, 2475.95)


def test_service_sla_empty_keeps_schema(spark):
    empty = sla.service_sla(spark.createDataFrame([], SLA_SCHEMA))
    assert empty.columns == sla.SLA_COLUMNS and empty.count() == 0


@pytest.mark.parametrize("probs", [(0.5, 0.95, 0.99), (0.0, 0.05, 1.0)])
def test_split_quantiles_equal_percentile_under_skew(spark, probs):
    # One key holds most rows, many of them ties.
    hot = spark.range(20000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 3001 / 7.0).alias("v"))
    tied = spark.range(5000).select(F.lit("tied").alias("k"), F.lit(4.25).alias("v"))
    few = spark.range(3).select(F.lit("few").alias("k"), F.col("id").cast("double").alias("v"))
    data = hot.union(tied).union(few).repartition(7)
    names = ["a", "b", "c"]
    plain = rows(exact_quantiles(data, ["k"], "v", probs, names, split=False), "k")
    split = rows(exact_quantiles(data, ["k"], "v", probs, names, split=True), "k")
    for x, y in zip(plain, split, strict=True):
        assert x["k"] == y["k"]
        assert [x[n] for n in names] == pytest.approx([y[n] for n in names], abs=1e-9)


def test_approx_sla_is_close(spark, views):
    exact = rows(sla.service_sla(views.telemetry), "service_name")
    approx = rows(sla.service_sla_approx(views.telemetry), "service_name")
    for x, y in zip(exact, approx, strict=True):
        assert x["total_requests"] == y["total_requests"]
        assert y["latency_p50_ms"] <= y["latency_p95_ms"] <= y["latency_p99_ms"]
        assert x["latency_p50_ms"] == pytest.approx(y["latency_p50_ms"], rel=0.2)


def test_split_ranks_equal_windows(spark):
    data = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.col("id").alias("seq"),
        (F.col("id") * 37 % 11).alias("score"),
    )
    plain = rows(arrival_rank(data, ["k"], "seq", "r", split=False), "seq")
    split = rows(arrival_rank(data.repartition(5), ["k"], "seq", "r", slice_rows=100, split=True), "seq")
    assert plain == split
    order = [F.col("score").desc(), F.col("seq")]
    plain = rows(ordered_rank(data, ["k"], order, "r", split=False), "seq")
    split = rows(ordered_rank(data.repartition(5), ["k"], order, "r", split=True, slices=13), "seq")
    assert plain == split


def test_partition_known_values(spark):
    names = {"api-gateway": 3, "rag-retrieval": 3, "auth-service": 1, "db-writer": 0}
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r["s"]: r["p"] for r in df.select("s", md5_modulo(F.col("s"), 4).alias("p")).collect()}
    assert got == names


GOOD = '{"event_id":"e1","service_name":"s","cpu_percent":45.0,"memory_percent":"60.5","latency_ms":32.4,"status_code":200}'


def test_validation_reports_every_field(spark):
    payloads = [
        (1, GOOD),
        (2, GOOD.replace("45.0", "150")),
        (3, GOOD.replace("32.4", "-5").replace("200", "700")),
        (4, '{"event_id":"e1","service_name":"s"}'),
        (5, '"just text"'),
        (6, GOOD.replace("200", "200.5")),
        (7, GOOD.replace("45.0", '"NaN"')),
        (8, "[1, 2]"),
        (9, "{broken"),
    ]
    df = spark.createDataFrame(payloads, "seq int, payload string")
    dlq = {r["seq"]: r for r in validation.dead_letters(df).collect()}
    assert sorted(dlq) == [2, 3, 4, 5, 6, 7, 8, 9]
    assert dlq[2]["reason"] == "1 validation error(s): cpu_percent less_than_equal"
    assert [e["field"] for e in dlq[3]["errors"]] == ["latency_ms", "status_code"]
    assert len(dlq[4]["errors"]) == 4
    assert dlq[5]["error_type"] == "TypeError" and dlq[2]["error_type"] == "ValidationError"
    assert dlq[6]["reason"].endswith("status_code int_parsing")
    assert dlq[7]["reason"].endswith("cpu_percent greater_than_equal")
    assert dlq[8]["error_type"] == "TypeError" and dlq[9]["error_type"] == "TypeError"
    valid = rows(validation.valid_rows(df, as_of=F.lit("2024-01-01").cast("timestamp")))
    assert [r["seq"] for r in valid] == [1] and valid[0]["memory_percent"] == 60.5
    assert valid[0]["metadata"] == {} and valid[0]["event_time"] is not None


def test_types_times_and_metadata(spark):
    add = lambda more: GOOD[:-1] + "," + more + "}"
    payloads = [
        (1, add('"timestamp":"garbage"')),
        (2, add('"metadata":"oops"')),
        (3, GOOD.replace('"e1"', "5")),
        (4, add('"timestamp":"2024-01-01T10:00:00+05:30","metadata":{"a":1}')),
        (5, add('"timestamp":1704067200000')),
        (6, add('"timestamp":null')),
        (7, add('"timestamp":{}')),
        (8, add('"metadata":null')),
        (9, add('"timestamp":"2024-01-01"')),
        (10, add('"timestamp":"2024-13-01"')),
    ]
    df = spark.createDataFrame(payloads, "seq int, payload string")
    broken = {r["seq"]: [(e["field"], e["rule"]) for e in r["errors"]] for r in validation.dead_letters(df).collect()}
    assert broken == {
        1: [("timestamp", "datetime_parsing")],
        2: [("metadata", "dict_type")],
        3: [("event_id", "string_type")],
        6: [("timestamp", "datetime_type")],
        7: [("timestamp", "datetime_type")],
        8: [("metadata", "dict_type")],
        10: [("timestamp", "datetime_parsing")],
    }
    shown = validation.valid_rows(df).select("seq", F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("t"), "metadata")
    got = {r["seq"]: (r["t"], r["metadata"]) for r in shown.collect()}
    assert got == {
        4: ("2024-01-01 04:30", {"a": "1"}),
        5: ("2024-01-01 00:00", {}),
        9: ("2024-01-01 00:00", {}),
    }


def test_diagnose_lists_are_bounded(spark):
    body = '{"service_name":"s","observed_latency_ms":1,"error_logs":%s}'
    many = "[" + ",".join(['{"m":1}'] * 101) + "]"
    payloads = [(1, body % "[]"), (2, body % many), (3, body % '"x"'), (4, body % many.replace('{"m":1},', "", 1))]
    df = spark.createDataFrame(payloads, "seq int, payload string")
    found = validation.checked(df, validation.DIAGNOSE_PROFILE).collect()
    assert {r["seq"]: [e["rule"] for e in r["errors"]] for r in found} == {
        1: [], 2: ["too_long"], 3: ["list_type"], 4: [],
    }


def test_api_profile_is_stricter(spark):
    df = spark.createDataFrame(
        [
            (1, GOOD),
            (2, GOOD.replace("32.4", "600001")),
            (3, GOOD.replace("32.4", "1e309")),
            (4, GOOD.replace('"service_name":"s"', '"service_name":""')),
        ],
        "seq int, payload string",
    )
    topic_ok = {r["seq"] for r in validation.valid_rows(df).collect()}
    api = validation.checked(df, validation.API_PROFILE).where(validation.is_valid())
    assert topic_ok == {1, 2, 3, 4}
    assert {r["seq"] for r in api.collect()} == {1}


def test_request_profiles(spark):
    df = spark.createDataFrame(
        [(1, '{"query":""}'), (2, '{"query":"q","top_k":11}'), (3, '{"query":"q"}')], "seq int, payload string"
    )
    ok = validation.checked(df, validation.SEARCH_PROFILE).where(validation.is_valid())
    assert [r["seq"] for r in ok.collect()] == [3]


def test_replay_tries_each_record_once(spark):
    df = spark.createDataFrame(
        [(1, GOOD.replace("45.0", "150")), (2, '"text"'), (3, GOOD.replace("200", "700"))], "seq int, payload string"
    )
    dlq = validation.dead_letters(df).withColumn(
        "raw_payload", F.replace("raw_payload", F.lit("700"), F.lit("503"))
    )
    got = rows(validation.replay_dead_letters(dlq), "seq")
    assert [r["resolved"] for r in got] == [False, False, True]
    assert got[1]["message"] == validation.NOT_REPLAYABLE
    assert got[2]["message"].startswith("Event accepted into partition")


def test_lag_before_and_after_commit(spark):
    data = spark.createDataFrame([(i, f"svc-{i % 2}") for i in range(10)], "seq bigint, service_name string")
    marks = topic.high_watermarks(topic.with_partition(data))
    assert marks.count() == 4 and marks.agg(F.sum("high_watermark")).first()[0] == 10
    none = marks.select(F.lit("g").alias("group_id"), "partition", F.lit(0).alias("committed"))
    before = topic.group_lag(topic.consumer_lag(marks, none)).first()
    assert before["total_lag"] == 10 and not before["zero_lag_verified"]
    done = marks.select(F.lit("g").alias("group_id"), "partition", F.col("high_watermark").alias("committed"))
    after = topic.group_lag(topic.consumer_lag(marks, done)).first()
    assert after["total_lag"] == 0 and after["zero_lag_verified"]


def test_offsets_split(spark):
    data = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 2).cast("int").alias("partition"))
    assert rows(topic.with_offsets(data, split=True), "seq") == rows(topic.with_offsets(data, split=False), "seq")


INCIDENTS = [
    ("T1", "a", "p1", "2026-01-01 10:00:00", "2026-01-01 10:10:00", 1),
    ("T2", "b", " P2 ", "2026-01-01T10:00:00", "2026-01-01T11:30:00", 2),
    ("T3", "c", "P3", "2026-01-01 10:00:00", "2026-01-01 11:00:00", 3),
    ("T4", "c", "P4", "bad", "2026-01-01 11:00:00", 4),
    (None, "c", "P4", "2026-01-01", "2026-01-01", 5),
    ("T1", "a", "P1", "2026-01-01 10:00:00", "2026-01-01 10:20:00", 6),
    ("T1", "a", "P1", "2026-01-01 10:00:00", None, 7),
]
INCIDENT_SCHEMA = "ticket_id string, service_name string, severity string, started_at string, resolved_at string, seq int"


def test_staging_and_mart(spark):
    feed = spark.createDataFrame(INCIDENTS, INCIDENT_SCHEMA)
    latest = incidents.upsert_incidents(feed)
    assert latest.count() == 5 and incidents.reject_incidents(feed).first()["missing"] == "resolved_at"
    staged = {r["ticket_id"]: r for r in incidents.stage_incidents(latest).collect()}
    assert None not in staged
    assert staged["T1"]["duration_minutes"] == 20.0 and staged["T1"]["is_sla_breached"] == 1
    assert staged["T2"]["sla_target_minutes"] == 60 and staged["T2"]["is_sla_breached"] == 1
    assert staged["T3"]["is_sla_breached"] == 0
    assert staged["T4"]["duration_minutes"] is None and staged["T4"]["is_sla_breached"] == 0
    mart = {r["service_name"]: r for r in incidents.service_reliability(incidents.stage_incidents(latest)).collect()}
    assert mart["c"]["reliability_tier"] == "ACCEPTABLE" and mart["c"]["mttr_minutes"] == 60.0
    assert mart["b"]["reliability_tier"] == "SLA_BREACH_RISK"


def test_null_mttr_is_a_risk(spark):
    feed = spark.createDataFrame([("T", "x", "P3", "bad", "bad", 1)], INCIDENT_SCHEMA)
    row = incidents.service_reliability(incidents.stage_incidents(feed)).first()
    assert row["mttr_minutes"] is None and row["reliability_tier"] == "SLA_BREACH_RISK"


def test_gates(spark):
    good = spark.createDataFrame([("a", 99.9), ("b", 99.5)], "service_name string, availability_sla double")
    mart = spark.createDataFrame([("a", 25.0), ("b", 40.0)], "service_name string, mttr_minutes double")
    passed = gates.sla_gate(good, mart)
    assert passed.first()["status"] == "PASSED" and passed.first()["evaluated_services_count"] == 2
    gates.require_passed(passed)
    bad = spark.createDataFrame([("a", 98.2)], "service_name string, availability_sla double")
    slow = spark.createDataFrame([("b", 85.0)], "service_name string, mttr_minutes double")
    failed = gates.sla_gate(bad, slow)
    text = failed.first()["violations"]
    assert text == (
        "SLA Gates Failed: Availability SLA Breach on 'a': 98.20% < 99.00% | MTTR SLA Breach on 'b': 85.0m > 60.0m"
    )
    with pytest.raises(gates.SLABreach, match="98.20%"):
        gates.require_passed(failed)
    published = gates.publish_status(failed, F.lit("now")).first()
    assert published["status"] == "SLA_BREACH" and published["gate_status"] == "FAILED"
    no_column = spark.createDataFrame([("a",)], "service_name string")
    assert gates.sla_gate(no_column, no_column).first()["status"] == "PASSED"


def test_gate_texts_round_by_binary_value(spark):
    values = [119.55, 60.25, 60.75, 119.95, 60.05, 1234567.35, 61.0, 2.0**60]
    mart = spark.createDataFrame([(str(v), v) for v in values], "service_name string, mttr_minutes double")
    got = {r.service_name: r.violation for r in gates.mttr_violations(mart).collect()}
    assert got == {str(v): f"MTTR SLA Breach on '{v}': {v:.1f}m > 60.0m" for v in values}
    shares = [79.125, 0.0, 98.995, 98.9949, 0.005, 1e-12, 80.375, -0.001]
    sla = spark.createDataFrame([(str(v), v) for v in shares], "service_name string, availability_sla double")
    got = {r.service_name: r.violation for r in gates.availability_violations(sla).collect()}
    assert got == {str(v): f"Availability SLA Breach on '{v}': {v:.2f}% < 99.00%" for v in shares}


def test_daily_run(spark, tmp_path):
    events = scan_telemetry(spark)
    assert events.count() == 2
    feed = spark.createDataFrame(INCIDENTS[:3], INCIDENT_SCHEMA)
    run = run_daily(events, feed, str(tmp_path), F.lit("2026-01-01"))
    assert run.metrics.count() == 2 and run.gate.first()["status"] == "FAILED"
    assert spark.table("fct_service_reliability").count() == 3


def test_log_lines_round_trip(spark, tmp_path):
    line = '{"ts":"t","level":"INFO","logger":"l","message":"m","status":200,"path":"/x"}'
    (tmp_path / "a.txt").write_text(line + "\n")
    df = scan_payloads(spark, str(tmp_path))
    parsed = logs.parse_lines(df, "payload")
    row = parsed.first()
    assert row["request_id"] == "-" and row["extras"] == {"status": "200", "path": "/x"}
    again = logs.parse_lines(logs.format_lines(parsed, "line").select("line"), "line").first()
    assert again["extras"] == row["extras"] and again["message"] == "m"


def test_sanitize_arrays(spark):
    df = spark.createDataFrame([([1.0, float("inf"), float("nan")],)], "xs array<double>")
    row = logs.sanitize_nonfinite(df, ["xs"]).first()
    assert row["xs"] == [1.0, None, None] and row["xs_text"] == [None, "inf", "nan"]


def test_runs(spark):
    logged = spark.createDataFrame(
        [("r", {"a": "1"}, {"m": 1.0}, None, 1), ("r", {"a": "2"}, {"m": 2.0}, None, 2)],
        "run_name string, params map<string,string>, metrics map<string,double>, tags map<string,string>, seq int",
    )
    latest = runs.latest_runs(logged)
    assert runs.get_run(latest, "r").first()["metrics"] == {"m": 2.0}
    assert runs.get_run(latest, "r").first()["tags"] == {}
    assert runs.get_run(latest, "x").count() == 0


def test_expected_small_sides_are_counted(spark, views, monkeypatch):
    from opsloom.operators import anomaly, httpmetrics
    from opsloom.plans import sizing

    def results():
        scored = anomaly.zscore_score(views.telemetry, anomaly.baseline_stats(views.telemetry))
        limited = httpmetrics.fixed_window_limit(views.access_log, limit=2, period="day")
        return rows(scored.select("seq", "scores"), "seq"), rows(limited.select("event_id", "answer"), "event_id")

    small = results()
    monkeypatch.setattr(sizing, "planned_bytes", lambda df: None)
    side = sizing.small_side(spark.range(10))
    assert "ResolvedHint" in side._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in sizing.small_side(spark.range(10), rows=9)._jdf.queryExecution().analyzed().toString()
    assert results() == small


def test_runs_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r}); import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(e.queries()['rolling_baseline_ingest'](s, '/root/testdata/sf0.001').count())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 0, done.stderr[-2000:]
