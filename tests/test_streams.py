"""Streams that keep order and time: alert rules, the ordered detector, decisions before tickets."""

import datetime
import random

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsloom.operators import anomaly, httpmetrics, remediation
from opsloom.streaming import alerts
from opsloom.streaming.decisions import decision_answers_stream
from opsloom.streaming.telemetry import rolling_ingest_in_order

START = datetime.datetime(2026, 3, 1, tzinfo=datetime.timezone.utc)


def written(frames, path):
    """Each frame as one file, in this order of arrival."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(path))


def read(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(path))


def drained(spark, df, out, checkpoint):
    query = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint))
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query, spark.read.schema(df.schema).parquet(str(out))


def access_log(spark):
    """Two hours with failing, slow and limited stretches and silences; arrival a little out of order."""
    draw = random.Random(3)
    found = []
    for second in range(0, 7200, 2):
        minute = second // 60
        if minute in (30, 31, 32, 33, 34, 35, 36, 80) or 90 <= minute < 105:
            continue
        bad, slow, limited = 5 <= minute < 16, 40 <= minute < 70, 45 <= minute < 75
        for _ in range(6 if limited else 1):
            status = 500 if bad and draw.random() < 0.5 else 429 if limited and draw.random() < 0.9 else 200
            severity = "CRITICAL" if 60 <= minute < 63 and draw.random() < 0.05 else "NORMAL"
            endpoint = draw.choice(["/v1/rag/search", "/v1/eval/chaos"])
            at = START + datetime.timedelta(seconds=second, microseconds=draw.randrange(2_000_000))
            duration = draw.uniform(0.6, 2.0) if slow or "eval" in endpoint else draw.uniform(0.0, 0.4)
            found.append((at, endpoint, status, duration, severity))
    # A row at a whole step, and rows later on that let the watermark pass.
    found.append((START + datetime.timedelta(minutes=20), "/", 200, 0.1, "NORMAL"))
    late = [(START + datetime.timedelta(hours=h), "/", 200, 0.1, "NORMAL") for h in (4, 5)]
    return found, late


LOG = "ts timestamp, endpoint string, status_code int, duration_s double, severity string"


@pytest.mark.parametrize("name", list(alerts.rules()))
def test_alert_stream_equals_batch(spark, tmp_path, name):
    found, later = access_log(spark)
    rule, batch_log = alerts.rules()[name], spark.createDataFrame(found + later[:1], LOG)
    batch = {
        "error_rate": httpmetrics.error_rate_rule,
        "high_latency": httpmetrics.latency_rule,
        "rate_limited": httpmetrics.rate_limited_rule,
        "target_down": httpmetrics.target_down,
        "critical_anomalies": lambda log: httpmetrics.alert_streaks(
            httpmetrics.critical_anomalies(log), F.col("alert"), httpmetrics.MINUTE, 0
        ),
    }[name](batch_log)
    order = sorted(found, key=lambda r: r[0].timestamp() + random.Random(str(r[0])).uniform(0, 240))
    parts = [order[i : i + 4000] for i in range(0, len(order), 4000)]
    # Far too late for any watermark.
    parts += [later[:1], [(START, "/", 500, 9.0, "CRITICAL")], later[1:]]
    written([spark.createDataFrame(p, LOG) for p in parts], tmp_path / "log")
    first, steps = drained(
        spark, alerts.step_sums(read(spark, tmp_path / "log", LOG), rule), tmp_path / "steps", tmp_path / "c1"
    )
    assert alerts.rows_dropped_late(first) == 1
    second, out = drained(
        # The first query's tasks write a file each, which belong together.
        spark, alerts.alert_stream(read(spark, tmp_path / "steps", steps.schema, 1000), rule), tmp_path / "out", tmp_path / "c2"
    )
    closed = out.where("event = 'closed'").select("started", "ended", "steps", "state", "firing_from")
    want = batch.select("started", "ended", "steps", "state", "firing_from")
    assert rows(closed, "started") == rows(want, "started") and closed.count() > 0
    fired = out.where("event = 'firing'")
    assert rows(fired.select("started", "firing_from"), "started") == rows(
        want.where("state = 'firing'").select("started", "firing_from"), "started"
    )
    assert out.where("late > 0").isEmpty()


def test_target_down_fires_while_it_is_silent(spark, tmp_path):
    """One target goes silent; the other's rows move the time, and the alert does not wait for its return."""
    step = 2 * httpmetrics.MINUTE
    t0 = 1_800_000_000_000_000 // step * step
    rule = alerts.rules()["target_down"]
    schema = "target string, t long, requests double"
    batches = [[("a", t0, 1.0), ("b", t0, 1.0)]] + [[("b", t0 + i * step, 1.0)] for i in range(1, 8)]
    written([spark.createDataFrame(b, schema) for b in batches], tmp_path / "steps")
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "steps"))
    _, out = drained(spark, alerts.alert_stream(frame, rule, ["target"]), tmp_path / "out", tmp_path / "c")
    (row,) = out.collect()
    assert (row.target, row.event, row.started, row.firing_from) == ("a", "firing", t0 + step, t0 + 2 * step)


def test_machine_counts_rows_that_come_too_late():
    machine = alerts.Machine(alerts.rules()["rate_limited"], None)
    minute = httpmetrics.MINUTE
    for t in (minute, 3 * minute, 2 * minute):
        machine.row(t, (0.0,))
    again = alerts.Machine(machine.rule, machine.state())
    assert again.late == 1 and again.state() == machine.state()


SCHEMA = "service_name string, seq long, ts timestamp, cpu_percent double, memory_percent double, latency_ms double"


def test_ordered_detector_equals_batch(spark, tmp_path):
    draw = random.Random(9)
    events = [
        (draw.choice(["a", "b"]), i, START + datetime.timedelta(seconds=20 * i), draw.gauss(40, 5), draw.gauss(50, 5),
         draw.gauss(120, 10) if draw.random() < 0.97 else 900.0)
        for i in range(700)
    ]
    # Arrival up to eight minutes late, within the watermark of ten.
    arrival = sorted(events, key=lambda e: e[1] * 20 + draw.uniform(0, 480))
    assert [e[1] for e in arrival] != list(range(700))
    last = [("z", 10_000, START + datetime.timedelta(days=1), 1.0, 1.0, 1.0), ("z", 10_001, START + datetime.timedelta(days=2), 1.0, 1.0, 1.0)]
    parts = [arrival[i : i + 100] for i in range(0, 700, 100)] + [last[:1], last[1:]]
    written([spark.createDataFrame(p, SCHEMA) for p in parts], tmp_path / "in")
    stream = rolling_ingest_in_order(read(spark, tmp_path / "in", SCHEMA))
    _, got = drained(spark, stream, tmp_path / "out", tmp_path / "c")
    want = anomaly.rolling_ingest(spark.createDataFrame(events, SCHEMA))
    assert rows(got.where("service_name <> 'z'"), "seq") == rows(want, "seq")


def test_streamed_decisions_get_the_batch_answers(spark, tmp_path):
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    decided = "ticket_id long, seq long, approved boolean, reviewer string, ts timestamp"
    plan = "ticket_id long, service_name string, action_type string, action_status string, ts timestamp"
    # Before its ticket, repeated out of order, for an unknown id, for a ticket without an action.
    decisions = [
        [(1, 10, True, "a", at(0)), (2, 12, False, "b", at(1))],
        [(2, 11, None, None, at(2)), (3, 13, True, "c", at(3)), (4, 14, True, "d", at(3)), (2, 15, True, "e", at(4))],
        [(99, 16, True, None, at(300))],
        [(98, 17, True, None, at(600))],
    ]
    tickets = [[(2, "s", "rollback", "pending", at(0))], [(1, "s", "rollback", "pending", at(5)), (4, "s", None, None, at(5))], [(97, "s", None, None, at(300))], [(96, "s", None, None, at(600))]]
    written([spark.createDataFrame(d, decided) for d in decisions], tmp_path / "decisions")
    written([spark.createDataFrame(t, plan) for t in tickets], tmp_path / "tickets")
    stream = decision_answers_stream(
        read(spark, tmp_path / "decisions", decided), read(spark, tmp_path / "tickets", plan)
    )
    _, got = drained(spark, stream, tmp_path / "out", tmp_path / "c")
    planned = spark.createDataFrame([t for part in tickets for t in part], plan)
    batch = remediation.decision_answers(planned, spark.createDataFrame([d for part in decisions for d in part], decided))
    columns = ["ticket_id", "seq", "approved", "reviewer", "answer"]
    closed = [r for r in rows(batch.select(*columns), "seq") if r["ticket_id"] < 90]
    assert [r["answer"] for r in closed] == [200, 200, 409, 404, 409, 409]
    assert [r for r in rows(got.select(*columns), "seq") if r["ticket_id"] < 90] == closed
