"""Stored forms that grow by what is new: the topic log, keyed tables, status rows, sketches."""

import random

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsloom.operators import incidents, sla, topic
from opsloom.sources.keyed import KeyedTable
from opsloom.sources.sinks import append_status
from opsloom.sources.topiclog import TopicLog


def messages(spark, first, n):
    return spark.range(first, first + n).select(
        F.concat(F.lit("svc-"), (F.col("id") % 9).cast("string")).alias("service_name"),
        F.col("id").alias("seq"),
        F.md5(F.col("id").cast("string")).alias("body"),
    )


def test_topic_log_polls_only_wanted_segments(spark, tmp_path):
    log = TopicLog(spark, str(tmp_path / "topic"), segment_rows=50)
    assert [r["high_watermark"] for r in rows(log.high_watermarks(), "partition")] == [0] * 4
    none = spark.createDataFrame([], "partition int, current long")
    assert log.poll(none).isEmpty()
    for batch, (first, n) in enumerate([(0, 700), (700, 1), (701, 900)]):
        assert log.append(messages(spark, first, n).repartition(3), batch)
    assert not log.append(messages(spark, 701, 900), 2)
    whole = topic.with_offsets(topic.with_partition(messages(spark, 0, 1601)))
    marks = topic.high_watermarks(whole)
    assert rows(log.high_watermarks(), "partition") == rows(marks, "partition")
    positions = marks.where("partition <> 1").select("partition", F.floor(F.col("high_watermark") / 2).alias("current"))
    polled = log.poll(positions, 60)
    columns = ["partition", "offset", "seq", "service_name", "body"]
    want = topic.read_range(whole, positions, 60)
    assert rows(polled.select(*columns), "partition", "offset") == rows(want.select(*columns), "partition", "offset")
    # 60 offsets touch at most three segments of 50 in each partition, of more than 30 there are.
    read = {f.rsplit("/part-", 1)[0] for f in polled.inputFiles()}
    every = log.index().select("batch", "partition", "segment").distinct().count()
    assert len(read) <= 4 * 3 + 2 and every > 30
    at = {(f.split("partition=")[1].split("/")[0], int(f.split("segment=")[1])) for f in read}
    current = {str(r["partition"]): r["current"] for r in positions.collect()}
    assert all((current.get(p, 0)) // 50 <= s <= (current.get(p, 0) + 59) // 50 for p, s in at)


def test_topic_log_appends_rank_only_new_rows(spark, tmp_path, monkeypatch):
    seen = []
    real = topic.with_offsets
    monkeypatch.setattr("opsloom.sources.topiclog.with_offsets", lambda df, seq: seen.append(df.count()) or real(df, seq))
    log = TopicLog(spark, str(tmp_path / "topic"))
    for batch, (first, n) in enumerate([(0, 300), (300, 20)]):
        log.append(messages(spark, first, n), batch)
    assert seen == [300, 20]


INCIDENTS = "ticket_id string, service_name string, severity string, started_at string, resolved_at string, seq long"


def arrivals(draw, first, n, ids):
    return [(f"T{draw.randrange(ids)}", "svc", draw.choice(["P1", "P2"]), f"2026-01-0{draw.randrange(1, 9)}", None, first + i) for i in range(n)]


def test_keyed_table_merges_touched_buckets(spark, tmp_path):
    draw = random.Random(4)
    table = KeyedTable(spark, str(tmp_path / "incidents"), INCIDENTS, "ticket_id", "seq", buckets=8)
    assert table.read().count() == 0
    every = []
    for batch in range(3):
        new = arrivals(draw, batch * 1000, 200, 90)
        # What arrives late has a smaller seq and must not win.
        new += arrivals(draw, -1000 - batch, 20, 90)
        every += new
        assert table.merge(spark.createDataFrame(new, INCIDENTS), f"day-{batch}")
    latest = {}
    for row in sorted(every, key=lambda r: r[-1]):
        latest[row[0]] = row
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(latest.values(), key=str)
    before = table.state()
    one = spark.createDataFrame([("T1", "svc", "P3", "x", None, 10_000), (None, "svc", "P3", "x", None, 1)], INCIDENTS)
    assert table.merge(one, "day-3") and not table.merge(one, "day-3")
    after = table.state()
    assert sum(before["folders"][b] != f for b, f in after["folders"].items()) == 1
    assert table.read().where("ticket_id = 'T1'").first()["severity"] == "P3"
    assert after["number"] == before["number"] + 1
    # The same rows as the batch form gives.
    complete = [r for r in [*every, ("T1", "svc", "P3", "x", None, 10_000)]]
    filled = [(*r[:4], "y", r[5]) for r in complete]
    batch = incidents.upsert_incidents(spark.createDataFrame(filled, INCIDENTS))
    assert {r["ticket_id"]: r["severity"] for r in batch.collect()} == {r["ticket_id"]: r["severity"] for r in table.read().collect()}


def test_keyed_table_refuses_a_second_writer(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k string, seq long", "k", "seq")
    state = table.state()
    table.merge(spark.createDataFrame([("a", 1)], "k string, seq long"), "one")
    with pytest.raises(RuntimeError, match="another merge"):
        table._publish(state | {"number": 1})
    assert table.read().count() == 1


def test_status_of_a_repeated_run_stays_one_row(spark, tmp_path):
    path = str(tmp_path / "status")
    for run, status in (("mon", "PUBLISHED"), ("tue", "SLA_BREACH"), ("mon", "PUBLISHED")):
        append_status(spark.createDataFrame([(status,)], "status string"), path, run)
    assert [(r["run"], r["status"]) for r in rows(spark.read.parquet(path), "run")] == [("mon", "PUBLISHED"), ("tue", "SLA_BREACH")]


def test_stored_sketches_roll_up_within_their_bound(spark, tmp_path, views):
    """A month of daily rows, written and read again, gives the counts exactly and quantiles in bound."""
    events = views.telemetry
    sla.sla_sketches(events).write.parquet(str(tmp_path / "days"))
    rolled = sla.rolled_up(spark.read.parquet(str(tmp_path / "days")))
    exact = sla.service_sla(events)
    plain = [c for c in sla.SLA_COLUMNS if not c.startswith("latency")]
    assert rows(rolled.select(*plain), "service_name") == rows(exact.select(*plain), "service_name")
    close = sla.approx_within_bound(events, rolled, 1 / sla.SKETCH_RANK_ERROR)
    assert all(all(v for k, v in r.items() if k.endswith("_close")) for r in rows(close, "service_name"))
    assert close.count() == exact.count()
    silent = spark.createDataFrame(
        [("s", None, 200, 1.0, None, "2026-01-01")], "service_name string, latency_ms double, status_code int, cpu_percent double, memory_percent double, ts string"
    )
    (row,) = sla.rolled_up(sla.sla_sketches(silent)).collect()
    assert row.total_requests == 1 and row.latency_p50_ms is None and row.avg_memory_percent is None


def test_a_written_step_leaves_no_shuffle_files(spark):
    """Files of a step's shuffles go at its end, not when the driver happens to collect garbage."""
    import time

    from opsloom.plans.durable import FREE_SHUFFLES, stored

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        found = blocks.getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "shuffle_" in f}

    rows = spark.range(20_000).selectExpr("id % 1000 as k", "id")
    before = shuffles()
    got = stored(rows.repartition(5, "k").groupBy("k").count(), "step")
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before
    assert got.count() == 1000 and got.agg({"count": "sum"}).first()[0] == 20_000
    assert spark.conf.get(FREE_SHUFFLES, "false") == "false"
