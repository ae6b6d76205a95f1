"""Anomaly detectors: golden sequences, split forms, forest properties, stream equals batch."""

import random

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from opsloom.operators import anomaly, httpmetrics, iforest
from opsloom.plans.sizing import planned_bytes
from opsloom.streaming.decisions import accepted_decisions
from opsloom.streaming.http import request_rate_stream
from opsloom.streaming.telemetry import rolling_ingest_stream, route_payloads, sla_windows

SCHEMA = "service_name string, seq bigint, cpu_percent double, memory_percent double, latency_ms double"


def events(spark, latencies, memory=lambda i: 40.0, service="s"):
    return spark.createDataFrame(
        [(service, i, 31.0, float(memory(i)), float(x)) for i, x in enumerate(latencies)], SCHEMA
    )


def warmup(n=20):
    return [40 + i % 5 for i in range(n)]


@pytest.mark.parametrize("split", [False, True])
def test_warmup_then_normal_then_spike(spark, split):
    df = events(spark, [*warmup(), 43, 99999, 43])
    got = rows(anomaly.rolling_ingest(df, split=split, fold_rows=7), "seq")
    assert [r["status"] for r in got[:20]] == ["WARMING_UP"] * 20
    assert [r["baseline_events"] for r in got[:20]] == list(range(1, 21))
    normal, spike, after = got[20:]
    assert normal["status"] == "SCORED" and not normal["is_anomaly"] and normal["baseline_events"] == 21
    assert spike["is_anomaly"] and spike["severity"] == "CRITICAL" and spike["baseline_events"] == 21
    assert not after["is_anomaly"] and after["baseline_events"] == 22


@pytest.mark.parametrize("split", [False, True])
def test_unusable_readings_stay_out_of_the_window(spark, split):
    latencies = [*warmup(), float("nan"), 43, float("inf"), 9000, None]
    df = spark.createDataFrame(
        [("s", i, 31.0, 40.0, x if x is None else float(x)) for i, x in enumerate(latencies)], SCHEMA
    ).withColumn("ts", F.timestamp_seconds("seq"))
    got = rows(anomaly.rolling_ingest(df, split=split, fold_rows=7, carry=["ts"]), "seq")
    assert [r["status"] for r in got[20:]] == ["REJECTED", "SCORED", "REJECTED", "SCORED", "REJECTED"]
    assert got[20]["baseline_events"] is None and got[20]["severity"] is None
    assert got[21]["severity"] == "NORMAL" and got[21]["baseline_events"] == 21
    assert got[23]["severity"] == "CRITICAL"
    assert [r["ts"] for r in got] == [r["ts"] for r in rows(df, "seq")]


def test_memory_leak_with_normal_latency(spark):
    df = events(spark, [*warmup(), 42], memory=lambda i: 95 if i == 20 else 40 + i % 3)
    leak = rows(anomaly.rolling_ingest(df), "seq")[-1]
    assert leak["is_anomaly"] and leak["metric_name"] == "memory_percent"
    assert abs(leak["z_latency_ms"]) < 3


def test_constant_baseline_counts_deviation_as_one(spark):
    base = events(spark, [48.0] * 50)
    score = anomaly.zscore_score(events(spark, [48.0, 2500.0]), anomaly.baseline_stats(base))
    got = rows(score, "seq")
    assert not got[0]["scores"][2]["is_anomaly"]
    assert got[1]["scores"][2]["severity"] == "CRITICAL" and got[1]["scores"][2]["confidence"] == 1.0


def test_unknown_service_scores_zero(spark):
    base = anomaly.baseline_stats(events(spark, warmup()))
    got = anomaly.zscore_score(events(spark, [5000.0], service="new"), base).first()["scores"][2]
    assert got["z_score"] == 0.0 and not got["baseline_ready"] and not got["is_anomaly"]


def test_worst_metric_prefers_first_on_tie(spark):
    base = anomaly.baseline_stats(events(spark, [48.0] * 30))
    score = anomaly.zscore_score(events(spark, [48.0]), base)
    assert score.select(anomaly.worst_metric(F.col("scores")).alias("w")).first()["w"]["metric_name"] == "cpu_percent"


def test_window_keeps_newest_samples():
    window = anomaly.RollingWindow(window=3)
    for x in range(40):
        window.append([x, x, x])
    assert len(window) == 3 and window.view()[0].tolist() == [37.0, 38.0, 39.0]
    assert anomaly.RollingWindow(window.state(), window=3).view().tolist() == window.view().tolist()


def noisy(spark, n, services=3):
    jitter = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    spike = F.when(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(41)) == 0, 400.0).otherwise(0.0)
    return spark.range(n).select(
        F.concat(F.lit("svc-"), F.when(F.col("id") % 4 < 2, 0).otherwise(F.col("id") % services)).alias("service_name"),
        F.col("id").alias("seq"),
        (30 + jitter * 9).alias("cpu_percent"),
        (50 + jitter * 3).alias("memory_percent"),
        (40 + jitter * 5 + spike).alias("latency_ms"),
    )


def test_folds_of_a_hot_service_equal_one_pass(spark):
    df = noisy(spark, 6000)
    whole = rows(anomaly.rolling_ingest(df, split=False), "seq")
    folded = rows(anomaly.rolling_ingest(df.repartition(7), split=True, fold_rows=700), "seq")
    assert whole == folded
    assert sum(bool(r["is_anomaly"]) for r in whole) > 50


def test_a_change_of_level_takes_fewer_rounds_than_folds(spark, monkeypatch):
    """After the shift every event is anomalous: 16 frozen folds need no more rounds than a few."""
    def shifted(folds):
        # 900 ordinary events, then a level that the window never accepts, then the old one again.
        n = 900 + 300 * folds + 400
        level = F.when((F.col("seq") >= 900) & (F.col("seq") < n - 400), 4000.0).otherwise(0.0)
        return noisy(spark, n).withColumn("latency_ms", F.col("latency_ms") + level)

    taken = []
    real = anomaly.frozen_starts
    monkeypatch.setattr(anomaly, "frozen_starts", lambda *a: taken.append(1) or real(*a))
    df = shifted(16)
    split = rows(anomaly.rolling_ingest(df, split=True, fold_rows=300), "seq")
    assert len(taken) <= 8
    assert split == rows(anomaly.rolling_ingest(df, split=False), "seq")


def test_blocks_of_a_hot_service_equal_one_window(spark):
    df = noisy(spark, 4000)
    whole = rows(anomaly.rolling_zscore(df, split=False), "seq")
    blocks = rows(anomaly.rolling_zscore(df.repartition(5), split=True, block_rows=600), "seq")
    assert whole == blocks


def test_forest_is_deterministic_and_flags_outliers(spark):
    df = noisy(spark, 3000).cache()
    odd = spark.createDataFrame([("x", 10_000, 99.0, 99.0, 5000.0)], SCHEMA)
    train = df.unionByName(odd)
    nodes = iforest.fit_nodes(train, trees=40)
    again = iforest.fit_nodes(train.repartition(9), trees=40)
    assert rows(nodes, "tree", "node") == rows(again, "tree", "node")
    scored = iforest.score_samples(train, nodes, trees=40)
    offset = iforest.training_offset(scored)
    verdicts = iforest.forest_verdicts(scored, offset)
    share = verdicts.agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0]
    assert 0.03 <= share <= 0.07
    outlier = verdicts.where("seq = 10000").first()
    assert outlier["is_anomaly"] and outlier["severity"] == "CRITICAL"
    bounds = scored.agg(F.min("score"), F.max("score")).first()
    assert -1 < bounds[0] <= bounds[1] < 0


def test_forest_sample_of_large_input_is_bounded(spark):
    sample = iforest.training_sample(noisy(spark, 20_000), "seq", trees=4, psi=64, seed=42)
    counts = rows(sample.groupBy("tree").count(), "tree")
    assert [r["count"] for r in counts] == [64] * 4
    assert sample.select("tree", "_id").distinct().count() == 256


def test_forest_samples_differ_by_tree_at_every_size(spark):
    """One rule for small and large input: every tree draws on its own, small input goes whole."""
    few = iforest.training_sample(noisy(spark, 50), "seq", trees=3, psi=64, seed=42)
    assert [r["count"] for r in rows(few.groupBy("tree").count(), "tree")] == [50] * 3
    for n in (200, 20_000):
        many = iforest.training_sample(noisy(spark, n), "seq", trees=2, psi=64, seed=42)
        drawn = many.groupBy("tree").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
        assert drawn.select("ids").distinct().count() == 2


def test_forest_leaves_unusable_rows_unscored(spark):
    odd = spark.createDataFrame([("x", 10_000, float("nan"), 9.0, 5.0), ("x", 10_001, None, 9.0, 5.0)], SCHEMA)
    train = noisy(spark, 500).unionByName(odd)
    nodes = iforest.fit_nodes(train, trees=10)
    assert rows(nodes, "tree", "node") == rows(iforest.fit_nodes(noisy(spark, 500), trees=10), "tree", "node")
    verdicts = iforest.forest_verdicts(iforest.score_samples(train, nodes, trees=10), -0.5)
    bad = verdicts.where("seq >= 10000").collect()
    assert [(r["is_anomaly"], r["severity"], r["anomaly_score"]) for r in bad] == [(False, "NORMAL", None)] * 2


def test_unfitted_forest_falls_back_to_latency(spark):
    base = anomaly.baseline_stats(events(spark, warmup()))
    verdict = iforest.unfitted_verdicts(events(spark, [900.0]), base).first()["verdict"]
    assert verdict["metric_name"] == "latency_ms" and verdict["is_anomaly"]


def run_stream(spark, df, name):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_rolling_stream_equals_batch(spark, tmp_path):
    df = noisy(spark, 900)
    for part in range(3):
        chunk = df.where((F.col("seq") >= part * 300) & (F.col("seq") < part * 300 + 300))
        chunk.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rows(run_stream(spark, rolling_ingest_stream(stream), "scored"), "seq")
    assert got == rows(anomaly.rolling_ingest(df), "seq")


def test_payload_stream_has_two_sinks(spark, tmp_path, views):
    payloads = views.raw_payloads
    payloads.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(payloads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = route_payloads(stream, str(tmp_path / "ok"), str(tmp_path / "dlq"), str(tmp_path / "cp"))
    query.awaitTermination(180)
    ok, dlq = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "dlq"))
    assert ok.count() + dlq.count() == payloads.count() and dlq.count() > 0
    assert ok.select("seq").intersect(dlq.select("seq")).count() == 0


def test_rate_stream_equals_batch(spark, tmp_path, views):
    log = httpmetrics.with_endpoint(views.access_log)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    query = (
        request_rate_stream(stream).writeStream.outputMode("complete").format("memory")
        .queryName("rates").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    batch = httpmetrics.request_rate(log).select("endpoint", "t", "requests")
    assert rows(spark.table("rates"), "endpoint", "t") == rows(batch, "endpoint", "t")


def test_sla_window_stream_runs(spark, tmp_path, views):
    views.telemetry.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(views.telemetry.schema).parquet(str(tmp_path / "in"))
    got = run_stream(spark, sla_windows(stream), "sla_days")
    closed = got.agg(F.sum("total_requests")).first()[0]
    assert 0 < closed <= views.telemetry.count()


def test_first_streamed_decision_wins(spark, tmp_path):
    decisions = spark.sql(
        "select 1 as ticket_id, true as approved, 'a' as reviewer, timestamp'2026-01-01 00:00:00' as ts"
        " union all select 3, true, 'a', timestamp'2026-01-01 00:00:00'"
    )
    decisions.coalesce(1).write.parquet(str(tmp_path / "in"))
    decisions.withColumn("approved", F.lit(False)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    planned = spark.createDataFrame(
        [(1, "s", "rollback", "pending"), (2, "s", "rollback", "pending"), (3, "s", None, None)],
        "ticket_id int, service_name string, action_type string, action_status string",
    )
    stream = spark.readStream.schema(decisions.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(spark, accepted_decisions(stream, planned), "accepted")
    assert [r["ticket_id"] for r in got.collect()] == [1]


def test_alert_rules_hold_as_long_as_they_say(spark):
    """20 minutes of bad requests, each rule fires after its own hold; 4 minutes stay pending."""
    def log(minutes):
        n = minutes * 60 * 4
        return spark.range(n).select(
            F.timestamp_seconds(F.floor(F.col("id") / 4) + 1).alias("ts"),
            F.lit("/v1/rag/search").alias("endpoint"),
            F.when(F.col("id") % 4 == 0, 500).when(F.col("id") % 4 < 3, 429).otherwise(200).alias("status_code"),
            F.lit(0.9).alias("duration_s"),
        )

    rules = {
        httpmetrics.error_rate_rule: 5,
        httpmetrics.latency_rule: 10,
        httpmetrics.rate_limited_rule: 10,
    }
    for rule, hold in rules.items():
        (long,) = rule(log(20)).collect()
        assert long["state"] == "firing"
        assert long["firing_from"] - long["started"] == hold * httpmetrics.MINUTE
    (short,) = httpmetrics.latency_rule(log(4)).collect()
    assert short["state"] == "pending" and short["firing_from"] is None


def test_rounds_of_short_folds_do_not_grow_their_plans(spark, monkeypatch):
    draw = random.Random(5)
    rows = [("hot", i, 50 + draw.gauss(0, 1), 40 + draw.gauss(0, 1), 20 + draw.gauss(0, 1)) for i in range(900)]
    events = spark.createDataFrame(
        rows, "service_name string, seq long, cpu_percent double, memory_percent double, latency_ms double"
    )
    sizes = []
    looked = anomaly.frozen_starts

    def spy(folds, changed):
        sizes.append(planned_bytes(changed))
        return looked(folds, changed)

    monkeypatch.setattr(anomaly, "frozen_starts", spy)
    got = anomaly.rolling_ingest(events, split=True, fold_rows=150).collect()
    want = anomaly.rolling_ingest(events, split=False).collect()
    assert sorted(got, key=lambda r: r.seq) == sorted(want, key=lambda r: r.seq)
    # Each holds at most six windows of 500 events; an estimate that grows with the rounds does not end.
    assert len(sizes) > 2 and max(sizes) < 6 * 500 * 3 * 8 * 2


def test_very_many_short_folds_take_few_rounds(spark, monkeypatch):
    """Folds shorter than the window grow with their number; the rows stay those of one pass."""
    df = noisy(spark, 6000)
    rounds, lengths = [], []
    real = anomaly.frozen_starts

    def spy(folds, changed):
        rounds.append(1)
        lengths.append(max(r["count"] for r in folds.groupBy("service_name", "_chunk").count().collect()))
        return real(folds, changed)

    monkeypatch.setattr(anomaly, "frozen_starts", spy)
    monkeypatch.setattr(anomaly, "MOST_FOLDS", 4)
    split = rows(anomaly.rolling_ingest(df, split=True, fold_rows=50), "seq")
    assert split == rows(anomaly.rolling_ingest(df, split=False), "seq")
    assert len(rounds) <= 3 and set(lengths) == {1500}
