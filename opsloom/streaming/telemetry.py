"""Telemetry streams: validation with two sinks, adaptive scoring and windowed SLA rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom.operators.anomaly import METRICS, SCORED_SCHEMA, RollingWindow, fold_events, scored_frame, shown
from opsloom.operators.sla import service_sla_approx
from opsloom.operators.validation import TOPIC_PROFILE, dead_letters, valid_rows

WATERMARK = "10 minutes"


def route_payloads(
    payloads: DataFrame, topic_path: str, dlq_path: str, checkpoint: str, profile=TOPIC_PROFILE
) -> StreamingQuery:
    """Writes valid rows and dead letters of a payload stream to two tables.

    Each micro-batch replaces its own folder, so a batch that is retried after a failure
    leaves no duplicates. ``payloads`` has ``payload`` and ``ts`` (arrival time).
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            valid_rows(batch, profile, as_of=F.col("ts")).write.mode("overwrite").parquet(
                f"{topic_path}/batch={batch_id}"
            )
            dead_letters(batch, profile).write.mode("overwrite").parquet(f"{dlq_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        payloads.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _score_batch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    window = RollingWindow(state.get[0] if state.exists else None)
    batch = pd.concat(list(frames)).sort_values("seq", kind="stable")
    rows = fold_events(window, batch[list(METRICS)].to_numpy(dtype=float))
    state.update((window.state(),))
    yield scored_frame(key[0], batch["seq"].to_numpy(), rows)


def rolling_ingest_stream(events: DataFrame, seq: str = "seq") -> DataFrame:
    """The adaptive rolling detector with the window of each service as keyed state.

    State is at most one window of samples per service. Inside a micro-batch events are
    taken in ``seq`` order; across micro-batches arrival decides. ``rolling_ingest_in_order``
    takes events with a time in their order however they arrive.
    """
    rows = events.select(
        "service_name", F.col(seq).cast("bigint").alias("seq"), *[F.col(m).cast("double").alias(m) for m in METRICS]
    )
    scored = rows.groupBy("service_name").applyInPandasWithState(
        _score_batch, SCORED_SCHEMA, "state array<double>", "append", GroupStateTimeout.NoTimeout
    )
    return shown(scored)


STATE = "window array<double>, ts array<long>, seq array<long>, metrics array<double>"


def _score_in_order(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes new rows into the buffer and folds what the watermark has passed, oldest first.

    The buffer grows frame by frame as plain arrays: what is held is the window, and the rows
    that late ones may still precede.
    """
    window, ts, seq, metrics = state.get if state.exists else (None, [], [], [])
    held = [(np.array(ts, np.int64), np.array(seq, np.int64), np.array(metrics).reshape(-1, len(METRICS)))]
    if not state.hasTimedOut:
        for frame in frames:
            values = frame[list(METRICS)].to_numpy(dtype=float)
            held.append((frame["at"].to_numpy(np.int64), frame["seq"].to_numpy(np.int64), values))
    ts, seq, metrics = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.lexsort((seq, ts))
    ts, seq, metrics = ts[order], seq[order], metrics[order]
    ready = int(np.searchsorted(ts, state.getCurrentWatermarkMs() * 1000))
    rolling = RollingWindow(window)
    if ready:
        rows = fold_events(rolling, metrics[:ready])
        yield scored_frame(key[0], seq[:ready], rows)
        window = rolling.state()
    state.update((window, ts[ready:].tolist(), seq[ready:].tolist(), metrics[ready:].ravel().tolist()))
    if ready < len(ts):
        state.setTimeoutTimestamp(max(int(ts[ready]) // 1000, state.getCurrentWatermarkMs()) + 1)


def rolling_ingest_in_order(events: DataFrame, seq: str = "seq", watermark: str = WATERMARK) -> DataFrame:
    """The adaptive rolling detector over a stream whose rows may arrive out of order.

    Each service's rows wait until the watermark has passed their ``ts`` and are taken in the
    order of (``ts``, ``seq``): any order of arrival within the watermark gives the rows of the
    batch form. Rows that come later than that, or without a time, are dropped by the
    watermark. State is one window of samples and the waiting rows of the service.
    """
    rows = events.where("ts is not null").withWatermark("ts", watermark).select(
        "service_name",
        "ts",
        F.unix_micros("ts").alias("at"),
        F.col(seq).cast("bigint").alias("seq"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
    )
    scored = rows.groupBy("service_name").applyInPandasWithState(
        _score_in_order, SCORED_SCHEMA, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return shown(scored)


def sla_windows(events: DataFrame, window: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """SLA rows per service and window from mergeable sketches; late rows are dropped."""
    timed = events.withWatermark("ts", watermark).withColumn("window", F.window("ts", window))
    rows = service_sla_approx(timed, ["service_name", "window"])
    return rows.withColumn("window_start", F.col("window.start")).drop("window")
