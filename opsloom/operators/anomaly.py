"""Baselines, z-scores, the adaptive rolling detector and its feedback-free variant."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from opsloom.functions.numeric import tidy
from opsloom.plans.durable import stored
from opsloom.plans.joins import match
from opsloom.plans.ranking import arrival_rank
from opsloom.plans.sizing import fits_one_task, small_side
from opsloom.session import ship_package

# Metrics in scoring order, thresholds, window and warm-up.
METRICS = ("cpu_percent", "memory_percent", "latency_ms")
Z_THRESHOLD = 3.0
CRITICAL_FACTOR = 1.5
WARMUP_EVENTS = 20
WINDOW_EVENTS = 500

# Scanned bytes up to which a service's whole history is folded in one task, and the
# events per fold beyond that.
FOLD_BYTES = 16 * 1024 * 1024
FOLD_ROWS = 200_000
# Folds from which on they are made longer than asked for, up to ``FOLD_ROWS``: each costs a window
# of its own, written in every round, and one shorter than the window never forgets its start.
MOST_FOLDS = 1024
# Events looked at between two sums of a whole window, and events scored at once while none is anomalous.
RESUMMED = 1024
SHORTEST_BLOCK = 32
LONGEST_BLOCK = 512
# Events scored at once against their windows.
SCORED_BLOCK = 64
# Running sums decide unless a score is this near the threshold, or a variance below this share
# of the greatest square: both are many times what rounding takes.
UNSURE_SCORE = 0.02
UNSURE_SPREAD = 1e-6
# Events per block of the feedback-free variant.
BLOCK_ROWS = 500_000


def baseline_stats(events: DataFrame, key: str = "service_name") -> DataFrame:
    """Mean and population deviation per metric; a zero deviation counts as 1."""
    aggs = []
    for m in METRICS:
        spread = F.stddev_pop(m)
        aggs.append(F.avg(m).alias(f"{m}_mean"))
        aggs.append(F.when(spread == 0, 1.0).otherwise(spread).alias(f"{m}_std"))
    return events.groupBy(key).agg(*aggs)


def zscore(metric: str, value: Column, mean: Column, std: Column, threshold: float = Z_THRESHOLD) -> Column:
    """The z-score verdict on one metric as a struct. Decisions use the unrounded score."""
    ready = mean.isNotNull()
    z = F.when(ready, (value - mean) / std).otherwise(0.0)
    anomalous = F.abs(z) > threshold
    severity = (
        F.when(F.abs(z) >= threshold * CRITICAL_FACTOR, "CRITICAL")
        .when(anomalous, "WARNING")
        .otherwise("NORMAL")
    )
    return F.struct(
        F.lit(metric).alias("metric_name"),
        anomalous.alias("is_anomaly"),
        F.least(F.lit(1.0), F.round(F.abs(z) / (threshold * 2), 2)).alias("confidence"),
        severity.alias("severity"),
        F.round(value, 2).alias("observed_value"),
        F.round(F.coalesce(mean, value), 2).alias("baseline_mean"),
        F.round(z, 2).alias("z_score"),
        ready.alias("baseline_ready"),
    )


def zscore_score(
    events: DataFrame, baseline: DataFrame, key: str = "service_name", threshold: float = Z_THRESHOLD
) -> DataFrame:
    """Adds ``scores``: one verdict per metric. Services without a baseline score 0."""
    joined = events.join(small_side(baseline), key, "left")
    verdicts = [
        zscore(m, F.col(m), F.col(f"{m}_mean"), F.col(f"{m}_std"), threshold) for m in METRICS
    ]
    return joined.select(*events.columns, F.array(*verdicts).alias("scores"))


def worst_metric(scores: Column) -> Column:
    """The verdict with the largest rounded score; the first metric wins a tie."""
    indexed = F.transform(
        scores, lambda s, i: F.struct(F.abs(s["z_score"]).alias("size"), (-i).alias("rank"), s.alias("s"))
    )
    return F.array_max(indexed)["s"]


def detectors_fired(scores: Column, forest_flag: Column | None = None) -> Column:
    """Names of the detectors that flag an event, latency first."""
    order = ("latency_ms", "cpu_percent", "memory_percent")
    names = [
        F.when(scores[METRICS.index(m)]["is_anomaly"], F.lit(f"zscore:{m}")) for m in order
    ]
    if forest_flag is not None:
        names.append(F.when(forest_flag, F.lit("isolation_forest")))
    return F.array_compact(F.array(*names))


def anomaly_counts(scored: DataFrame) -> DataFrame:
    """Anomalous events per detector and severity; ``scored`` has the worst verdict's columns."""
    return (
        scored.where("is_anomaly")
        .groupBy(F.lit("Z_SCORE").alias("detector_type"), "severity")
        .agg(F.count(F.lit(1)).alias("anomalies"))
    )


# ---------------------------------------------------------------------------------------
# Adaptive rolling detector: only accepted events enter the window, so the decision on an
# event depends on all earlier decisions of its service.
# ---------------------------------------------------------------------------------------

SCORED_SCHEMA = (
    "service_name string, seq bigint, status string, baseline_events int, metric_name string, "
    "is_anomaly boolean, confidence double, severity string, observed_value double, "
    "baseline_mean double, z_cpu_percent double, z_memory_percent double, z_latency_ms double"
)
STATE_SCHEMA = "service_name string, _chunk bigint, state array<double>"


class RollingWindow:
    """The last accepted samples of one service, newest last."""

    def __init__(self, state: Sequence[float] | None = None, window: int = WINDOW_EVENTS):
        self.window = window
        self.samples = np.empty((len(METRICS), window * 2 + 8 * LONGEST_BLOCK))
        self.end = 0
        if state is not None and len(state):
            block = np.asarray(state, dtype=float).reshape(-1, len(METRICS)).T
            self.end = block.shape[1]
            self.samples[:, : self.end] = block

    @property
    def start(self) -> int:
        return max(0, self.end - self.window)

    def __len__(self) -> int:
        return self.end - self.start

    def view(self) -> np.ndarray:
        return self.samples[:, self.start : self.end]

    def append(self, samples: np.ndarray) -> int:
        """Adds samples (metrics x events, or one event); returns the size of the window."""
        samples = np.asarray(samples, dtype=float).reshape(len(METRICS), -1)
        count = samples.shape[1]
        if self.end + count > self.samples.shape[1]:
            tail = self.view().copy()
            self.end = tail.shape[1]
            self.samples[:, : self.end] = tail
        self.samples[:, self.end : self.end + count] = samples
        self.end += count
        return len(self)

    def state(self) -> list[float]:
        return self.view().T.reshape(-1).tolist()


def _verdicts(frames: np.ndarray, samples: np.ndarray) -> tuple:
    """Scores of samples (metrics x events) against their frames (metrics x events x window)."""
    mean = frames.mean(axis=2)
    std = frames.std(axis=2)
    std[std == 0] = 1.0
    z = (samples - mean) / std
    worst = np.abs(np.round(z, 2)).argmax(axis=0)
    size = np.abs(np.take_along_axis(z, worst[None, :], axis=0)[0])
    return z, mean, worst, size


REJECTED = ("REJECTED", *[None] * 10)


def fold_events(window: RollingWindow, values: np.ndarray, warmup: int = WARMUP_EVENTS) -> list[tuple]:
    """Scores the rows of ``values`` (events x metrics) in order, updating ``window``.

    A row with a metric that is null, NaN or infinite is rejected: it gets no score and
    never enters the window.
    """
    usable = np.isfinite(values).all(axis=1)
    scored = iter(fold_finite(window, values[usable], warmup))
    return [next(scored) if ok else REJECTED for ok in usable]


def fold_finite(window: RollingWindow, values: np.ndarray, warmup: int, scores: bool = True) -> list[tuple]:
    """The same for rows of finite metrics; without ``scores`` only the window is updated.

    A window that is not full grows event by event. Once it is full, the events that are
    accepted are found first; they name the window of every event, and all are scored at once.
    """
    out: list[tuple] = []
    at = 0
    while at < len(values) and (len(window) < window.window or len(window) < warmup):
        samples = values[at : at + 1].T
        at += 1
        if len(window) < warmup:
            size = window.append(samples)
            out.append(("WARMING_UP", size, None, None, None, None, None, None, None, None, None))
            continue
        first = len(window)
        z, mean, worst, size = _verdicts(np.ascontiguousarray(window.view()[:, None, :]), samples)
        if not size[0] > Z_THRESHOLD:
            window.append(samples)
        out += _scored_rows(samples, z, mean, worst, size, np.array([first if size[0] > Z_THRESHOLD else first + 1]))
    rest = values[at:].T
    if not rest.shape[1]:
        return out
    known = window.view().copy()
    accepted = accepted_events(known, rest)
    line = np.concatenate([known, rest[:, accepted]], axis=1)
    if scores:
        ahead = np.cumsum(accepted) - accepted
        frames = np.lib.stride_tricks.sliding_window_view(line, known.shape[1], axis=1)
        for i in range(0, rest.shape[1], SCORED_BLOCK):
            samples = rest[:, i : i + SCORED_BLOCK]
            verdicts = _verdicts(np.ascontiguousarray(frames[:, ahead[i : i + SCORED_BLOCK]]), samples)
            out += _scored_rows(samples, *verdicts, np.full(samples.shape[1], known.shape[1]))
    window.append(line[:, -known.shape[1] :])
    return out


def _scored_rows(samples, z, mean, worst, size, events) -> list[tuple]:
    at = np.arange(len(worst))
    columns = worst, size, samples[worst, at], mean[worst, at], events, *z
    rows = []
    for w, s, value, middle, n, *each in zip(*[c.tolist() for c in columns], strict=True):
        flagged = s > Z_THRESHOLD
        severity = "NORMAL"
        if flagged:
            severity = "CRITICAL" if s >= Z_THRESHOLD * CRITICAL_FACTOR else "WARNING"
        rows.append(
            ("SCORED", n, METRICS[w], flagged, min(1.0, s / (Z_THRESHOLD * 2)), severity, value, middle, *each)
        )
    return rows


def accepted_events(known: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Which of ``samples`` (metrics x events) enter a full window that begins as ``known``.

    Running sums decide, one event after the other, at a constant cost. What they cannot tell, next to
    the threshold or where a deviation is small against the values, is scored as in scoring.
    """
    size, n = known.shape[1], samples.shape[1]
    accepted = np.zeros(n, bool)
    low, high = (Z_THRESHOLD - UNSURE_SCORE) ** 2, (Z_THRESHOLD + UNSURE_SCORE) ** 2
    at, block = 0, SHORTEST_BLOCK
    while at < n:
        # Values are taken from the window's means, and the sums are made anew after a window's length.
        centre = known.mean(axis=1)
        with np.errstate(all="ignore"):
            line = (known - centre[:, None]).T.tolist()
            events = (samples[:, at : at + RESUMMED] - centre[:, None]).T.tolist()
        (a, b, c), (aa, bb, cc) = (map(sum, zip(*x, strict=True)) for x in (line, [[v * v for v in row] for row in line]))
        greatest = [max(abs(v) for v in column) for column in zip(*line, strict=True)]
        ga, gb, gc = (UNSURE_SPREAD * g * g for g in greatest)
        first, begun, unsure, spread = 0, at, False, True
        moved = True
        for x, y, z in events:
            if moved:
                ma, mb, mc = a / size, b / size, c / size
                va, vb, vc = aa / size - ma * ma, bb / size - mb * mb, cc / size - mc * mc
                spread, moved = va > ga and vb > gb and vc > gc, False
            da, db, dc = x - ma, y - mb, z - mc
            da, db, dc = da * da, db * db, dc * dc
            if not spread:
                unsure = True
                break
            if da < low * va and db < low * vb and dc < low * vc:
                accepted[at] = moved = True
                u, v, w = line[first]
                first += 1
                line.append((x, y, z))
                xx, yy, zz = x * x, y * y, z * z
                a, b, c = a + x - u, b + y - v, c + z - w
                aa, bb, cc = aa + xx - u * u, bb + yy - v * v, cc + zz - w * w
                ga, gb, gc = max(ga, UNSURE_SPREAD * xx), max(gb, UNSURE_SPREAD * yy), max(gc, UNSURE_SPREAD * zz)
            elif not (da > high * va or db > high * vb or dc > high * vc):
                unsure = True
                break
            at += 1
        taken = samples[:, begun:at][:, accepted[begun:at]]
        known = np.concatenate([known, taken], axis=1)[:, -size:]
        if not unsure:
            continue
        # As if all of a block were accepted, up to the first that is anomalous.
        if spread:
            block = 1
        part = samples[:, at : at + block]
        line = np.concatenate([known, part], axis=1)
        frames = np.lib.stride_tricks.sliding_window_view(line, size, axis=1)[:, : part.shape[1]]
        anomalous = np.flatnonzero(_verdicts(np.ascontiguousarray(frames), part)[3] > Z_THRESHOLD)
        stop = int(anomalous[0]) if len(anomalous) else part.shape[1]
        accepted[at : at + stop] = True
        known = line[:, stop : stop + size]
        at += stop + 1 if len(anomalous) else stop
        block = SHORTEST_BLOCK if len(anomalous) else min(max(block * 2, SHORTEST_BLOCK), LONGEST_BLOCK)
    return accepted


SHOWN_ROUNDED = (
    "confidence observed_value baseline_mean z_cpu_percent z_memory_percent z_latency_ms".split()
)


def shown(scored: DataFrame) -> DataFrame:
    """The scored rows with their numbers rounded for display."""
    return scored.withColumns({c: tidy(F.col(c), 2) for c in SHOWN_ROUNDED})


SCORED_COLUMNS = [c.split()[0] for c in SCORED_SCHEMA.split(", ")]


def scored_frame(service: str, seqs: np.ndarray, rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=SCORED_COLUMNS[2:])
    frame["baseline_events"] = frame["baseline_events"].astype("Int32")
    frame.insert(0, "seq", seqs)
    frame.insert(0, "service_name", service)
    return frame


def _fold_group(pdf: pd.DataFrame, state, carry: Sequence[str] = ()) -> tuple[pd.DataFrame, RollingWindow]:
    pdf = pdf.sort_values("seq", kind="stable")
    window = RollingWindow(state)
    rows = fold_events(window, pdf[list(METRICS)].to_numpy(dtype=float))
    frame = scored_frame(pdf["service_name"].iloc[0], pdf["seq"].to_numpy(), rows)
    return frame.assign(**{c: pdf[c].to_numpy() for c in carry}), window


def _end_window(pdf: pd.DataFrame, state) -> RollingWindow:
    """The window that a fold ends with; its scores are not worked out."""
    window = RollingWindow(state)
    values = pdf.sort_values("seq", kind="stable")[list(METRICS)].to_numpy(dtype=float)
    fold_finite(window, values[np.isfinite(values).all(axis=1)], WARMUP_EVENTS, scores=False)
    return window


def _first_state(starts: pd.DataFrame):
    return starts["state"].iloc[0] if len(starts) else None


@F.pandas_udf(ArrayType(DoubleType()))
def _frame(state: pd.Series) -> pd.Series:
    """Means, then deviations of a window's metrics, computed as in scoring; null while it warms up."""

    def of(samples):
        window = RollingWindow(samples).view()
        if window.shape[1] < WARMUP_EVENTS:
            return None
        std = window.std(axis=1)
        return [*window.mean(axis=1).tolist(), *np.where(std == 0, 1.0, std).tolist()]

    return state.map(of)


def frozen_starts(folds: DataFrame, changed: DataFrame) -> DataFrame:
    """(service_name, _chunk, state): folds that are expected to start from a frozen window.

    The earliest changed fold of a service starts from a window that is settled. Up to and
    including the first fold with an event that this window would accept, all later folds start
    from the same window. They are expectations: the caller compares them with the folds' ends.
    """
    # One row per service: its state holds at most a window.
    first = changed.groupBy("service_name").agg(
        F.min("_chunk").alias("_first"), F.min_by("state", "_chunk").alias("state")
    )
    first = stored(first.withColumn("_frame", _frame("state")), "first-changed")
    first = small_side(first.where("_frame is not null"))
    scores = [
        (F.col(m) - F.col("_frame")[i]) / F.col("_frame")[i + len(METRICS)] for i, m in enumerate(METRICS)
    ]
    finite = F.lit(True)
    for m in METRICS:
        finite = finite & F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf"))
    # The metric with the largest rounded score decides, as in scoring.
    sized = F.array(*[F.struct(F.abs(F.rint(z * 100) / 100), F.lit(-i), F.abs(z).alias("z")) for i, z in enumerate(scores)])
    accepted = finite & (F.array_max(sized)["z"] <= Z_THRESHOLD)
    later = match(folds, first, ["service_name"]).where("_chunk >= _first")
    thaw = later.groupBy("service_name").agg(
        F.min(F.when(accepted, F.col("_chunk"))).alias("_thaw")
    )
    places = match(folds.select("service_name", "_chunk").distinct(), first, ["service_name"])
    return (
        match(places, small_side(thaw), ["service_name"])
        .where("_chunk > _first and (_thaw is null or _chunk <= _thaw)")
        .select("service_name", "_chunk", "state")
    )


def rolling_ingest(
    events: DataFrame,
    seq: str = "seq",
    fold_rows: int = FOLD_ROWS,
    split: bool | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Status, worst verdict and z-scores of every event, in arrival order per service.

    Columns named in ``carry`` come along unchanged. An event with a metric that is null,
    NaN or infinite reads REJECTED and never enters a window.

    A service's history is one long dependency chain, so a hot service cannot be one task.
    Beyond a size check the chain is cut into folds that run side by side: each starts from
    the window its predecessor ended with in the previous round, and rounds repeat for the
    folds whose start changed until none does. The window forgets everything older than
    ``WINDOW_EVENTS`` accepted events, so a fold's end hardly depends on its start and two
    rounds are the rule. After a change of level a window is frozen, as long as every event is
    anomalous under it; the folds it stays frozen in are found by one aggregation and all run
    from that window in the same round (``frozen_starts``). Agreement of every start with its
    predecessor's end is what makes the result exact. ``fold_rows`` is the least length of a fold:
    beyond ``MOST_FOLDS`` of them folds grow, so that many short ones do not take a round for
    each part of a window.
    """
    ship_package(events.sparkSession)
    base = events.select(
        "service_name",
        F.col(seq).cast("bigint").alias("seq"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
        *carry,
    )
    schema = ", ".join([SCORED_SCHEMA, *[f"`{c}` {base.schema[c].dataType.simpleString()}" for c in carry]])
    if split is None:
        split = not fits_one_task(base, FOLD_BYTES)
    if not split:
        whole = base.groupBy("service_name").applyInPandas(
            lambda pdf: _fold_group(pdf, None, carry)[0], schema
        )
        return shown(whole)

    ranked = arrival_rank(base, ["service_name"], "seq", "_pos", split=True)
    # Every round builds on the one before it: written tables, because the estimates and constraints
    # that a checkpoint keeps would grow until planning takes longer than the work.
    placed = stored(ranked, "folds")
    fold_rows = max(fold_rows, min(FOLD_ROWS, -(-placed.count() // MOST_FOLDS)))
    folds = placed.withColumn("_chunk", F.floor((F.col("_pos") - 1) / F.lit(fold_rows))).drop("_pos")
    keys = ["service_name", "_chunk"]

    def end_state(key, pdf, starts):
        if pdf.empty:
            return pd.DataFrame({"service_name": [], "_chunk": [], "state": []})
        window = _end_window(pdf, _first_state(starts))
        return pd.DataFrame({"service_name": [key[0]], "_chunk": [key[1]], "state": [window.state()]})

    def scored(key, pdf, starts):
        if pdf.empty:
            return pd.DataFrame(columns=[*SCORED_COLUMNS, *carry])
        return _fold_group(pdf, _first_state(starts), carry)[0]

    def following(states: DataFrame) -> DataFrame:
        return states.select("service_name", (F.col("_chunk") + 1).alias("_chunk"), "state")

    def run(rows: DataFrame, starts: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(end_state, STATE_SCHEMA)

    none = events.sparkSession.createDataFrame([], STATE_SCHEMA)
    used = none
    ends = stored(run(folds, none), "fold-ends")
    while True:
        starts = following(ends)
        before = used.withColumnRenamed("state", "_used")
        changed = stored(
            match(match(starts, before, keys, "left"), folds.select(*keys).distinct(), keys, "left_semi")
            .where(~F.col("state").eqNullSafe(F.col("_used")))
            .select(*keys, "state"),
            "fold-changes",
        )
        if changed.isEmpty():
            break
        frozen = stored(frozen_starts(folds, changed), "fold-frozen")
        rest = match(changed, frozen.select(*keys), keys, "left_anti")
        todo = rest.unionByName(frozen)
        again = run(match(folds, todo.select(*keys), keys, "left_semi"), todo)
        kept = match(ends, todo.select(*keys), keys, "left_anti")
        used = match(starts, frozen.select(*keys), keys, "left_anti").unionByName(frozen)
        ends = stored(kept.unionByName(again), "fold-ends")
    result = folds.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(scored, schema)
    return shown(result)


def _merged(metric: str) -> tuple[Column, Column]:
    """Mean and deviation of two adjacent runs from their counts, means and variances."""
    na, nb = F.coalesce("_sn", F.lit(0)), F.coalesce("_pn", F.lit(0))
    ma, mb = F.coalesce(f"_s_{metric}", F.lit(0.0)), F.coalesce(f"_p_{metric}", F.lit(0.0))
    va, vb = F.coalesce(f"_sv_{metric}", F.lit(0.0)), F.coalesce(f"_pv_{metric}", F.lit(0.0))
    n = na + nb
    apart = mb - ma
    mean = F.when(na == 0, mb).otherwise(ma + apart * nb / n)
    spread = va * na + vb * nb + F.when(na == 0, 0.0).otherwise(apart * apart * na * nb / n)
    return mean, F.sqrt(spread / n)


def rolling_zscore(
    events: DataFrame,
    seq: str = "seq",
    window: int = WINDOW_EVENTS,
    warmup: int = WARMUP_EVENTS,
    split: bool | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Verdicts against the previous ``window`` events, accepted or not; no Python involved.

    A sliding frame would add up ``window`` rows for every event. Instead arrival order is
    cut into runs of ``window`` events; the frame before an event is the tail of one run
    plus the head of the next, so running statistics from both ends of each run, merged per
    event, give the frame at constant cost. Means and variances are merged, not sums of
    squares, so nothing cancels and a constant frame has deviation 0 exactly.

    Beyond a size check a service is also cut into blocks, each preceded by a copy of the
    ``window`` events before it, so that no task orders a whole hot service.
    """
    if split is None:
        split = not fits_one_task(events)
    ranked = arrival_rank(events, ["service_name"], seq, "_pos", split=split)
    ranked = ranked.withColumn("_run", F.floor((F.col("_pos") - 1) / F.lit(window)))
    run = W.partitionBy("service_name", "_run")
    head = run.orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    tail = run.orderBy(F.col("_pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    running = {"_hn": F.count(F.lit(1)).over(head), "_tn": F.count(F.lit(1)).over(tail)}
    for m in METRICS:
        running[f"_h_{m}"] = F.avg(m).over(head)
        running[f"_hv_{m}"] = F.var_pop(m).over(head)
        running[f"_t_{m}"] = F.avg(m).over(tail)
        running[f"_tv_{m}"] = F.var_pop(m).over(tail)
    rows = ranked.withColumns(running)

    keys = ["service_name"]
    if split:
        block_rows = max(block_rows, window)
        block = F.floor((F.col("_pos") - 1) / F.lit(block_rows))
        in_tail = (F.col("_pos") - 1) % block_rows >= block_rows - window
        copies = F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))
        rows = rows.withColumn("_home", block).withColumn("_block", F.explode(copies))
        keys = ["service_name", "_block"]
    order = W.partitionBy(*keys).orderBy("_pos")
    shifted = {"_pn": F.lag("_hn", 1).over(order)}
    # The tail of the run before is part of the frame except right at the start of a run.
    inside = (F.col("_pos") - 1) % window > 0
    shifted["_sn"] = F.when(inside, F.lag("_tn", window).over(order))
    for m in METRICS:
        shifted[f"_p_{m}"] = F.lag(f"_h_{m}", 1).over(order)
        shifted[f"_pv_{m}"] = F.lag(f"_hv_{m}", 1).over(order)
        shifted[f"_s_{m}"] = F.when(inside, F.lag(f"_t_{m}", window).over(order))
        shifted[f"_sv_{m}"] = F.when(inside, F.lag(f"_tv_{m}", window).over(order))
    scored = rows.withColumns(shifted)
    if split:
        scored = scored.where(F.col("_home") == F.col("_block"))
    size = F.coalesce("_pn", F.lit(0)) + F.coalesce("_sn", F.lit(0))
    ready = size >= warmup
    verdicts = []
    for m in METRICS:
        mean, std = _merged(m)
        std = F.when(std == 0, 1.0).otherwise(std)
        verdicts.append(zscore(m, F.col(m), F.when(ready, mean), F.when(ready, std)))
    return scored.select(
        *events.columns,
        F.when(ready, "SCORED").otherwise("WARMING_UP").alias("status"),
        size.alias("baseline_events"),
        F.array(*verdicts).alias("scores"),
    )
