"""Alert rules over a stream: a pending and firing state machine per key, driven by event time.

A first query sums the log per evaluation step (``step_sums``) and appends each step once its
watermark has passed; its output is one small row per step and key. A second one reads those
rows, all of a batch together, and keeps, per key, the sums of the rule's range and the open
streak (``alert_stream``).
Steps are taken in order up to the newest row; where rows stay out, an event-time timer takes
them as the watermark passes, so that an alert on absent data fires while data is absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom.operators import httpmetrics as http
from opsloom.streaming.telemetry import WATERMARK


@dataclass(frozen=True)
class Rule:
    """An alert rule over sums of ``range_us``, evaluated every ``step_us``.

    ``sums`` and ``keep`` are SQL texts, as the rule travels to tasks. ``broken`` judges the
    sums of a window; None for a rule that asks for steps without rows.
    """

    name: str
    sums: dict[str, str]
    broken: Callable[[dict[str, float]], bool] | None
    range_us: int
    step_us: int
    for_us: int
    keep: str | None = None


def _quantile_above(sums: dict[str, float], q: float = 0.95, limit: float = http.LATENCY_P95_S) -> bool:
    """The histogram quantile of ``httpmetrics.bucket_quantile`` on the window's sums."""
    rank, below, start = sums["requests"] * q, 0.0, 0.0
    for i, bound in enumerate(http.BUCKETS):
        reached = sums[f"le_{i}"]
        if reached >= rank:
            return reached > below and start + (bound - start) * (rank - below) / (reached - below) > limit
        below, start = reached, bound
    return http.BUCKETS[-1] > limit


def rules() -> dict[str, Rule]:
    """The rules of the batch forms, with their limits, ranges and holds."""
    wide, minute = 5 * http.MINUTE, http.MINUTE
    seconds = wide / http.SECOND
    le = {f"le_{i}": f"count_if(duration_s <= {b}D)" for i, b in enumerate(http.BUCKETS)}
    every = [
        Rule(
            "error_rate",
            {"errors": "count_if(status_code between 500 and 599)", "requests": "count(1)"},
            lambda s: s["errors"] * 100.0 / max(s["requests"], 1e-9) > http.ERROR_PCT,
            wide, minute, http.ERROR_HOLD * minute,
        ),
        Rule(
            "high_latency", {**le, "requests": "count(1)"}, _quantile_above, wide, minute, http.LATENCY_HOLD * minute,
            keep=f"not (endpoint rlike '{http.NOT_INTERACTIVE}')",
        ),
        Rule(
            "rate_limited",
            {"limited": "count_if(status_code = 429)"},
            lambda s: s["limited"] / seconds > http.LIMITED_PER_SECOND,
            wide, minute, http.LIMITED_HOLD * minute,
        ),
        Rule(
            "critical_anomalies",
            {"criticals": "count_if(severity = 'CRITICAL')"},
            lambda s: s["criticals"] > 5,
            10 * minute, minute, 0,
        ),
        Rule("target_down", {"requests": "count(1)"}, None, 2 * minute, 2 * minute, 2 * minute),
    ]
    return {r.name: r for r in every}


def step_sums(log: DataFrame, rule: Rule, keys: Sequence[str] = (), watermark: str = WATERMARK) -> DataFrame:
    """(keys, t, sums): a rule's sums per evaluation step ``(t - step, t]``, each appended once."""
    rows = log if rule.keep is None else log.where(rule.keep)
    # Spark's windows are closed at the start, so the event time is moved by its smallest unit.
    timed = rows.withColumn("ts", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("ts", watermark)
    step = F.window("ts", f"{rule.step_us} microseconds").alias("w")
    sums = timed.groupBy(*keys, step).agg(*[F.expr(value).cast("double").alias(n) for n, value in rule.sums.items()])
    return sums.select(*keys, F.unix_micros("w.end").alias("t"), *rule.sums)


STREAK = "event string, t long, started long, ended long, steps long, state string, firing_from long, late long"


class Machine:
    """One key's evaluation: the sums in range, the last step taken, the open streak, late rows."""

    STATE = "last long, started long, steps long, fired boolean, late long, times array<long>, sums array<double>"

    def __init__(self, rule: Rule, state: tuple | None):
        self.rule, self.names = rule, list(rule.sums)
        self.last, self.started, self.steps, self.fired, self.late, times, sums = state or (None, None, 0, False, 0, [], [])
        width = len(self.names)
        self.window = [(t, tuple(sums[i * width : (i + 1) * width])) for i, t in enumerate(times)]
        self.out: list[tuple] = []

    def state(self) -> tuple:
        times = [t for t, _ in self.window]
        return self.last, self.started, self.steps, self.fired, self.late, times, [x for _, s in self.window for x in s]

    def row(self, t: int, sums: tuple[float, ...]) -> None:
        """A step that has rows; the steps before it are taken first."""
        if self.last is not None and t <= self.last:
            self.late += 1
            return
        self.pass_to(t - self.rule.step_us)
        self.window.append((t, sums))
        self.take(t)

    def pass_to(self, t: int) -> None:
        """Takes the steps up to ``t``, none of which has rows of its own."""
        if self.last is None:
            return
        step = self.rule.step_us
        if self.rule.broken is None:
            n = (t - self.last) // step
            if n > 0:
                # All of them are absent: one streak, however long.
                self.extend(self.last + step, n)
                self.last += n * step
            return
        while self.last + step <= t and self.window:
            self.take(self.last + step)
        if self.last < t:
            # Nothing is in range any more.
            self.close()
            self.last += (t - self.last) // step * step

    def take(self, t: int) -> None:
        self.window = [(at, s) for at, s in self.window if at > t - self.rule.range_us]
        self.last = t
        if self.rule.broken is None:
            broken = not any(at == t for at, _ in self.window)
        else:
            totals = [sum(column) for column in zip(*[s for _, s in self.window], strict=True)]
            broken = bool(self.window) and self.rule.broken(dict(zip(self.names, totals, strict=True)))
        if broken:
            self.extend(t, 1)
        else:
            self.close()

    def extend(self, t: int, steps: int) -> None:
        """``steps`` more broken steps from ``t`` on."""
        if self.started is None:
            self.started, self.steps, self.fired = t, 0, False
        self.steps += steps
        if not self.fired and self.ended() - self.started >= self.rule.for_us:
            self.fired = True
            self.emit("firing", self.started + self.rule.for_us)

    def ended(self) -> int:
        return self.started + (self.steps - 1) * self.rule.step_us

    def close(self) -> None:
        if self.started is not None:
            self.emit("closed", self.ended())
            self.started = None

    def emit(self, event: str, t: int) -> None:
        state = "firing" if self.fired else "pending"
        begin = self.started + self.rule.for_us if self.fired else None
        self.out.append((event, t, self.started, self.ended(), self.steps, state, begin, self.late))


def alert_stream(steps: DataFrame, rule: Rule, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, event, t, started, ended, steps, state, firing_from, late) from rows of ``step_sums``.

    ``firing`` rows come as soon as a streak has held long enough, ``closed`` rows with its
    end; closed ones equal the rows of the batch form. ``late`` counts the key's rows that
    came after their step had been taken.
    """
    names, step_ms = [name for name in STREAK.split(", ")], rule.step_us // 1000
    columns = [n.split(" ")[0] for n in names]

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(rule, state.get if state.exists else None)
        watermark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            # All rows before the watermark have come: its step is the last that is complete.
            machine.pass_to((watermark * 1000 - 1) // rule.step_us * rule.step_us)
        else:
            rows = pd.concat(list(frames)).sort_values("t", kind="stable")
            for t, *sums in rows[["t", *rule.sums]].itertuples(index=False):
                machine.row(int(t), tuple(map(float, sums)))
        state.update(machine.state())
        # As long as steps without rows can change something, look again one step on.
        if machine.last is not None and (rule.broken is None or machine.window):
            state.setTimeoutTimestamp(max(machine.last // 1000 + step_ms, watermark) + 1)
        found = pd.DataFrame(machine.out, columns=columns).astype({"firing_from": "Int64"})
        for name, value in zip(reversed(list(keys)), reversed(key), strict=False):
            found.insert(0, name, value)
        yield found

    timed = steps.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", "0 seconds")
    if not keys:
        timed = timed.withColumn("_all", F.lit(0))
    kinds = dict(steps.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + names)
    return timed.groupBy(*(keys or ["_all"])).applyInPandasWithState(
        advance, schema, Machine.STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def rows_dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's watermarks have dropped so far, as its recent progress reports them."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
