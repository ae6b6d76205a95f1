"""Reviewer decisions as a stream, against a table or a stream of planned actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom.operators.triage import awaiting


def accepted_decisions(decisions: DataFrame, planned: DataFrame, watermark: str = "7 days") -> DataFrame:
    """The first decision on each waiting incident; later ones within the watermark are dropped."""
    first = decisions.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["ticket_id"])
    waiting = planned.where(awaiting()).select("ticket_id", "service_name", "action_type")
    return first.join(waiting, "ticket_id")


ANSWER = "ticket_id bigint, seq bigint, approved boolean, reviewer string, answer int"
STATE = (
    "awaiting boolean, decided long, forget long, seqs array<long>, times array<long>, "
    "approved array<boolean>, reviewers array<string>"
)


def decision_answers_stream(
    decisions: DataFrame, planned: DataFrame, watermark: str = "10 minutes", horizon: str = "1 hour", keep: str = "1 day"
) -> DataFrame:
    """ticket_id, seq, approved, reviewer, answer for every decision, as the batch form gives them.

    Both inputs have an event time ``ts`` and may be out of order within ``watermark``. A
    decision waits until the watermark is ``horizon`` beyond it: a ticket that arrives after
    its decision is then known (200 or 409), one that does not is unknown (404), and of the
    decisions on a waiting ticket the smallest ``seq`` counts (200), the others are repeats
    (409). What is known of a ticket is forgotten ``keep`` after its last row, so state does not
    grow with the history.
    """
    none = lambda kind: F.lit(None).cast(kind)
    asked = decisions.withWatermark("ts", watermark).select(
        "ticket_id", "ts", F.unix_millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "approved", "reviewer",
        none("boolean").alias("awaiting"),
    )
    known = planned.withWatermark("ts", watermark).select(
        "ticket_id", "ts", F.unix_millis("ts").alias("at"), none("long").alias("seq"),
        none("boolean").alias("approved"), none("string").alias("reviewer"), awaiting().alias("awaiting"),
    )
    wait, forget = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (horizon, keep))

    def answer(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ticket, decided, until, *held = state.get if state.exists else (None, None, 0, [], [], [], [])
        open_ = list(zip(*held, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    until = max(until, row.at + forget)
                    if pd.isna(row.seq):
                        ticket = bool(row.awaiting)
                    else:
                        reviewer = None if pd.isna(row.reviewer) else row.reviewer
                        approved = None if pd.isna(row.approved) else bool(row.approved)
                        open_.append((int(row.seq), int(row.at), approved, reviewer))
        now = state.getCurrentWatermarkMs()
        ready = sorted(d for d in open_ if d[1] + wait < now)
        open_ = [d for d in open_ if d[1] + wait >= now]
        out = []
        for seq, _, approved, reviewer in ready:
            code = 404 if ticket is None else 409 if not ticket or decided is not None else 200
            if code == 200:
                decided = seq
            out.append((key[0], seq, approved, reviewer, code))
        if not open_ and until < now:
            state.remove()
        else:
            state.update((ticket, decided, until, *(list(c) for c in zip(*open_, strict=True))) if open_ else (ticket, decided, until, [], [], [], []))
            next_ = min((d[1] + wait for d in open_), default=until)
            state.setTimeoutTimestamp(max(next_, now) + 1)
        yield pd.DataFrame(out, columns=["ticket_id", "seq", "approved", "reviewer", "answer"]).astype({"approved": "boolean"})

    return asked.unionByName(known).groupBy("ticket_id").applyInPandasWithState(
        answer, ANSWER, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
