"""Streams of job events: a state machine per job, idempotent submission and windows over time.

The state of a job is one small row, so that any number of jobs is spread over the executors by key; events are replayed from the
checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (state, action): next state. What is not listed is refused.
TRANSITIONS = {
    (None, "submit"): "queued", ("queued", "start"): "running", ("queued", "cancel"): "cancelled", ("running", "pause"): "paused", ("running", "cancel"): "cancelled", ("running", "finish"): "done",
    ("running", "fail"): "error", ("paused", "resume"): "running", ("paused", "cancel"): "cancelled", ("queued", "restart"): "interrupted", ("running", "restart"): "interrupted", ("paused", "restart"): "interrupted",
}
OUTPUT = "job_id long, action string, at double, state string, accepted boolean, active double"
STATE = "state string, started double, paused_at double, paused double"


def step(state: tuple, action: str, at: float) -> tuple[tuple, bool, float | None]:
    """(state, started, paused_at, paused) after an action, whether it was accepted, and the active seconds so far."""
    name, started, paused_at, paused = state
    after = TRANSITIONS.get((name, action))
    if after is not None:
        if action == "start":
            started = at
        if action == "pause":
            paused_at = at
        elif paused_at is not None:
            paused, paused_at = paused + at - paused_at, None
        name = after
    active = None if started is None else max(0.0, (paused_at if paused_at is not None else at) - started - paused)
    return (name, started, paused_at, paused), after is not None, active


def _rows(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(None if v is None or v != v else v for v in state.get) if state.exists else (None, None, None, 0.0)
    events = pd.concat(list(frames)).sort_values(["at", "event_id"])
    out = []
    for r in events.itertuples(index=False):
        now, accepted, active = step(now, r.action, float(r.at))
        out.append((key[0], r.action, float(r.at), now[0], accepted, active))
    state.update(now)
    yield pd.DataFrame(out, columns=["job_id", "action", "at", "state", "accepted", "active"])


def job_states(events: DataFrame) -> DataFrame:
    """Every event (job_id, event_id, action, at) with the state that it leads to; a stream or a table."""
    if events.isStreaming:
        return events.groupBy("job_id").applyInPandasWithState(_rows, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        now, out = (None, None, None, 0.0), []
        for r in frame.sort_values(["at", "event_id"]).itertuples(index=False):
            now, accepted, active = step(now, r.action, float(r.at))
            out.append((key[0], r.action, float(r.at), now[0], accepted, active))
        return pd.DataFrame(out, columns=["job_id", "action", "at", "state", "accepted", "active"])

    return events.groupBy("job_id").applyInPandas(fold, OUTPUT)


def submissions(requests: DataFrame, ref: str = "client_ref", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """One request of each reference within a time; later ones are dropped. On tables, the earliest of each reference."""
    if requests.isStreaming:
        return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([ref])
    first = requests.groupBy(ref).agg(F.min(ts).alias(ts))
    return requests.join(first, [ref, ts], "left_semi").dropDuplicates([ref])


def activity(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type. An addition to the operators that the engine's model has."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    out = df.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user by a gap. An addition to the operators that the engine's model has."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    out = df.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
