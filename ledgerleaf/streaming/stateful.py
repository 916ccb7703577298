"""Stateful streams: timeline replay, failure limits, expired claims. Each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay_stream(items: DataFrame) -> DataFrame:
    """STM-02: for each thread, a snapshot at first and then what each batch appends; state is the cursor.

    No watermark: the order is that of `seq`, and a timeline must not lose late rows. Rows at or below the cursor were
    sent before and are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else None
        seqs = sorted({int(s) for f in frames for s in f["seq"] if cursor is None or s > cursor})
        if seqs:
            event = "snapshot" if cursor is None else "items_appended"
            state.update((seqs[-1],))
            yield pd.DataFrame({"thread_id": [key[0]], "event": [event], "cursor_after": [seqs[-1]], "items": [len(seqs)]})

    return items.groupBy("thread_id").applyInPandasWithState(step, "thread_id long, event string, cursor_after long, items long", "cursor long", "append", GroupStateTimeout.NoTimeout)


def limit_failures(failures: DataFrame, limit: int = 5, seconds: int = 300) -> DataFrame:
    """STM-20: each failure (user_id, event_id, at in seconds) with the failures of its key in the window up to it.

    State holds the times within the window of the newest one, so it is bounded by what a key can fail in that time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        recent = []
        for at, same in rows.groupby("at"):
            kept = [t for t in kept if t >= at - seconds] + [int(at)] * len(same)
            recent += [len(kept)] * len(same)
        state.update((kept,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "recent": recent, "blocked": [n >= limit for n in recent]})

    return failures.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, recent long, blocked boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def expired_claims(beats: DataFrame, timeout_s: int = 30, late: str = "10 seconds") -> DataFrame:
    """STM-11: turns (turn_id, ts) without a heartbeat for `timeout_s` of event time; state is the last beat."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"turn_id": [key[0]], "last_beat_ms": [last]})
            return
        last = max(int(t.timestamp() * 1000) for f in frames for t in f["ts"])
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_s * 1000, state.getCurrentWatermarkMs() + 1))

    return beats.withWatermark("ts", late).groupBy("turn_id").applyInPandasWithState(step, "turn_id long, last_beat_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
