"""Live streams of threads: wake-ups in, events for each connection out, with debounce and keepalives from timers.

Input rows are (thread_id, at, kind, conn, seq): an `item` has a number in its thread, a `touch` says that the thread
itself changed, `connect` opens a connection that has seen items up to `seq` (none: null), `leave` closes it. A
connection first gets what `timeline.replay` would say: a snapshot, the items after its cursor, that there are none, or
a reset where the cursor is ahead of the thread. Later wake-ups are gathered for `debounce_ms` from the first of them and
answered once; `keepalive_ms` after its last event a connection gets a heartbeat with its cursor.

State is one thread's: its item numbers, open connections with cursor and time of their last event, and when the gathered
wake-ups are due. Timers hold the next time at which something is due, so nothing is polled. On the processing clock all
rows of a batch come now, and connections that nobody closes are forgotten after `forget_ms`; on the event clock rows
come at `at`, the watermark is the clock, and the same rows give the same events however they are cut into batches.

Defined results: an item that is there already changes nothing but wakes; a thread without items has cursor 0; rows
without a thread are dropped; connections are told apart within a thread only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Gathering and keepalive times, and the pause that a client is asked to keep before it connects again.
DEBOUNCE_MS, KEEPALIVE_MS, RETRY_MS = 100, 15_000, 3_000
EVENT = "thread_id long, conn string, at long, event string, cursor long, items long"


@dataclass
class Channel:
    """One thread: what is known, and what happens when. Times are in milliseconds."""

    debounce: int
    keepalive: int
    seqs: set[int] = field(default_factory=set)
    conns: dict[str, list[int | None]] = field(default_factory=dict)
    due: int | None = None

    def _answer(self, now: int, conn: str) -> tuple:
        """The event for a connection, by its cursor; the cursor moves on."""
        cursor, latest = self.conns[conn][0], max(self.seqs, default=0)
        if cursor is None:
            kind, items = "snapshot", len(self.seqs)
        elif cursor > latest:
            kind, items = "reset", len(self.seqs)
        else:
            items = sum(s > cursor for s in self.seqs)
            kind = "items_appended" if items else "thread_updated"
        self.conns[conn] = [latest, now]
        return conn, now, kind, latest, items

    def next(self) -> int | None:
        """When something is due next."""
        times = [last + self.keepalive for _, last in self.conns.values()] + ([self.due] if self.due is not None else [])
        return min(times) if self.conns and times else None

    def advance(self, now: int) -> Iterator[tuple]:
        """All that is due up to now, in order."""
        while (at := self.next()) is not None and at <= now:
            if at == self.due:
                self.due = None
                for conn in sorted(self.conns):
                    yield self._answer(at, conn)
                continue
            for conn, (cursor, last) in sorted(self.conns.items()):
                if last + self.keepalive <= at:
                    self.conns[conn] = [cursor, at]
                    yield conn, at, "heartbeat", cursor or 0, 0

    def row(self, now: int, kind: str, conn: str | None, seq: int | None) -> Iterator[tuple]:
        yield from self.advance(now)
        if kind == "connect":
            self.conns[conn] = [seq, now]
            yield self._answer(now, conn)
        elif kind == "leave":
            self.conns.pop(conn, None)
            if not self.conns:
                self.due = None
        else:
            if kind == "item":
                self.seqs.add(seq)
            if self.conns and self.due is None:
                self.due = now + self.debounce


class _Live(StatefulProcessor):
    def __init__(self, debounce: int, keepalive: int, forget: int | None):
        self.debounce, self.keepalive, self.forget = debounce, keepalive, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seqs = handle.getMapState("seqs", "seq long", "there boolean")
        self.conns = handle.getMapState("conns", "conn string", "cursor long, last long", self.forget)
        self.due = handle.getValueState("due", "at long")

    def _load(self) -> Channel:
        seqs = {k[0] for k in self.seqs.keys()} if self.seqs.exists() else set()
        conns = {k[0]: list(v) for k, v in self.conns.iterator()} if self.conns.exists() else {}
        return Channel(self.debounce, self.keepalive, seqs, conns, self.due.get()[0] if self.due.exists() else None)

    def _save(self, was: Channel, now: Channel) -> None:
        for seq in now.seqs - was.seqs:
            self.seqs.updateValue((seq,), (True,))
        for conn in was.conns.keys() - now.conns.keys():
            self.conns.removeKey((conn,))
        for conn, state in now.conns.items():
            if was.conns.get(conn) != state:
                self.conns.updateValue((conn,), tuple(state))
        self.due.clear() if now.due is None else self.due.update((now.due,))
        # one timer at a time: the next thing that is due
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now.next() is not None:
            self.handle.registerTimer(now.next())

    def _events(self, key: tuple, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            conn, at, event, cursor, items = zip(*found)
            yield pd.DataFrame({"thread_id": key[0], "conn": conn, "at": at, "event": event, "cursor": cursor, "items": items})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["ms", "kind", "conn", "seq"], kind="stable")
        times = [timerValues.getCurrentProcessingTimeInMs()] * len(whole) if self.forget else whole["ms"]
        was, now, found = self._load(), self._load(), []
        for at, kind, conn, seq in zip(times, whole["kind"], whole["conn"], whole["seq"]):
            found += now.row(int(at), kind, conn, None if pd.isna(seq) else int(seq))
        self._save(was, now)
        yield from self._events(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        was, now = self._load(), self._load()
        # all up to the clock, as a timer set here would wait for the next batch
        clock = timerValues.getCurrentProcessingTimeInMs() if self.forget else timerValues.getCurrentWatermarkInMs()
        found = list(now.advance(max(clock, expiredTimerInfo.getExpiryTimeInMs())))
        self._save(was, now)
        yield from self._events(key, found)


def live(wakes: DataFrame, clock: str = "processingTime", debounce_ms: int = DEBOUNCE_MS, keepalive_ms: int = KEEPALIVE_MS, forget_ms: int = 86_400_000) -> DataFrame:
    """STM-01 to STM-04 as a stream: thread_id, conn, at, event, cursor, items. On the event clock `wakes` has a watermark on `at`.

    Needs the RocksDB state store: `spark.sql.streaming.stateStore.providerClass`.
    """
    forget = forget_ms if clock == "processingTime" else None
    rows = wakes.where("thread_id is not null").select("thread_id", "at", F.unix_millis("at").alias("ms"), "kind", "conn", "seq")
    return rows.groupBy("thread_id").transformWithStateInPandas(_Live(debounce_ms, keepalive_ms, forget), outputStructType=EVENT, outputMode="append", timeMode=clock)


def frame(events: DataFrame) -> Column:
    """An event as one server-sent frame: how long to wait before connecting again, its cursor, kind and content."""
    body = F.to_json(F.struct(F.col("event").alias("type"), "thread_id", "cursor", F.col("at").alias("sent_at"), F.struct("items").alias("payload")))
    return F.concat(F.lit(f"retry: {RETRY_MS}\nid: "), events["cursor"].cast("string"), F.lit("\nevent: "), events["event"], F.lit("\ndata: "), body, F.lit("\n\n"))


def replayed(rows: list[tuple], debounce_ms: int = DEBOUNCE_MS, keepalive_ms: int = KEEPALIVE_MS, until: int | None = None) -> list[tuple]:
    """What a stream on the event clock gives for the rows (at, kind, conn, seq) of one thread, up to a time."""
    channel, out = Channel(debounce_ms, keepalive_ms), []
    for at, kind, conn, seq in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or 0)):
        out += channel.row(at, kind, conn, seq)
    return out + (list(channel.advance(until)) if until is not None else [])


def replay_all(wakes: DataFrame, until_ms: int, debounce_ms: int = DEBOUNCE_MS, keepalive_ms: int = KEEPALIVE_MS) -> DataFrame:
    """The stream's events for rows that are all there, (thread_id, ms, kind, conn, seq), up to a time.

    A partition's rows come sorted by thread and time and run through one channel after another; none is gathered.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thread, channel = None, None

        def shown(found: Iterator[tuple]) -> list[tuple]:
            return [(thread, *e) for e in found]

        for rows in frames:
            out = []
            for now, at, kind, conn, seq in zip(rows["thread_id"], rows["ms"], rows["kind"], rows["conn"], rows["seq"]):
                if channel is None or now != thread:
                    out += shown(channel.advance(until_ms)) if channel else []
                    thread, channel = now, Channel(debounce_ms, keepalive_ms)
                out += shown(channel.row(int(at), kind, conn, None if pd.isna(seq) else int(seq)))
            yield pd.DataFrame(out, columns=["thread_id", "conn", "at", "event", "cursor", "items"])
        if channel:
            yield pd.DataFrame(shown(channel.advance(until_ms)), columns=["thread_id", "conn", "at", "event", "cursor", "items"])

    rows = wakes.where("thread_id is not null").select("thread_id", "ms", "kind", "conn", "seq")
    # dealt by a hash of the thread: a shuffle by the column itself is left out where `wakes` is a union of sides that are
    # dealt by it already, and adaptive execution then merges the partitions of each side apart
    return rows.repartition(F.xxhash64("thread_id")).sortWithinPartitions("thread_id", "ms", "kind", "conn", "seq").mapInPandas(run, EVENT)
