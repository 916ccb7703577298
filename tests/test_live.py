"""Live streams: the batch rules at the start, gathered answers, keepalives; the same events however the rows are cut into batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import timeline
from ledgerleaf.streaming import live

ROW = "thread_id long, ms long, kind string, conn string, seq long"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, was)


def put(spark, folder, rows):
    spark.createDataFrame(rows, ROW).withColumn("at", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def wakes(spark, folder):
    return spark.readStream.schema("thread_id long, kind string, conn string, seq long, at timestamp").parquet(f"{folder}/in")


def run(spark, folder, batches):
    for rows in batches:
        put(spark, folder, rows)
        stream = live.live(wakes(spark, folder).withWatermark("at", "0 seconds"), "eventTime")
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted((r.thread_id, r.at, r.conn, r.event, r.cursor, r["items"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_one_connection_by_hand():
    """Snapshot, two gathered items, a touch without items, a keepalive, a late answer that puts the next keepalive off, leaving."""
    rows = [(0, "item", None, 1), (1000, "connect", "c", None), (1500, "item", None, 2), (1599, "item", None, 3), (1600, "item", None, 4), (5000, "touch", None, None), (20_200, "item", None, 5), (40_000, "leave", "c", None), (90_000, "item", None, 6)]
    assert live.replayed(rows, until=200_000) == [("c", 1000, "snapshot", 1, 1), ("c", 1600, "items_appended", 3, 2), ("c", 1700, "items_appended", 4, 1), ("c", 5100, "thread_updated", 4, 0), ("c", 20_100, "heartbeat", 4, 0), ("c", 20_300, "items_appended", 5, 1), ("c", 35_300, "heartbeat", 5, 0)]
    assert live.replayed([(0, "connect", "c", 99)], until=15_000) == [("c", 0, "reset", 0, 0), ("c", 15_000, "heartbeat", 0, 0)]
    assert live.replayed([(0, "item", None, 1), (5, "item", None, 1), (9, "connect", "c", 0)]) == [("c", 9, "items_appended", 1, 1)]


def test_first_events_are_those_of_the_batch(spark, tmp_path):
    items = [(t, 10, "item", None, s) for t in range(4) for s in range(1, 4)]
    cursors = [(0, None), (1, 1), (2, 3), (3, 99)]
    found = run(spark, tmp_path, [items, [(t, 500, "connect", "c", c) for t, c in cursors]])
    batch = timeline.replay(spark.createDataFrame([(t, s) for t, _, _, _, s in items], "thread_id long, seq long"), spark.createDataFrame(cursors, "thread_id long, cursor long"))
    assert [(t, e, c, n) for t, _, _, e, c, n in found] == sorted((r.thread_id, r.event, r.cursor_after, r["items"]) for r in batch.collect())


def test_however_the_rows_are_cut(spark, tmp_path):
    rng, rows, times = random.Random(6), [], [0, 0, 0]
    open_ = [set(), set(), set()]
    for i in range(140):
        t = rng.randrange(3)
        times[t] += rng.choice([1, 30, 99, 100, 101, 2_000, 15_000, 40_000])
        kind = rng.choice(["item", "item", "item", "touch", "connect", "leave"])
        conn = rng.choice("ab") if kind in ("connect", "leave") else None
        seq = rng.randrange(1, 60) if kind == "item" else rng.choice([None, 0, 5, 99]) if kind == "connect" else None
        rows.append((t, times[t], kind, conn, seq))
    rows.sort(key=lambda r: r[1])
    end = max(times) + 60_000
    rows.append((7, end, "touch", None, None))  # moves the clock on
    want = sorted((t, at, conn, e, c, n) for t in range(3) for conn, at, e, c, n in live.replayed([r[1:] for r in rows if r[0] == t], until=end))
    cuts = [0, 13, 14, 60, 110, len(rows)]
    assert run(spark, tmp_path / "five", [rows[a:b] for a, b in zip(cuts, cuts[1:])]) == want
    assert run(spark, tmp_path / "one", [rows[:-1], rows[-1:]]) == want
    whole = live.replay_all(spark.createDataFrame(rows, ROW).repartition(3), end).where("thread_id < 3")
    assert sorted((r.thread_id, r.at, r.conn, r.event, r.cursor, r["items"]) for r in whole.collect()) == want
    assert {e for *_, e, _, _ in want} == {"snapshot", "reset", "items_appended", "thread_updated", "heartbeat"}


def test_on_the_processing_clock(spark, tmp_path):
    """Keepalives come while nothing else does, and state outlives a restart of the query."""
    put(spark, tmp_path, [(1, 0, "item", None, 1), (1, 1, "connect", "c", None), (None, 0, "connect", "x", None)])

    def start():
        stream = live.live(wakes(spark, tmp_path), debounce_ms=50, keepalive_ms=400)
        return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="100 milliseconds").start()

    def until(query, enough):
        for _ in range(300):
            got = [(r.event, r.cursor) for r in spark.read.schema(live.EVENT).parquet(f"{tmp_path}/out").orderBy("at").collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []
            if enough(got):
                break
            time.sleep(0.2)
        query.stop()
        return got

    got = until(start(), lambda g: g.count(("heartbeat", 1)) >= 2)
    assert got[0] == ("snapshot", 1) and set(got[1:]) == {("heartbeat", 1)}
    put(spark, tmp_path, [(1, 0, "item", None, 2), (1, 0, "item", None, 3)])
    got = until(start(), lambda g: ("items_appended", 3) in g and g[-1] == ("heartbeat", 3))
    assert got.count(("snapshot", 1)) == 1 and ("items_appended", 3) in got and got[-1] == ("heartbeat", 3)


def test_frames(spark):
    e = spark.createDataFrame([(1, "c", 5, "heartbeat", 2, 0)], live.EVENT)
    assert e.select(live.frame(e)).first()[0] == 'retry: 3000\nid: 2\nevent: heartbeat\ndata: {"type":"heartbeat","thread_id":1,"cursor":2,"sent_at":5,"payload":{"items":0}}\n\n'
