"""The conversation timeline and the queue: replay by cursor, previews, claims, stale work, failure limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from ..streaming import live


@query("PAG-03", B.with_views("items", "SELECT thread_id, seq, role FROM items WHERE thread_id = 3 ORDER BY seq DESC LIMIT 5 OFFSET 1"))
def pag03(spark, sf_dir):
    return B.items(spark, sf_dir).where("thread_id = 3").select("thread_id", "seq", "role").orderBy(F.desc("seq")).offset(1).limit(5)


@query("FLT-27", B.with_views("items", "SELECT thread_id, seq, role FROM items WHERE seq > 2"))
def flt27(spark, sf_dir):
    return B.items(spark, sf_dir).where("seq > 2").select("thread_id", "seq", "role")


@query("FLT-31", B.with_views("items", "SELECT thread_id, seq, item_type FROM items WHERE item_type <> 'reasoning'"))
def flt31(spark, sf_dir):
    return B.items(spark, sf_dir).where("item_type != 'reasoning'").select("thread_id", "seq", "item_type")


@query("FLT-33", B.with_views("items", "SELECT thread_id, seq, md5(content_text) AS digest FROM items WHERE item_type = 'message' AND role = 'assistant' AND trim(content_text) <> ''"))
def flt33(spark, sf_dir):
    return B.items(spark, sf_dir).where("item_type = 'message' and role = 'assistant' and trim(content_text) != ''").select("thread_id", "seq", F.md5("content_text").alias("digest"))


@query("AGG-06", B.with_views("items", "SELECT thread_id, coalesce(max(seq), 0) AS last_seq, coalesce(max(seq), 0) + 1 AS next_seq FROM items GROUP BY thread_id"))
def agg06(spark, sf_dir):
    last = F.coalesce(F.max("seq"), F.lit(0))
    return B.items(spark, sf_dir).groupBy("thread_id").agg(last.alias("last_seq"), (last + 1).alias("next_seq"))


@query("WIN-03", B.with_views("items", "SELECT thread_id, coalesce(arg_max(trim(content_text), seq) FILTER (trim(content_text) <> ''), '') AS preview FROM items GROUP BY thread_id"))
def win03(spark, sf_dir):
    body = F.trim("content_text")
    return B.items(spark, sf_dir).groupBy("thread_id").agg(F.coalesce(F.max_by(body, F.when(body != "", F.col("seq"))), F.lit("")).alias("preview"))


@query("STR-13", B.with_views("items", "SELECT thread_id, coalesce(nullif(trim(min(CASE WHEN role = 'system' THEN content_text END)), ''), 'Untitled thread') AS title FROM items GROUP BY thread_id"))
def str13(spark, sf_dir):
    t = B.items(spark, sf_dir).groupBy("thread_id").agg(F.min(F.when(F.col("role") == "system", F.col("content_text"))).alias("t"))
    return t.select("thread_id", F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.lit("Untitled thread")).alias("title"))


def append_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-18: new items (thread_id, ord, role, content_text) take the next numbers of their thread in their order."""
    last = old.groupBy("thread_id").agg(F.max("seq").alias("last"))
    n = F.row_number().over(Window.partitionBy("thread_id").orderBy("ord"))
    return new.join(last, "thread_id", "left").select("thread_id", (F.coalesce("last", F.lit(0)) + n).alias("seq"), "role", "content_text")


@query("SNK-18", B.with_views("items", "SELECT i.thread_id, l.last + row_number() OVER (PARTITION BY i.thread_id ORDER BY i.seq) AS seq, role FROM items i JOIN (SELECT thread_id, max(seq) AS last FROM items GROUP BY thread_id) l ON i.thread_id = l.thread_id WHERE role = 'user'"))
def snk18(spark, sf_dir):
    old = B.items(spark, sf_dir)
    return append_items(old, old.where("role = 'user'").withColumnRenamed("seq", "ord")).select("thread_id", "seq", "role")


def replay(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """STM-01: the event that each cursor (thread_id, cursor) meets, the cursor after it, and how many items it carries."""
    last = items.groupBy("thread_id").agg(F.max("seq").alias("last"))
    c = cursors.join(last, "thread_id")
    cursor = F.col("cursor")
    event = F.when(cursor.isNull(), "snapshot").when(cursor > F.col("last"), "reset").when(cursor < F.col("last"), "items_appended").otherwise("thread_updated")
    floor = F.when(F.col("event").isin("snapshot", "reset"), F.lit(-1)).otherwise(F.col("cursor"))
    c = c.withColumn("event", event).withColumn("floor", floor)
    carried = c.join(items.select("thread_id", "seq"), "thread_id").where("seq > floor").groupBy("thread_id").agg(F.count("*").alias("items"))
    return c.join(carried, "thread_id", "left").select("thread_id", "event", F.when(F.col("event") == "thread_updated", F.col("cursor")).otherwise(F.col("last")).alias("cursor_after"), F.coalesce("items", F.lit(0)).alias("items"))


def sample_cursors(items: DataFrame) -> DataFrame:
    """A cursor for each thread: none, behind, at the end, or past it."""
    last = items.groupBy("thread_id").agg(F.max("seq").alias("last"))
    k = F.col("thread_id") % 4
    return last.select("thread_id", F.when(k == 1, F.lit(1)).when(k == 2, F.col("last")).when(k == 3, F.lit(999_999_999)).cast("long").alias("cursor"))


@query("STM-01", B.with_views("items", """SELECT c.thread_id, event, CASE WHEN event = 'thread_updated' THEN cursor ELSE last END AS cursor_after, count(i.seq) AS items
  FROM (SELECT *, CASE WHEN cursor IS NULL THEN 'snapshot' WHEN cursor > last THEN 'reset' WHEN cursor < last THEN 'items_appended' ELSE 'thread_updated' END AS event
    FROM (SELECT thread_id, max(seq) AS last, CASE thread_id % 4 WHEN 1 THEN 1 WHEN 2 THEN max(seq) WHEN 3 THEN 999999999 END AS cursor FROM items GROUP BY thread_id)) c
  LEFT JOIN items i ON i.thread_id = c.thread_id AND i.seq > CASE WHEN event IN ('snapshot', 'reset') THEN -1 ELSE cursor END GROUP BY ALL"""))
def stm01(spark, sf_dir):
    items = B.items(spark, sf_dir)
    return replay(items, sample_cursors(items))


@query("STM-02", B.with_views("items", """SELECT thread_id, CASE WHEN cursor > last THEN 'reset' WHEN cursor < last THEN 'items_appended' ELSE 'thread_updated' END AS event, greatest(cursor, last) * CAST(cursor <= last AS INTEGER) + last * CAST(cursor > last AS INTEGER) AS cursor_after,
  (SELECT count(*) FROM items i WHERE i.thread_id = c.thread_id AND i.seq > CASE WHEN cursor > last THEN -1 ELSE cursor END) AS items FROM (SELECT thread_id, max(seq) AS last, CASE thread_id % 4 WHEN 1 THEN 1 WHEN 2 THEN max(seq) WHEN 3 THEN 999999999 END AS cursor FROM items GROUP BY thread_id) c WHERE cursor IS NOT NULL"""))
def stm02(spark, sf_dir):
    """What a live connection gets next: the rules of STM-01 for those that have a cursor."""
    items = B.items(spark, sf_dir)
    return replay(items, sample_cursors(items).where("cursor is not null"))


def heartbeats(replayed: DataFrame) -> DataFrame:
    """STM-03: a keepalive for connections that get no new items; it leaves their cursor where it is."""
    return replayed.where("event = 'thread_updated'").select("thread_id", F.lit("heartbeat").alias("event"), F.col("cursor_after").alias("cursor"))


@query("STM-03", B.with_views("items", "SELECT thread_id, 'heartbeat' AS event, max(seq) AS cursor FROM items WHERE thread_id % 4 = 2 GROUP BY thread_id"))
def stm03(spark, sf_dir):
    items = B.items(spark, sf_dir)
    return heartbeats(replay(items, sample_cursors(items)))


#: Events as items of their user's thread, which one connection follows from the first on; times in the query are longer than a live stream's.
GATHER_MS, KEEP_MS = 3_600_000, 86_400_000
WAKES = f"""w AS (SELECT user_id AS thread_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
o AS (SELECT thread_id, min(ms) AS opened FROM w GROUP BY thread_id), z AS (SELECT max(ms) + {2 * KEEP_MS} AS till FROM w),
a AS (SELECT thread_id, opened AS moment, 0 AS n FROM o
  UNION ALL SELECT thread_id, due, n + 1 FROM (SELECT a.thread_id, a.n, min(w.ms) + {GATHER_MS} AS due FROM a JOIN w ON w.thread_id = a.thread_id AND w.ms >= a.moment GROUP BY a.thread_id, a.n)),
e AS (SELECT thread_id, moment, n, lead(moment) OVER (PARTITION BY thread_id ORDER BY n) AS later, (SELECT count(*) FROM w WHERE w.thread_id = a.thread_id AND w.ms < a.moment) AS cursor FROM a)"""


def event_wakes(spark, sf_dir: str) -> DataFrame:
    e = B.read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("thread_id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("ms"), "event_id")
    items = e.select("thread_id", "ms", F.lit("item").alias("kind"), F.lit(None).cast("string").alias("conn"), F.row_number().over(Window.partitionBy("thread_id").orderBy("ms", "event_id")).cast("long").alias("seq"))
    opened = e.groupBy("thread_id").agg(F.min("ms").alias("ms")).select("thread_id", "ms", F.lit("connect").alias("kind"), F.lit("c").alias("conn"), F.lit(None).cast("long").alias("seq"))
    return items.unionByName(opened)


@query("STM-04", f"""WITH RECURSIVE {WAKES}
SELECT thread_id, moment AS at_ms, CASE WHEN n = 0 THEN 'snapshot' ELSE 'items_appended' END AS event, cursor, cursor - coalesce(lag(cursor) OVER (PARTITION BY thread_id ORDER BY n), 0) AS items FROM e
UNION ALL SELECT thread_id, moment + k * {KEEP_MS}, 'heartbeat', cursor, 0 FROM e, z, unnest(range(1, CAST(ceil((coalesce(later, till + 1) - moment) / {KEEP_MS}) AS BIGINT))) r(k)""")
def stm04(spark, sf_dir):
    """What the connections get: gathered answers, and keepalives until two of them after the last event."""
    wakes = event_wakes(spark, sf_dir)
    until = wakes.agg(F.max("ms")).first()[0]
    return live.replay_all(wakes, (until or 0) + 2 * KEEP_MS, GATHER_MS, KEEP_MS).drop("conn").withColumnRenamed("at", "at_ms")


STALE_BEFORE = 1704200000


def live_turns(calls: DataFrame, stale_before: int) -> DataFrame:
    """Turns with a running call whose heartbeat is fresh."""
    return calls.where((F.col("status") == "running") & (F.col("beat") >= stale_before)).select("turn_id").distinct()


def claimable(turns: DataFrame, model_calls: DataFrame, tool_calls: DataFrame, me: str, stale_before: int) -> DataFrame:
    """JOI-07: turns that `me` may claim: free, its own, or stale and without a fresh call of the turn in its phase."""
    model = live_turns(model_calls, stale_before).withColumn("in_model", F.lit(True))
    tool = live_turns(tool_calls, stale_before).withColumn("in_tool", F.lit(True))
    t = turns.where(F.col("status").isin("queued", "active")).join(model, "turn_id", "left").join(tool, "turn_id", "left")
    busy: Column = ((F.col("phase") == "executing_model") & F.coalesce("in_model", F.lit(False))) | ((F.col("phase") == "executing_tools") & F.coalesce("in_tool", F.lit(False)))
    return t.where(F.col("worker").isNull() | (F.col("worker") == me) | ((F.col("beat") < stale_before) & ~busy)).drop("in_model", "in_tool")


ME = "worker_3"
CLAIMABLE = f"""SELECT * FROM claims c WHERE status IN ('queued', 'active') AND (worker IS NULL OR worker = '{ME}' OR (beat < {STALE_BEFORE}
  AND NOT (phase = 'executing_model' AND EXISTS (SELECT 1 FROM model_calls x WHERE x.turn_id = c.turn_id AND x.status = 'running' AND x.beat >= {STALE_BEFORE}))
  AND NOT (phase = 'executing_tools' AND EXISTS (SELECT 1 FROM tool_calls x WHERE x.turn_id = c.turn_id AND x.status = 'running' AND x.beat >= {STALE_BEFORE}))))"""


def runnable(spark, sf_dir: str) -> DataFrame:
    return claimable(B.claims(spark, sf_dir), B.turn_calls(spark, sf_dir, False), B.turn_calls(spark, sf_dir, True), ME, STALE_BEFORE)


@query("JOI-07", B.with_views("claims model_calls tool_calls", f"SELECT turn_id, thread_id, phase FROM ({CLAIMABLE})"))
def joi07(spark, sf_dir):
    return runnable(spark, sf_dir).select("turn_id", "thread_id", "phase")


@query("STM-07", B.with_views("claims model_calls tool_calls", f"SELECT turn_id, thread_id, phase, '{ME}' AS claimed_by, {STALE_BEFORE} + 30 AS claimed_at FROM ({CLAIMABLE}) ORDER BY queued_at, turn_id LIMIT 1"))
def stm07(spark, sf_dir):
    """The next turn, as claimed: the one that waits longest."""
    return runnable(spark, sf_dir).orderBy("queued_at", "turn_id").limit(1).select("turn_id", "thread_id", "phase", F.lit(ME).alias("claimed_by"), F.lit(STALE_BEFORE + 30).alias("claimed_at"))


@query("STM-07-threads", B.with_views("claims model_calls tool_calls", f"SELECT thread_id, arg_min(turn_id, (queued_at, turn_id)) AS turn_id FROM ({CLAIMABLE}) GROUP BY thread_id"))
def stm07_threads(spark, sf_dir):
    """The same for workers bound to one thread each: the next turn of every thread, in one pass."""
    return runnable(spark, sf_dir).groupBy("thread_id").agg(F.min_by("turn_id", F.struct("queued_at", "turn_id")).alias("turn_id"))


@query("FLT-30", B.with_views("claims", "SELECT turn_id, status FROM claims WHERE status IN ('queued', 'active') ORDER BY queued_at, turn_id LIMIT 25"))
def flt30(spark, sf_dir):
    return B.claims(spark, sf_dir).where(F.col("status").isin("queued", "active")).orderBy("queued_at", "turn_id").limit(25).select("turn_id", "status")


@query("STM-11", B.with_views("claims", f"SELECT turn_id, worker FROM claims WHERE status = 'active' AND worker IS NOT NULL AND beat < {STALE_BEFORE}"))
def stm11(spark, sf_dir):
    return B.claims(spark, sf_dir).where((F.col("status") == "active") & F.col("worker").isNotNull() & (F.col("beat") < STALE_BEFORE)).select("turn_id", "worker")


STALE_CALLS = f"SELECT x.call_id, x.turn_id, c.thread_id FROM %s x JOIN claims c ON c.turn_id = x.turn_id WHERE x.status = 'running' AND x.beat < {STALE_BEFORE} AND c.phase = '%s' AND c.status = 'active'"


def stale_calls(calls: DataFrame, turns: DataFrame, phase: str, stale_before: int) -> DataFrame:
    """Running calls without a fresh heartbeat whose turn is active and still in that phase."""
    t = turns.where((F.col("status") == "active") & (F.col("phase") == phase)).select("turn_id", "thread_id")
    return calls.where((F.col("status") == "running") & (F.col("beat") < stale_before)).join(t, "turn_id").select("call_id", "turn_id", "thread_id")


@query("JOI-05", B.with_views("claims tool_calls", STALE_CALLS % ("tool_calls", "executing_tools")))
def joi05(spark, sf_dir):
    return stale_calls(B.turn_calls(spark, sf_dir, True), B.claims(spark, sf_dir), "executing_tools", STALE_BEFORE)


@query("JOI-06", B.with_views("claims model_calls", STALE_CALLS % ("model_calls", "executing_model")))
def joi06(spark, sf_dir):
    return stale_calls(B.turn_calls(spark, sf_dir, False), B.claims(spark, sf_dir), "executing_model", STALE_BEFORE)


@query("JOI-16", B.with_views("claims", "SELECT t.thread_id, a.phase AS active_phase, l.phase AS last_phase FROM (SELECT thread_id, max(turn_id) FILTER (status = 'active') AS active_turn, max(turn_id) AS last_turn FROM claims GROUP BY thread_id) t LEFT JOIN claims a ON t.active_turn = a.turn_id LEFT JOIN claims l ON t.last_turn = l.turn_id"))
def joi16(spark, sf_dir):
    c = B.claims(spark, sf_dir)
    t = c.groupBy("thread_id").agg(F.max(F.when(F.col("status") == "active", F.col("turn_id"))).alias("active_turn"), F.max("turn_id").alias("last_turn"))
    a = c.select(F.col("turn_id").alias("active_turn"), F.col("phase").alias("active_phase"))
    z = c.select(F.col("turn_id").alias("last_turn"), F.col("phase").alias("last_phase"))
    return t.join(a, "active_turn", "left").join(z, "last_turn", "left").select("thread_id", "active_phase", "last_phase")


LIMIT, SECONDS = 5, 300


def failures_in_window(failures: DataFrame, key: str, ts: str, seconds: int = SECONDS) -> DataFrame:
    """STM-20: how many failures a key has had in the seconds up to each one, both ends counted."""
    w = Window.partitionBy(key).orderBy(T.seconds(F.col(ts))).rangeBetween(-seconds, 0)
    return failures.withColumn("recent", F.count("*").over(w))


@query("STM-20", f"SELECT event_id, user_id, recent, recent >= {LIMIT} AS blocked FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN {SECONDS} PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')")
def stm20(spark, sf_dir):
    f = failures_in_window(B.read(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "ts")
    return f.select("event_id", "user_id", "recent", (F.col("recent") >= LIMIT).alias("blocked"))


@query("MTH-12", f"SELECT turn_id, beat IS NOT NULL AND beat < {STALE_BEFORE} - 120 AS stale FROM claims".join(["WITH claims AS (" + B.SQL["claims"] + ") ", ""]))
def mth12(spark, sf_dir):
    return B.claims(spark, sf_dir).select("turn_id", (F.col("beat").isNotNull() & (F.col("beat") < STALE_BEFORE - 120)).alias("stale"))


@query("STR-16", B.with_views("items", r"SELECT thread_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 79)) || '...' END AS title FROM (SELECT thread_id, trim(regexp_replace(coalesce(content_text, ''), '\s+', ' ', 'g')) AS c FROM items WHERE seq = 1)"))
def str16(spark, sf_dir):
    return B.items(spark, sf_dir).where("seq = 1").select("thread_id", T.cut(F.col("content_text"), 80).alias("title"))
