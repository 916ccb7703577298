"""The turn queue and its payloads: claims, stale work, state machine, subscriptions, usage, JSON text, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .timeline import CLAIMABLE, ME, STALE_BEFORE, claimable

CALLS = "SELECT turn_id AS call_id, thread_id, status, worker, beat, queued_at FROM claims WHERE phase = 'executing_model'"
TOOLS = "SELECT turn_id AS call_id, thread_id, status, worker, beat, queued_at FROM claims WHERE phase = 'executing_tools'"


def calls(spark, sf_dir: str, phase: str) -> DataFrame:
    return B.claims(spark, sf_dir).where(F.col("phase") == phase).select(F.col("turn_id").alias("call_id"), "thread_id", "status", "worker", "beat", "queued_at")


def _call_queries(phase: str, sql: str, one: str, page: str, claim: str, stale: str) -> None:
    """Model calls and tool invocations have the same shape."""

    @query(one, B.with_views("claims", "SELECT call_id, thread_id, status FROM calls WHERE call_id BETWEEN 40 AND 43", calls=sql))
    def by_id(spark, sf_dir):
        return calls(spark, sf_dir, phase).where("call_id between 40 and 43").select("call_id", "thread_id", "status")

    @query(page, B.with_views("claims", "SELECT call_id, status FROM calls ORDER BY queued_at DESC, call_id LIMIT 20 OFFSET 20", calls=sql))
    def a_page(spark, sf_dir):
        return calls(spark, sf_dir, phase).orderBy(F.desc("queued_at"), "call_id").offset(20).limit(20).select("call_id", "status")

    @query(claim, B.with_views("claims", f"SELECT call_id FROM calls WHERE status = 'queued' OR (status = 'active' AND (beat IS NULL OR beat < {STALE_BEFORE}))", calls=sql))
    def may_claim(spark, sf_dir):
        """Created calls, and running ones without a fresh heartbeat."""
        return calls(spark, sf_dir, phase).where((F.col("status") == "queued") | ((F.col("status") == "active") & (F.col("beat").isNull() | (F.col("beat") < STALE_BEFORE)))).select("call_id")

    @query(stale, B.with_views("claims", f"SELECT call_id, CASE WHEN status = 'active' AND beat < {STALE_BEFORE} THEN 'failed' ELSE status END AS status, CASE WHEN NOT (status = 'active' AND coalesce(beat < {STALE_BEFORE}, false)) THEN worker END AS worker FROM calls", calls=sql))
    def fail_stale(spark, sf_dir):
        """Running calls whose lease is over fail and lose their worker; all others stay as they are."""
        over = (F.col("status") == "active") & F.coalesce(F.col("beat") < STALE_BEFORE, F.lit(False))
        return calls(spark, sf_dir, phase).select("call_id", F.when(over, "failed").otherwise(F.col("status")).alias("status"), F.when(~over, F.col("worker")).alias("worker"))


_call_queries("executing_model", CALLS, "PRJ-13", "PAG-05", "STM-09", "STM-12")
_call_queries("executing_tools", TOOLS, "PRJ-14", "PAG-06", "STM-10", "STM-13")


@query("PRJ-11", B.with_views("items", "SELECT thread_id, count(*) AS items, max(seq) AS last_seq FROM items WHERE thread_id = 3 GROUP BY thread_id"))
def prj11(spark, sf_dir):
    return B.items(spark, sf_dir).where("thread_id = 3").groupBy("thread_id").agg(F.count("*").alias("items"), F.max("seq").alias("last_seq"))


@query("PRJ-21", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def prj21(spark, sf_dir):
    return B.read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("STM-08", B.with_views("claims model_calls tool_calls", f"SELECT turn_id, thread_id FROM ({CLAIMABLE}) WHERE turn_id = 45"))
def stm08(spark, sf_dir):
    """One named turn, if it may be claimed; only its own calls are looked at."""
    one = F.col("turn_id") == 45
    calls = (B.turn_calls(spark, sf_dir, tools).where(one) for tools in (False, True))
    return claimable(B.claims(spark, sf_dir).where(one), *calls, ME, STALE_BEFORE).select("turn_id", "thread_id")


def cursor_of(asked: Column, seen: Column) -> Column:
    """STM-05: the cursor asked for, else that of the last event seen, else none; what is no number from 0 counts as not given."""
    number = lambda c: F.when(c.try_cast("long") >= 0, c.try_cast("long"))
    return F.coalesce(number(asked), number(seen))


@query("STM-05", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 AND event_id % 5 > 0 THEN event_id % 5 END, CASE WHEN event_id % 2 = 0 THEN event_id END) AS cursor FROM events")
def stm05(spark, sf_dir):
    k = F.col("event_id")
    asked = F.when((k % 3 == 0) & (k % 5 > 0), (k % 5).cast("string")).when(k % 3 == 1, "-7").otherwise("x")
    seen = F.when(k % 2 == 0, k.cast("string")).otherwise("")
    return B.read(spark, sf_dir, "events").select("event_id", cursor_of(asked, seen).alias("cursor"))


SUBSCRIPTIONS = [(1, 3, None, None), (2, None, None, "error"), (3, 5, None, "purchase"), (4, 7, None, "signup"), (5, None, 44, None), (6, None, 45, "error"), (7, None, None, None), (8, 5, 46, None)]
KEYS = ("thread", "turn", "kind")
#: Subscriptions to everything are held beside every event: so many at most.
MAX_OPEN = 10_000


def dispatch(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """STM-06: each event to the subscriptions whose thread, turn and kind (as far as the subscriptions have these columns) it has; null is any.

    One equi-join for each combination of keys that occurs; subscriptions without any key get all events, from a list
    of checked length that goes along with each row.
    """
    known = [k for k in KEYS if k in subscriptions.columns]
    given = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), k) for k in known]))
    out = None
    for keys in (r["keys"] for r in subscriptions.select(given.alias("keys")).distinct().collect()):  # eight at most
        s = subscriptions.where(" and ".join(f"{k} is {'not ' * (k in keys)}null" for k in known)).select(*keys, "sub")
        if keys:
            one = events.join(s, keys)
        else:
            open_ = sorted(r["sub"] for r in s.limit(MAX_OPEN + 1).collect())
            if len(open_) > MAX_OPEN:
                raise ValueError(f"at most {MAX_OPEN} subscriptions without any key")
            one = events.withColumn("sub", F.explode(F.array(*map(F.lit, open_))))
        one = one.select("event_id", "sub")
        out = one if out is None else out.unionByName(one)
    return events.select("event_id").limit(0).withColumn("sub", F.lit(0)) if out is None else out


_LISTED = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in s) + ")" for s in SUBSCRIPTIONS)


@query("STM-06", f"SELECT event_id, sub FROM events JOIN (VALUES {_LISTED}) s(sub, thread, turn, kind) ON (thread IS NULL OR thread = user_id) AND (turn IS NULL OR turn = event_id - event_id % 4) AND (kind IS NULL OR kind = event_type)")
def stm06(spark, sf_dir):
    s = spark.createDataFrame(SUBSCRIPTIONS, "sub int, thread long, turn long, kind string")
    e = B.read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("thread"), (F.col("event_id") - F.col("event_id") % 4).alias("turn"), F.col("event_type").alias("kind"))
    return dispatch(e, s)


def last_heartbeats(claims: DataFrame) -> DataFrame:
    """STM-15: thread_id, worker, beat: the latest heartbeat of each worker in each thread; rows without a worker have none."""
    return claims.where("worker is not null").groupBy("thread_id", "worker").agg(F.max("beat").alias("beat"))


@query("STM-15", B.with_views("claims", "SELECT thread_id, worker, max(beat) AS beat FROM claims WHERE worker IS NOT NULL GROUP BY thread_id, worker"))
def stm15(spark, sf_dir):
    return last_heartbeats(B.claims(spark, sf_dir))


def next_turns(turns: DataFrame) -> DataFrame:
    """STM-16: thread_id, idle, next_turn: a thread takes its next turn only while no turn of it is active."""
    return turns.groupBy("thread_id").agg((F.count_if(F.col("status") == "active") == 0).alias("idle"), F.min(F.when(F.col("status") == "queued", F.col("turn_id"))).alias("next_turn"))


@query("STM-16", B.with_views("claims", "SELECT thread_id, count_if(status = 'active') = 0 AS idle, min(CASE WHEN status = 'queued' THEN turn_id END) AS next_turn FROM claims GROUP BY thread_id"))
def stm16(spark, sf_dir):
    return next_turns(B.claims(spark, sf_dir))


def phase_steps(turns: DataFrame) -> DataFrame:
    """STM-17: was, phase, n: how often one phase followed another from a thread's turn to its next."""
    before = F.lag("phase").over(Window.partitionBy("thread_id").orderBy("turn_id"))
    return turns.select("phase", before.alias("was")).where("was is not null").groupBy("was", "phase").agg(F.count("*").alias("n"))


@query("STM-17", B.with_views("claims", "SELECT was, phase, count(*) AS n FROM (SELECT phase, lag(phase) OVER (PARTITION BY thread_id ORDER BY turn_id) AS was FROM claims) WHERE was IS NOT NULL GROUP BY ALL"))
def stm17(spark, sf_dir):
    return phase_steps(B.claims(spark, sf_dir))


@query("STM-21", B.with_views("items", "SELECT thread_id, count(*) AS items FROM items WHERE thread_id % 5 <> 0 GROUP BY thread_id"))
def stm21(spark, sf_dir):
    """Items of deleted threads go with them."""
    items = B.items(spark, sf_dir)
    gone = items.where("thread_id % 5 = 0").select("thread_id").distinct()
    return items.join(gone, "thread_id", "left_anti").groupBy("thread_id").agg(F.count("*").alias("items"))


def stale_actions(stale: DataFrame, tools: DataFrame) -> DataFrame:
    """SIB-72: call_id, action: stale calls (call_id, tool) are tried again if their tool (tool, retry_on_stale) is unknown or allows it; else their turn fails."""
    return stale.join(tools, "tool", "left").select("call_id", F.when(F.coalesce("retry_on_stale", F.lit(True)), "retry").otherwise("fail_turn").alias("action"))


@query("SIB-72", B.with_views("claims", f"SELECT call_id, CASE WHEN call_id % 3 = 0 OR call_id % 4 = 2 THEN 'retry' ELSE 'fail_turn' END AS action FROM tools WHERE status = 'active' AND beat < {STALE_BEFORE}", tools=TOOLS))
def sib72(spark, sf_dir):
    known = spark.createDataFrame([("search", False), ("page", True)], "tool string, retry_on_stale boolean")
    tool = F.when(F.col("call_id") % 3 == 0, "gone").when(F.col("call_id") % 4 == 2, "page").otherwise("search")
    stale = calls(spark, sf_dir, "executing_tools").where((F.col("status") == "active") & (F.col("beat") < STALE_BEFORE)).select("call_id", tool.alias("tool"))
    return stale_actions(stale, known)


@query("WIN-02", B.with_views("claims", "SELECT thread_id, max(call_id) AS call_id, arg_max(status, call_id) AS status FROM calls GROUP BY thread_id", calls=CALLS))
def win02(spark, sf_dir):
    return calls(spark, sf_dir, "executing_model").groupBy("thread_id").agg(F.max("call_id").alias("call_id"), F.max_by("status", "call_id").alias("status"))


@query("WIN-21", B.with_views("items", "SELECT thread_id, seq, row_number() OVER (PARTITION BY thread_id ORDER BY CASE WHEN seq % 4 <> 0 THEN seq END NULLS LAST, seq) AS place FROM items"))
def win21(spark, sf_dir):
    """By number, those without one last and by time."""
    w = Window.partitionBy("thread_id").orderBy(F.asc_nulls_last(F.when(F.col("seq") % 4 != 0, F.col("seq"))), "seq")
    return B.items(spark, sf_dir).select("thread_id", "seq", F.row_number().over(w).cast("long").alias("place"))


@query("FLT-32", B.with_views("items", "SELECT thread_id, seq FROM items WHERE coalesce(CASE WHEN seq % 4 <> 0 THEN seq END, 0) > 1"))
def flt32(spark, sf_dir):
    numbered = F.when(F.col("seq") % 4 != 0, F.col("seq"))
    return B.items(spark, sf_dir).where(F.coalesce(numbered, F.lit(0)) > 1).select("thread_id", "seq")


@query("AGG-07", B.with_views("items", "SELECT thread_id, coalesce(max(seq), 0) + 1 AS next_seq FROM items GROUP BY thread_id"))
def agg07(spark, sf_dir):
    return B.items(spark, sf_dir).groupBy("thread_id").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


@query("AGG-22", "SELECT event_id, user_id, CAST(sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events")
def agg22(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return B.read(spark, sf_dir, "events").select("event_id", "user_id", F.sum(F.col("event_id") % 97).over(w).alias("running"))


@query("AGG-23", "SELECT user_id, CAST(sum(event_id % 97) AS BIGINT) AS tokens, arg_max(event_type, event_id) AS model FROM events GROUP BY user_id")
def agg23(spark, sf_dir):
    """Numbers add up, of other values the latest stays."""
    return B.read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("event_id") % 97).alias("tokens"), F.max_by("event_type", "event_id").alias("model"))


@query("SIB-26", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id % 97 END) AS BIGINT) AS tokens, CAST(sum(coalesce(CASE WHEN event_type = 'purchase' THEN event_id % 97 END, 0)) AS BIGINT) AS filled FROM events GROUP BY user_id")
def sib26(spark, sf_dir):
    """SIB-26, 27: usage is null where none was reported; with the default it is 0."""
    used = F.when(F.col("event_type") == "purchase", F.col("event_id") % 97)
    return B.read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(used).alias("tokens"), F.sum(F.coalesce(used, F.lit(0))).alias("filled"))


@query("AGG-31", "SELECT user_id, avg(CASE WHEN event_type <> 'click' AND event_id % 101 - 10 >= 0 THEN event_id % 101 - 10 END) AS mean FROM events GROUP BY user_id")
def agg31(spark, sf_dir):
    """Mean confidence of the tokens that aren't blank; null if there is none."""
    token, conf = F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")), F.col("event_id") % 101 - 10
    return B.read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when((F.trim(token) != "") & (conf >= 0), conf)).alias("mean"))


@query("SET-07", "SELECT user_id, count(DISTINCT event_type) = 1 AND min(event_type) = 'view' AS only_view FROM events GROUP BY user_id")
def set07(spark, sf_dir):
    return B.read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds")).select("user_id", F.array_sort("kinds").eqNullSafe(F.array(F.lit("view"))).alias("only_view"))


def text_list(c: Column) -> Column:
    """JSN-02: a JSON list of texts; whatever else gives the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


@query("JSN-02", "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN array_to_string(list_filter([event_type, CASE WHEN event_id % 5 = 1 THEN CAST(user_id AS VARCHAR) END, 'x ' || event_id], lambda x: x IS NOT NULL), ',') ELSE '' END AS listed FROM events")
def jsn02(spark, sf_dir):
    """Lists of strings and numbers; objects, blank and broken texts are no list."""
    k = F.col("event_id") % 5
    last = F.concat(F.lit("x "), F.col("event_id").cast("string"))
    mixed = F.concat(F.lit('["'), "event_type", F.lit('", '), F.col("user_id").cast("string"), F.lit(', "'), last, F.lit('"]'))
    raw = F.when(k == 1, mixed).when(k < 3, F.to_json(F.array("event_type", last))).when(k == 3, F.concat(F.lit('{"a": ["'), "event_type", F.lit('"]}'))).otherwise(F.concat(F.lit("["), "event_type"))
    return B.read(spark, sf_dir, "events").select("event_id", F.array_join(text_list(raw), ",").alias("listed"))


@query("JSN-03", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS flag FROM events")
def jsn03(spark, sf_dir):
    k = (F.col("event_id") % 3).cast("int")
    return B.read(spark, sf_dir, "events").select("event_id", F.when(k < 2, k).cast("boolean").alias("flag"))


@query("JSN-04", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def jsn04(spark, sf_dir):
    props = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return B.read(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("k")).alias("k"))


@query("JSN-05", """SELECT event_id, '{"type":"' || event_type || '","worker":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(event_id % 7 AS VARCHAR) END || '}' AS payload FROM events""")
def jsn05(spark, sf_dir):
    """Null fields are written."""
    worker = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7)
    return B.read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), worker.alias("worker")), {"ignoreNullFields": "false"}).alias("payload"))


SAID = "CASE event_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'so ' || props || ' it is' WHEN 2 THEN props || ' and {not closed' ELSE 'none: ' || event_type END"


@query("JSN-06", rf"SELECT event_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.k') END AS k, json_valid(j) AS found FROM (SELECT event_id, regexp_extract({SAID}, '\{{(.|\n)*\}}') AS j FROM events)")
def jsn06(spark, sf_dir):
    """The object that an answer holds, with or without a fence around it, from its first brace to its last."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).when(k == 2, F.concat("props", F.lit(" and {not closed"))).otherwise(F.concat(F.lit("none: "), "event_type"))
    held = F.regexp_extract(said, r"(?s)\{.*\}", 0)
    return B.read(spark, sf_dir, "events").select("event_id", F.get_json_object(held, "$.k").alias("k"), (F.get_json_object(held, "$").isNotNull()).alias("found"))


@query("COE-04", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_id % 4 + 1))), ',') AS pages FROM events GROUP BY user_id")
def coe04(spark, sf_dir):
    """Evidence pages as sorted distinct numbers; they come as numbers or as texts."""
    return B.read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 4 + 1).cast("string")).otherwise(F.format_string(" %d ", F.col("event_id") % 4 + 1))).alias("raw")).select("user_id", F.array_join(F.array_sort(F.array_distinct(F.transform("raw", lambda p: F.trim(p).try_cast("int")))), ",").alias("pages"))


@query("COE-13", B.with_views("items", "SELECT thread_id, count(*) AS messages, md5(string_agg(role || ':' || length(content_text), ';' ORDER BY seq)) AS digest FROM items WHERE item_type = 'message' GROUP BY thread_id"))
def coe13(spark, sf_dir):
    """Chat messages of each thread in order."""
    m = F.array_sort(F.collect_list(F.struct("seq", "role", "chars")))
    shown = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["chars"].cast("string"))), ";")
    # a length for each text, before the exchange: a long thread brings no texts to its task
    items = B.items(spark, sf_dir).where("item_type = 'message'").select("thread_id", "seq", "role", F.length("content_text").alias("chars"))
    return items.groupBy("thread_id").agg(m.alias("m")).select("thread_id", F.size("m").alias("messages"), F.md5(shown).alias("digest"))


@query("MTH-13", f"SELECT event_id, {STALE_BEFORE} - epoch_us(ts) // 1000000 BETWEEN 0 AND 604800 AND {STALE_BEFORE} - (epoch_us(ts) // 1000000 + event_id % 5 * 86400) <= 172800 AS valid, {STALE_BEFORE} - (epoch_us(ts) // 1000000 + event_id % 5 * 86400) >= 900 AS refresh FROM events")
def mth13(spark, sf_dir):
    """MTH-13, 14: sessions last 7 days from their start and 2 from their last use; they are refreshed after 15 minutes."""
    age, idle = F.lit(STALE_BEFORE) - T.seconds(F.col("ts")), F.lit(STALE_BEFORE) - (T.seconds(F.col("ts")) + F.col("event_id") % 5 * 86400)
    return B.read(spark, sf_dir, "events").select("event_id", (age.between(0, 7 * 86400) & (idle <= 2 * 86400)).alias("valid"), (idle >= 900).alias("refresh"))


@query("MTH-15", "SELECT event_id, epoch_us(ts) // 1000000 AS at FROM events")
def mth15(spark, sf_dir):
    """Text of a time and back."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return B.read(spark, sf_dir, "events").select("event_id", T.seconds(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss")).alias("at"))


@query("MTH-17", B.with_views("claims", f"SELECT turn_id, greatest(0, {STALE_BEFORE} - beat) AS duration FROM claims WHERE beat IS NOT NULL"))
def mth17(spark, sf_dir):
    return B.claims(spark, sf_dir).where("beat is not null").select("turn_id", F.greatest(F.lit(0), F.lit(STALE_BEFORE) - F.col("beat")).alias("duration"))


@query("SIB-57", B.with_views("items", "SELECT thread_id, max(seq) AS last_seq, length(arg_max(content_text, seq)) AS preview FROM items GROUP BY thread_id ORDER BY last_seq DESC, thread_id LIMIT 25"))
def sib57(spark, sf_dir):
    t = B.items(spark, sf_dir).groupBy("thread_id").agg(F.max("seq").alias("last_seq"), F.length(F.max_by("content_text", "seq")).alias("preview"))
    return t.orderBy(F.desc("last_seq"), "thread_id").limit(25)


@query("SIB-63", B.with_views("claims", "SELECT turn_id, CASE WHEN turn_id % 6 = 1 THEN 'completed' ELSE status END AS status FROM claims"))
def sib63(spark, sf_dir):
    """Turns take the values of their updates; those without one stay."""
    t = B.claims(spark, sf_dir).select("turn_id", "status")
    fresh = t.where("turn_id % 6 = 1").select("turn_id", F.lit("completed").alias("fresh"))
    return t.join(fresh, "turn_id", "left").select("turn_id", F.coalesce("fresh", "status").alias("status"))


@query("SIB-75", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'override' END, CASE WHEN event_id % 3 = 0 THEN 'base' END, 'default') AS model, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS effort FROM events")
def sib75(spark, sf_dir):
    """An option is that of the call, else that of the agent, else the default; of the extras the call's win."""
    k = F.col("event_id")
    extras = lambda c: F.create_map(F.lit("effort"), F.lit(c))
    call = F.when(k % 2 == 0, extras("high")).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_zip_with(extras("low"), call, lambda _, old, new: F.coalesce(new, old))
    return B.read(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(k % 2 == 0, "override"), F.when(k % 3 == 0, "base"), F.lit("default")).alias("model"), merged["effort"].alias("effort"))
