"""Action blocks of the runtime: each changes several tables at once, or none.

A `Runtime` holds the tables; a block takes one and returns the next. Blocks are guarded by the state that they need: a
response to a call that no longer runs, or whose turn has moved on, changes nothing, so a block that comes twice counts
once. `sources.commits` writes what a block returns in one step.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import bridges as B
from ..plans.catalog import query
from .timeline import STALE_BEFORE

ERROR = "struct<message:string,tool:string>"


@dataclass(frozen=True)
class Runtime:
    """threads (thread_id, status, phase, active_turn, last_turn), turns (turn_id, thread_id, status, phase, worker, beat,
    tokens, error, completed_at), calls (call_id, turn_id, status, beat, tokens, error, completed_at), tools (tool_id,
    thread_id, turn_id, call_id, item_seq, tool, arguments, status, worker, beat, error, completed_at), items (thread_id,
    seq, item_type, role, content_text)."""

    threads: DataFrame
    turns: DataFrame
    calls: DataFrame
    tools: DataFrame
    items: DataFrame


def changed(old: DataFrame, new: DataFrame, key: str, **values: Column) -> DataFrame:
    """`old` with the given columns set where `new` has a row of that key; `values` may use the columns of `new` as `n`."""
    hit = F.col(f"n.{key}").isNotNull()
    met = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return met.select(*[(F.when(hit, values[c]).otherwise(F.col(f"o.{c}")) if c in values else F.col(f"o.{c}")).alias(c) for c in old.columns])


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _error(message: Column, tool: Column | None = None) -> Column:
    return F.struct(message.alias("message"), (_none("string") if tool is None else tool).alias("tool"))


def _open(state: Runtime, told: DataFrame) -> DataFrame:
    """Rows of `told` (call_id, ...) whose call runs in an active turn that waits for it, the first call of each turn, with turn and thread."""
    calls = state.calls.where("status = 'running'").select("call_id", "turn_id")
    turns = state.turns.where("status = 'active' and phase = 'executing_model'").select("turn_id", "thread_id")
    met = told.join(calls, "call_id").join(turns, "turn_id")
    return met.withColumn("_first", F.row_number().over(Window.partitionBy("turn_id").orderBy("call_id"))).where("_first = 1").drop("_first")


def succeed(state: Runtime, responses: DataFrame, outputs: DataFrame, now: int) -> Runtime:
    """SIB-67 with SIB-66: responses (call_id, tokens) and what they hold (call_id, ord, item_type, tool, body).

    Outputs become items at the end of their threads, tool calls among them requests; the call is completed and its
    tokens are added to the turn, which goes on to its tools or, without any, is completed.
    """
    done = _open(state, responses)
    last = state.items.groupBy("thread_id").agg(F.max("seq").alias("last"))
    placed = outputs.join(done.select("call_id", "turn_id", "thread_id"), "call_id").join(last, "thread_id", "left")
    seq = (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("thread_id").orderBy("call_id", "ord"))).alias("seq")
    placed = placed.select("thread_id", "turn_id", "call_id", "ord", "item_type", "tool", "body", seq)
    tools = placed.where("item_type = 'tool_call'")
    asked = tools.select(F.concat_ws(":", "call_id", "ord").alias("tool_id"), "thread_id", "turn_id", "call_id", F.col("seq").alias("item_seq"), "tool", F.col("body").alias("arguments"), F.lit("requested").alias("status"), _none("string").alias("worker"), _none("long").alias("beat"), _none("string").alias("error"), _none("long").alias("completed_at"))
    then = done.join(tools.select("turn_id").distinct().withColumn("more", F.lit(True)), "turn_id", "left")
    phase = F.when(F.col("n.more"), "executing_tools").otherwise("completed")
    return replace(
        state,
        items=state.items.unionByName(placed.select("thread_id", "seq", "item_type", F.lit("assistant").alias("role"), F.col("body").alias("content_text"))),
        tools=state.tools.unionByName(asked.select(*state.tools.columns)),
        calls=changed(state.calls, done, "call_id", status=F.lit("completed"), tokens=F.col("n.tokens"), beat=_none("long"), completed_at=F.lit(now).cast("long")),
        turns=changed(state.turns, then, "turn_id", phase=phase, tokens=F.coalesce("o.tokens", F.lit(0)) + F.coalesce("n.tokens", F.lit(0))),
    )


def fail(state: Runtime, failures: DataFrame, now: int) -> Runtime:
    """SIB-68: failures (call_id, message): the call fails, and its turn, still active, is in phase `failed` with the message."""
    done = _open(state, failures)
    error = _error(F.col("n.message"))
    return replace(
        state,
        calls=changed(state.calls, done, "call_id", status=F.lit("failed"), error=error, beat=_none("long"), completed_at=F.lit(now).cast("long")),
        turns=changed(state.turns, done, "turn_id", phase=F.lit("failed"), error=error),
    )


def fail_stale_tools(tools: DataFrame, stale_before: int, now: int, message: str) -> DataFrame:
    """SIB-71: running calls of tools whose heartbeat is old fail, without worker and heartbeat; those without a heartbeat stay."""
    old = tools.where((F.col("status") == "running") & (F.col("beat") < stale_before)).select("tool_id")
    return _failed(tools, old, now, message)


def _failed(tools: DataFrame, which: DataFrame, now: int, message: str) -> DataFrame:
    return changed(tools, which, "tool_id", status=F.lit("failed"), error=F.lit(message), worker=_none("string"), beat=_none("long"), completed_at=F.lit(now).cast("long"))


def fail_stale_turns(state: Runtime, stale_before: int, now: int, message: str) -> Runtime:
    """STM-14: stale calls of tools fail together with their turns, which stay active in phase `failed`; threads go back to them.

    The turn must be executing its tools, and its thread be idle or on that turn. A thread takes the call that has waited
    longest; by then its other turns and the turn's other calls are no longer in such a state, and stay as they are.
    """
    turns = state.turns.where("status = 'active' and phase = 'executing_tools'").select("turn_id")
    old = state.tools.where((F.col("status") == "running") & (F.col("beat") < stale_before)).select("tool_id", "turn_id", "thread_id", "tool", "beat")
    met = old.join(turns, "turn_id").join(state.threads.select("thread_id", "active_turn"), "thread_id").where("active_turn is null or active_turn = turn_id")
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("thread_id").orderBy("beat", "tool_id"))).where("_n = 1").select("tool_id", "turn_id", "thread_id", "tool")
    return replace(
        state,
        tools=_failed(state.tools, first.select("tool_id"), now, message),
        turns=changed(state.turns, first, "turn_id", phase=F.lit("failed"), error=_error(F.lit(message), F.col("n.tool"))),
        threads=changed(state.threads, first, "thread_id", status=F.lit("running"), phase=F.lit("failed"), active_turn=F.col("n.turn_id")),
    )


def finish(state: Runtime, now: int) -> Runtime:
    """SIB-70: active turns in phase `completed` or `failed` end, free of worker and heartbeat; their threads are idle, with the latest as their last turn."""
    done = state.turns.where("status = 'active' and phase in ('completed', 'failed')").select("turn_id", "thread_id", "phase")
    ends = done.groupBy("thread_id").agg(F.max("turn_id").alias("turn_id"))
    return replace(
        state,
        turns=changed(state.turns, done, "turn_id", status=F.col("n.phase"), worker=_none("string"), beat=_none("long"), completed_at=F.coalesce("o.completed_at", F.lit(now).cast("long"))),
        threads=changed(state.threads, ends, "thread_id", status=F.lit("active"), phase=F.lit("idle"), active_turn=_none("long"), last_turn=F.col("n.turn_id")),
    )


# ---- over the test tables: events stand for turns and calls

NOW = STALE_BEFORE + 60


def runtime(spark, sf_dir: str) -> Runtime:
    k, none = F.col("call_id"), _none("long")
    turns = B.claims(spark, sf_dir)
    active = F.col("status") == "active"
    on = F.when(F.col("thread_id") % 3 == 1, F.min(F.when(active & (F.col("phase") == "executing_tools"), F.col("turn_id")))).when(F.col("thread_id") % 3 == 2, F.max(F.when(active, F.col("turn_id"))))
    threads = turns.groupBy("thread_id").agg(on.alias("active_turn"), F.max(F.when(F.col("status") == "completed", F.col("turn_id"))).alias("last_turn"))
    threads = threads.select("thread_id", F.when(F.col("active_turn").isNull(), "active").otherwise("running").alias("status"), F.when(F.col("active_turn").isNull(), "idle").otherwise("executing").alias("phase"), "active_turn", "last_turn")
    tools = B.turn_calls(spark, sf_dir, True).join(turns.select("turn_id", "thread_id"), "turn_id")
    tools = tools.select(k.cast("string").alias("tool_id"), "thread_id", "turn_id", none.alias("call_id"), none.alias("item_seq"), F.when(k % 2 == 0, "search").otherwise("page").alias("tool"), F.lit("{}").alias("arguments"), "status", F.when(F.col("beat").isNotNull(), F.concat(F.lit("worker_"), (k % 7).cast("string"))).alias("worker"), "beat", _none("string").alias("error"), none.alias("completed_at"))
    return Runtime(
        threads,
        turns.select("turn_id", "thread_id", "status", "phase", "worker", "beat", F.when(F.col("turn_id") % 8 != 0, F.col("turn_id") % 50).alias("tokens"), _none(ERROR).alias("error"), none.alias("completed_at")),
        B.turn_calls(spark, sf_dir, False).select("call_id", "turn_id", "status", "beat", none.alias("tokens"), _none(ERROR).alias("error"), none.alias("completed_at")),
        tools,
        B.items(spark, sf_dir),
    )


def answered(spark, sf_dir: str) -> Runtime:
    """Three of five calls get a response: a message, and one or two calls of tools in some."""
    state, k = runtime(spark, sf_dir), F.col("call_id")
    told = state.calls.where(k % 5 < 3).select("call_id", F.when(k % 9 != 0, k % 100).alias("tokens"))
    kinds = F.array(F.struct(F.lit(1).alias("ord"), F.lit("message").alias("item_type"), _none("string").alias("tool"), F.concat(F.lit("m"), k.cast("string")).alias("body")), *[F.when(k % every == 0, F.struct(F.lit(n).alias("ord"), F.lit("tool_call").alias("item_type"), F.lit(tool).alias("tool"), F.concat(F.lit('{"q":'), k.cast("string"), F.lit("}")).alias("body"))) for n, every, tool in ((2, 2, "search"), (3, 6, "page"))])
    outputs = told.select("call_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("o")).select("call_id", "o.*")
    return succeed(state, told, outputs, NOW)


def failed(spark, sf_dir: str) -> Runtime:
    """The others fail, in what the responses left."""
    state, k = answered(spark, sf_dir), F.col("call_id")
    return fail(state, state.calls.where(k % 5 >= 3).select("call_id", F.concat(F.lit("no answer to "), k.cast("string")).alias("message")), NOW)


_VIEWS = {
    "done": "SELECT c.call_id, c.turn_id, t.thread_id, CASE WHEN c.call_id % 9 <> 0 THEN c.call_id % 100 END AS tokens FROM model_calls c JOIN claims t USING (turn_id) WHERE c.status = 'running' AND t.status = 'active' AND t.phase = 'executing_model' AND c.call_id % 5 < 3 QUALIFY row_number() OVER (PARTITION BY c.turn_id ORDER BY c.call_id) = 1",
    "placed": """SELECT d.*, ord, CASE ord WHEN 1 THEN 'message' ELSE 'tool_call' END AS item_type, CASE ord WHEN 2 THEN 'search' WHEN 3 THEN 'page' END AS tool, CASE ord WHEN 1 THEN 'm' || call_id ELSE '{"q":' || call_id || '}' END AS body,
      coalesce(last, 0) + row_number() OVER (PARTITION BY d.thread_id ORDER BY call_id, ord) AS seq
      FROM done d JOIN (VALUES (1, 1), (2, 2), (3, 6)) o(ord, every) ON call_id % every = 0 LEFT JOIN (SELECT thread_id, max(seq) AS last FROM items GROUP BY thread_id) l ON l.thread_id = d.thread_id""",
    "bad": """SELECT c.call_id, c.turn_id, 'no answer to ' || c.call_id AS message FROM model_calls c JOIN claims t USING (turn_id) ANTI JOIN done d ON d.turn_id = c.turn_id
      WHERE c.status = 'running' AND t.status = 'active' AND t.phase = 'executing_model' AND c.call_id % 5 >= 3 QUALIFY row_number() OVER (PARTITION BY c.turn_id ORDER BY c.call_id) = 1""",
    "moved": "SELECT t.turn_id, t.thread_id, t.status, CASE WHEN d.turn_id IS NULL THEN CASE WHEN b.turn_id IS NULL THEN t.phase ELSE 'failed' END WHEN EXISTS (SELECT 1 FROM placed p WHERE p.turn_id = d.turn_id AND p.item_type = 'tool_call') THEN 'executing_tools' ELSE 'completed' END AS phase, t.worker, t.beat, message FROM claims t LEFT JOIN done d USING (turn_id) LEFT JOIN bad b ON b.turn_id = t.turn_id",
    "thread": f"SELECT thread_id, CASE thread_id % 3 WHEN 1 THEN min(turn_id) FILTER (status = 'active' AND phase = 'executing_tools') WHEN 2 THEN max(turn_id) FILTER (status = 'active') END AS active_turn, max(turn_id) FILTER (status = 'completed') AS last_turn FROM claims GROUP BY thread_id",
    "hit": f"SELECT x.call_id, x.turn_id, t.thread_id FROM tool_calls x JOIN claims t USING (turn_id) JOIN thread h ON h.thread_id = t.thread_id WHERE x.status = 'running' AND x.beat < {STALE_BEFORE} AND t.status = 'active' AND t.phase = 'executing_tools' AND (active_turn IS NULL OR active_turn = t.turn_id) QUALIFY row_number() OVER (PARTITION BY t.thread_id ORDER BY x.beat, CAST(x.call_id AS VARCHAR)) = 1",
}


def _sql(select: str) -> str:
    return B.with_views("model_calls tool_calls claims items", select, **_VIEWS)


@query("SIB-66", _sql("SELECT call_id || ':' || ord AS tool_id, thread_id, turn_id, call_id, seq AS item_seq, tool, body AS arguments, 'requested' AS status FROM placed WHERE item_type = 'tool_call'"))
def sib66(spark, sf_dir):
    return answered(spark, sf_dir).tools.where("status = 'requested'").select("tool_id", "thread_id", "turn_id", "call_id", "item_seq", "tool", "arguments", "status")


@query("SIB-67", _sql(f"SELECT c.call_id, CASE WHEN d.call_id IS NULL THEN c.status ELSE 'completed' END AS status, d.tokens, CASE WHEN d.call_id IS NULL THEN c.beat END AS beat, CASE WHEN d.call_id IS NOT NULL THEN {NOW} END AS completed_at FROM model_calls c LEFT JOIN done d USING (call_id)"))
def sib67(spark, sf_dir):
    return answered(spark, sf_dir).calls.select("call_id", "status", "tokens", "beat", "completed_at")


@query("SIB-67-items", _sql("SELECT thread_id, seq, item_type, role, content_text FROM items UNION ALL SELECT thread_id, seq, item_type, 'assistant', body FROM placed"))
def sib67_items(spark, sf_dir):
    return answered(spark, sf_dir).items


@query("SIB-67-turns", _sql("SELECT t.turn_id, m.status, CASE WHEN m.phase = 'failed' THEN t.phase ELSE m.phase END AS phase, CASE WHEN d.turn_id IS NULL THEN t.tokens ELSE coalesce(t.tokens, 0) + coalesce(d.tokens, 0) END AS tokens FROM (SELECT turn_id, phase, CASE WHEN turn_id % 8 <> 0 THEN turn_id % 50 END AS tokens FROM claims) t JOIN moved m USING (turn_id) LEFT JOIN done d ON d.turn_id = t.turn_id"))
def sib67_turns(spark, sf_dir):
    return answered(spark, sf_dir).turns.select("turn_id", "status", "phase", "tokens")


@query("SIB-68", _sql("SELECT c.call_id, CASE WHEN b.call_id IS NOT NULL THEN 'failed' WHEN d.call_id IS NOT NULL THEN 'completed' ELSE c.status END AS status, b.message, m.phase FROM model_calls c LEFT JOIN done d USING (call_id) LEFT JOIN bad b ON b.call_id = c.call_id LEFT JOIN moved m ON m.turn_id = c.turn_id"))
def sib68(spark, sf_dir):
    """Calls with the message that they failed with, beside the phase of their turn."""
    state = failed(spark, sf_dir)
    return state.calls.join(state.turns.select("turn_id", "phase"), "turn_id", "left").select("call_id", "status", F.col("error.message").alias("message"), "phase")


@query("SIB-70", _sql("SELECT h.thread_id, CASE WHEN e.turn_id IS NOT NULL OR active_turn IS NULL THEN 'active' ELSE 'running' END AS status, CASE WHEN e.turn_id IS NOT NULL OR active_turn IS NULL THEN 'idle' ELSE 'executing' END AS phase, CASE WHEN e.turn_id IS NULL THEN active_turn END AS active_turn, coalesce(e.turn_id, last_turn) AS last_turn FROM thread h LEFT JOIN (SELECT thread_id, max(turn_id) AS turn_id FROM moved WHERE status = 'active' AND phase IN ('completed', 'failed') GROUP BY thread_id) e USING (thread_id)"))
def sib70(spark, sf_dir):
    """Threads after the turns that ended."""
    return finish(failed(spark, sf_dir), NOW).threads


@query("SIB-70-turns", _sql(f"SELECT turn_id, CASE WHEN ends THEN phase ELSE status END AS status, phase, CASE WHEN NOT ends THEN worker END AS worker, CASE WHEN NOT ends THEN beat END AS beat, CASE WHEN ends THEN {NOW} END AS completed_at, message FROM (SELECT *, status = 'active' AND phase IN ('completed', 'failed') AS ends FROM moved)"))
def sib70_turns(spark, sf_dir):
    return finish(failed(spark, sf_dir), NOW).turns.select("turn_id", "status", "phase", "worker", "beat", "completed_at", F.col("error.message").alias("message"))


@query("SIB-71", _sql(f"SELECT CAST(call_id AS VARCHAR) AS tool_id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN 'stale' END AS error, CASE WHEN NOT old AND beat IS NOT NULL THEN 'worker_' || (call_id % 7) END AS worker, CASE WHEN NOT old THEN beat END AS beat, CASE WHEN old THEN {NOW} END AS completed_at FROM (SELECT *, coalesce(x.status = 'running' AND x.beat < {STALE_BEFORE}, false) AS old FROM tool_calls x SEMI JOIN claims t ON t.turn_id = x.turn_id)"))
def sib71(spark, sf_dir):
    return fail_stale_tools(runtime(spark, sf_dir).tools, STALE_BEFORE, NOW, "stale").select("tool_id", "status", "error", "worker", "beat", "completed_at")


_TOOL = "CASE WHEN call_id % 2 = 0 THEN 'search' ELSE 'page' END"


@query("STM-14", _sql(f"SELECT turn_id, t.thread_id, status, CASE WHEN call_id IS NULL THEN phase ELSE 'failed' END AS phase, CASE WHEN call_id IS NOT NULL THEN 'stale' END AS message, CASE WHEN call_id IS NOT NULL THEN {_TOOL} END AS tool FROM claims t LEFT JOIN hit USING (turn_id)"))
def stm14(spark, sf_dir):
    """Turns after one pass over the stale calls of their tools."""
    return fail_stale_turns(runtime(spark, sf_dir), STALE_BEFORE, NOW, "stale").turns.select("turn_id", "thread_id", "status", "phase", F.col("error.message").alias("message"), F.col("error.tool").alias("tool"))


@query("STM-14-threads", _sql("SELECT thread_id, CASE WHEN call_id IS NOT NULL OR active_turn IS NOT NULL THEN 'running' ELSE 'active' END AS status, CASE WHEN call_id IS NOT NULL THEN 'failed' WHEN active_turn IS NULL THEN 'idle' ELSE 'executing' END AS phase, coalesce(turn_id, active_turn) AS active_turn FROM thread LEFT JOIN hit USING (thread_id)"))
def stm14_threads(spark, sf_dir):
    return fail_stale_turns(runtime(spark, sf_dir), STALE_BEFORE, NOW, "stale").threads.select("thread_id", "status", "phase", "active_turn")


@query("STM-14-tools", _sql(f"SELECT CAST(x.call_id AS VARCHAR) AS tool_id, CASE WHEN h.call_id IS NULL THEN status ELSE 'failed' END AS status, CASE WHEN h.call_id IS NOT NULL THEN {NOW} END AS completed_at FROM tool_calls x SEMI JOIN claims t ON t.turn_id = x.turn_id LEFT JOIN hit h ON h.call_id = x.call_id"))
def stm14_tools(spark, sf_dir):
    return fail_stale_turns(runtime(spark, sf_dir), STALE_BEFORE, NOW, "stale").tools.select("tool_id", "status", "completed_at")
