"""Chats as a model and a reader see them, text clean-up, selectors and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .artifacts import ORIENTED, PENDING, orientation_pending, oriented
from .mart import best_variant
from .pages import ROUTED, routed

# ---- messages and tool calls


def chat_items(spark, sf_dir: str) -> DataFrame:
    """Lines of orders as items of a thread: messages, tool calls, results and reasoning; some share a model call, some have a role that no model takes."""
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(k % 5 == 0, "message").when(k % 5 < 3, "tool_call").when(k % 5 == 3, "tool_result").otherwise("reasoning")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    said = lambda before, after="": F.concat(F.lit(before), k.cast("string"), F.lit(after))
    rows = B.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("thread"),
        F.row_number().over(by).cast("long").alias("seq"),
        kind.alias("item_type"),
        F.when(k % 13 == 0, "tool").when(k % 4 == 0, "system").when(k % 2 == 0, "user").otherwise("developer").alias("role"),
        F.when(k % 3 != 0, said("text ")).alias("content"),
        F.when(k % 7 != 0, F.col("l_suppkey") % 2).alias("model_call"),
        F.concat(F.lit("tool"), (k % 4).cast("string")).alias("name"),
        said('{"q": "', '"}').alias("arguments"),
        F.when(k % 4 == 0, said('{"ok": ', "}")).when(k % 4 == 1, "{}").alias("result"),
        F.when(k % 6 == 3, said("call_")).when(k % 6 == 0, "").alias("tool_call_id"),
        F.when(k % 9 == 3, said("p_")).alias("parent"),
    )
    return rows.withColumn("item_id", F.concat_ws("_", F.lit("i"), "thread", "seq"))


#: The roles of messages that a model is sent.
SENT_ROLES = ("user", "assistant", "system", "developer")


def provider_messages(items: DataFrame, system_prompt: str = "") -> DataFrame:
    """JOI-14: messages (thread, seq, role, content, tool_calls, tool_call_id) of a thread's items, as a model is sent them.

    Calls of one model call go out together, once, as JSON in `tool_calls`: with the first message or call of their model
    call; calls without a model call go alone. A result names its call (the one it was stored with, else its parent, else
    itself) and holds its result's JSON, or its text where that is empty. Messages of other roles, and reasoning, aren't
    sent; developers speak as the assistant. A prompt that isn't blank comes first in every thread, as number 0.
    Items are (thread, seq, item_id, item_type, role, content, model_call, name, arguments, result, tool_call_id, parent).
    """
    at = ["thread", "model_call"]
    call, result, message = (F.col("item_type") == t for t in ("tool_call", "tool_result", "message"))
    one = F.struct(F.col("item_id").alias("id"), F.lit("function").alias("type"), F.struct("name", "arguments").alias("function"))
    groups = items.where(call & F.col("model_call").isNotNull()).groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("call")))), lambda c: c["call"]).alias("group"))
    sent = items.where((message & F.col("role").isin(*SENT_ROLES)) | call | result)
    carries = ~result & F.col("model_call").isNotNull()
    first = F.min(F.when(carries, F.col("seq"))).over(Window.partitionBy(*at))
    rows = sent.withColumn("first", first).join(groups, at, "left")
    calls = F.when(call & F.col("model_call").isNull(), F.array(one)).when(carries & (F.col("seq") == F.col("first")), F.col("group"))
    blank = lambda c: F.coalesce(F.translate(c, " \n\t", "").isin("", "{}", "null"), F.lit(True))
    text = F.coalesce("content", F.lit(""))
    answer = F.when(blank(F.col("result")), F.to_json(F.struct(text.alias("text")))).otherwise(F.col("result"))
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    out = rows.select(
        "thread",
        "seq",
        F.when(result, "tool").when(call | (F.col("role") == "developer"), "assistant").otherwise(F.col("role")).alias("role"),
        F.when(result, answer).when(call, "").otherwise(text).alias("content"),
        F.to_json(calls).alias("tool_calls"),
        F.when(result, F.coalesce(named("tool_call_id"), named("parent"), "item_id")).alias("tool_call_id"),
        call.alias("is_call"),
    )
    out = out.where(~F.col("is_call") | F.col("tool_calls").isNotNull()).drop("is_call")
    if not system_prompt.strip():
        return out
    none = F.lit(None).cast("string")
    prompt = items.select("thread").distinct().select("thread", F.lit(0).cast("long").alias("seq"), F.lit("system").alias("role"), F.lit(system_prompt.strip()).alias("content"), none.alias("tool_calls"), none.alias("tool_call_id"))
    return prompt.unionByName(out)


CHAT = """SELECT *, 'i_' || thread || '_' || seq AS item_id FROM (SELECT l_orderkey AS thread, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_partkey % 5 = 0 THEN 'message' WHEN l_partkey % 5 < 3 THEN 'tool_call' WHEN l_partkey % 5 = 3 THEN 'tool_result' ELSE 'reasoning' END AS item_type,
  CASE WHEN l_partkey % 13 = 0 THEN 'tool' WHEN l_partkey % 4 = 0 THEN 'system' WHEN l_partkey % 2 = 0 THEN 'user' ELSE 'developer' END AS role, CASE WHEN l_partkey % 3 <> 0 THEN 'text ' || l_partkey END AS content, CASE WHEN l_partkey % 7 <> 0 THEN l_suppkey % 2 END AS model_call, 'tool' || (l_partkey % 4) AS name,
  '{"q": "' || l_partkey || '"}' AS arguments, CASE l_partkey % 4 WHEN 0 THEN '{"ok": ' || l_partkey || '}' WHEN 1 THEN '{}' END AS result, CASE l_partkey % 6 WHEN 3 THEN 'call_' || l_partkey WHEN 0 THEN '' END AS tool_call_id, CASE WHEN l_partkey % 9 = 3 THEN 'p_' || l_partkey END AS parent FROM lineitem)"""
_CALL = """'{"id":"' || item_id || '","type":"function","function":{"name":"' || name || '","arguments":' || CAST(to_json(arguments) AS VARCHAR) || '}}'"""


@query("JOI-14", f"""WITH i AS ({CHAT}), s AS (SELECT * FROM i WHERE item_type IN ('tool_call', 'tool_result') OR (item_type = 'message' AND role <> 'tool')),
  g AS (SELECT thread, model_call, '[' || string_agg({_CALL}, ',' ORDER BY seq) || ']' AS calls FROM i WHERE item_type = 'tool_call' AND model_call IS NOT NULL GROUP BY ALL),
  f AS (SELECT thread, model_call, min(seq) AS first FROM s WHERE item_type <> 'tool_result' AND model_call IS NOT NULL GROUP BY ALL)
  SELECT thread, seq, CASE WHEN item_type = 'tool_result' THEN 'tool' WHEN item_type = 'tool_call' OR role = 'developer' THEN 'assistant' ELSE role END AS role,
    CASE WHEN item_type = 'tool_result' THEN CASE WHEN coalesce(result, '{{}}') = '{{}}' THEN '{{"text":"' || coalesce(content, '') || '"}}' ELSE result END WHEN item_type = 'tool_call' THEN '' ELSE coalesce(content, '') END AS content, calls AS tool_calls,
    CASE WHEN item_type = 'tool_result' THEN coalesce(nullif(tool_call_id, ''), parent, item_id) END AS tool_call_id
  FROM (SELECT s.*, CASE WHEN item_type = 'tool_call' AND s.model_call IS NULL THEN '[' || {_CALL} || ']' WHEN item_type <> 'tool_result' AND seq = first THEN g.calls END AS calls
    FROM s LEFT JOIN g ON s.thread = g.thread AND s.model_call = g.model_call LEFT JOIN f ON s.thread = f.thread AND s.model_call = f.model_call) WHERE item_type <> 'tool_call' OR calls IS NOT NULL
  UNION ALL SELECT DISTINCT thread, 0, 'system', 'Be brief.', NULL, NULL FROM i""")
def joi14(spark, sf_dir):
    return provider_messages(chat_items(spark, sf_dir), " Be brief.\n")


def tool_requests(responses: DataFrame) -> DataFrame:
    """COE-15: (id, ordinal, tool, arguments) of the well-formed calls in a response's JSON (id, body).

    Arguments are JSON text: an object stays, no object is empty, and what is no JSON is kept as raw text.
    """
    calls = F.from_json("body", "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")
    c = responses.select("id", F.posexplode(calls).alias("ordinal", "c")).select("id", "ordinal", F.col("c.function.name").alias("tool"), F.col("c.function.arguments").alias("raw"))
    raw = T.strip(F.coalesce("raw", F.lit("")))
    valid = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v").isNotNull() | (raw == "null")
    arguments = F.when((raw == "") | (valid & ~raw.startswith("{")), "{}").when(valid, raw).otherwise(F.to_json(F.struct(F.col("raw").alias("raw_arguments"))))
    return c.where("tool is not null and tool != ''").select("id", "ordinal", "tool", arguments.alias("arguments"))


@query("COE-15", """SELECT event_id AS id, j AS ordinal, 'tool' || j AS tool, CASE (event_id + j) % 4 WHEN 0 THEN '{"k":' || event_id || '}' WHEN 1 THEN '{}' WHEN 2 THEN '{}' ELSE '{"raw_arguments":"k=' || event_id || '"}' END AS arguments FROM events, range(3) r(j) WHERE j < event_id % 4 AND NOT (j = 1 AND event_id % 5 = 0)""")
def coe15(spark, sf_dir):
    """Responses of up to three calls; some arguments are a list, missing, or no JSON, some calls have no name."""
    k = F.col("event_id")
    args = lambda j: F.when((k + j) % 4 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).when((k + j) % 4 == 1, "[1]").when((k + j) % 4 == 3, F.concat(F.lit("k="), k.cast("string")))
    name = lambda j: F.when((k % 5 == 0) & (j == 1), "").otherwise(F.concat(F.lit("tool"), j.cast("string")))
    made = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda j: j < k % 4), lambda j: F.struct(F.lit("c").alias("id"), F.lit("function").alias("type"), F.struct(name(j).alias("name"), args(j).alias("arguments")).alias("function")))
    return tool_requests(B.read(spark, sf_dir, "events").select(k.alias("id"), F.to_json(made).alias("body")))


OUTPUT = "array<struct<type:string,role:string,id:string,call_id:string,name:string,arguments:string,status:string,content:array<struct<text:string>>>>"


def output_items(responses: DataFrame) -> DataFrame:
    """COE-14: items (id, ordinal, item_id, item_type, role, name, content, arguments, status) of the output list in a response's JSON (id, body).

    Messages hold their texts, blank ones left out; calls without a name are left out; whatever is neither message, call
    nor reasoning is an event of a hosted tool.
    """
    o = responses.select("id", F.posexplode(F.from_json("body", OUTPUT)).alias("ordinal", "o")).select("id", "ordinal", *[F.col(f"o.{c}") for c in ("type", "role", "name", "arguments", "status", "content")])
    kind = F.col("type")
    texts = F.filter(F.transform("content", lambda c: T.strip(c["text"])), lambda t: F.coalesce(t != "", F.lit(False)))
    said = F.when((kind == "message") & (F.size(texts) > 0), F.array_join(texts, "\n\n"))
    call = kind == "function_call"
    item_type = F.when(kind == "message", "message").when(call, "tool_call").when(kind == "reasoning", "reasoning").otherwise("hosted_tool_event")
    o = o.where(~F.coalesce(call, F.lit(False)) | (F.coalesce("name", F.lit("")) != ""))
    name = F.when(call, F.col("name")).when(kind != "message", kind)
    return o.select("id", "ordinal", F.concat_ws(":", "id", F.col("ordinal").cast("string")).alias("item_id"), item_type.alias("item_type"), F.when(kind == "message", F.coalesce("role", F.lit("assistant"))).otherwise("assistant").alias("role"), name.alias("name"), said.alias("content"), F.when(call, F.coalesce("arguments", F.lit("{}"))).alias("arguments"), F.when(~kind.isin("message", "function_call"), F.col("status")).alias("status"))


def _responses(spark, sf_dir: str) -> DataFrame:
    """Answers of up to four parts of each sort."""
    k = F.col("event_id")
    sort = lambda j: F.element_at(F.array(*map(F.lit, ("message", "function_call", "reasoning", "web_search_call", "function_call"))), ((k + j) % 5 + 1).cast("int"))
    parts = lambda j: F.array(F.struct(F.concat(F.lit(" a"), k.cast("string"), F.lit(" ")).alias("text")), F.struct(F.lit("  ").alias("text")), F.struct(F.when(k % 2 == 0, F.concat(F.lit("b"), j.cast("string"))).alias("text")))
    one = lambda j: F.struct(sort(j).alias("type"), F.when((k + j) % 5 == 1, F.concat(F.lit("tool"), j.cast("string"))).alias("name"), F.when((k + j) % 5 == 1, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).alias("arguments"), F.lit("done").alias("status"), F.when((k + j) % 5 == 0, parts(j)).alias("content"))
    made = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda j: j < k % 5), one)
    return B.read(spark, sf_dir, "events").select(k.alias("id"), F.to_json(made).alias("body"))


_ITEMS = """SELECT event_id AS id, j AS ordinal, event_id || ':' || j AS item_id, ['message', 'tool_call', 'reasoning', 'hosted_tool_event'][s + 1] AS item_type, [NULL, 'tool' || j, 'reasoning', 'web_search_call'][s + 1] AS name,
  CASE WHEN s = 0 THEN 'a' || event_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(10) || 'b' || j ELSE '' END END AS content, CASE WHEN s = 1 THEN '{"k":' || event_id || '}' END AS arguments, CASE WHEN s > 1 THEN 'done' END AS status
  FROM (SELECT event_id, j, (event_id + j) % 5 AS s FROM events, range(4) r(j) WHERE j < event_id % 5) WHERE s < 4"""


@query("COE-14", _ITEMS)
def coe14(spark, sf_dir):
    return output_items(_responses(spark, sf_dir)).drop("role")


@query("JOI-15", f"SELECT item_id, name AS tool, arguments, 100 + row_number() OVER (PARTITION BY id ORDER BY ordinal) AS seq FROM ({_ITEMS}) QUALIFY item_type = 'tool_call'")
def joi15(spark, sf_dir):
    """Each requested call with the stored item that it came from, by the item's id."""
    items = output_items(_responses(spark, sf_dir))
    stored = items.select("item_id", (F.lit(100) + F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))).cast("long").alias("seq"))
    requests = items.where("item_type = 'tool_call'").select("item_id", F.col("name").alias("tool"), "arguments")
    # both sides grow with the responses, and their size as guessed from the files is far too small: never broadcast
    return requests.join(stored.hint("merge"), "item_id")


@query("JSN-07", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' END AS a, CASE event_id % 6 WHEN 3 THEN 'no object' WHEN 4 THEN 'no JSON' WHEN 5 THEN 'empty' END AS error FROM events""")
def jsn07(spark, sf_dir):
    """The object that a model's answer holds: an object, its text, or a list of text parts; else what is wrong with it."""
    k = F.col("event_id") % 6
    answer = F.when(k == 0, '{"a": "1"}').when(k == 1, ' "{\\"a\\": \\"2\\"}" ').when(k == 2, '[{"type": "text", "text": "{\\"a\\": "}, {"type": "image"}, {"type": "output_text", "text": "\\"3\\"}"}]').when(k == 3, '"[1]"').when(k == 4, '"oh no"').otherwise('" "')
    parts = F.from_json(answer, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "output_text") & p["text"].isNotNull()), lambda p: p["text"]), "")
    bare = F.trim(answer)
    text = F.trim(F.when(bare.startswith("["), joined).when(bare.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v")).otherwise(bare))
    parsed = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    is_object = parsed.isNotNull() & text.startswith("{")
    error = F.when(text == "", "empty").when(parsed.isNull(), "no JSON").when(~is_object, "no object")
    return B.read(spark, sf_dir, "events").select("event_id", F.when(is_object, F.get_json_object(text, "$.a")).alias("a"), error.alias("error"))


# ---- texts


def title(text: Column) -> Column:
    """STR-17: a generated title in one line, without quotes around it, 120 characters at most; null if nothing is left."""
    return F.substring(F.nullif(F.btrim(T.clean(text), F.lit("\"' ")), F.lit("")), 1, 120)


@query("STR-17", B.with_views("items", r"""SELECT thread_id, seq, nullif(substr(trim(trim(regexp_replace(t, '\s+', ' ', 'g')), '"'' '), 1, 120), '') AS title FROM (SELECT thread_id, seq, CASE seq % 3 WHEN 0 THEN ' "' || chr(10) || content_text || '''" ' WHEN 1 THEN content_text ELSE ' "" ' END AS t FROM items)"""))
def str17(spark, sf_dir):
    c = F.col("content_text")
    said = F.when(F.col("seq") % 3 == 0, F.concat(F.lit(' "\n'), c, F.lit("'\" "))).when(F.col("seq") % 3 == 1, c).otherwise(' "" ')
    return B.items(spark, sf_dir).select("thread_id", "seq", title(said).alias("title"))


def gibberish(term: Column) -> Column:
    """Few vowels in many letters, with long runs of capitals and digits or other noise."""
    solid = F.regexp_replace(term, r"\s+", "")
    letters = F.regexp_replace(solid, r"[^A-Za-z]", "")
    n, vowels = F.length(letters), F.length(F.regexp_replace(F.lower(letters), r"[^aeiou]", ""))
    run, noise = solid.rlike(r"[A-Z0-9]{8,}"), solid.rlike(r"[0-9]{2,}|[_/\\]")
    share = vowels / F.greatest(n, F.lit(1))
    return (F.length(solid) >= 6) & (n > 0) & (((n >= 8) & (share < 0.2) & run) | ((n >= 10) & (share < 0.15) & noise))


def key_terms(terms: Column) -> Column:
    """STR-22: terms collapsed, without blanks and gibberish, each once whatever its case, in the spelling that comes first."""
    kept = F.filter(F.transform(terms, T.clean), lambda t: t.isNotNull() & ~gibberish(t))
    lows = F.transform(kept, F.lower)
    return F.filter(kept, lambda t, i: F.array_position(lows, F.lower(t)) == i + 1)


@query("STR-22", r"""SELECT page_id, coalesce(string_agg(t, ',' ORDER BY first), '') AS terms FROM pages LEFT JOIN (SELECT page_id AS p, arg_min(t, i) AS t, min(i) AS first FROM (SELECT page_id, i, trim(ts[i]) AS t FROM (SELECT page_id, regexp_split_to_array(url, '[/?&=:.]+') || ['HTTPS', 'XKCDBRTPLW', 'Contract' || page_id % 3, 'contract1', 'BRTXKPLMNQZ_07', '  '] AS ts FROM pages), range(1, 30) r(i) WHERE i <= len(ts))
  WHERE t <> '' AND NOT (length(t) >= 6 AND length(l(t)) > 0 AND ((length(l(t)) >= 8 AND length(v(t)) / length(l(t)) < 0.2 AND regexp_matches(t, '[A-Z0-9]{8,}')) OR (length(l(t)) >= 10 AND length(v(t)) / length(l(t)) < 0.15 AND regexp_matches(t, '[0-9]{2,}|[_/\\]')))) GROUP BY page_id, lower(t)) ON page_id = p GROUP BY page_id""".replace("l(t)", "regexp_replace(t, '[^A-Za-z]', '', 'g')").replace("v(t)", "regexp_replace(lower(t), '[^aeiou]', '', 'g')"))
def str22(spark, sf_dir):
    more = F.array(F.lit("HTTPS"), F.lit("XKCDBRTPLW"), F.concat(F.lit("Contract"), (F.col("page_id") % 3).cast("string")), F.lit("contract1"), F.lit("BRTXKPLMNQZ_07"), F.lit("  "))
    return B.read(spark, sf_dir, "pages").select("page_id", F.array_join(key_terms(F.concat(F.split("url", r"[/?&=:.]+"), more)), ",").alias("terms"))


@query("STR-23", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 * 90 END AS rotation, CASE WHEN event_id % 4 <> 0 THEN event_id % 100 / 4 END AS confidence FROM events")
def str23(spark, sf_dir):
    """Turn and confidence in what an orientation check prints; null where it prints none."""
    k = F.col("event_id")
    said = F.concat_ws("\n", F.lit("Page number: 0"), F.when(k % 3 != 0, F.concat(F.lit("Rotate: "), (k % 4 * 90).cast("string"))), F.when(k % 4 != 0, F.concat(F.lit("Orientation confidence: "), (k % 100 / 4).cast("string"))), F.lit("Script: Latin"))
    number = lambda p, kind: F.nullif(F.regexp_extract(said, p, 1), F.lit("")).cast(kind)
    return B.read(spark, sf_dir, "events").select("event_id", number(r"Rotate:\s*(\d+)", "long").alias("rotation"), number(r"Orientation confidence:\s*([0-9.]+)", "double").alias("confidence"))


@query("STR-25", B.with_views("items", r"SELECT thread_id, seq, md5(trim(regexp_replace(coalesce(content_text, ''), '\s+', ' ', 'g'))) AS digest FROM items"))
def str25(spark, sf_dir):
    return B.items(spark, sf_dir).select("thread_id", "seq", F.md5(F.trim(F.regexp_replace(F.coalesce("content_text", F.lit("")), r"\s+", " "))).alias("digest"))


@query("STR-29", B.with_views("flagged best", """SELECT f.doc, f.page, md5('Write a page-local retrieval note for this one page.' || chr(10) || 'doc_id: ' || f.doc || chr(10) || 'source_filename: ' || filename || chr(10) || 'page_number: ' || f.page || chr(10) || 'page_representation: ' || coalesce(representation, 'unknown') || chr(10)
  || 'page_quality_flags: ' || CASE WHEN len(flags) = 0 THEN '-' ELSE array_to_string(flags, ', ') END || chr(10) || chr(10) || 'Page content:' || chr(10) || coalesce(b.content, '')) AS digest FROM flagged f LEFT JOIN best b ON f.doc = b.doc AND f.page = b.page"""))
def str29(spark, sf_dir):
    """The payload of one page's call, as text. Its lines."""
    best = best_variant(B.variants(spark, sf_dir)).select("doc", "page", "representation", "content")
    p = B.flagged(spark, sf_dir).select("doc", "page", "filename", "flags").join(best, ["doc", "page"], "left")
    said = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    lines = [F.lit("Write a page-local retrieval note for this one page."), said("doc_id", F.col("doc").cast("string")), said("source_filename", F.col("filename")), said("page_number", F.col("page").cast("string")), said("page_representation", F.coalesce("representation", F.lit("unknown"))), said("page_quality_flags", F.when(F.size("flags") == 0, "-").otherwise(F.array_join("flags", ", "))), F.lit(""), F.lit("Page content:"), F.coalesce("content", F.lit(""))]
    return p.select("doc", "page", F.md5(F.concat_ws("\n", *lines)).alias("digest"))


NOW = 1_704_300_000


def relative_time(seconds: Column) -> Column:
    """MTH-16: a distance in time (negative: past) in whole minutes, hours or days, halves rounded up, as English says it."""
    size = F.abs(seconds)
    unit = F.when(size < 3600, "minute").when(size < 86400, "hour").otherwise("day")
    n = F.floor(seconds / F.when(size < 3600, 60).when(size < 86400, 3600).otherwise(86400) + 0.5)
    many = lambda c: F.concat(F.abs(c).cast("string"), F.lit(" "), unit, F.when(F.abs(c) == 1, "").otherwise("s"))
    near = F.when(n == 0, F.when(unit == "day", "today").otherwise(F.concat(F.lit("this "), unit))).when((unit == "day") & (n == 1), "tomorrow").when((unit == "day") & (n == -1), "yesterday")
    return F.coalesce(near, F.when(n > 0, F.concat(F.lit("in "), many(n))).otherwise(F.concat(many(n), F.lit(" ago"))))


@query("MTH-16", B.with_views("claims", f"""SELECT turn_id, CASE WHEN n = 0 THEN CASE WHEN u = 'day' THEN 'today' ELSE 'this ' || u END WHEN u = 'day' AND n = 1 THEN 'tomorrow' WHEN u = 'day' AND n = -1 THEN 'yesterday' WHEN n > 0 THEN 'in ' || n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END ELSE -n || ' ' || u || CASE WHEN n = -1 THEN '' ELSE 's' END || ' ago' END AS said
  FROM (SELECT turn_id, u, CAST(floor(s / CASE u WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 ELSE 86400 END + 0.5) AS BIGINT) AS n FROM (SELECT turn_id, s, CASE WHEN abs(s) < 3600 THEN 'minute' WHEN abs(s) < 86400 THEN 'hour' ELSE 'day' END AS u FROM (SELECT turn_id, CASE turn_id % 3 WHEN 0 THEN queued_at - {NOW} WHEN 1 THEN turn_id % 7200 - 3600 ELSE turn_id * 37 % 400000 - 200000 END AS s FROM claims)))"""))
def mth16(spark, sf_dir):
    k = F.col("turn_id")
    s = F.when(k % 3 == 0, F.col("queued_at") - NOW).when(k % 3 == 1, k % 7200 - 3600).otherwise(k * 37 % 400000 - 200000)
    return B.claims(spark, sf_dir).select("turn_id", relative_time(s).alias("said"))


#: Fixed value: the longest delay that may be asked for, in milliseconds.
LONGEST_MS = 5_000


def delay_of(asked: Column) -> Column:
    """MTH-18: a delay that was asked for: whole numbers from 1 up to the bound, nothing else."""
    text = F.trim(asked)
    n = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    return F.least(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.lit(LONGEST_MS))


@query("MTH-18", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(event_id % 9000, 5000) ELSE 0 END AS delay FROM events")
def mth18(spark, sf_dir):
    k = F.col("event_id")
    asked = F.when(k % 5 == 0, F.concat(F.lit(" "), (k % 9000).cast("string"))).when(k % 5 == 1, "-5").when(k % 5 == 2, "1.5").when(k % 5 == 3, "soon").otherwise("")
    return B.read(spark, sf_dir, "events").select("event_id", delay_of(asked).alias("delay"))


# ---- selectors and samples


def selectors() -> dict[str, Column]:
    """FLT-13: conditions on routed pages by the selector's name. Failed documents have no pages; FLT-15 lists them."""
    made = lambda c: G.given(F.col(c))
    return {
        "markdown": F.col("markdown"),
        "repair": F.col("repair"),
        "vision_markdown": F.col("vision"),
        "skipped_repair": G.any_of(F.col("flags"), *G.SKIP),
        "markdown_generated": made("markdown_path"),
        "vision_markdown_generated": made("vision_path"),
        "repaired": made("repair_path"),
    }


def _selectable(spark, sf_dir: str) -> DataFrame:
    paths = B.flagged(spark, sf_dir).select("doc", "page", "markdown_path", "vision_path", "repair_path")
    marked = F.when(F.col("doc_id") % 7 == 0, F.array_append("flags", "skip_llm_repair")).otherwise(F.col("flags"))
    return routed(spark, sf_dir).withColumn("flags", marked).join(paths, ["doc", "page"])


SELECTED = f"""SELECT doc, page, doc_id, unnest(list_filter([CASE WHEN markdown THEN 'markdown' END, CASE WHEN repair THEN 'repair' END, CASE WHEN vision THEN 'vision_markdown' END, CASE WHEN doc_id % 7 = 0 THEN 'skipped_repair' END, CASE WHEN markdown_path IS NOT NULL THEN 'markdown_generated' END,
  CASE WHEN vision_path IS NOT NULL THEN 'vision_markdown_generated' END, CASE WHEN repair_path IS NOT NULL THEN 'repaired' END], lambda x: x IS NOT NULL)) AS selector FROM ({ROUTED}) r JOIN (SELECT doc, page, markdown_path, vision_path, repair_path FROM flagged) p USING (doc, page)"""


def selected(spark, sf_dir: str) -> DataFrame:
    picks = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in selectors().items()]))
    return _selectable(spark, sf_dir).select("doc", "page", "doc_id", F.explode(picks).alias("selector"))


@query("FLT-13", B.with_views("flagged", f"SELECT doc, page, selector FROM ({SELECTED})"))
def flt13(spark, sf_dir):
    return selected(spark, sf_dir).select("doc", "page", "selector")


@query("FLT-34", B.with_views("flagged", f"SELECT doc, page FROM oriented WHERE {PENDING} AND NOT (doc_id % 12 = 6 OR list_has_any(flags, ['likely_blank_page', 'likely_low_information_page', 'skip_llm_repair']))", oriented=ORIENTED))
def flt34(spark, sf_dir):
    """Images that are still to be turned, but for blank ones and pages marked as such."""
    blank = F.col("doc_id") % 12 == 6
    return oriented(spark, sf_dir).where(orientation_pending() & ~(blank | G.any_of(F.col("flags"), *G.SKIP))).select("doc", "page")


SEED = 7


def sample(rows: DataFrame, keys: list[str], n: int, seed: int = SEED, within: tuple[str, ...] = ()) -> DataFrame:
    """MTH-19: `n` rows, the same on every run and on every cluster: those whose hash of seed and keys comes first. All rows if there are fewer."""
    mark = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    if within:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(mark, *keys))).where(F.col("_r") <= n).drop("_r")
    return rows.withColumn("_m", mark).orderBy("_m", *keys).limit(n).drop("_m")


def select_documents(rows: DataFrame, key: str, one: object = None, n: int | None = None, seed: int = SEED) -> DataFrame:
    """MTH-20: one document, a sample of `n`, or all; asking for none or for more than there are is an error."""
    if one is not None:
        found = rows.where(F.col(key) == F.lit(one))
        if found.isEmpty():
            raise LookupError(f"no document {one}")
        return found
    if n is None:
        return rows
    if n <= 0 or rows.limit(n).count() < n:
        raise ValueError(f"can't choose {n} documents")
    return sample(rows, [key], n, seed)


@query("MTH-19", "SELECT event_id FROM events ORDER BY md5('7/' || event_id), event_id LIMIT 25")
def mth19(spark, sf_dir):
    return sample(B.read(spark, sf_dir, "events").select("event_id"), ["event_id"], 25)


@query("MTH-20", B.with_views("contracts", "SELECT doc, filename FROM contracts ORDER BY md5('3/' || doc), doc LIMIT 5"))
def mth20(spark, sf_dir):
    return select_documents(B.contracts(spark, sf_dir).select("doc", "filename"), "doc", n=5, seed=3)


@query("SIB-40", B.with_views("flagged", f"SELECT doc, page, selector FROM (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY md5('7/' || doc || '/' || page), doc, page) AS r FROM ({SELECTED})) WHERE r <= 10"))
def sib40(spark, sf_dir):
    """A sample of each selector's pages."""
    return sample(selected(spark, sf_dir).select("doc", "page", "selector"), ["doc", "page"], 10, within=("selector",))


@query("SIB-42", B.with_views("contracts", "SELECT lang, doc FROM (SELECT lang, doc, row_number() OVER (PARTITION BY lang ORDER BY md5('7/' || doc), doc) AS r FROM contracts) WHERE r <= 3"))
def sib42(spark, sf_dir):
    """Of each language so many, or all."""
    return sample(B.contracts(spark, sf_dir).select("lang", "doc"), ["doc"], 3, within=("lang",))


@query("SIB-37", B.with_views("variants best contracts", """SELECT ranking, doc, filename, tokens FROM (SELECT ranking, doc, tokens, filename, row_number() OVER (PARTITION BY ranking ORDER BY tokens DESC, filename, doc) AS r
  FROM (SELECT representation AS ranking, doc, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM variants WHERE representation IN ('text', 'ocr_text', 'markdown', 'repair_markdown') GROUP BY ALL UNION ALL SELECT 'best', doc, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) FROM best GROUP BY doc) JOIN contracts USING (doc) WHERE tokens > 0) WHERE r <= 10"""))
def sib37(spark, sf_dir):
    """Five rankings of documents by tokens: of their best pages, and of each sort of artifact."""
    v = B.variants(spark, sf_dir)
    by_type = v.where(F.col("representation").isin("text", "ocr_text", "markdown", "repair_markdown")).select(F.col("representation").alias("ranking"), "doc", "content")
    both = by_type.unionByName(best_variant(v).select(F.lit("best").alias("ranking"), "doc", "content"))
    tokens = both.groupBy("ranking", "doc").agg(F.sum(T.inventory_tokens(F.col("content"))).alias("tokens")).where("tokens > 0").join(B.contracts(spark, sf_dir).select("doc", "filename"), "doc")
    w = Window.partitionBy("ranking").orderBy(F.desc("tokens"), "filename", "doc")
    return tokens.withColumn("r", F.row_number().over(w)).where("r <= 10").select("ranking", "doc", "filename", "tokens")


@query("WIN-08", B.with_views("pages", "SELECT doc, min(filename) AS filename, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) AS total FROM pages GROUP BY doc HAVING sum(ceil(length(content) / 4)) >= 2500 ORDER BY total DESC, filename, doc"))
def win08(spark, sf_dir):
    """Documents long enough for page notes, the longest first."""
    p = B.pages(spark, sf_dir).groupBy("doc").agg(F.min("filename").alias("filename"), F.sum(T.inventory_tokens(F.col("content"))).alias("total"))
    return p.where("total >= 2500").orderBy(F.desc("total"), "filename", "doc")
