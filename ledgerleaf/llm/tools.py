"""Chat formatting with tool-call linking.

Messages are rows (conv_id, turn, kind, call_id, name, body): a `call` has a tool's name and its arguments as JSON, a
`result` what came back, a `message` a role as its name and text. Calls and results are hash-joined by conversation and
identifier, through one row for each identifier, so repeated identifiers can't multiply. Calls whose arguments refer to
other calls (`{"$ref": "identifier"}` as a value, nested or not) come after the results of those. Arguments are parsed,
validated against the tools' schemas and written as canonical JSON (keys sorted, no spaces, UTF-8). One row for each
message comes back, ordered in its conversation by (at, level, sub, turn).

Order: `at` is the greatest turn among a call and all that it waits for, so a chat whose turns are in a valid order
keeps it, and only what waits for something later moves back, to just after that. `level` is the longest way to a call
that waits for nothing. Only references move: a task takes the calls of a conversation that refer to others, without
texts, up to `LOCAL` of them; longer conversations are ordered by rounds of joins, a round for each level, and their
cycles are found by rounds of joins as well.

Schemas are a part of JSON Schema: type (one or several), enum, properties, required, additionalProperties, items,
minimum, maximum, minLength, maxLength, minItems, maxItems, at any depth. An object with `properties` takes no other
names unless `additionalProperties` allows them; a reference fits any type. `problems` lists what doesn't fit as
"path: rule", by path; a tool without a schema has the problem "$: tool", arguments that aren't JSON "$: json".

Status: `linked`, `no_result`, `no_call` (a result without its call), `repeated` (an identifier's later calls or
results), `cycle` (calls that wait for each other), `blocked` (calls that wait for a cycle and are in none), `message`.
`valid` and `problems` are null but for calls. Nulls: a null conversation or identifier links nothing; a null text is an
empty string. Repeated rows each get their row; extra columns are ignored; an empty table gives no rows. NaN, infinite
numbers and numbers too large for a double aren't JSON: such arguments are broken and are written as a string. Half
surrogates in arguments are written as escapes; an identifier that holds one refers to nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

Schemas = dict[str, dict]
TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}
#: References of a conversation that one task orders by itself.
LOCAL = 100_000
#: Rounds after which what was found so far is written as one table, which keeps the plan short.
COMPACT = 32
MESSAGE = "conv_id, turn, kind, call_id, name, body"
HALF = re.compile("[\ud800-\udfff]")

#: The tool that the query reads a chat's turns as: a user's turn calls it, the assistant's next turn is its result.
REPLY: Schemas = {
    "reply": {
        "type": "object",
        "properties": {
            "context": {"type": "string"},
            "prompt": {"type": "string"},
            "size": {"type": "object", "properties": {"n_chars": {"type": "integer", "minimum": 0}, "unit": {"type": "string", "enum": ["chars"]}}, "required": ["n_chars", "unit"]},
            "turn": {"type": "integer"},
        },
        "required": ["prompt", "size", "turn"],
    }
}


def canonical_json(value: object) -> str:
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _finite(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(number)
    return value


def parse(body: str | None) -> object:
    """The value of a JSON text; ValueError or RecursionError for what isn't JSON, is too deep or isn't finite."""
    return json.loads(body or "", parse_constant=_finite, parse_float=_finite)


def _is(value: object, kind: str) -> bool:
    return isinstance(value, TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _rules(v: object, schema: dict) -> Iterator[str]:
    """Rules of one schema that the value itself breaks, not what is in it."""
    kinds = schema.get("type", list(TYPES))
    if not any(_is(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield "type"
        return
    if "enum" in schema and not any(type(v) is type(e) and v == e for e in schema["enum"]):
        yield "enum"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if v < schema.get("minimum", v):
            yield "minimum"
        if v > schema.get("maximum", v):
            yield "maximum"
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(v, kind):
            if len(v) < schema.get(least, 0):
                yield least
            if len(v) > schema.get(most, len(v)):
                yield most


def violations(arguments: object, schema: dict | None) -> list[str]:
    """All places that don't fit, as "path: rule", by path."""
    if schema is None:
        return ["$: tool"]
    out, todo = [], [("$", arguments, schema)]
    while todo:
        path, v, s = todo.pop()
        if isinstance(v, dict) and set(v) == {"$ref"}:
            continue
        broken = list(_rules(v, s))
        out += [(path, r) for r in broken]
        if "type" in broken:
            continue
        if isinstance(v, dict):
            known, more = s.get("properties", {}), s.get("additionalProperties", "properties" not in s)
            out += [(f"{path}.{k}", "required") for k in s.get("required", ()) if k not in v]
            for k, inner in v.items():
                if k in known:
                    todo.append((f"{path}.{k}", inner, known[k]))
                elif more is False:
                    out.append((f"{path}.{k}", "unknown"))
                elif isinstance(more, dict):
                    todo.append((f"{path}.{k}", inner, more))
        elif isinstance(v, list) and "items" in s:
            todo += [(f"{path}[{i}]", inner, s["items"]) for i, inner in enumerate(v)]
    return [HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", f"{p}: {r}") for p, r in sorted(out)]


def references(body: str | None) -> list[str]:
    """Identifiers of all `{"$ref": identifier}` in the arguments, however deep they are nested."""
    try:
        todo, out = [parse(body)], []
    except (ValueError, RecursionError):
        return []
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if set(v) == {"$ref"} and isinstance(v["$ref"], str) and not HALF.search(v["$ref"]):
                out.append(v["$ref"])
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return sorted(set(out))


def _serialise(schemas: Schemas):
    def line(kind: str, call_id: str | None, name: str | None, body: str | None) -> tuple[str, str | None]:
        if kind == "call":
            try:
                args = parse(body)
                wrong = violations(args, schemas.get(name))
                text = canonical_json(args)
            except (ValueError, RecursionError):
                text, wrong = canonical_json(body), ["$: json"]
            return f'{{"role":"assistant","tool_calls":[{{"function":{{"arguments":{text},"name":{canonical_json(name)}}},"id":{canonical_json(call_id)},"type":"function"}}]}}', "; ".join(wrong)
        if kind == "result":
            return canonical_json({"content": body or "", "role": "tool", "tool_call_id": call_id}), None
        return canonical_json({"content": body or "", "role": name}), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "call_id", "name", "body")]
            out = [line(*x) for x in zip(*cols)]
            names = [n for n in batch.schema.names if n not in ("name", "body")]
            found = [pa.array([None if x[1] is None else not x[1] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.string()), pa.array([x[0] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], *found], [*names, "valid", "problems", "json"])

    return run


def _latest(times: Iterable[int | None]) -> int | None:
    return max((t for t in times if t is not None), default=None)


def _cycles(waits: dict[str, list[str]]) -> set[str]:
    """Calls that wait for themselves, directly or through others: members of strongly connected parts (Kosaraju's two walks)."""
    order, seen = [], set()
    for start in waits:
        todo = [(start, False)]
        while todo:
            c, left = todo.pop()
            if left:
                order.append(c)
            elif c not in seen:
                seen.add(c)
                todo.append((c, True))
                todo += [(r, False) for r in waits[c] if r not in seen]
    back = defaultdict(list)
    for c, refs in waits.items():
        for r in refs:
            back[r].append(c)
    found, seen = set(), set()
    for start in reversed(order):
        part, todo = [], [start]
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                part.append(c)
                todo += back[c]
        if len(part) > 1 or part and start in waits[start]:
            found.update(part)
    return found


def order(edges: list[tuple]) -> Iterator[tuple[str, int, int | None, str | None]]:
    """call_id, level, ready, state for the calls of one conversation; edges are (call_id, ref, turn, end, met).

    `turn` and `end` are the turns of the call and of its result, `met` is the later one of the call referred to.
    """
    waits, times, met = defaultdict(list), {}, {}
    for call, ref, turn, end, then in edges:
        waits[call].append(ref)
        times[call], met[ref] = (turn, end), then
    open_refs, behind = {}, defaultdict(list)
    for call, refs in waits.items():
        inside = [r for r in refs if r in times]
        open_refs[call] = len(inside)
        for r in inside:
            behind[r].append(call)
    level, done = {}, dict(met)
    todo = [c for c, n in open_refs.items() if not n]
    while todo:
        c = todo.pop()
        turn, end = times[c]
        level[c] = 1 + max(level.get(r, 0) for r in waits[c])
        ready = _latest([turn, *[done[r] for r in waits[c]]])
        done[c] = _latest([ready, end])
        yield c, level[c], ready, None
        for other in behind[c]:
            open_refs[other] -= 1
            if not open_refs[other]:
                todo.append(other)
    left = {c: [r for r in refs if r in times and r not in level] for c, refs in waits.items() if c not in level}
    cyclic = _cycles(left)
    for c in left:
        yield c, -1, times[c][0], "cycle" if c in cyclic else "blocked"


def _order_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation after another."""
    now, edges = None, []

    def batch() -> pa.RecordBatch:
        found = list(order(edges))
        cols = [[now] * len(found), *map(list, zip(*found))]
        kinds = (conv_type, pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "call_id", "level", "ready", "state"])

    for whole in batches:
        conv_type = whole.column(0).type
        for conv, *edge in zip(*(c.to_pylist() for c in whole.columns)):
            if conv != now and edges:
                yield batch()
                edges = []
            now = conv
            edges.append(edge)
    if edges:
        yield batch()


EDGE = ("conv_id", "call_id", "ref", "turn", "end", "met")
KEY = ["conv_id", "call_id"]


def _rounds(edges: DataFrame) -> DataFrame:
    """What `order` gives, by joins: calls that wait for none that is left get their level, a round for each."""
    left, found, n = edges.withColumn("deep", F.lit(0)), None, -1
    level = 0
    while True:
        left = materialize(left, "refs")
        rest = left.count()
        if not rest:
            return found
        if rest == n:
            break
        level, n = level + 1, rest
        waits = left.select("conv_id", F.col("call_id").alias("ref")).distinct()
        waiting = left.join(waits, ["conv_id", "ref"], "left_semi").select(KEY).distinct()
        done = left.join(waiting, KEY, "left_anti").groupBy(KEY).agg((F.max("deep") + 1).alias("level"), F.greatest(F.max("turn"), F.max("met")).alias("ready"), F.max("end").alias("end"))
        done = materialize(done, "levels")
        now = done.select(*KEY, "level", "ready", F.lit(None).cast("string").alias("state"))
        found = now if found is None else found.unionByName(now)
        if level % COMPACT == 0:
            found = materialize(found, "levels")
        known = done.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("_level"), F.greatest("ready", "end").alias("_met"))
        still = left.join(waiting, KEY, "left_semi").join(known, ["conv_id", "ref"], "left")
        left = still.select("conv_id", "call_id", "ref", "turn", "end", F.when(F.col("_level").isNotNull(), F.col("_met")).otherwise(F.col("met")).alias("met"), F.greatest("deep", F.coalesce("_level", F.lit(0))).alias("deep"))
    cyclic = _rounds_cycles(left.select("conv_id", F.col("call_id").alias("a"), F.col("ref").alias("b")))
    stuck = left.groupBy(KEY).agg(F.max("turn").alias("ready")).join(cyclic.withColumn("state", F.lit("cycle")), KEY, "left")
    stuck = stuck.select(*KEY, F.lit(-1).alias("level"), "ready", F.coalesce("state", F.lit("blocked")).alias("state"))
    return stuck if found is None else found.unionByName(stuck)


def _spread(nodes: DataFrame, edges: DataFrame, value: str, take: Column) -> DataFrame:
    """Carries `value` of (conv_id, b) to (conv_id, a) over the edges, the greatest wins, until nothing changes."""
    before = None
    while True:
        nodes = materialize(nodes, "nodes")
        mark = nodes.agg(F.count(value), F.sum(F.xxhash64("conv_id", "id", value).cast("decimal(38,0)"))).first()
        if mark == before:
            return nodes
        before = mark
        come = edges.join(nodes.select("conv_id", F.col("id").alias("b"), F.col(value).alias("_come"), F.col("color").alias("_color")), ["conv_id", "b"])
        come = come.join(nodes.select("conv_id", F.col("id").alias("a"), F.col("color").alias("_own")), ["conv_id", "a"]).where(take).groupBy("conv_id", F.col("a").alias("id")).agg(F.max("_come").alias("_come"))
        nodes = nodes.join(come, ["conv_id", "id"], "left").withColumn(value, F.greatest(value, "_come")).drop("_come")


def _rounds_cycles(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id) of calls on cycles. Each round colours a call by the greatest call that it leads to; what a
    colour's own call leads to within the colour is one strongly connected part and leaves."""
    own = edges.where("a = b").select("conv_id", F.col("a").alias("call_id")).distinct()
    found = materialize(own, "cycles")
    left = edges.where("a <> b")
    while True:
        n = -1
        while True:  # what leads to nothing that is left, or is led to by nothing, is on no cycle
            left = materialize(left, "edges")
            rest = left.count()
            if rest in (0, n):
                break
            n = rest
            left = left.join(left.select("conv_id", F.col("a").alias("b")).distinct(), ["conv_id", "b"], "left_semi").join(left.select("conv_id", F.col("b").alias("a")).distinct(), ["conv_id", "a"], "left_semi").select("conv_id", "a", "b")
        if not rest:
            return found.distinct()
        nodes = left.select("conv_id", F.col("a").alias("id")).distinct().withColumn("color", F.col("id"))
        colored = _spread(nodes, left, "color", F.lit(True))
        reached = colored.withColumn("hit", F.when(F.col("id") == F.col("color"), F.lit(1)))
        back = left.select("conv_id", F.col("b").alias("a"), F.col("a").alias("b"))
        reached = _spread(reached, back, "hit", (F.col("_come") == 1) & (F.col("_color") == F.col("_own")))
        part = reached.where("hit = 1")
        several = part.groupBy("conv_id", "color").count().where("count > 1")
        found = materialize(found.unionByName(part.join(several, ["conv_id", "color"], "left_semi").select("conv_id", F.col("id").alias("call_id"))), "cycles")
        out = part.select("conv_id", F.col("id").alias("a"))
        left = left.join(out, ["conv_id", "a"], "left_anti").join(out.select("conv_id", F.col("a").alias("b")), ["conv_id", "b"], "left_anti").select("conv_id", "a", "b")


def _waiting(calls: DataFrame, owners: DataFrame, local: int) -> DataFrame:
    """conv_id, call_id, level, ready, state of the calls that refer to others."""

    @F.pandas_udf("array<string>")
    def find(body: pd.Series) -> pd.Series:
        return body.map(references)

    wanting = calls.where(F.col("body").contains("$ref") & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).select(*KEY, F.explode(find("body")).alias("ref")).distinct()
    met = owners.select("conv_id", F.col("call_id").alias("ref"), F.greatest("call_turn", "result_turn").alias("met"))
    edges = wanting.join(owners, KEY).join(met, ["conv_id", "ref"], "left").select(*KEY, "ref", F.col("call_turn").alias("turn"), F.col("result_turn").alias("end"), "met")
    edges = materialize(edges, "references")
    long = edges.groupBy("conv_id").count().where(F.col("count") > local).select("conv_id")
    shape = f"conv_id {edges.schema['conv_id'].dataType.simpleString()}, call_id string, level int, ready long, state string"
    if long.isEmpty():
        return edges.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_order_all, shape)
    long = materialize(long, "long")
    short = edges.join(long, "conv_id", "left_anti").select(*EDGE).repartition("conv_id").sortWithinPartitions("conv_id")
    return short.mapInArrow(_order_all, shape).unionByName(_rounds(edges.join(long, "conv_id", "left_semi").select(*EDGE)))


def format_chats(messages: DataFrame, schemas: Schemas, local: int = LOCAL) -> DataFrame:
    """conv_id, turn, kind, call_id, status, level, at, sub, valid, problems, json for each row of `messages` (columns `MESSAGE`)."""
    rows = messages.select(*MESSAGE.split(", ")).withColumn("turn", F.col("turn").cast("long"))
    pick = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("turn")))
    owners = rows.where("kind != 'message' and call_id is not null").groupBy(KEY).agg(pick("call").alias("call_turn"), pick("result").alias("result_turn"))
    owners = owners.join(_waiting(rows.where("kind = 'call'"), owners, local), KEY, "left")
    met = rows.join(owners, KEY, "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    late = (call & (F.col("turn") > F.col("call_turn"))) | (result & (F.col("turn") > F.col("result_turn")))
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("state").isNotNull(), F.col("state"))
        .when(late, "repeated")
        .when(call, F.when(F.col("result_turn").isNull(), "no_result").otherwise("linked"))
        .otherwise(F.when(F.col("call_turn").isNull(), "no_call").otherwise("linked"))
    )
    at = F.when(result, F.greatest("turn", F.coalesce("ready", "call_turn"))).when(call, F.greatest("turn", "ready")).otherwise(F.col("turn"))
    out = met.select("conv_id", "turn", "kind", "call_id", "name", "body", status.alias("status"), F.coalesce("level", F.lit(0)).alias("level"), at.alias("at"), F.when(result, 1).otherwise(0).alias("sub"))
    shape = out.drop("name", "body").withColumns({"valid": F.lit(None).cast("boolean"), "problems": F.lit(None).cast("string"), "json": F.lit("")}).schema
    return out.mapInArrow(_serialise(schemas), shape)


def from_turns(chats: DataFrame) -> DataFrame:
    """A chat's turns as tool use: a user's turn calls `reply`, an assistant's turn is the result of the call a turn before.

    Calls refer to the call two turns before, three times in a row; to one that never comes in every 13th chat; the first
    two refer to each other in every 11th; the first refers to the second in every 17th. In every 7th chat two calls
    share an identifier. Lengths are texts in every 5th chat, some prompts are missing in every other 5th, and some units
    are wrong in every other 7th, so their arguments don't fit.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    text, pair = F.coalesce("text", F.lit("")), F.floor(turn / 2)
    shared = F.coalesce(conv % 7 == 3, F.lit(False))
    call_id = lambda t: F.concat(F.lit("c"), conv.cast("string"), F.lit("_"), F.when(shared, t - t % 4).otherwise(t).cast("string"))
    follows = (pair % 4 != 0) & ~((conv % 17 == 3) & (pair == 1))
    ahead = ((conv % 11 == 5) | (conv % 17 == 3)) & (pair == 0)
    ref = F.when(~shared, F.when((conv % 13 == 7) & follows, F.concat(F.lit("c"), conv.cast("string"), F.lit("_gone"))).when(ahead, call_id(turn + 2)).when(follows, call_id(turn - 2)))
    context = F.when(ref.isNotNull(), F.struct(ref.alias("$ref"))).alias("context")
    prompt = F.when(~F.coalesce((conv % 5 == 2) & (pair % 2 == 1), F.lit(False)), text).alias("prompt")
    unit = F.when((conv % 7 == 2) & (pair % 3 == 1), "words").otherwise("chars").alias("unit")
    args = lambda kind: F.to_json(F.struct(turn.alias("turn"), F.struct(unit, F.length(text).cast(kind).alias("n_chars")).alias("size"), context, prompt))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return chats.select(
        "conv_id",
        "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, call_id(turn)).when(assistant, call_id(turn - 1)).alias("call_id"),
        F.when(user, "reply").when(assistant, None).otherwise(F.col("role")).alias("name"),
        F.when(user, F.when(conv % 5 == 1, args("string")).otherwise(args("long"))).otherwise(text).alias("body"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(from_turns(table(spark, sf_dir, "conversations")), REPLY)


_ID = "'c' || conv_id || '_' || CASE WHEN conv_id % 7 = 3 THEN {t} - {t} % 4 ELSE {t} END".format
_TEXTS, _GAPS, _WORDS = "m.conv_id % 5 = 1", "m.conv_id % 5 = 2 AND pair % 2 = 1", "m.conv_id % 7 = 2 AND pair % 3 = 1"
OP9_SQL = f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, turn // 2 AS pair,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN {_ID(t='turn')} WHEN 'assistant' THEN {_ID(t='(turn - 1)')} END AS call_id,
    turn // 2 % 4 <> 0 AND NOT (conv_id % 17 = 3 AND turn // 2 = 1) AS follows,
    CASE WHEN role = 'user' AND conv_id % 7 <> 3 THEN CASE WHEN conv_id % 13 = 7 AND follows THEN 'c' || conv_id || '_gone' WHEN (conv_id % 11 = 5 OR conv_id % 17 = 3) AND turn // 2 = 0 THEN {_ID(t='(turn + 2)')} WHEN follows THEN {_ID(t='(turn - 2)')} END END AS ref
  FROM conversations),
o AS (
  SELECT conv_id, call_id, min(CASE WHEN kind = 'call' THEN turn END) AS call_turn, min(CASE WHEN kind = 'result' THEN turn END) AS result_turn
  FROM m WHERE kind <> 'message' GROUP BY ALL),
w AS (
  SELECT DISTINCT m.conv_id, m.call_id, m.ref, o.call_turn, o.result_turn, greatest(r.call_turn, r.result_turn) AS met
  FROM m JOIN o ON o.conv_id = m.conv_id AND o.call_id = m.call_id LEFT JOIN o r ON r.conv_id = m.conv_id AND r.call_id = m.ref WHERE ref IS NOT NULL),
d AS (
  SELECT conv_id, call_id, 1 AS level, greatest(call_turn, met) AS ready, greatest(call_turn, met, result_turn) AS done FROM w WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.conv_id = w.conv_id AND x.call_id = w.ref)
  UNION ALL SELECT w.conv_id, w.call_id, d.level + 1, greatest(w.call_turn, d.done), greatest(w.call_turn, d.done, w.result_turn) FROM w JOIN d ON w.conv_id = d.conv_id AND w.ref = d.call_id),
way AS (
  SELECT conv_id, call_id, ref AS node FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = w.conv_id AND d.call_id = w.call_id)
  UNION SELECT way.conv_id, way.call_id, w.ref FROM way JOIN w ON w.conv_id = way.conv_id AND w.call_id = way.node),
lv AS (
  SELECT w.conv_id, w.call_id, coalesce(max(d.level), -1) AS depth, coalesce(max(d.ready), min(w.call_turn)) AS ready,
    CASE WHEN max(d.level) IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM way WHERE way.conv_id = w.conv_id AND way.call_id = w.call_id AND way.node = w.call_id) THEN 'cycle' ELSE 'blocked' END END AS state
  FROM w LEFT JOIN d ON w.conv_id = d.conv_id AND w.call_id = d.call_id GROUP BY w.conv_id, w.call_id)
SELECT m.conv_id, m.turn, kind, m.call_id,
  CASE WHEN kind = 'message' THEN 'message' WHEN state IS NOT NULL THEN state WHEN (kind = 'call' AND m.turn > call_turn) OR (kind = 'result' AND m.turn > result_turn) THEN 'repeated'
       WHEN kind = 'call' THEN CASE WHEN result_turn IS NULL THEN 'no_result' ELSE 'linked' END
       ELSE CASE WHEN call_turn IS NULL THEN 'no_call' ELSE 'linked' END END AS status,
  coalesce(depth, 0) AS level, CASE kind WHEN 'result' THEN greatest(m.turn, coalesce(ready, call_turn)) WHEN 'call' THEN greatest(m.turn, ready) ELSE m.turn END AS at,
  CASE WHEN kind = 'result' THEN 1 ELSE 0 END AS sub,
  CASE WHEN kind = 'call' THEN NOT coalesce({_TEXTS} OR ({_GAPS}) OR ({_WORDS}), false) END AS valid,
  CASE WHEN kind = 'call' THEN concat_ws('; ', CASE WHEN {_GAPS} THEN '$.prompt: required' END, CASE WHEN {_TEXTS} THEN '$.size.n_chars: type' END, CASE WHEN {_WORDS} THEN '$.size.unit: enum' END) END AS problems,
  CASE kind
    WHEN 'call' THEN '{{"role":"assistant","tool_calls":[{{"function":{{"arguments":{{' || coalesce('"context":{{"$ref":"' || ref || '"}},', '') || CASE WHEN {_GAPS} THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',' END
      || '"size":{{"n_chars":' || CASE WHEN {_TEXTS} THEN '"' || length(text) || '"' ELSE CAST(length(text) AS VARCHAR) END || ',"unit":"' || CASE WHEN {_WORDS} THEN 'words' ELSE 'chars' END || '"}},"turn":' || m.turn || '}},"name":"reply"}},"id":"' || m.call_id || '","type":"function"}}]}}'
    WHEN 'result' THEN '{{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"' || m.call_id || '"}}'
    ELSE '{{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}}' END AS json
FROM m LEFT JOIN o ON m.conv_id = o.conv_id AND m.call_id = o.call_id LEFT JOIN lv ON m.conv_id = lv.conv_id AND m.call_id = lv.call_id
"""
