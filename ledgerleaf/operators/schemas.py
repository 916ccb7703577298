"""JSON schemas of any depth as nodes: what keeps them from being strict, and how they look when they are.

A node is (id, at, depth, kind, json): `at` holds the steps from the root (`.name` for a member, `[n]` for an entry, n
padded with zeros so that steps sort in order), `json` the value as text with sorted keys. Spark's parser says
which texts are JSON; these are read and walked where they lie, with a stack of what is open. So nothing is written, joined
or grouped, however deep a schema is, and rows leave in bounded blocks. Numbers take the form that Spark's variants give
them, doubles the fewest digits that tell them apart.

Defined results: text that isn't JSON as a whole, or names a member twice, has no nodes, and one violation at the root; so
has a null, and what is nested over 999 deep (Spark's parser takes no more). Members count in the order of their names,
whatever the text's order, and stand in messages as they are, between quotes. Ids must be unique; a null id is an id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import bridges as B
from ..plans.catalog import query

#: How many violations a report spells out. Fixed value.
REPORTED = 10
#: Rows, and characters, that a block of output may reach.
ROWS, CHARS = 20_000, 1 << 23

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Of JSON without blanks: the name of a member and what it holds, an entry, or an end. Of a container, the beginning.
_TOKEN = re.compile(rf'(?:({_STRING}):)?+([\[{{]|{_STRING}|[^"\[\]{{}},:]++)|[\]}}]')
_KINDS = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
_ESCAPED = re.compile(r'[\x00-\x1f"\\]')
_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + e for c, e in zip('\b\t\n\f\r"\\', 'btnfr"\\', strict=True)}
_LONE = re.compile(r"\\(?:u[dD][89abAB]..\\u[dD][c-fC-F]|(u[dD][89a-fA-F]..)|.)", re.S)
_ARROW = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def _kind(node: Column) -> Column:
    """object, array, string, boolean, null or number."""
    t = F.schema_of_variant(node)
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")


def _texts(docs: DataFrame) -> DataFrame:
    """id, text: `json`; null if it isn't JSON."""
    # the parser stops where a value ends, whatever comes then; the number behind it must come next
    rows = B.once(docs, mark=F.xxhash64("json"))
    whole = F.try_parse_json(F.concat(F.lit("["), "json", F.lit(","), F.col("mark").cast("string"), F.lit("]")))
    return rows.select("id", F.when(F.try_variant_get(whole, "$[1]", "bigint") == F.col("mark"), F.make_valid_utf8("json")).alias("text"))


def _each(docs: DataFrame, id_col: str, json_col: str, rows: Callable[..., Iterator[int]], columns: dict[str, str]) -> DataFrame:
    """id, `columns`: what `rows` puts into lists for each text (`_texts`); it yields how many characters a row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of, size, found = batch.column(0), [], 0, [[] for _ in columns]

            def block() -> pa.RecordBatch:
                made = [ids.take(pa.array(of, pa.int32())), *[pa.array(c, _ARROW[t]) for c, t in zip(found, columns.values(), strict=True)]]
                for c in (of, *found):
                    c.clear()
                return pa.RecordBatch.from_arrays(made, ["id", *columns])

            for i, text in enumerate(batch.column(1).to_pylist()):
                for chars in rows(text, *found):
                    of.append(i)
                    size += chars
                    if size >= CHARS or len(of) >= ROWS:
                        yield block()
                        size = 0
            if of:
                yield block()

    # dealt anew: a few small files hold very many texts
    texts = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"))
    texts = _texts(texts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("id", "json")))
    return texts.mapInArrow(run, ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}", *[f"{c} {t}" for c, t in columns.items()]]))


class _Raw(str):
    """JSON that stands as it is."""


def _number(t: str) -> str:
    """A number as Spark writes it: with up to 38 digits and no exponent as it is, but for zeros at the end; others as doubles."""
    if "e" not in t and "E" not in t:
        _, digits, exponent = (d := Decimal(t)).as_tuple()
        if len(digits) <= 38 and exponent >= -38:
            shown = f"{d:f}"
            shown = shown.rstrip("0").rstrip(".") if "." in shown else shown
            return _Raw("0" if shown == "-0" else shown)
    f = float(t)
    if f in (float("inf"), float("-inf")):
        return "Infinity" if f > 0 else "-Infinity"  # a string
    if f == 0 or 1e-3 <= abs(f) < 1e7:
        return _Raw(repr(f))
    sign, digits, exponent = Decimal(repr(f)).as_tuple()
    shown = "".join(map(str, digits))
    return _Raw(f"{'-' * sign}{shown[0]}.{shown[1:].rstrip('0') or '0'}E{exponent + len(shown) - 1}")


_READER = json.JSONDecoder(parse_int=lambda t: _Raw(t) if len(t) < 38 and t != "-0" else _number(t), parse_float=_number)


def _read(text: str) -> object:
    """What a text holds. Half a pair of surrogates is a question mark."""
    if "\\ud" in text or "\\uD" in text:
        text = _LONE.sub(lambda m: "?" if m[1] else m[0], text)
    return _READER.decode(text)


def _scalar(v: object) -> str:
    if type(v) is str:
        return f'"{v.translate(_ESCAPES) if _ESCAPED.search(v) else v}"'
    return v if type(v) is _Raw else "null" if v is None else "true" if v else "false"


def _shown(root: object) -> str:
    """As JSON without blanks, names sorted."""
    out, todo = [], [root]
    while todo:
        v = todo.pop()
        if type(v) is dict:
            todo.append(_Raw("}"))
            for k in sorted(v, reverse=True):
                todo += v[k], _Raw(f"{_scalar(k)}:"), _Raw(",")
            todo[-1] = _Raw("{") if v else _Raw("{}")
        elif type(v) is list:
            todo.append(_Raw("]"))
            for x in reversed(v):
                todo += x, _Raw(",")
            todo[-1] = _Raw("[") if v else _Raw("[]")
        else:
            out.append(_scalar(v))
    return "".join(out)


def _nodes(text: str | None, steps: list, kinds: list, texts: list) -> Iterator[int]:
    """Each node of a text, a container after what it holds."""
    at, far, pos, up = (), 0, None, []
    text = "" if text is None else _shown(_read(text))
    for m in _TOKEN.finditer(text):
        key, value = m.groups()
        here, long, start = at, far, m.start(2)
        if value is None:  # an end
            (at, far, pos), kind, start = up.pop()
        else:
            if key is not None:
                step = "." + (json.loads(key) if "\\" in key else key[1:-1])
                here, long = (*at, step), far + len(step)
            elif pos is not None:
                here, long, pos = (*at, f"[{pos:010d}]"), far + 12, pos + 1
            kind = _KINDS.get(value[0], "number")
            if value == "{" or value == "[":
                up.append(((at, far, pos), kind, start))
                at, far, pos = here, long, 0 if value == "[" else None
                continue
        steps.append(here)
        kinds.append(kind)
        texts.append(text[start : m.end()])
        yield long + m.end() - start


def nodes(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """All nodes of the JSON texts, with their kind."""
    found = _each(docs, id_col, json_col, _nodes, {"at": "array<string>", "kind": "string", "json": "string"})
    return found.select("id", "at", F.size("at").alias("depth"), "kind", "json")


def shown(at: Column) -> Column:
    """A path as text, from `root`."""
    return F.concat(F.lit("root"), F.array_join(F.transform(at, lambda s: F.when(s.startswith("["), F.regexp_replace(s, r"^\[0*(?=\d)", "[")).otherwise(s)), ""))


def _names(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))


def _strict(found: DataFrame) -> DataFrame:
    """Nodes that are objects, with what the rules look at: names, properties, required, additionalProperties."""
    member = lambda c, name: F.get_json_object(c, f"$.{name}")
    o = found.where("kind = 'object'").select("id", "at", "depth", "json", F.json_object_keys("json").alias("names"), F.parse_json("json").alias("node"))
    part = lambda name: F.try_variant_get("node", f"$.{name}", "variant")
    o = o.select("id", "at", "depth", "names", part("properties").alias("p"), part("required").alias("r"), part("additionalProperties").alias("a"), part("type").alias("t"), member(F.col("json"), "properties").alias("inner"))
    required = F.when(_kind(F.col("r")) == "array", F.transform(F.filter(F.expr("cast(r as array<variant>)"), lambda x: _kind(x) == "string"), lambda x: F.try_variant_get(x, "$", "string")))
    return o.select(
        "id",
        "at",
        "depth",
        "names",
        F.when(_kind(F.col("p")) == "object", F.json_object_keys(F.to_json("p"))).alias("properties"),
        required.alias("required"),
        F.coalesce((_kind(F.col("a")) == "boolean") & ~F.try_variant_get("a", "$", "boolean"), F.lit(False)).alias("closed"),
        F.when(_kind(F.col("t")) == "string", F.try_variant_get("t", "$", "string")).alias("type"),
    )


def violations(docs: DataFrame, id_col: str, json_col: str, found: DataFrame | None = None) -> DataFrame:
    """JSN-09: id, at, rule (their order), message: all that keeps a schema from being strict. `found`: its nodes, if they are there already."""
    o, c = _strict(nodes(docs, id_col, json_col) if found is None else found), F.col
    path = shown(c("at"))
    siblings = F.array_sort(F.filter("names", lambda n: n != "$ref"))
    missing = F.array_sort(F.array_except("properties", "required"))
    extra = F.array_sort(F.array_except("required", "properties"))
    has = c("properties").isNotNull()
    root = c("depth") == 0
    rules = [
        F.when(root & ~F.coalesce(c("type") == "object", F.lit(False)), "Root schema must have type='object'."),
        F.when(root & F.array_contains("names", "anyOf"), "Root schema must not use anyOf."),
        F.when(F.array_contains("names", "$ref") & (F.size(siblings) > 0), F.concat(path, F.lit(": $ref must not have sibling keywords "), _names(siblings), F.lit("."))),
        F.when(has & ~c("closed"), F.concat(path, F.lit(": additionalProperties must be false."))),
        F.when(has & c("required").isNull(), F.concat(path, F.lit(": required must be a list."))),
        F.when(has & (F.size(missing) > 0), F.concat(path, F.lit(": required missing keys "), _names(missing), F.lit("."))),
        F.when(has & (F.size(extra) > 0), F.concat(path, F.lit(": required has unknown keys "), _names(extra), F.lit("."))),
    ]
    each = o.select("id", "at", F.posexplode(F.array(*rules)).alias("rule", "message")).where("message is not null")
    texts = _texts(docs.select(c(id_col).alias("id"), c(json_col).alias("json")))
    bare = texts.where(F.coalesce(~F.ltrim("text", F.lit(" \t\n\r")).startswith("{"), F.lit(True))).select("id", F.array().cast("array<string>").alias("at"), F.lit(0).alias("rule"), F.lit("Root schema must have type='object'.").alias("message"))
    return each.unionByName(bare)


def report(found: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """id, n, message: a line for each schema, the first `REPORTED` of its violations and how many more there are; null if it is strict."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("at", "rule", "message"))), lambda v: v["message"])
    each = found.groupBy("id").agg(line.alias("all"))
    told = F.concat(F.array_join(F.slice("all", 1, REPORTED), "; "), F.when(F.size("all") > REPORTED, F.concat(F.lit("; ... ("), (F.size("all") - REPORTED).cast("string"), F.lit(" more)"))).otherwise(""))
    return docs.select(F.col(id_col).alias("id")).join(each.select("id", F.size("all").alias("n"), told.alias("message")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "message")


def _strictly(root: object) -> object:
    """`root` itself, rewritten."""
    todo = [root]
    while todo:
        v = todo.pop()
        if type(v) is dict:
            if "$ref" in v:  # what stands under the name of a reference stays as it is
                ref = v["$ref"]
                v.clear()
                v["$ref"] = ref
                continue
            if type(p := v.get("properties")) is dict and p:
                v["required"], v["additionalProperties"] = sorted(p), False
            todo += [x for x in v.values() if type(x) is dict or type(x) is list]
        elif type(v) is list:
            todo += [x for x in v if type(x) is dict or type(x) is list]
    return root


def _written(text: str | None, texts: list) -> Iterator[int]:
    """The rewritten text; a null stays."""
    texts.append(None if text is None else _shown(_strictly(_read(text))))
    yield len(text or "")


def _places(text: str | None, places: list, values: list) -> Iterator[int]:
    """Each node of the rewritten text."""
    todo = [] if text is None else [("", _strictly(_read(text)))]
    while todo:
        at, v = todo.pop()
        if type(v) is dict:
            value = "object"
            todo += [(f"{at}.{k}", x) for k, x in v.items()]
        elif type(v) is list:
            value = "array"
            todo += [(f"{at}[{i:010d}]", x) for i, x in enumerate(v)]
        else:
            value = _scalar(v)
        places.append(at)
        values.append(value)
        yield len(at) + len(value)


def strict(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """JSN-08: id, json: each schema with all names of an object's properties required and no others allowed, at every depth.

    A reference keeps nothing beside it. Texts that aren't JSON give null.
    """
    return _each(docs, id_col, json_col, _written, {"json": "string"})


def strict_places(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, place, value: all nodes of the rewritten schemas (`strict`), steps joined; value is the kind of a container, else the text."""
    return _each(docs, id_col, json_col, _places, {"place": "string", "value": "string"})


# ---- schemas made from events: deeper, and wrong in more ways, as the id says

#: Spark and DuckDB read this expression alike.
MADE = """concat('{"type":"', CASE WHEN event_id % 11 = 0 THEN 'array' ELSE 'object' END, '",', CASE WHEN event_id % 13 = 0 THEN '"anyOf":[],' ELSE '' END,
  '"properties":{"k":', CASE WHEN event_id % 7 = 0 THEN '{"$ref":"#/k","title":"t","default":0}' ELSE concat('{"const":', substr(props, 7, length(props) - 7), '}') END, ',"a b":',
  repeat('{"properties":{"in":', CAST(event_id % 4 AS INT)), CASE WHEN event_id % 5 = 0 THEN '{"items":[{"properties":{"z":{},"y":{}},"required":["z"]},{"properties":{}}]}' ELSE '{"type":["string","null"]}' END,
  repeat(CASE WHEN event_id % 6 = 0 THEN '},"required":["in","out"]}' ELSE '},"required":["in"],"additionalProperties":false}' END, CAST(event_id % 4 AS INT)), '}',
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN ',"additionalProperties":false' ELSE ',"additionalProperties":{"type":"string"}' END,
  CASE WHEN event_id % 4 = 0 THEN ',"required":["k","a b"]' WHEN event_id % 4 = 1 THEN ',"required":["k",5,"more"]' WHEN event_id % 4 = 2 THEN ',"required":"k"' ELSE '' END, CASE WHEN event_id % 17 = 0 THEN '' ELSE '}' END)"""


def made(spark, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").select("event_id", F.expr(MADE).alias("schema"))


_TREE = f"""m AS (SELECT event_id AS id, {MADE} AS j FROM events),
n AS (SELECT id, CAST([] AS VARCHAR[]) AS way, CAST(NULL AS VARCHAR) AS key, CAST(j AS JSON) AS node, 0 AS depth FROM m WHERE json_valid(j)
  UNION ALL SELECT n.id, list_append(n.way, CASE WHEN json_type(n.node) = 'ARRAY' THEN '[' || lpad(e.key, 10, '0') || ']' ELSE '.' || e.key END), e.key, e.value, depth + 1 FROM n, json_each(n.node) e WHERE json_type(n.node) IN ('OBJECT', 'ARRAY')),
o AS (SELECT id, way, depth, json_keys(node) AS names, 'root' || array_to_string(list_transform(way, lambda s: CASE WHEN s[1] = '[' THEN regexp_replace(s, '^\\[0*([0-9])', '[\\1') ELSE s END), '') AS path, node->'properties' AS p, node->'required' AS r, node->'additionalProperties' AS a, node->>'type' AS t FROM n WHERE json_type(node) = 'OBJECT'),
q AS (SELECT *, CASE WHEN json_type(p) = 'OBJECT' THEN json_keys(p) END AS props, CASE WHEN json_type(r) = 'ARRAY' THEN list_transform(list_filter(CAST(r AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') END AS req FROM o),
s AS (SELECT *, list_sort(list_filter(names, lambda x: x <> '$ref')) AS sib, list_sort(list_filter(props, lambda x: NOT list_contains(req, x))) AS miss, list_sort(list_filter(req, lambda x: NOT list_contains(props, x))) AS extra FROM q)"""
_LISTED = "'[''' || array_to_string({}, ''', ''') || '''].'".format
VIOLATIONS = f"""SELECT id, way, 0 AS rule, 'Root schema must have type=''object''.' AS message FROM s WHERE depth = 0 AND t IS DISTINCT FROM 'object'
UNION ALL SELECT id, [], 0, 'Root schema must have type=''object''.' FROM m WHERE NOT json_valid(j)
UNION ALL SELECT id, way, 1, 'Root schema must not use anyOf.' FROM s WHERE depth = 0 AND list_contains(names, 'anyOf')
UNION ALL SELECT id, way, 2, path || ': $ref must not have sibling keywords ' || {_LISTED('sib')} FROM s WHERE list_contains(names, '$ref') AND len(sib) > 0
UNION ALL SELECT id, way, 3, path || ': additionalProperties must be false.' FROM s WHERE props IS NOT NULL AND coalesce(CAST(a AS VARCHAR), '') <> 'false'
UNION ALL SELECT id, way, 4, path || ': required must be a list.' FROM s WHERE props IS NOT NULL AND req IS NULL
UNION ALL SELECT id, way, 5, path || ': required missing keys ' || {_LISTED('miss')} FROM s WHERE props IS NOT NULL AND req IS NOT NULL AND len(miss) > 0
UNION ALL SELECT id, way, 6, path || ': required has unknown keys ' || {_LISTED('extra')} FROM s WHERE props IS NOT NULL AND req IS NOT NULL AND len(extra) > 0"""


@query("JSN-09", f"WITH RECURSIVE {_TREE} SELECT id AS event_id, array_to_string(way, '') AS place, rule, message FROM ({VIOLATIONS})")
def jsn09(spark, sf_dir):
    return violations(made(spark, sf_dir), "event_id", "schema").select(F.col("id").alias("event_id"), F.array_join("at", "").alias("place"), "rule", "message")


@query("JSN-09-report", f"""WITH RECURSIVE {_TREE}, v AS ({VIOLATIONS}), g AS (SELECT id, list(message ORDER BY way, rule) AS l FROM v GROUP BY id)
SELECT event_id, coalesce(len(l), 0) AS n, array_to_string(l[1:{REPORTED}], '; ') || CASE WHEN len(l) > {REPORTED} THEN '; ... (' || (len(l) - {REPORTED}) || ' more)' ELSE '' END AS message FROM events LEFT JOIN g ON id = event_id""")
def jsn09_report(spark, sf_dir):
    docs = made(spark, sf_dir)
    return report(violations(docs, "event_id", "schema"), docs, "event_id").select(F.col("id").alias("event_id"), "n", "message")


@query("JSN-08", f"""WITH RECURSIVE {_TREE},
gone AS (SELECT id, list_append(way, '.' || u.name) AS way FROM s, unnest(list_concat(CASE WHEN list_contains(names, '$ref') THEN sib ELSE [] END, CASE WHEN NOT list_contains(names, '$ref') AND len(props) > 0 THEN ['required', 'additionalProperties'] ELSE [] END)) u(name)),
kept AS (SELECT id, way, node FROM n WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = n.id AND gone.way = n.way[1:len(gone.way)])),
more AS (SELECT s.id, s.way, list_sort(props) AS props FROM s JOIN kept k ON k.id = s.id AND k.way = s.way WHERE len(props) > 0 AND NOT list_contains(names, '$ref'))
SELECT id AS event_id, array_to_string(way, '') AS place, CASE WHEN json_type(node) IN ('OBJECT', 'ARRAY') THEN lower(json_type(node)) ELSE CAST(node AS VARCHAR) END AS value FROM kept
UNION ALL SELECT id, array_to_string(way, '') || '.additionalProperties', 'false' FROM more
UNION ALL SELECT id, array_to_string(way, '') || '.required', 'array' FROM more
UNION ALL SELECT id, array_to_string(way, '') || '.required[' || lpad(CAST(i - 1 AS VARCHAR), 10, '0') || ']', CAST(to_json(props[i]) AS VARCHAR) FROM more, unnest(range(1, len(props) + 1)) r(i)""")
def jsn08(spark, sf_dir):
    """All nodes of the rewritten schemas."""
    found = strict_places(made(spark, sf_dir), "event_id", "schema")
    return found.select(F.col("id").alias("event_id"), "place", "value")
