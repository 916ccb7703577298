"""Strictness of JSON schemas against a plain walk of the parsed text: nesting, references, repeated names, broken texts, odd names."""

import json
import random

from pyspark.sql import functions as F

from ledgerleaf.operators import schemas


def walk(v, at="root"):
    """Every value with its path; members in the order of their names."""
    yield at, v
    if isinstance(v, dict):
        for k in sorted(v):
            yield from walk(v[k], f"{at}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{at}[{i}]")


def listed(names):
    return "['" + "', '".join(sorted(names)) + "']"


def broken(text):
    try:
        schema = json.loads(text)
    except (TypeError, ValueError):
        return ["Root schema must have type='object'."]
    out = []
    if not isinstance(schema, dict) or schema.get("type") != "object":
        out.append("Root schema must have type='object'.")
    if isinstance(schema, dict) and "anyOf" in schema:
        out.append("Root schema must not use anyOf.")
    for at, v in walk(schema):
        if not isinstance(v, dict):
            continue
        if "$ref" in v and len(v) > 1:
            out.append(f"{at}: $ref must not have sibling keywords {listed(k for k in v if k != '$ref')}.")
        p, r = v.get("properties"), v.get("required")
        if isinstance(p, dict):
            if v.get("additionalProperties") is not False:
                out.append(f"{at}: additionalProperties must be false.")
            if not isinstance(r, list):
                out.append(f"{at}: required must be a list.")
            else:
                names = {x for x in r if isinstance(x, str)}
                out += [f"{at}: required missing keys {listed(set(p) - names)}."] * bool(set(p) - names)
                out += [f"{at}: required has unknown keys {listed(names - set(p))}."] * bool(names - set(p))
    return out


def rewritten(v):
    if isinstance(v, list):
        return [rewritten(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "$ref" in v:
        return {"$ref": v["$ref"]}
    p = v.get("properties")
    more = {"required": sorted(p), "additionalProperties": False} if isinstance(p, dict) and p else {}
    return {k: rewritten(x) for k, x in {**v, **more}.items()}


def made(rng, depth=0):
    if depth > 4 or rng.random() < 0.2:
        return rng.choice([1, 2.5, True, None, "s", 'q"\\é', [], {}, False])
    if rng.random() < 0.15:
        return [made(rng, depth + 1) for _ in range(rng.randrange(12))]
    names = rng.sample(["type", "properties", "required", "additionalProperties", "anyOf", "items", "x y", "a.b", "$defs", "k"], rng.randrange(5)) + ["$ref"] * (rng.random() < 0.1)
    out = {k: made(rng, depth + 1) for k in names}
    if rng.random() < 0.6:
        out["properties"] = {k: made(rng, depth + 2) for k in rng.sample("abcde", rng.randrange(4))}
        out["required"] = rng.choice([["a", "b"], ["a", 5, "z"], "a", list(out["properties"])])
        out["additionalProperties"] = rng.choice([False, True, {}, 0])
    if not depth:
        out["type"] = rng.choice(["object", "array", ["object"]])
    return out


def test_like_a_walk_of_the_schema(spark):
    rng = random.Random(4)
    texts = [json.dumps(made(rng)) for _ in range(150)] + ["", "no", None, "[1]", "{}", "5", '{"type":"object"}', '{"a":1,"a":2}', '{"type":"object","properties":{"$ref":{"x":1},"y":{}}}']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, schema string").repartition(3)
    twice = texts.index('{"a":1,"a":2}')
    got = {}
    for r in schemas.violations(docs, "doc", "schema").orderBy("id", "at", "rule").collect():
        got.setdefault(r.id, []).append(r.message)
    want = {i: broken(t) for i, t in enumerate(texts)}
    want[twice] = broken(None)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v}
    told = {r.id: (r.n, r.message) for r in schemas.report(schemas.violations(docs, "doc", "schema"), docs, "doc").collect()}
    assert {i: n for i, (n, _) in told.items()} == {i: len(v) for i, v in want.items()}
    most = max(want, key=lambda i: len(want[i]))
    assert told[most][1].endswith(f"; ... ({len(want[most]) - 10} more)") and told[texts.index('{"type":"object"}')] == (0, None)
    made_strict = {r.id: r.json for r in schemas.strict(docs, "doc", "schema").collect()}
    for i, t in enumerate(texts):
        try:
            value = json.loads(t) if i != twice else None
        except (TypeError, ValueError):
            value = None
        assert (made_strict[i] and json.loads(made_strict[i])) == (rewritten(value) if value is not None else None)


def test_the_rewritten_schema_is_strict(spark):
    text = json.dumps({"type": "object", "properties": {"a": {"properties": {"b": {"$ref": "#/x", "title": "t"}}}, "c": {"items": [{"properties": {"d": {}}}]}}})
    docs = spark.createDataFrame([(1, text)], "id int, schema string")
    assert schemas.violations(docs, "id", "schema").count() == 7
    assert schemas.violations(schemas.strict(docs, "id", "schema"), "id", "json").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "id int, schema string")
    assert schemas.violations(docs, "id", "schema").count() == 0 and schemas.strict(docs, "id", "schema").count() == 0
    assert schemas.report(schemas.violations(docs, "id", "schema"), docs, "id").select(F.max("n")).first()[0] is None


def placed(v, at=""):
    """Every node of a value with its place, as JSN-08 gives them."""
    if isinstance(v, dict):
        return [(at, "object"), *[x for k in v for x in placed(v[k], f"{at}.{k}")]]
    if isinstance(v, list):
        return [(at, "array"), *[x for i, e in enumerate(v) for x in placed(e, f"{at}[{i:010d}]")]]
    return [(at, json.dumps(v, ensure_ascii=False))]


def test_places_of_the_rewritten_schema(spark):
    rng = random.Random(5)
    deep = '{"properties":{"a":[' * 300 + '{"$ref":{"properties":{"x":1}},"title":"t"}' + '],"b":0}}' * 300
    wide = json.dumps({"items": list(range(45_000)), "properties": {str(i): {"properties": {"é😀": "\x1f\n\"\\/"}} for i in range(3)}})
    odd = json.dumps({"properties": {"": {}, 'q"': [True, None], "tab\t": " ", "a.b": -7, "[0]": [[], {}]}, "required": 5})
    texts = [json.dumps(made(rng)) for _ in range(60)] + [deep, wide, odd, "null", '"s"', "{}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, schema string")
    got = {}
    for r in schemas.strict_places(docs, "doc", "schema").collect():
        got.setdefault(r.id, []).append((r.place, r.value.replace("\\u001F", "\\u001f")))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(placed(rewritten(json.loads(t)))) for i, t in enumerate(texts)}


def test_text_after_the_schema_breaks_it(spark):
    texts = ['{"type":"object"} x', '{"type":"object"}}', "[1]]", "1,2", "1],[2", '{"type":"object"},{}', ' {"type":"object"} \n']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, schema string")
    assert {r.id for r in schemas.violations(docs, "doc", "schema").collect()} == set(range(6))
    assert {r.id: r.json for r in schemas.strict(docs, "doc", "schema").collect()} == {**dict.fromkeys(range(6)), 6: '{"type":"object"}'}
    assert {r.id for r in schemas.strict_places(docs, "doc", "schema").collect()} == {6}


def test_no_rounds_by_depth(spark):
    """JSN-08 is one plan, however deep the schemas are: making it runs no jobs but that for the table's columns, and it has one exchange."""
    spark.sparkContext.setJobGroup("schemas", "schemas")
    try:
        found = schemas.jsn08(spark, "/root/testdata/sf0.001")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("schemas")) <= 1
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_numbers_and_strings_as_spark_writes_them(spark):
    text = r'[1.50,-0,100.0,1e2,-12.340e-5,0.00100,12345678901234567890123,1E999,"😀\ud83dx\\ud83d","\u0000\u001f\t\/"]'
    docs = spark.createDataFrame([(1, text)], "id int, schema string")
    want = docs.select(F.to_json(F.parse_json("schema"))).first()[0]
    assert schemas.strict(docs, "id", "schema").first().json == want
    assert "[" + ",".join(r.value for r in schemas.strict_places(docs, "id", "schema").where("place <> ''").orderBy("place").collect()) + "]" == want
