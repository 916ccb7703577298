"""Secret scans with multipart credential linking, in DataFrame functions only.

1. Each text is scanned once for strong spans (assign, access, hex) and for weak parts (an access identifier, a bare
   40-character secret, an endpoint). A match's position is the length of all that stands before it: `split` gives the
   text between matches, `regexp_extract_all` the matches.
2. The parts of a text are interval-joined: two parts belong together if they start within `reach` code points.
   Positions are dealt to buckets of that width; each bucket keeps only the first and last start of each sort of part,
   which settles whether a partner is in reach, so a part meets three rows at most and no pairs are listed.
3. A weak identifier or secret is reported only with its counterpart, an endpoint only with both.

Defined results: a null text counts as empty; repeated rows each get their row; an empty table gives no rows; only the
id and text columns are used, so extra columns can't clash. A row is known by its id and a hash of its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, materialize, table

#: The patterns of the query's contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")

#: Weak parts: identifiers of known shapes, bare secrets of 40 characters, service addresses.
WEAK_ID = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}"
WEAK_KEY = r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"
ENDPOINT = r"https?://[^\s\"'<>]+"
#: A run that a bare secret could be; looked for from the start of a run only.
LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"
SPAN = "struct<start:int,rank:int,end:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever and how often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    """An array cut into pieces of about the root of its size, 64 at least: folds over pieces stay cheap however long it is."""
    k = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items)))).cast("int")
    last = F.greatest(F.ceil(F.size(items) / k).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * k + 1, k))


def _before(items: Column, kind: str, zero: int, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """array<struct<before,x>>: each item (of SQL type `kind`) with the `join` of the values of all items before it.

    A fold that appends copies its array each time, so it runs over pieces: n matches cost about n * sqrt(n) / 2 copies.
    """
    fold = lambda at, x: join(at, value(x))
    none = lambda kind: F.array().cast(f"array<{kind}>").alias("out")
    sums = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), fold))
    starts = lambda chunks: F.aggregate(sums(chunks), F.struct(F.lit(zero).alias("at"), none("int")), lambda acc, n: F.struct(join(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    pair = lambda at, x: F.struct(at.alias("before"), x.alias("x"))
    step = lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.array_append(acc["out"], pair(acc["at"], x)).alias("out"))
    within = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none(f"struct<before:int,x:{kind}>")), step, lambda acc: acc["out"])
    return _let(items, lambda found: _let(_chunks(found), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), within))))


def _spans(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0, may: Column | None = None) -> Column:
    """array<struct<start,rank,end>> of the matches whose `group` has `least` code points; `may`: a cheap test that any can exist."""
    lit = F.lit(pattern)
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, lit, F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, lit, F.lit(group)), F.length) if group else whole
    zipped = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("len"), kept.alias("kept"))
    placed = _before(zipped, "struct<gap:int,len:int,kept:int>", 0, lambda x: x["gap"] + x["len"], lambda a, b: a + b)
    start = lambda m: m["before"] + m["x"]["gap"]
    found = F.transform(F.filter(placed, lambda m: m["x"]["kept"] >= least), lambda m: F.struct(start(m).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start(m) + m["x"]["len"]).alias("end")))
    return F.when(may, found).otherwise(F.array().cast(f"array<{SPAN}>")) if may is not None else found


def _free(spans: Column, base: Column) -> Column:
    """Those of `spans` that meet no base span: the furthest end of base spans from the left and the nearest start to the right decide."""
    tag = lambda arr, weak: F.transform(arr, lambda s: F.struct(s["start"].alias("start"), F.lit(weak).alias("weak"), s["rank"].alias("rank"), s["end"].alias("end")))
    kind = "struct<start:int,weak:int,rank:int,end:int>"
    left = _before(F.array_sort(F.concat(tag(spans, 1), tag(base, 0))), kind, 0, lambda x: F.when(x["weak"] == 0, x["end"]).otherwise(0), F.greatest)
    far = 2**31 - 1
    both = _before(F.reverse(left), f"struct<before:int,x:{kind}>", far, lambda p: F.when(p["x"]["weak"] == 0, p["x"]["start"]).otherwise(far), F.least)
    clear = F.filter(both, lambda q: (q["x"]["x"]["weak"] == 1) & (q["x"]["before"] <= q["x"]["x"]["start"]) & (q["before"] >= q["x"]["x"]["end"]))
    return F.transform(clear, lambda q: F.struct(q["x"]["x"]["start"].alias("start"), q["x"]["x"]["rank"].alias("rank"), q["x"]["x"]["end"].alias("end")))


def parts_of(text: Column) -> dict[str, Column]:
    """Spans of each sort in a text that isn't null. Runs of `HEX` of any length are found by the same start as those of the least length."""
    low = F.lower(text)
    named = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    long_run = text.rlike(r"(?<![0-9a-f])[0-9a-f]{24}")
    ids = text.rlike(r"(?:AKIA|ASIA|AROA|AIDA)")
    # a greedy run of fewer characters than the least is dropped and holds no other, so the least length can stand in the pattern
    return {
        "assign": _spans(text, ASSIGN, "assign", ASSIGN_LEAST, 2, named),
        "access": _spans(text, r"AKIA[A-Z0-9]{16,}", "access", ACCESS_LEAST, 0, ids),
        "hex": _spans(text, r"[0-9a-f]{24,}", "hex", HEX_LEAST, 0, long_run),
        "ids": _spans(text, WEAK_ID, "id", 0, 0, ids),
        "keys": _spans(text, WEAK_KEY, "key", 0, 0, text.rlike(LONG_RUN)),
        "endpoints": _spans(text, ENDPOINT, "endpoint", 0, 0, text.contains("://")),
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, base and weak spans of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rid = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.hex(F.xxhash64("text")))
    return rows.select("doc_id", rid.alias("rid"), *[c.alias(name) for name, c in parts_of(F.col("text")).items()])


def link(found: DataFrame, reach: int = 256) -> DataFrame:
    """(rid, added) of the weak parts with their counterparts in reach; parts that a base span covers only serve as evidence."""
    role = lambda name, arr, add: F.transform(arr, lambda s: F.struct(F.lit(name).alias("role"), s.alias("span"), F.lit(add).alias("add")))
    of = lambda free, kind: F.filter(free, lambda s: s["rank"] == F.lit(KINDS.index(kind)))
    # parts that a base span covers are evidence for others, and base spans themselves as well
    evidence = F.concat(role("id", F.concat("ids", "access"), False), role("key", F.concat("keys", "assign", "hex"), False))
    free = _free(F.concat("ids", "keys", "endpoints"), F.concat("assign", "access", "hex"))
    parts = F.concat(evidence, _let(free, lambda f: F.concat(*[role(kind, of(f, kind), True) for kind in ("id", "key", "endpoint")])))
    weak = (F.size("ids") + F.size("keys") + F.size("endpoints")) > 0
    found = found.where(weak).dropDuplicates(["rid"])
    rows = found.select("rid", F.explode(parts).alias("p")).select("rid", "p.role", "p.span", "p.add", F.floor(F.col("p.span.start") / reach).alias("bucket"))
    edge = lambda name, f: f(F.when(F.col("role") == name, F.col("span.start")))
    scopes = rows.where("role != 'endpoint'").groupBy("rid", "bucket").agg(edge("id", F.min).alias("id0"), edge("id", F.max).alias("id1"), edge("key", F.min).alias("key0"), edge("key", F.max).alias("key1"))
    asked = rows.where("add").select("rid", "role", "span", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket"))
    at = F.col("span.start")
    near = lambda name: F.max(F.coalesce((F.abs(F.col(f"{name}0") - at) <= reach) | (F.abs(F.col(f"{name}1") - at) <= reach), F.lit(False)))
    met = asked.join(scopes, ["rid", "bucket"]).groupBy("rid", "role", "span").agg(near("id").alias("id_near"), near("key").alias("key_near"))
    kept = met.where(F.when(F.col("role") == "id", F.col("key_near")).when(F.col("role") == "key", F.col("id_near")).otherwise(F.col("id_near") & F.col("key_near")))
    return kept.groupBy("rid").agg(F.collect_list("span").alias("added"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 256) -> DataFrame:
    """doc_id, rid, n_assign, n_access, n_hex, base and spans: arrays of (start, rank, end) in order; rank is a place in `KINDS`."""
    found = materialize(scan(docs, id_col, text_col), "secrets")
    rows = found.join(link(found, reach), "rid", "left")
    none = F.array().cast(f"array<{SPAN}>")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return rows.select("doc_id", "rid", count("assign"), count("access"), count("hex"), base.alias("base"), F.array_sort(F.concat(base, F.coalesce("added", none))).alias("spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """The text with `mark` in place of its spans, of overlapping ones together."""

    def clean(spans: Column) -> Column:
        # what stays: from the furthest end of all spans before to the start of a span that begins there or later
        reached = _before(spans, SPAN, 0, lambda s: s["end"], F.greatest)
        gaps = F.transform(F.filter(reached, lambda p: p["x"]["start"] >= p["before"]), lambda p: F.struct(p["before"].alias("from"), p["x"]["start"].alias("to")))
        # a substring is counted from the start of its text, so the text is first cut into as many parts as there are pieces
        cut = F.transform(_let(gaps, _chunks), lambda c: F.struct(c.alias("gaps"), c[0]["from"].alias("at"), F.substring(text, c[0]["from"] + 1, F.element_at(c, -1)["to"] - c[0]["from"]).alias("part")))
        joined = F.transform(cut, lambda c: F.array_join(F.transform(c["gaps"], lambda g: F.concat(F.substring(c["part"], g["from"] - c["at"] + 1, g["to"] - g["from"]), F.lit(mark))), ""))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(joined, ""), F.substring(text, end + 1, F.length(text)))

    return _let(spans, lambda s: F.when(F.size(s) > 0, clean(s)).otherwise(text))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret span of the text replaced by `mark`; other texts and columns stay as they are.

    Without an identifier and a bare secret nothing can be linked: such texts are redacted where they lie, by their
    base spans. Only the others are joined with the spans that were found in them.
    """
    text = F.col(text_col)
    full = F.coalesce(text, F.lit(""))
    parts = parts_of(full)
    linked = full.rlike(r"(?:AKIA|ASIA|AROA|AIDA)") | full.rlike(LONG_RUN)
    plain = docs.where(~linked).withColumn(text_col, blanked(text, F.array_sort(F.concat(parts["assign"], parts["hex"])), mark))
    some = docs.where(linked)
    hits = find_secrets(some, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["rid"]).select("rid", "spans")
    rid = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.hex(F.xxhash64(full)))
    met = some.select(as_row(some), rid.alias("rid")).join(hits, "rid", "left")
    was = F.col("row").getField(text_col)
    now = F.when(F.col("spans").isNotNull(), blanked(was, F.col("spans"), mark)).otherwise(was)
    return plain.unionByName(met.select(*[(now if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
