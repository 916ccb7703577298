"""Notes of contracts: coercion of payloads, loading with citations, records, details and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .mart import LEGACY, delete_scope, index, legacy_stage

# Domains of governing notes, their fields, and the label of each answer.
FIELDS = (
    ("identity", "what_this_document_is", "What this document is"),
    ("identity", "how_it_identifies_itself", "How it identifies itself"),
    ("identity", "linked_documents_or_materials", "Linked documents or materials"),
    ("parties", "who_the_main_parties_are", "Who the main parties are"),
    ("parties", "how_their_roles_are_described", "How their roles are described"),
    ("parties", "other_material_entities", "Other material entities"),
    ("subject", "what_is_being_bought_or_governed", "What is being bought or governed"),
    ("subject", "what_scope_or_deliverables_are_described", "What scope or deliverables are described"),
    ("term", "when_it_takes_effect_and_how_long_it_runs", "When it takes effect and how long it runs"),
    ("term", "how_renewal_or_extension_works", "How renewal or extension works"),
    ("economics", "how_pricing_works", "How pricing works"),
    ("economics", "what_total_fee_or_cap_language_is_explicit", "What total fee or cap language is explicit"),
    ("economics", "how_payment_is_described", "How payment is described"),
    ("controls", "how_termination_or_exit_works", "How termination or exit works"),
    ("controls", "what_insurance_or_risk_requirements_apply", "What insurance or risk requirements apply"),
    ("controls", "what_performance_or_compliance_obligations_matter", "What performance or compliance obligations matter"),
    ("quality", "important_caveats_or_ambiguities", "Important caveats or ambiguities"),
)
DOMAINS = ("identity", "parties", "subject", "term", "economics", "controls")
GOVERNING, CHANGE = "governing_domain_notes", "change_extraction"
#: Documents of the batch that is loaded; the others keep what they have.
BATCH = "doc % 5 <> 0"


# ---- payloads, made up from ids: answers that are missing, blank or padded, and lists of citations

def _some(n: Column, make) -> Column:
    """`n` made entries, by their place from 0."""
    return F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")), lambda j: j < n), make)


def _cited(doc: Column, i: int, name: str) -> Column:
    return _some((doc + i) % 3, lambda j: F.struct(((doc + i + j) % 9 + 1).alias("page"), F.concat_ws(".", F.lit(name), doc.cast("string"), F.lit(str(i)), j.cast("string")).alias("snippet")))


def governing_payloads(spark, sf_dir: str) -> DataFrame:
    """doc, fields: array of (i, domain, key, label, answer, citations)."""
    doc = F.col("doc")
    answer = lambda i: F.when((doc + i) % 4 == 1, "  ").when((doc + i) % 4 != 0, F.concat(F.lit(f"  Answer {i} of "), doc.cast("string"), F.lit(" ")))
    one = lambda i, d, k, label: F.struct(F.lit(i).alias("i"), F.lit(d).alias("domain"), F.lit(k).alias("key"), F.lit(label).alias("label"), answer(i).alias("answer"), _cited(doc, i, "g").alias("citations"))
    return B.notes(spark, sf_dir).where("governing is not null").select("doc", F.array(*[one(i, *f) for i, f in enumerate(FIELDS)]).alias("fields"))


def change_payloads(spark, sf_dir: str) -> DataFrame:
    """doc, change, dimensions, warnings, confidence, sections (domain, citations), clauses (label, summary, citations)."""
    doc = F.col("doc")
    sections = F.array(*[F.struct(F.lit(d).alias("domain"), _cited(doc, i, "c").alias("citations")) for i, d in enumerate(("target_artifact", "change", "resulting_state", "overall"))])
    word = lambda j: F.element_at(F.array(*[F.lit(x) for x in (" notice", "price", "control ", "", "price", "governance")]), (((doc + j) % 6) + 1).cast("int"))
    blank = lambda j, v: F.when((doc + j) % 5 == 0, " ").otherwise(v)
    clause = lambda j: F.struct(blank(j, F.concat(F.lit(" Clause  "), j.cast("string"))).alias("label"), F.concat(F.lit("Sum "), doc.cast("string"), F.lit(" "), j.cast("string")).alias("summary"), _some((doc + j) % 3, lambda n: F.struct((n + 1).alias("page"), F.concat_ws(".", F.lit("k"), j.cast("string"), n.cast("string")).alias("snippet"))).alias("citations"))
    warnings = _some(doc % 4, lambda j: F.when(j == 1, "  ").otherwise(F.concat(F.lit(" w  "), j.cast("string"))))
    return B.notes(spark, sf_dir).where("change is not null").select("doc", F.when(doc % 7 != 0, F.concat(F.lit(" target  "), doc.cast("string"))).alias("target"), F.when(doc % 11 != 0, F.col("change")).alias("change"), _some(doc % 5, word).alias("dimensions"), warnings.alias("warnings"), ((doc % 20 + 81) / 100).alias("confidence"), sections.alias("sections"), _some(doc % 8, clause).alias("clauses"))


_G = "SELECT doc, i, domain, key, label, CASE (doc + i) % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE '  Answer ' || i || ' of ' || doc || ' ' END AS answer FROM notes, (VALUES " + ", ".join(f"({i}, '{d}', '{k}', '{label}')" for i, (d, k, label) in enumerate(FIELDS)) + ") f(i, domain, key, label) WHERE governing IS NOT NULL"
_GC = f"SELECT doc, '{GOVERNING}' AS stage, domain || '.' || key AS domain, (doc + i + j) % 9 + 1 AS page, 'g.' || doc || '.' || i || '.' || j AS snippet, NULL AS clause_label, j AS ordinal FROM g, range(2) r(j) WHERE j < (doc + i) % 3"
_CLAUSES = """SELECT doc, raw, row_number() OVER (PARTITION BY doc ORDER BY raw) - 1 AS ordinal, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label, 'Sum ' || doc || ' ' || raw AS summary
  FROM (SELECT doc, j AS raw, CASE WHEN (doc + j) % 5 = 0 THEN ' ' ELSE ' Clause  ' || j END AS label FROM notes, range(5) r(j) WHERE change IS NOT NULL AND j < doc % 8) WHERE trim(label) <> ''"""
_CC = f"""SELECT doc, '{CHANGE}' AS stage, domain, (doc + i + j) % 9 + 1 AS page, 'c.' || doc || '.' || i || '.' || j AS snippet, NULL AS clause_label, j AS ordinal FROM notes, (VALUES (0, 'target_artifact'), (1, 'change'), (2, 'resulting_state'), (3, 'overall')) f(i, domain), range(2) r(j) WHERE change IS NOT NULL AND j < (doc + i) % 3
  UNION ALL SELECT doc, '{CHANGE}', 'key_clause', n + 1, 'k.' || raw || '.' || n, label, ordinal * 100 + n FROM clauses, range(2) r(n) WHERE n < (doc + raw) % 3"""
_OLD = f"SELECT doc, s.stage, 'old' AS domain, 1 AS page, 'old' AS snippet, NULL AS clause_label, 0 AS ordinal FROM notes, (VALUES ('{GOVERNING}'), ('{CHANGE}')) s(stage)"
VIEWS = {"g": _G, "gc": _GC, "clauses": _CLAUSES, "cc": _CC, "old": _OLD}


def with_notes(select: str, names: str = "notes") -> str:
    return B.with_views(names, select, **VIEWS)


# ---- coercion

# Change dimensions that go by another name, and signs of a cooperative buyer.
DIMENSION_ALIASES = {"notice": "control", "governance": "control", "administrative": "control"}
COOPERATIVE = ("sourcewell", "cooperative purchasing", "national cooperative", "piggyback")
# What legacy lifecycles and types say of stage, role and kind of change.
LIFECYCLE = {
    "base": ("contracting", "operative", None),
    "modifies_prior": ("active_change", "delta", "amendment"),
    "extends_term": ("active_change", "delta", "renewal"),
    "updates_pricing": ("active_change", "delta", "pricing_update"),
    "supporting_only": ("unclear", "context", None),
    "unclear": ("unclear", "context", None),
}
TYPE_CHANGE = {"renewal": "renewal", "amendment": "amendment", "quote_or_pricing_sheet": "pricing_update"}
CLASSIFICATION_COLUMNS = ("doc", "source_filename", "procurement_stage", "primary_document_role", "change_kind", "confidence", "evidence_pages", "rationale", "warnings", "evidence", "status")


def _by_name(c: Column, table: dict[str, str | None]) -> Column:
    out, name = F.lit(None).cast("string"), F.lower(F.trim(c))
    for k, v in table.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def coerce_classification(raw: DataFrame) -> DataFrame:
    """COE-05: legacy fields mapped, stage and role filled in, kinds only of changes, page numbers sorted and distinct; eleven columns stay.

    `raw` has procurement_stage, primary_document_role, change_kind, document_role, document_type, lifecycle_role,
    attached_document_types, evidence_pages, and those of the result, all as far as they are given.
    """
    known = legacy_stage(F.col("document_type"))
    role = F.coalesce("primary_document_role", "document_role")
    lacks = F.col("procurement_stage").isNull() | role.isNull()
    by_type = lacks & known.isNotNull()
    by_life = lacks & ~by_type
    life_stage, life_role = (_by_name(F.col("lifecycle_role"), {k: v[n] for k, v in LIFECYCLE.items()}) for n in (0, 1))
    stage = F.when(by_type, known["stage"]).when(by_life & life_stage.isNotNull(), life_stage).otherwise(F.col("procurement_stage"))
    role = F.when(by_type, known["role"]).when(by_life & life_role.isNotNull(), life_role).otherwise(role)
    kind = F.coalesce("change_kind", _by_name(F.col("document_type"), TYPE_CHANGE), _by_name(F.col("lifecycle_role"), {k: v[2] for k, v in LIFECYCLE.items()}))
    full = raw.withColumns({"procurement_stage": F.coalesce(stage, F.lit("unclear")), "primary_document_role": F.coalesce(role, F.lit("context")), "kind": kind})
    changes = (F.col("procurement_stage") == "active_change") & (F.col("primary_document_role") == "delta")
    warned = F.coalesce("warnings", F.array().cast("array<string>"))
    mixed = F.coalesce(F.size("attached_document_types") > 0, F.lit(False)) & ~F.array_contains(warned, "mixed_bundle")
    return full.withColumns({"change_kind": F.when(changes, F.coalesce("kind", F.lit("amendment"))), "evidence_pages": F.array_sort(F.array_distinct("evidence_pages")), "warnings": F.when(mixed, F.array_append(warned, "mixed_bundle")).otherwise(warned), "status": F.coalesce("status", F.lit("completed"))}).select(*CLASSIFICATION_COLUMNS)


def raw_classifications(spark, sf_dir: str) -> DataFrame:
    """Orders as raw answers in every mixture of new and legacy fields."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda x, names: F.element_at(F.array(*map(F.lit, names)), (x % len(names) + 1).cast("int"))
    return B.read(spark, sf_dir, "orders").select(
        k.alias("doc"), F.concat(F.lit("o"), k.cast("string")).alias("source_filename"), F.when(k % 3 == 0, pick(c, ["contracting", "active_change"])).alias("procurement_stage"), F.when(k % 4 == 0, pick(c, ["operative", "delta", "context"])).alias("primary_document_role"),
        F.when(k % 5 == 0, "pricing_update").alias("change_kind"), F.when(k % 7 == 0, "delta").alias("document_role"), F.when(c % 3 != 0, pick(k + c, [*LEGACY, " Renewal ", "nothing"])).alias("document_type"), F.when(c % 5 != 0, pick(k, [*LIFECYCLE])).alias("lifecycle_role"),
        F.when(k % 6 == 0, F.array(F.lit("exhibit"))).alias("attached_document_types"), (k % 10 / 10).alias("confidence"), F.array(k % 5, c % 4, k % 5).alias("evidence_pages"), F.lit("").alias("rationale"), F.when(k % 12 == 0, F.array(F.lit("mixed_bundle"))).when(k % 2 == 0, F.array(F.lit("w"))).alias("warnings"), F.array().cast("array<string>").alias("evidence"), F.lit(None).cast("string").alias("status"),
    )


def _sql_pick(x: str, names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][{x} % {len(names)} + 1]"


def _sql_map(c: str, table: dict[str, str | None]) -> str:
    return f"CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items() if v) + " END"


RAW = f"""SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN {_sql_pick('o_custkey', ['contracting', 'active_change'])} END AS s, CASE WHEN o_orderkey % 4 = 0 THEN {_sql_pick('o_custkey', ['operative', 'delta', 'context'])} WHEN o_orderkey % 7 = 0 THEN 'delta' END AS r,
  CASE WHEN o_orderkey % 5 = 0 THEN 'pricing_update' END AS ck, CASE WHEN o_custkey % 3 <> 0 THEN {_sql_pick('(o_orderkey + o_custkey)', [*LEGACY, ' Renewal ', 'nothing'])} END AS t, CASE WHEN o_custkey % 5 <> 0 THEN {_sql_pick('o_orderkey', [*LIFECYCLE])} END AS l, o_custkey AS c FROM orders"""
COERCED = f"""SELECT doc, coalesce(s3, 'unclear') AS procurement_stage, coalesce(r3, 'context') AS primary_document_role, CASE WHEN s3 = 'active_change' AND r3 = 'delta' THEN coalesce(ck, {_sql_map('t', TYPE_CHANGE)}, {_sql_map('l', {k: v[2] for k, v in LIFECYCLE.items()})}, 'amendment') END AS change_kind,
  array_to_string(list_sort(list_distinct([doc % 5, c % 4])), ',') AS pages, CASE WHEN doc % 12 = 0 THEN 'mixed_bundle' WHEN doc % 6 = 0 THEN 'w,mixed_bundle' WHEN doc % 2 = 0 THEN 'w' ELSE '' END AS warnings, 'completed' AS status
  FROM (SELECT *, CASE WHEN lacks AND ts IS NOT NULL THEN ts WHEN lacks AND ls IS NOT NULL THEN ls ELSE s END AS s3, CASE WHEN lacks AND ts IS NOT NULL THEN tr WHEN lacks AND ls IS NOT NULL THEN lr ELSE r END AS r3
    FROM (SELECT *, s IS NULL OR r IS NULL AS lacks, {_sql_map('t', {k: v[0] for k, v in LEGACY.items()})} AS ts, {_sql_map('t', {k: v[1] for k, v in LEGACY.items()})} AS tr, {_sql_map('l', {k: v[0] for k, v in LIFECYCLE.items()})} AS ls, {_sql_map('l', {k: v[1] for k, v in LIFECYCLE.items()})} AS lr FROM ({RAW})))"""


@query("COE-05", COERCED)
def coe05(spark, sf_dir):
    c = coerce_classification(raw_classifications(spark, sf_dir))
    return c.select("doc", "procurement_stage", "primary_document_role", "change_kind", F.array_join(F.transform("evidence_pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join("warnings", ",").alias("warnings"), "status")


@query("SNK-05", f"SELECT doc, procurement_stage AS stage, primary_document_role AS role FROM ({COERCED}) WHERE doc % 3 <> 0 UNION ALL SELECT o_orderkey, 'old', 'old' FROM orders WHERE o_orderkey % 3 = 0")
def snk05(spark, sf_dir):
    """The loaded batch replaces the rows of its documents."""
    new = coerce_classification(raw_classifications(spark, sf_dir).where("doc % 3 != 0")).select("doc", F.col("procurement_stage").alias("stage"), F.col("primary_document_role").alias("role"))
    old = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("old").alias("stage"), F.lit("old").alias("role"))
    return delete_scope(old, new, ["doc"]).select("doc", "stage", "role").unionByName(new)


def coerce_change(raw: DataFrame) -> DataFrame:
    """COE-06: texts collapsed, dimensions by their common names, the first five clauses as far as they have label and summary, confidence capped.

    A dimension that was seen is left out before it is renamed, so two names of one dimension can both stay.
    """
    named = lambda d: F.coalesce(_by_name(d, DIMENSION_ALIASES), d)
    empty = F.array().cast("array<string>")
    fold = lambda acc, d: F.when(d.isNull() | F.array_contains(acc, d), acc).otherwise(F.array_append(acc, named(d)))
    dimensions = F.aggregate(F.transform("dimensions", T.clean), empty, fold)
    tidy = F.transform(F.slice("clauses", 1, 5), lambda c: F.struct(T.clean(c["label"]).alias("label"), T.clean(c["summary"]).alias("summary"), c["citations"].alias("citations")))
    warnings = F.filter(F.transform("warnings", T.clean), lambda w: w.isNotNull())
    full = raw.withColumns({"target": T.clean(F.col("target")), "change": T.clean(F.col("change")), "dimensions": dimensions, "clauses": F.filter(tidy, lambda c: c["label"].isNotNull() & c["summary"].isNotNull()), "warnings": warnings})
    cap = lambda cond, most: F.when(cond, F.lit(most)).otherwise(F.lit(1e9))
    capped = F.least("confidence", cap(F.size("warnings") >= 1, 0.94), cap(F.size("warnings") >= 2, 0.90), cap(F.col("target").isNull(), 0.90), cap(F.col("change").isNull(), 0.88))
    return full.withColumn("confidence", F.bround(capped, 2))


_WORD = "[' notice', 'price', 'control ', '', 'price', 'governance']"
CHANGED = f"""SELECT doc, trim(regexp_replace(target, '\\s+', ' ', 'g')) AS target, change, round_even(least((doc % 20 + 81) / 100, CASE WHEN w >= 1 THEN 0.94 ELSE 9 END, CASE WHEN w >= 2 OR target IS NULL THEN 0.90 ELSE 9 END, CASE WHEN change IS NULL THEN 0.88 ELSE 9 END), 2) AS confidence, w AS warnings
  FROM (SELECT doc, CASE WHEN doc % 7 <> 0 THEN ' target  ' || doc END AS target, CASE WHEN doc % 11 <> 0 THEN change END AS change, doc % 4 - CASE WHEN doc % 4 > 1 THEN 1 ELSE 0 END AS w FROM notes WHERE change IS NOT NULL)"""


@query("COE-06", with_notes(f"""SELECT c.doc, target, change, confidence, warnings, coalesce(d.dimensions, '') AS dimensions, coalesce(k.clauses, '') AS clauses FROM ({CHANGED}) c
  LEFT JOIN (SELECT doc, string_agg(CASE WHEN d IN ('notice', 'governance') THEN 'control' ELSE d END, ',' ORDER BY j) AS dimensions FROM (SELECT doc, j, d, min(j) OVER (PARTITION BY doc, d) AS first, min(CASE WHEN d IN ('notice', 'governance') THEN j END) OVER (PARTITION BY doc) AS renamed
    FROM (SELECT doc, j, trim({_WORD}[(doc + j) % 6 + 1]) AS d FROM notes, range(4) r(j) WHERE change IS NOT NULL AND j < doc % 5) WHERE d <> '') WHERE CASE WHEN d IN ('notice', 'governance') THEN true WHEN d = 'control' THEN j = first AND (renamed IS NULL OR renamed > j) ELSE j = first END GROUP BY doc) d ON c.doc = d.doc
  LEFT JOIN (SELECT doc, string_agg(label || ':' || summary, ',' ORDER BY ordinal) AS clauses FROM clauses GROUP BY doc) k ON c.doc = k.doc"""))
def coe06(spark, sf_dir):
    c = coerce_change(change_payloads(spark, sf_dir))
    return c.select("doc", "target", "change", "confidence", F.size("warnings").alias("warnings"), F.array_join("dimensions", ",").alias("dimensions"), F.array_join(F.transform("clauses", lambda x: F.concat_ws(":", x["label"], x["summary"])), ",").alias("clauses"))


def coerce_procurement(raw: DataFrame) -> DataFrame:
    """COE-07: no parties where nothing is bought, no cooperative as the buyer, warnings and evidence once each, confidence capped."""
    bought = ~F.coalesce(F.col("is_procurement_doc") == "no", F.lit(False))
    rows = raw.withColumns({c: F.when(bought, F.col(c)) for c in ("buyer", "seller", "subject", "category")})
    joint = F.lit(False)
    for sign in COOPERATIVE:
        joint = joint | F.coalesce(F.lower("buyer").contains(sign), F.lit(False))
    warned = F.coalesce("warnings", F.array().cast("array<string>"))
    rows = rows.withColumns({"warnings": F.array_distinct(F.when(joint, F.array_append(warned, "cooperative_vehicle_present_buyer_not_explicit")).otherwise(warned)), "buyer": F.when(~joint, F.col("buyer")), "evidence": F.array_distinct("evidence")})
    blank = lambda c: F.coalesce(T.strip(F.col(c)), F.lit("")) == ""
    cap = lambda cond, most: F.when(cond, F.lit(most)).otherwise(F.lit(1e9))
    yes = F.col("is_procurement_doc") == "yes"
    caps = [cap(F.col("is_procurement_doc") == "unclear", 0.75), cap(yes & blank("buyer"), 0.86), cap(yes & blank("seller"), 0.88), cap(yes & blank("subject"), 0.84), cap(yes & F.col("category").isNull(), 0.86), cap(F.size("warnings") >= 2, 0.88), cap(F.size("warnings") >= 4, 0.80)]
    return rows.withColumn("confidence", F.bround(F.least("confidence", *caps), 4))


@query("COE-07", """SELECT doc, buyer, seller, array_to_string(warnings, ',') AS warnings, evidence, round_even(least((doc % 13 + 88) / 100, CASE WHEN gate = 'unclear' THEN 0.75 ELSE 9 END, CASE WHEN gate = 'yes' AND coalesce(trim(buyer), '') = '' THEN 0.86 ELSE 9 END, CASE WHEN gate = 'yes' AND coalesce(trim(seller), '') = '' THEN 0.88 ELSE 9 END,
    CASE WHEN gate = 'yes' AND subject IS NULL THEN 0.84 ELSE 9 END, CASE WHEN len(warnings) >= 2 THEN 0.88 ELSE 9 END, CASE WHEN len(warnings) >= 4 THEN 0.8 ELSE 9 END), 4) AS confidence
  FROM (SELECT doc, gate, CASE WHEN gate <> 'no' AND NOT joint THEN b END AS buyer, CASE WHEN gate <> 'no' THEN s END AS seller, CASE WHEN gate <> 'no' AND doc % 6 <> 0 THEN 'subject' END AS subject, evidence,
      list_concat(list_slice(['w0', 'w1', 'w2'], 1, doc % 4), CASE WHEN gate <> 'no' AND joint THEN ['cooperative_vehicle_present_buyer_not_explicit'] ELSE [] END) AS warnings
    FROM (SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'unclear' END AS gate, o_orderkey % 9 = 0 AND o_orderkey % 5 <> 0 AS joint, CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 9 = 0 THEN 'The SourceWell group' ELSE 'Buyer ' || o_custkey END AS b,
      CASE WHEN o_orderkey % 8 <> 0 THEN 'Seller' END AS s, 1 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS evidence FROM orders))""")
def coe07(spark, sf_dir):
    k = F.col("o_orderkey")
    gate = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("unclear")
    buyer = F.when(k % 5 == 0, " ").when(k % 9 == 0, "The SourceWell group").otherwise(F.concat(F.lit("Buyer "), F.col("o_custkey").cast("string")))
    words = F.flatten(_some(k % 4, lambda j: F.array_repeat(F.concat(F.lit("w"), j.cast("string")), 2)))
    proof = lambda label: F.struct(label.alias("label"), F.lit("s").alias("snippet"), F.lit(1).alias("page"))
    raw = B.read(spark, sf_dir, "orders").select(k.alias("doc"), gate.alias("is_procurement_doc"), buyer.alias("buyer"), F.when(k % 8 != 0, "Seller").alias("seller"), F.when(k % 6 != 0, "subject").alias("subject"), F.lit("c").alias("category"), words.alias("warnings"), F.array(proof(F.lit("0")), proof(F.lit("0")), proof(F.when(k % 3 == 0, "0").otherwise("1"))).alias("evidence"), ((k % 13 + 88) / 100).alias("confidence"))
    return coerce_procurement(raw).select("doc", "buyer", "seller", F.array_join("warnings", ",").alias("warnings"), F.size("evidence").alias("evidence"), "confidence")


# ---- loading

CITATION = ("doc", "stage", "domain", "page", "snippet", "clause_label", "ordinal")


def governing_citations(payloads: DataFrame) -> DataFrame:
    f = payloads.select("doc", F.explode("fields").alias("f")).select("doc", "f.domain", "f.key", F.posexplode("f.citations").alias("ordinal", "c"))
    return f.select("doc", F.lit(GOVERNING).alias("stage"), F.concat_ws(".", "domain", "key").alias("domain"), "c.page", "c.snippet", F.lit(None).cast("string").alias("clause_label"), "ordinal")


def change_citations(payloads: DataFrame) -> DataFrame:
    """Citations of the sections, and of the clauses with the clause's place in hundreds."""
    s = payloads.select("doc", F.explode("sections").alias("s")).select("doc", "s.domain", F.posexplode("s.citations").alias("ordinal", "c"))
    s = s.select("doc", F.lit(CHANGE).alias("stage"), "domain", "c.page", "c.snippet", F.lit(None).cast("string").alias("clause_label"), "ordinal")
    k = payloads.select("doc", F.posexplode("clauses").alias("place", "k")).select("doc", "place", "k.label", F.posexplode("k.citations").alias("n", "c"))
    return s.unionByName(k.select("doc", F.lit(CHANGE).alias("stage"), F.lit("key_clause").alias("domain"), "c.page", "c.snippet", F.col("label").alias("clause_label"), (F.col("place") * 100 + F.col("n")).alias("ordinal")))


def load_citations(old: DataFrame, batch: DataFrame, new: DataFrame, stage: str) -> DataFrame:
    """What the table holds after a load: citations of that stage of the batch's documents are replaced, all others stay."""
    return delete_scope(old, batch, ["doc"], F.col("stage") == stage).select(*CITATION).unionByName(new)


def _old_citations(spark, sf_dir: str) -> DataFrame:
    n = B.notes(spark, sf_dir).select("doc", F.explode(F.array(F.lit(GOVERNING), F.lit(CHANGE))).alias("stage"))
    return n.select("doc", "stage", F.lit("old").alias("domain"), F.lit(1).cast("long").alias("page"), F.lit("old").alias("snippet"), F.lit(None).cast("string").alias("clause_label"), F.lit(0).alias("ordinal"))


def governing_records(payloads: DataFrame) -> DataFrame:
    """doc and an answer for each domain: its labelled answers, blank ones left out; null if none is left."""
    said = lambda d: F.transform(F.filter("fields", lambda f: (f["domain"] == d) & (F.coalesce(T.strip(f["answer"]), F.lit("")) != "")), lambda f: F.concat_ws(": ", f["label"], T.strip(f["answer"])))
    return payloads.select("doc", *[F.nullif(F.array_join(said(d), "\n"), F.lit("")).alias(f"{d}_answer") for d in DOMAINS])


@query("SNK-06", with_notes(f"SELECT * FROM old WHERE NOT ({BATCH} AND stage = '{GOVERNING}') UNION ALL SELECT * FROM gc WHERE {BATCH}"))
def snk06(spark, sf_dir):
    batch = B.notes(spark, sf_dir).where(BATCH)
    return load_citations(_old_citations(spark, sf_dir), batch, governing_citations(governing_payloads(spark, sf_dir).where(BATCH)), GOVERNING)


@query("SNK-06-notes", with_notes("SELECT doc, " + ", ".join(f"string_agg(label || ': ' || trim(answer), chr(10) ORDER BY i) FILTER (domain = '{d}' AND trim(answer) <> '') AS {d}_answer" for d in DOMAINS) + " FROM g GROUP BY doc"))
def snk06_notes(spark, sf_dir):
    return governing_records(governing_payloads(spark, sf_dir))


@query("SNK-07", with_notes(f"SELECT * FROM old WHERE NOT ({BATCH} AND stage = '{CHANGE}') UNION ALL SELECT * FROM cc WHERE {BATCH}"))
def snk07(spark, sf_dir):
    batch = B.notes(spark, sf_dir).where(BATCH)
    return load_citations(_old_citations(spark, sf_dir), batch, change_citations(coerce_change(change_payloads(spark, sf_dir).where(BATCH))), CHANGE)


def clause_rows(payloads: DataFrame) -> DataFrame:
    return payloads.select("doc", F.posexplode("clauses").alias("ordinal", "k")).select("doc", "k.label", "k.summary", "ordinal")


@query("SNK-07-clauses", with_notes("SELECT doc, label, summary, ordinal FROM clauses"))
def snk07_clauses(spark, sf_dir):
    return clause_rows(coerce_change(change_payloads(spark, sf_dir)))


PAGE_NOTES = "SELECT doc, page, CASE page % 3 WHEN 0 THEN 'signature' WHEN 1 THEN 'terms' END AS role, 'Page ' || page || ' of ' || filename AS summary FROM pages"


def page_notes(spark, sf_dir: str) -> DataFrame:
    p = F.col("page")
    return B.pages(spark, sf_dir).select("doc", "page", F.when(p % 3 == 0, "signature").when(p % 3 == 1, "terms").alias("role"), F.concat(F.lit("Page "), p.cast("string"), F.lit(" of "), "filename").alias("summary"))


@query("SNK-08", B.with_views("pages", f"SELECT doc, page, 'old' AS role, 'old' AS summary FROM n WHERE NOT ({BATCH}) UNION ALL SELECT * FROM n WHERE {BATCH} AND doc % 7 <> 0", n=PAGE_NOTES))
def snk08(spark, sf_dir):
    """Documents of the batch without notes lose the rows that they had."""
    n = page_notes(spark, sf_dir)
    nested = n.where(f"{BATCH} and doc % 7 <> 0").groupBy("doc").agg(F.collect_list(F.struct("page", "role", "summary")).alias("notes"))
    old = n.select("doc", "page", F.lit("old").alias("role"), F.lit("old").alias("summary"))
    fresh = nested.select("doc", F.explode("notes").alias("n")).select("doc", "n.*")
    return delete_scope(old, n.where(BATCH), ["doc"]).select("doc", "page", "role", "summary").unionByName(fresh)


@query("SNK-10", with_notes(f"""SELECT 1 AS step, 'documents' AS target, count(*) AS n FROM contracts WHERE {BATCH} UNION ALL SELECT 2, 'document_page_variants', count(*) FROM variants WHERE {BATCH} UNION ALL SELECT 3, 'procurement_context', count(*) FROM parties WHERE {BATCH} UNION ALL SELECT 4, 'classification', count(*) FROM classification WHERE {BATCH}
  UNION ALL SELECT 5, 'governing_notes', count(DISTINCT doc) FROM g WHERE {BATCH} UNION ALL SELECT 6, 'change_notes', count(*) FROM notes WHERE change IS NOT NULL AND {BATCH} UNION ALL SELECT 7, 'page_notes', count(*) FROM pages WHERE {BATCH} AND doc % 7 <> 0""", "notes contracts variants parties classification pages"))
def snk10(spark, sf_dir):
    """The steps of a whole load in their order, and how many rows each writes for the batch."""
    steps = {"documents": B.contracts, "document_page_variants": B.variants, "procurement_context": B.parties, "classification": B.classification, "governing_notes": governing_payloads, "change_notes": change_payloads, "page_notes": lambda s, d: page_notes(s, d).where("doc % 7 <> 0")}
    out = None
    for i, (name, rows) in enumerate(steps.items()):
        one = rows(spark, sf_dir).where(BATCH).agg(F.count("*").alias("n")).select(F.lit(i + 1).alias("step"), F.lit(name).alias("target"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- records

def _cited_list(citations: DataFrame) -> DataFrame:
    return citations.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("domain", "ordinal", "page", "snippet"))).alias("citations"))


def _shown(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["domain"], x["ordinal"].cast("string"), x["page"].cast("string"), x["snippet"])), ",")


_AGG = "string_agg(domain || ':' || ordinal || ':' || page || ':' || snippet, ',' ORDER BY domain, ordinal, page)"


@query("PRJ-06", with_notes(f"SELECT a.doc, identity_answer, controls_answer, coalesce(c.citations, '') AS citations FROM (SELECT doc, " + ", ".join(f"string_agg(label || ': ' || trim(answer), chr(10) ORDER BY i) FILTER (domain = '{d}' AND trim(answer) <> '') AS {d}_answer" for d in ("identity", "controls")) + f" FROM g GROUP BY doc) a LEFT JOIN (SELECT doc, {_AGG} AS citations FROM gc GROUP BY doc) c ON a.doc = c.doc"))
def prj06(spark, sf_dir):
    p = governing_payloads(spark, sf_dir)
    r = governing_records(p).join(_cited_list(governing_citations(p)), "doc", "left")
    return r.select("doc", "identity_answer", "controls_answer", F.coalesce(_shown(F.col("citations")), F.lit("")).alias("citations"))


@query("PRJ-07", with_notes(f"SELECT n.doc, confidence, coalesce(k.clauses, 0) AS clauses, coalesce(k.labels, '') AS labels, coalesce(c.citations, '') AS citations FROM ({CHANGED}) n LEFT JOIN (SELECT doc, count(*) AS clauses, string_agg(label, ',' ORDER BY ordinal) AS labels FROM clauses GROUP BY doc) k ON n.doc = k.doc LEFT JOIN (SELECT doc, {_AGG} AS citations FROM cc GROUP BY doc) c ON n.doc = c.doc"))
def prj07(spark, sf_dir):
    """Clauses and citations are gathered apart and joined by document: joined raw they would multiply."""
    p = coerce_change(change_payloads(spark, sf_dir))
    k = clause_rows(p).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "summary"))).alias("k"))
    r = p.select("doc", "confidence").join(k, "doc", "left").join(_cited_list(change_citations(p)), "doc", "left")
    return r.select("doc", "confidence", F.coalesce(F.size("k"), F.lit(0)).alias("clauses"), F.coalesce(F.array_join(F.col("k.label"), ","), F.lit("")).alias("labels"), F.coalesce(_shown(F.col("citations")), F.lit("")).alias("citations"))


def of_domain(citations: Column, domain: str) -> Column:
    """PRJ-18: citations of a domain or of a field of it."""
    return F.filter(citations, lambda c: (c["domain"] == domain) | c["domain"].startswith(domain + "."))


@query("PRJ-18", with_notes(f"SELECT doc, {_AGG} AS citations FROM (SELECT * FROM gc UNION ALL SELECT doc, stage, domain, page, snippet, clause_label, ordinal FROM cc) WHERE domain = 'term' OR starts_with(domain, 'term.') OR domain = 'change' GROUP BY doc"))
def prj18(spark, sf_dir):
    c = _cited_list(governing_citations(governing_payloads(spark, sf_dir)).unionByName(change_citations(coerce_change(change_payloads(spark, sf_dir)))))
    both = F.array_sort(F.concat(of_domain(F.col("citations"), "term"), of_domain(F.col("citations"), "change")))
    return c.select("doc", _shown(both).alias("citations")).where("citations != ''")


@query("PRJ-08", B.with_views("contracts flagged", "SELECT c.doc, filename, page_count, CASE WHEN c.doc % 5 <> 0 THEN c.doc % 2 = 1 END AS has_text_layer, array_to_string(from_json(CASE WHEN c.doc % 7 = 0 THEN '[]' ELSE CAST(to_json(f.flags) AS VARCHAR) END, '[\"VARCHAR\"]'), ',') AS quality_flags FROM contracts c JOIN (SELECT doc, arg_min(flags, page) AS flags FROM flagged GROUP BY doc) f ON c.doc = f.doc"))
def prj08(spark, sf_dir):
    """JSON text to lists (none if it is no list), numbers to truth values, null kept."""
    doc = F.col("doc")
    f = B.flagged(spark, sf_dir).groupBy("doc").agg(F.min_by("flags", "page").alias("flags"))
    text = F.when(doc % 14 == 0, "{broken").when(doc % 7 != 0, F.to_json("flags"))
    stored = B.contracts(spark, sf_dir).join(f, "doc").select("doc", "filename", "page_count", F.when(doc % 5 != 0, doc % 2).alias("has_text_layer"), text.alias("quality_flags_json"))
    decoded = F.coalesce(F.from_json("quality_flags_json", "array<string>"), F.array().cast("array<string>"))
    return stored.select("doc", "filename", "page_count", F.col("has_text_layer").cast("boolean").alias("has_text_layer"), F.array_join(decoded, ",").alias("quality_flags"))


@query("PRJ-09", B.with_views("classification", "SELECT doc, stage, confidence, '' AS rationale, CASE WHEN doc % 3 = 0 THEN '' ELSE array_to_string(from_json('[' || doc % 5 || ', ' || doc % 9 || ']', '[\"BIGINT\"]'), ',') END AS evidence_pages FROM classification"))
def prj09(spark, sf_dir):
    doc = F.col("doc")
    stored = B.classification(spark, sf_dir).select("doc", "stage", "confidence", F.lit(None).cast("string").alias("rationale"), F.when(doc % 3 != 0, F.concat(F.lit("["), (doc % 5).cast("string"), F.lit(", "), (doc % 9).cast("string"), F.lit("]"))).alias("evidence_pages_json"))
    pages = F.coalesce(F.from_json("evidence_pages_json", "array<bigint>"), F.array().cast("array<bigint>"))
    return stored.select("doc", "stage", "confidence", F.coalesce("rationale", F.lit("")).alias("rationale"), F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("evidence_pages"))


def detail(spark, sf_dir: str) -> DataFrame:
    """PRJ-16: document, overview, procurement and classification of a contract as one nested row; what is not known is null."""
    i = index(spark, sf_dir)
    has = lambda *cols: F.coalesce(*[F.col(c).isNotNull() for c in cols]) if len(cols) == 1 else F.col(cols[0]).isNotNull() | F.col(cols[1]).isNotNull()
    return i.select(
        "doc",
        F.struct("filename", "page_count", T.humanize_filename(F.col("filename")).alias("title")).alias("document"),
        T.first_text(F.col("governing"), F.col("change"), F.col("category")).alias("overview"),
        F.when(has("buyer", "seller"), F.struct("buyer", "seller", "category")).alias("procurement_context"),
        F.when(has("stage"), F.struct("stage", "role", "change_kind", "confidence")).alias("classification"),
    )


_DETAIL = """SELECT doc, filename, page_count, trim(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '[_-]+', ' ', 'g')) AS title, coalesce(nullif(trim(governing), ''), nullif(trim(change), ''), nullif(trim(category), ''), '') AS overview,
  buyer IS NOT NULL OR seller IS NOT NULL AS bought, CASE WHEN buyer IS NOT NULL OR seller IS NOT NULL THEN category END AS category, stage, role, change_kind FROM (SELECT c.*, buyer, seller, category, stage, role, change_kind, governing, change FROM contracts c LEFT JOIN parties USING (doc) LEFT JOIN classification USING (doc) LEFT JOIN notes USING (doc))"""


def _flat(d: DataFrame) -> DataFrame:
    return d.select("doc", "document.*", "overview", F.col("procurement_context").isNotNull().alias("bought"), "procurement_context.category", "classification.stage", "classification.role", "classification.change_kind")


@query("PRJ-16", B.with_views("contracts parties classification notes", _DETAIL))
def prj16(spark, sf_dir):
    return _flat(detail(spark, sf_dir))


@query("PRJ-26", B.with_views("contracts parties classification notes", f"SELECT * FROM ({_DETAIL}) WHERE doc = 12"))
def prj26(spark, sf_dir):
    """The overview of one document; an id that isn't there gives no row."""
    return _flat(detail(spark, sf_dir).where("doc = 12"))


@query("PRJ-27", with_notes("SELECT doc, CASE WHEN governing IS NOT NULL THEN 'governing' WHEN change IS NOT NULL THEN 'change' ELSE 'none' END AS kind, coalesce(governing, change) AS answer, coalesce(n, 0) AS citations FROM notes LEFT JOIN (SELECT doc, count(*) AS n FROM (SELECT doc FROM gc UNION ALL SELECT doc FROM cc) GROUP BY doc) c USING (doc) WHERE doc BETWEEN 8 AND 24"))
def prj27(spark, sf_dir):
    """Notes of some documents, of whichever kind they have, with their number of citations."""
    some = "doc between 8 and 24"
    n = B.notes(spark, sf_dir).where(some).select("doc", F.when(F.col("governing").isNotNull(), "governing").when(F.col("change").isNotNull(), "change").otherwise("none").alias("kind"), F.coalesce("governing", "change").alias("answer"))
    c = governing_citations(governing_payloads(spark, sf_dir).where(some)).select("doc").unionAll(change_citations(coerce_change(change_payloads(spark, sf_dir).where(some))).select("doc"))
    return n.join(c.groupBy("doc").agg(F.count("*").alias("citations")), "doc", "left").na.fill(0, ["citations"])


@query("PRJ-28", B.with_views("pages", "SELECT page, role, summary FROM n WHERE doc = 12 ORDER BY page LIMIT 2 OFFSET 1", n=PAGE_NOTES))
def prj28(spark, sf_dir):
    """A slice of a document's page notes, by page."""
    return page_notes(spark, sf_dir).where("doc = 12").orderBy("page").offset(1).limit(2).select("page", "role", "summary")


@query("PRJ-29", B.with_views("best", "SELECT doc, page, representation, length(content) AS chars, md5(content) AS digest FROM best WHERE doc = 12 AND page = 2"))
def prj29(spark, sf_dir):
    """One page in its best representation."""
    from .mart import best_variant

    return best_variant(B.variants(spark, sf_dir).where("doc = 12 and page = 2")).select("doc", "page", "representation", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def status_columns(prefix: str, status: Column) -> list[Column]:
    """PRJ-23: a stage's status as columns that begin with its name; warnings as JSON text."""
    plain = [status[c].alias(f"{prefix}_{c}") for c in ("status", "updated_at", "version", "error")]
    return [*plain, F.to_json(status["warnings"]).alias(f"{prefix}_warnings_json")]


@query("PRJ-23", B.with_views("claims", "SELECT turn_id, " + ", ".join(f"CASE WHEN (turn_id + {i}) % 3 = 0 THEN 'failed' ELSE 'completed' END AS {p}_status, queued_at + {i} AS {p}_updated_at, 'v' || (turn_id % 4) AS {p}_version, CASE WHEN (turn_id + {i}) % 3 = 0 THEN 'broken' END AS {p}_error, CASE WHEN (turn_id + {i}) % 2 = 0 THEN '[\"{p}\",\"w ' || turn_id || '\"]' ELSE '[]' END AS {p}_warnings_json" for i, p in enumerate(("classification", "page_notes"))) + " FROM claims"))
def prj23(spark, sf_dir):
    k = F.col("turn_id")
    status = lambda i, p: F.struct(F.when((k + i) % 3 == 0, "failed").otherwise("completed").alias("status"), (F.col("queued_at") + i).alias("updated_at"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("version"), F.when((k + i) % 3 == 0, "broken").alias("error"), F.when((k + i) % 2 == 0, F.array(F.lit(p), F.concat(F.lit("w "), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    rows = B.claims(spark, sf_dir).select("turn_id", "queued_at", *[status(i, p).alias(p) for i, p in enumerate(("classification", "page_notes"))])
    return rows.select("turn_id", *status_columns("classification", F.col("classification")), *status_columns("page_notes", F.col("page_notes")))


def audit_page_notes(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """JOI-11: what differs between the notes that a document has and the loaded rows; one line for each page and difference."""
    e = expected.select("doc", "page", F.coalesce("role", F.lit("")).alias("e_role"), F.coalesce("summary", F.lit("")).alias("e_summary"), F.lit(True).alias("in_e"))
    w = loaded.select("doc", "page", F.coalesce("role", F.lit("")).alias("w_role"), F.coalesce("summary", F.lit("")).alias("w_summary"), F.lit(True).alias("in_w"))
    known = expected.select("doc").distinct().withColumn("known", F.lit(True))
    j = e.join(w, ["doc", "page"], "full_outer").join(known, "doc", "left")
    on = lambda text: F.concat(F.lit(text), F.col("page").cast("string"))
    both = F.col("in_e") & F.col("in_w")
    found = F.array_compact(F.array(F.when(F.col("in_w").isNull(), on("missing page_notes row for page ")), F.when(F.col("in_e").isNull() & F.col("known"), on("unexpected page_notes row for page ")), F.when(F.col("known").isNull(), "unexpected ci_page_notes rows"), F.when(both & (F.col("e_role") != F.col("w_role")), on("page_notes role mismatch on page ")), F.when(both & (F.col("e_summary") != F.col("w_summary")), on("page_notes summary mismatch on page "))))
    return j.select("doc", F.explode(found).alias("mismatch")).distinct()


@query("JOI-11", B.with_views("pages", """SELECT DISTINCT doc, unnest(list_filter([CASE WHEN w.doc IS NULL THEN 'missing page_notes row for page ' || page END, CASE WHEN e.doc IS NULL AND doc % 10 <> 9 THEN 'unexpected page_notes row for page ' || page END, CASE WHEN e.doc IS NULL AND doc % 10 = 9 THEN 'unexpected ci_page_notes rows' END,
    CASE WHEN w.doc IS NOT NULL AND e.doc IS NOT NULL AND coalesce(e.role, '') <> coalesce(w.role, '') THEN 'page_notes role mismatch on page ' || page END, CASE WHEN e.summary <> w.summary THEN 'page_notes summary mismatch on page ' || page END], lambda x: x IS NOT NULL)) AS mismatch FROM e FULL JOIN w USING (doc, page)""",
    n=PAGE_NOTES, e="SELECT * FROM n WHERE doc % 10 <> 9 AND (doc + page) % 8 <> 0", w="SELECT doc, page, CASE WHEN doc % 6 = 0 THEN 'terms' ELSE role END AS role, CASE WHEN doc % 13 = 0 THEN summary || '!' ELSE summary END AS summary FROM n WHERE (doc + page) % 7 <> 0"))
def joi11(spark, sf_dir):
    n = page_notes(spark, sf_dir)
    loaded = n.where("(doc + page) % 7 != 0").select("doc", "page", F.when(F.col("doc") % 6 == 0, "terms").otherwise(F.col("role")).alias("role"), F.when(F.col("doc") % 13 == 0, F.concat("summary", F.lit("!"))).otherwise(F.col("summary")).alias("summary"))
    return audit_page_notes(n.where("doc % 10 != 9 and (doc + page) % 8 != 0"), loaded)


def page_note_xml(n: DataFrame) -> DataFrame:
    """COE-12: doc, xml of all page notes (doc, filename, page, role, summary, warnings, terms, tags), by page; blank terms and tags left out."""
    full = lambda c: F.filter(c, lambda t: T.strip(t) != "")
    terms = F.array_join(F.transform(full("terms"), lambda t: F.concat(F.lit("        <term>"), T.cdata(t), F.lit("</term>"))), "\n")
    tags = F.array_join(F.transform(full("tags"), lambda t: F.concat(F.lit('        <tag value="'), T.xml_attribute(t), F.lit('" />'))), "\n")
    head = F.concat(F.lit('    <page_note number="'), F.col("page").cast("string"), F.lit('" role="'), T.xml_attribute(F.coalesce("role", F.lit("unclear"))), F.lit('">'))
    body = [head, F.concat(F.lit("      <summary>"), T.cdata(F.coalesce("summary", F.lit(""))), F.lit("</summary>")), F.concat(F.lit("      <warnings>"), T.xml_attribute(F.array_join("warnings", ",")), F.lit("</warnings>")), F.lit("      <key_terms>"), terms, F.lit("      </key_terms>"), F.lit("      <relevance_tags>"), tags, F.lit("      </relevance_tags>"), F.lit("    </page_note>")]
    blocks = n.select("doc", "filename", "page", F.concat_ws("\n", *body).alias("xml")).groupBy("doc").agg(F.min("filename").alias("filename"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "xml"))), lambda b: b["xml"]), "\n").alias("blocks"))
    lines = [F.concat(F.lit('<page_notes_document doc_id="'), F.col("doc").cast("string"), F.lit('">')), F.lit("  <metadata>"), F.concat(F.lit("    <source_filename>"), T.xml_attribute(F.col("filename")), F.lit("</source_filename>")), F.concat(F.lit("    <page_count>"), F.col("n").cast("string"), F.lit("</page_count>")), F.lit("  </metadata>"), F.lit("  <page_notes>"), F.col("blocks"), F.lit("  </page_notes>"), F.lit("</page_notes_document>")]
    return blocks.select("doc", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("xml"))


@query("COE-12", B.with_views("pages", """SELECT doc, '<page_notes_document doc_id="' || doc || '">' || chr(10) || '  <metadata>' || chr(10) || '    <source_filename>' || min(filename) || '</source_filename>' || chr(10) || '    <page_count>' || count(*) || '</page_count>' || chr(10) || '  </metadata>' || chr(10) || '  <page_notes>' || chr(10)
  || string_agg('    <page_note number="' || page || '" role="' || CASE page % 3 WHEN 0 THEN 'a&amp;b' WHEN 1 THEN 'terms' ELSE 'unclear' END || '">' || chr(10) || '      <summary><![CDATA[' || replace(coalesce(CASE WHEN doc % 4 <> 0 THEN 'S ]]> ' || page END, ''), ']]>', ']]]]><![CDATA[>') || ']]></summary>' || chr(10) || '      <warnings>' || CASE WHEN page % 2 = 0 THEN 'low &lt;1&gt;,dark' ELSE '' END || '</warnings>' || chr(10)
    || '      <key_terms>' || chr(10) || CASE WHEN doc % 3 = 0 THEN '' ELSE '        <term><![CDATA[term ' || doc || ']]></term>' END || chr(10) || '      </key_terms>' || chr(10) || '      <relevance_tags>' || chr(10) || '        <tag value="t' || page || '" />' || chr(10) || '        <tag value="u" />' || chr(10) || '      </relevance_tags>' || chr(10) || '    </page_note>', chr(10) ORDER BY page)
  || chr(10) || '  </page_notes>' || chr(10) || '</page_notes_document>' || chr(10) AS xml FROM pages GROUP BY doc"""))
def coe12(spark, sf_dir):
    p, d = F.col("page"), F.col("doc")
    n = B.pages(spark, sf_dir).select("doc", "filename", "page", F.when(p % 3 == 0, "a&b").when(p % 3 == 1, "terms").alias("role"), F.when(d % 4 != 0, F.concat(F.lit("S ]]> "), p.cast("string"))).alias("summary"), F.when(p % 2 == 0, F.array(F.lit("low <1>"), F.lit("dark"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.array(F.when(d % 3 == 0, " ").otherwise(F.concat(F.lit("term "), d.cast("string"))), F.lit("")).alias("terms"), F.array(F.concat(F.lit("t"), p.cast("string")), F.lit("u"), F.lit(" ")).alias("tags"))
    return page_note_xml(n)
