"""The document mart: best pages, readiness, search, finders, lookups, pages of results, upserts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query

MAX_PAGE_SIZE = 100


def best_variant(variants: DataFrame) -> DataFrame:
    """WIN-01: the non-empty representation of the least priority number of each page."""
    w = Window.partitionBy("doc", "page").orderBy("priority", "representation")
    return variants.where("content != ''").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def first_path(variants: DataFrame) -> DataFrame:
    """WIN-20: the representation whose path comes first, even if its content is blank."""
    return variants.groupBy("doc", "page").agg(F.min_by("representation", "priority").alias("representation"), F.min_by("content", "priority").alias("content"))


def index(spark, sf_dir: str) -> DataFrame:
    """JOI-01: a row for each contract with what is known of it."""
    c, k, p, n = B.contracts(spark, sf_dir), B.classification(spark, sf_dir), B.parties(spark, sf_dir), B.notes(spark, sf_dir)
    flagged = n.where("page_notes").select("doc").distinct().withColumn("has_page_notes", F.lit(True))
    j = c.join(p, "doc", "left").join(k, "doc", "left").join(n.drop("page_notes"), "doc", "left").join(flagged, "doc", "left")
    return j.withColumn("has_page_notes", F.coalesce("has_page_notes", F.lit(False)))


INDEX = "SELECT c.*, buyer, seller, category, stage, role, change_kind, confidence, governing, change, coalesce(page_notes, false) AS has_page_notes FROM contracts c LEFT JOIN parties USING (doc) LEFT JOIN classification USING (doc) LEFT JOIN notes USING (doc)"
NEED = "contracts parties classification notes"


def matches(term: str, *cols: str) -> Column:
    """FLT-01: any of the columns holds the term, without regard to case."""
    found = F.lit(False)
    for c in cols:
        found = found | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return found


def is_in(c: Column, values: Iterable) -> Column:
    """FLT-05: no value at all holds for no row."""
    values = list(values)
    return c.isin(values) if values else F.lit(False)


def stage_rank(c: Column) -> Column:
    out = F.lit(6)
    for i, s in enumerate(("sourcing", "award", "contracting", "active_change", "compliance")):
        out = F.when(c == s, i + 1).otherwise(out)
    return out


def role_rank(c: Column) -> Column:
    return F.when(c == "operative", 1).when(c == "delta", 2).when(F.coalesce(c, F.lit("context")) == "context", 3).otherwise(4)


def order(mode: str) -> list[Column]:
    """WIN-13: sort keys of the index; an unknown mode sorts by name."""
    stage, role, name = stage_rank(F.col("stage")), role_rank(F.col("role")), F.lower("filename")
    head = {"page_count": [F.desc("page_count"), stage, role, name], "seller": [F.lower(F.coalesce("seller", F.lit(""))), stage, role, name], "buyer": [F.lower(F.coalesce("buyer", F.lit(""))), stage, role, name]}
    return [*head.get(mode, [name, stage, role]), F.col("doc")]


def result_page(rows: DataFrame, keys: list[Column], page: int, size: int) -> DataFrame:
    """PAG-01: one page of a sorted result; page and size are held in their ranges."""
    page, size = max(1, page), min(MAX_PAGE_SIZE, max(1, size))
    return rows.orderBy(*keys).offset((page - 1) * size).limit(size)


def anti_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-02: rows of the source replace those of the target with their keys; others stay."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def delete_scope(target: DataFrame, keys: DataFrame, on: list[str], where: Column | None = None) -> DataFrame:
    """SNK-09: without the rows whose keys are given and for which the condition holds."""
    t, k = target.alias("t"), keys.select(*[F.col(c).alias(f"_key_{c}") for c in on]).distinct()
    hit = F.lit(True) if where is None else where
    for c in on:
        hit = hit & (F.col(f"t.{c}") == F.col(f"_key_{c}"))
    return t.join(k, hit, "left_anti")


@query("WIN-01", B.with_views("best", "SELECT doc, page, representation, priority, length(content) AS chars, md5(content) AS digest FROM best"))
def win01(spark, sf_dir):
    return best_variant(B.variants(spark, sf_dir)).select("doc", "page", "representation", "priority", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query("WIN-20", B.with_views("variants", "SELECT doc, page, arg_min(representation, priority) AS representation, length(arg_min(content, priority)) AS chars FROM variants GROUP BY doc, page"))
def win20(spark, sf_dir):
    return first_path(B.variants(spark, sf_dir)).select("doc", "page", "representation", F.length("content").alias("chars"))


@query("PRJ-01", B.with_views("contracts", "SELECT * FROM contracts WHERE doc = 42"))
def prj01(spark, sf_dir):
    return B.contracts(spark, sf_dir).where("doc = 42")


@query("PRJ-02", B.with_views("best", "SELECT doc, page, representation, length(content) AS chars FROM best WHERE doc = 42 AND page IN (1, 3)"))
def prj02(spark, sf_dir):
    v = B.variants(spark, sf_dir).where("doc = 42").where(is_in(F.col("page"), [1, 3]))
    return best_variant(v).select("doc", "page", "representation", F.length("content").alias("chars")).orderBy("page")


@query("PRJ-03", B.with_views("variants", "SELECT doc, page, priority, representation, length(content) AS chars, row_number() OVER (PARTITION BY doc ORDER BY page, priority, representation) AS place FROM variants"))
def prj03(spark, sf_dir):
    w = Window.partitionBy("doc").orderBy("page", "priority", "representation")
    return B.variants(spark, sf_dir).select("doc", "page", "priority", "representation", F.length("content").alias("chars"), F.row_number().over(w).cast("long").alias("place"))


@query("PRJ-05", B.with_views(NEED + " pages", f"SELECT i.*, list_aggregate(list_sort(list(p.page)), 'string_agg', ',') AS pages_text FROM ({INDEX}) i LEFT JOIN pages p ON i.doc = p.doc GROUP BY ALL"))
def prj05(spark, sf_dir):
    p = B.pages(spark, sf_dir).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.col("page").cast("string"))), ",").alias("pages_text"))
    return index(spark, sf_dir).join(p, "doc", "left")


@query("PRJ-15", B.with_views(NEED, f"""SELECT doc, trim(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '[_-]+', ' ', 'g')) AS title, coalesce(nullif(trim(change), ''), nullif(trim(governing), ''), nullif(trim(category), ''), '') AS overview FROM ({INDEX})"""))
def prj15(spark, sf_dir):
    return index(spark, sf_dir).select("doc", T.humanize_filename(F.col("filename")).alias("title"), T.first_text(F.col("change"), F.col("governing"), F.col("category")).alias("overview"))


@query("PRJ-17", B.with_views("notes", "SELECT doc, CASE WHEN governing IS NOT NULL THEN 'governing' WHEN change IS NOT NULL THEN 'change' END AS kind, coalesce(governing, change) AS answer FROM notes"))
def prj17(spark, sf_dir):
    return B.notes(spark, sf_dir).select("doc", F.when(F.col("governing").isNotNull(), "governing").when(F.col("change").isNotNull(), "change").alias("kind"), F.coalesce("governing", "change").alias("answer"))


@query("PRJ-19", B.with_views("best variants notes", """SELECT b.doc, b.page, b.representation, r.reps || CASE WHEN n.page_notes THEN ',page_notes' ELSE '' END AS representations FROM best b
  JOIN (SELECT doc, page, string_agg(DISTINCT representation, ',' ORDER BY representation) AS reps FROM variants GROUP BY doc, page) r ON b.doc = r.doc AND b.page = r.page LEFT JOIN notes n ON b.doc = n.doc"""))
def prj19(spark, sf_dir):
    v = B.variants(spark, sf_dir)
    reps = v.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_set("representation")), ",").alias("reps"))
    j = best_variant(v).select("doc", "page", "representation").join(reps, ["doc", "page"]).join(B.notes(spark, sf_dir).select("doc", "page_notes"), "doc", "left")
    return j.select("doc", "page", "representation", F.concat("reps", F.when(F.col("page_notes"), ",page_notes").otherwise("")).alias("representations"))


@query("FLT-01", B.with_views(NEED, f"SELECT doc, filename FROM ({INDEX}) WHERE contains(lower(filename), 'r 1') OR contains(lower(buyer), 'r 1') OR contains(lower(seller), 'r 1') OR contains(lower(category), 'r 1') OR contains(lower(governing), 'r 1') OR contains(lower(change), 'r 1')"))
def flt01(spark, sf_dir):
    return index(spark, sf_dir).where(matches("R 1", "filename", "buyer", "seller", "category", "governing", "change")).select("doc", "filename")


@query("FLT-02", B.with_views(NEED, f"SELECT doc, filename, stage, buyer FROM ({INDEX}) WHERE stage IN ('active_change', 'contracting') AND seller IN ('seller 3', 'seller 5', 'seller 8') ORDER BY filename, doc LIMIT 25"))
def flt02(spark, sf_dir):
    return index(spark, sf_dir).where("stage in ('active_change', 'contracting') and seller in ('seller 3', 'seller 5', 'seller 8')").select("doc", "filename", "stage", "buyer").orderBy("filename", "doc").limit(25)


@query("FLT-03", B.with_views(NEED, "SELECT doc, filename, buyer, governing FROM contracts JOIN classification USING (doc) LEFT JOIN parties USING (doc) LEFT JOIN notes USING (doc) WHERE stage = 'contracting' AND role = 'operative'"))
def flt03(spark, sf_dir):
    k = B.classification(spark, sf_dir).where("stage = 'contracting' and role = 'operative'")
    return B.contracts(spark, sf_dir).join(k, "doc").join(B.parties(spark, sf_dir), "doc", "left").join(B.notes(spark, sf_dir), "doc", "left").select("doc", "filename", "buyer", "governing")


@query("FLT-04", B.with_views(NEED, "SELECT doc, filename, change_kind, change FROM contracts JOIN classification USING (doc) LEFT JOIN notes USING (doc) WHERE stage = 'active_change' AND role = 'delta' AND change_kind = 'amendment'"))
def flt04(spark, sf_dir):
    k = B.classification(spark, sf_dir).where("stage = 'active_change' and role = 'delta' and change_kind = 'amendment'")
    return B.contracts(spark, sf_dir).join(k, "doc").join(B.notes(spark, sf_dir), "doc", "left").select("doc", "filename", "change_kind", "change")


@query("FLT-25", B.with_views("classification", "SELECT doc, stage = 'contracting' AND role = 'operative' AS needs_governing, stage = 'active_change' AND role = 'delta' AS needs_change FROM classification"))
def flt25(spark, sf_dir):
    return B.classification(spark, sf_dir).selectExpr("doc", "stage = 'contracting' and role = 'operative' as needs_governing", "stage = 'active_change' and role = 'delta' as needs_change")


@query("FLT-21", B.with_views("classification notes", "SELECT doc FROM classification WHERE stage = 'active_change' AND role = 'delta' AND doc NOT IN (SELECT doc FROM notes WHERE change IS NOT NULL)"))
def flt21(spark, sf_dir):
    done = B.notes(spark, sf_dir).where("change is not null").select("doc")
    return B.classification(spark, sf_dir).where("stage = 'active_change' and role = 'delta'").join(done, "doc", "left_anti").select("doc")


@query("FLT-22", B.with_views("classification notes", "SELECT doc FROM classification WHERE stage = 'contracting' AND role = 'operative' AND doc NOT IN (SELECT doc FROM notes WHERE governing IS NOT NULL)"))
def flt22(spark, sf_dir):
    done = B.notes(spark, sf_dir).where("governing is not null").select("doc")
    return B.classification(spark, sf_dir).where("stage = 'contracting' and role = 'operative'").join(done, "doc", "left_anti").select("doc")


@query("FLT-23", B.with_views("contracts classification", "SELECT doc FROM contracts WHERE doc NOT IN (SELECT doc FROM classification)"))
def flt23(spark, sf_dir):
    return B.contracts(spark, sf_dir).join(B.classification(spark, sf_dir), "doc", "left_anti").select("doc")


@query("JOI-01", B.with_views(NEED, INDEX))
def joi01(spark, sf_dir):
    return index(spark, sf_dir)


@query("JOI-02", B.with_views(NEED, "SELECT doc, filename, stage, buyer, governing FROM contracts JOIN classification USING (doc) LEFT JOIN parties USING (doc) LEFT JOIN notes USING (doc)"))
def joi02(spark, sf_dir):
    return B.contracts(spark, sf_dir).join(B.classification(spark, sf_dir), "doc").join(B.parties(spark, sf_dir), "doc", "left").join(B.notes(spark, sf_dir), "doc", "left").select("doc", "filename", "stage", "buyer", "governing")


@query("JOI-03", B.with_views(NEED, "SELECT doc, filename, stage, seller, change FROM contracts JOIN classification USING (doc) LEFT JOIN parties USING (doc) LEFT JOIN notes USING (doc)"))
def joi03(spark, sf_dir):
    return B.contracts(spark, sf_dir).join(B.classification(spark, sf_dir), "doc").join(B.parties(spark, sf_dir), "doc", "left").join(B.notes(spark, sf_dir), "doc", "left").select("doc", "filename", "stage", "seller", "change")


READY = """SELECT doc, blockers, blockers[1] AS blocker FROM (SELECT doc, list_filter([CASE WHEN doc %% 29 = 7 THEN 'normalize_document' END, CASE WHEN doc %% 29 <> 7 AND buyer IS NULL AND seller IS NULL THEN 'procurement_context' END,
  CASE WHEN doc %% 29 <> 7 AND stage IS NULL THEN 'classification' END, CASE WHEN stage = 'contracting' AND role = 'operative' AND governing IS NULL THEN 'governing_domain_notes' END,
  CASE WHEN stage = 'active_change' AND role = 'delta' AND change IS NULL THEN 'change_extraction' END], lambda x: x IS NOT NULL) AS blockers FROM (%s))""" % INDEX


def readiness(spark, sf_dir: str) -> DataFrame:
    """JOI-04, WIN-17: all stages that a contract still waits for, in order, and the first of them, null if it waits for none.

    Every 29th contract isn't normalised yet; what needs its text isn't asked for before.
    """
    normal = F.col("doc") % 29 != 7
    routed = lambda stage, role: (F.col("stage") == stage) & (F.col("role") == role)
    blockers = F.array_compact(
        F.array(
            F.when(~normal, "normalize_document"),
            F.when(normal & F.col("buyer").isNull() & F.col("seller").isNull(), "procurement_context"),
            F.when(normal & F.col("stage").isNull(), "classification"),
            F.when(routed("contracting", "operative") & F.col("governing").isNull(), "governing_domain_notes"),
            F.when(routed("active_change", "delta") & F.col("change").isNull(), "change_extraction"),
        )
    )
    return index(spark, sf_dir).select("doc", blockers.alias("blockers")).withColumn("blocker", F.get("blockers", F.lit(0)))


@query("JOI-04", B.with_views(NEED, f"SELECT doc, array_to_string(blockers, ',') AS blockers, blocker FROM ({READY})"))
def joi04(spark, sf_dir):
    return readiness(spark, sf_dir).withColumn("blockers", F.array_join("blockers", ","))


@query("WIN-17", B.with_views(NEED, f"SELECT doc, coalesce('missing_' || blocker, 'ready_for_loader') AS state FROM ({READY})"))
def win17(spark, sf_dir):
    return readiness(spark, sf_dir).select("doc", F.coalesce(F.concat(F.lit("missing_"), F.col("blocker")), F.lit("ready_for_loader")).alias("state"))


@query("AGG-14", B.with_views(NEED, f"SELECT coalesce('missing_' || blocker, 'ready_for_loader') AS state, count(*) AS n FROM ({READY}) GROUP BY ALL"))
def agg14(spark, sf_dir):
    return win17(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("AGG-15", B.with_views("classification notes", """SELECT CAST(count_if(stage = 'contracting') AS BIGINT) AS required, CAST(count_if(stage = 'contracting' AND governing IS NOT NULL) AS BIGINT) AS done, CAST(count_if(stage = 'contracting' AND governing IS NULL) AS BIGINT) AS remaining FROM classification LEFT JOIN notes USING (doc)"""))
def agg15(spark, sf_dir):
    need, ready = F.col("stage") == "contracting", F.col("governing").isNotNull()
    return B.classification(spark, sf_dir).join(B.notes(spark, sf_dir), "doc", "left").agg(F.count_if(need).alias("required"), F.count_if(need & ready).alias("done"), F.count_if(need & ~ready).alias("remaining"))


STAGE_SQL = "CASE coalesce(stage, '') WHEN 'sourcing' THEN 1 WHEN 'award' THEN 2 WHEN 'contracting' THEN 3 WHEN 'active_change' THEN 4 WHEN 'compliance' THEN 5 ELSE 6 END"
ROLE_SQL = "CASE coalesce(role, 'context') WHEN 'operative' THEN 1 WHEN 'delta' THEN 2 WHEN 'context' THEN 3 ELSE 4 END"


@query("WIN-13", B.with_views(NEED, f"SELECT doc, filename, buyer FROM ({INDEX}) ORDER BY lower(coalesce(buyer, '')), {STAGE_SQL}, {ROLE_SQL}, lower(filename), doc LIMIT 40"))
def win13(spark, sf_dir):
    return index(spark, sf_dir).orderBy(*order("buyer")).limit(40).select("doc", "filename", "buyer")


@query("PAG-01", B.with_views(NEED, f"SELECT doc, filename, page_count FROM ({INDEX}) ORDER BY page_count DESC, {STAGE_SQL}, {ROLE_SQL}, lower(filename), doc LIMIT 20 OFFSET 40"))
def pag01(spark, sf_dir):
    return result_page(index(spark, sf_dir), order("page_count"), 3, 20).select("doc", "filename", "page_count")


@query("PAG-02", B.with_views("contracts", "SELECT doc, filename FROM contracts ORDER BY lower(filename), doc LIMIT 100 OFFSET 100"))
def pag02(spark, sf_dir):
    return B.contracts(spark, sf_dir).select("doc", "filename").orderBy(F.lower("filename"), "doc").offset(100).limit(100)


@query("PAG-07", B.with_views("pages", "SELECT doc, page, place, total FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc ORDER BY page) AS place, count(*) OVER (PARTITION BY doc) AS total FROM pages) WHERE place BETWEEN 2 AND 3"))
def pag07(spark, sf_dir):
    w = Window.partitionBy("doc")
    p = B.pages(spark, sf_dir).select("doc", "page", F.row_number().over(w.orderBy("page")).cast("long").alias("place"), F.count("*").over(w).alias("total"))
    return p.where("place between 2 and 3")


@query("PAG-08", B.with_views("pages", "SELECT doc, page, (page - 1) // 2 + 1 AS window_number FROM pages"))
def pag08(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc", "page", (F.floor((F.col("page") - 1) / 2) + 1).alias("window_number"))


@query("AGG-01", B.with_views("contracts", "SELECT count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM contracts"))
def agg01(spark, sf_dir):
    return B.contracts(spark, sf_dir).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("AGG-03", B.with_views("contracts pages variants classification parties", "SELECT 'contracts' AS relation, count(*) AS n FROM contracts UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'variants', count(*) FROM variants UNION ALL SELECT 'classification', count(*) FROM classification UNION ALL SELECT 'parties', count(*) FROM parties"))
def agg03(spark, sf_dir):
    out = None
    for name in ("contracts", "pages", "variants", "classification", "parties"):
        one = getattr(B, name)(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("AGG-04", B.with_views("contracts", "SELECT count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages, round_even(sum(size_bytes) / 1048576, 2) AS megabytes FROM contracts"))
def agg04(spark, sf_dir):
    return B.contracts(spark, sf_dir).agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.bround(F.sum("size_bytes") / 1048576, 2).alias("megabytes"))


@query("AGG-05", B.with_views("notes", "SELECT DISTINCT doc FROM notes WHERE page_notes"))
def agg05(spark, sf_dir):
    return B.notes(spark, sf_dir).where("page_notes").select("doc").distinct()


def reconcile(expected: DataFrame, loaded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """JOI-10: a full outer join of what should be there and what is; only keys that differ."""
    e, w = expected.select(*keys, F.col(value).alias("e")).withColumn("in_e", F.lit(True)), loaded.select(*keys, F.col(value).alias("w")).withColumn("in_w", F.lit(True))
    issue = F.when(F.col("in_w").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(~F.col("e").eqNullSafe(F.col("w")), "mismatched")
    return e.join(w, keys, "full_outer").withColumn("issue", issue).where("issue is not null").select(*keys, "issue")


def _loaded(v: DataFrame) -> DataFrame:
    """What the audit finds: some rows and documents lost, some altered, some added."""
    kept = v.where("(doc + page) % 9 != 0 and doc % 19 != 4").withColumn("content", F.when(F.col("doc") % 13 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return kept.unionByName(v.where("doc % 17 = 0 and priority = 5").withColumn("representation", F.lit("extra")))


AUDIT = {
    "loaded": "SELECT doc, page, representation, CASE WHEN doc % 13 = 0 THEN content || '!' ELSE content END AS content FROM variants WHERE (doc + page) % 9 <> 0 AND doc % 19 <> 4 UNION ALL SELECT doc, page, 'extra', content FROM variants WHERE doc % 17 = 0 AND priority = 5",
    "diff": """SELECT coalesce(e.doc, w.doc) AS doc, coalesce(e.page, w.page) AS page, coalesce(e.representation, w.representation) AS representation,
      CASE WHEN w.doc IS NULL THEN 'missing' WHEN e.doc IS NULL THEN 'unexpected' WHEN e.content IS DISTINCT FROM w.content THEN 'mismatched' END AS issue
      FROM variants e FULL JOIN loaded w ON e.doc = w.doc AND e.page = w.page AND e.representation = w.representation""",
}


def audit(spark, sf_dir: str) -> DataFrame:
    v = B.variants(spark, sf_dir)
    return reconcile(v, _loaded(v), ["doc", "page", "representation"], "content")


@query("JOI-10", B.with_views("variants", "SELECT * FROM diff WHERE issue IS NOT NULL", **AUDIT))
def joi10(spark, sf_dir):
    return audit(spark, sf_dir)


@query("JOI-12", B.with_views("variants", "SELECT DISTINCT doc FROM variants WHERE doc NOT IN (SELECT doc FROM loaded)", **AUDIT))
def joi12(spark, sf_dir):
    v = B.variants(spark, sf_dir)
    return v.select("doc").distinct().join(_loaded(v).select("doc"), "doc", "left_anti")


@query("AGG-30", B.with_views("variants", "SELECT count(DISTINCT v.doc) AS audited, count(DISTINCT v.doc) - count(DISTINCT d.doc) AS ok, (SELECT count(*) FROM diff WHERE issue IS NOT NULL) AS issues FROM variants v LEFT JOIN (SELECT DISTINCT doc FROM diff WHERE issue IS NOT NULL) d ON v.doc = d.doc", **AUDIT))
def agg30(spark, sf_dir):
    issues = audit(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"))
    docs = B.variants(spark, sf_dir).select("doc").distinct().join(issues, "doc", "left")
    return docs.agg(F.count("*").alias("audited"), F.count_if(F.col("n").isNull()).alias("ok"), F.coalesce(F.sum("n"), F.lit(0)).alias("issues"))


@query("SNK-02", B.with_views("contracts", "SELECT doc, filename, page_count FROM contracts WHERE doc % 5 <> 0 UNION ALL SELECT doc, 'new_' || filename, page_count + 1 FROM contracts WHERE doc % 5 = 0"))
def snk02(spark, sf_dir):
    c = B.contracts(spark, sf_dir).select("doc", "filename", "page_count")
    fresh = c.where("doc % 5 = 0").select("doc", F.concat(F.lit("new_"), "filename").alias("filename"), (F.col("page_count") + 1).alias("page_count"))
    return anti_upsert(c, fresh, ["doc"])


@query("SNK-03", B.with_views("variants", "SELECT doc, page, representation, priority, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length(content) / 4, 0) AS BIGINT)) END AS estimated_tokens FROM variants WHERE content <> ''"))
def snk03(spark, sf_dir):
    return B.variants(spark, sf_dir).where("content != ''").select("doc", "page", "representation", "priority", T.mart_tokens(F.col("content")).alias("estimated_tokens"))


@query("SNK-04", B.with_views("purchases", "SELECT line, CASE gate WHEN 'yes' THEN true WHEN 'no' THEN false END AS related FROM purchases"))
def snk04(spark, sf_dir):
    return B.purchases(spark, sf_dir).select("line", F.when(F.col("gate") == "yes", True).when(F.col("gate") == "no", False).alias("related"))


@query("SNK-09", B.with_views("variants", "SELECT doc, page, representation FROM variants WHERE NOT (doc % 3 = 0 AND representation = 'text')"))
def snk09(spark, sf_dir):
    v = B.variants(spark, sf_dir).select("doc", "page", "representation")
    return delete_scope(v, v.where("doc % 3 = 0"), ["doc"], F.col("representation") == "text")


@query("SNK-11", B.with_views(NEED, f"SELECT CAST(doc AS VARCHAR) AS doc, filename, coalesce(buyer, '') AS buyer, coalesce(seller, '') AS seller, coalesce(stage, '') AS stage FROM ({INDEX})"))
def snk11(spark, sf_dir):
    return index(spark, sf_dir).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc", "filename", "buyer", "seller", "stage")])


@query("COE-09", B.with_views("notes", "SELECT doc, 'identity' AS domain, 0 AS ordinal, governing AS answer FROM notes WHERE governing IS NOT NULL UNION ALL SELECT doc, 'change', 0, change FROM notes WHERE change IS NOT NULL"))
def coe09(spark, sf_dir):
    lists = F.array(F.struct(F.lit("identity").alias("domain"), F.array_compact(F.array("governing")).alias("answers")), F.struct(F.lit("change").alias("domain"), F.array_compact(F.array("change")).alias("answers")))
    n = B.notes(spark, sf_dir).select("doc", F.explode(lists).alias("d"))
    return n.select("doc", "d.domain", F.posexplode("d.answers").alias("ordinal", "answer"))


@query("COE-11", B.with_views("variants", "SELECT representation, priority, count(*) AS n, CAST(count_if(content = '') AS BIGINT) AS blank FROM variants GROUP BY ALL"))
def coe11(spark, sf_dir):
    return B.variants(spark, sf_dir).groupBy("representation", "priority").agg(F.count("*").alias("n"), F.count_if(F.col("content") == "").alias("blank"))


@query("COE-02", B.with_views("contracts classification", "SELECT doc, coalesce(stage, 'unclear') AS stage, coalesce(role, 'context') AS role, CASE WHEN stage = 'active_change' OR role = 'delta' THEN coalesce(change_kind, 'amendment') END AS change_kind FROM contracts LEFT JOIN classification USING (doc)"))
def coe02(spark, sf_dir):
    j = B.contracts(spark, sf_dir).join(B.classification(spark, sf_dir), "doc", "left")
    kind = F.when((F.col("stage") == "active_change") | (F.col("role") == "delta"), F.coalesce("change_kind", F.lit("amendment")))
    return j.select("doc", F.coalesce("stage", F.lit("unclear")).alias("stage"), F.coalesce("role", F.lit("context")).alias("role"), kind.alias("change_kind"))


# fixed values: how legacy types map to a stage and a role
LEGACY = {
    "agreement": ("contracting", "operative"),
    "task_order_or_sow": ("contracting", "operative"),
    "renewal": ("active_change", "delta"),
    "amendment": ("active_change", "delta"),
    "quote_or_pricing_sheet": ("sourcing", "context"),
    "bid_or_proposal": ("sourcing", "context"),
    "disclosure_or_compliance": ("compliance", "context"),
    "exhibit_or_schedule": ("unclear", "context"),
    "other": ("unclear", "context"),
}


def legacy_stage(c: Column) -> Column:
    """COE-01: struct(stage, role) of a legacy type; null if it isn't known."""
    out = F.lit(None).cast("struct<stage:string,role:string>")
    for name, (stage, role) in LEGACY.items():
        out = F.when(F.lower(F.trim(c)) == name, F.struct(F.lit(stage).alias("stage"), F.lit(role).alias("role"))).otherwise(out)
    return out


@query("COE-01", B.with_views("purchases", """SELECT kind, CASE kind WHEN 'agreement' THEN 'contracting' WHEN 'renewal' THEN 'active_change' WHEN 'bid_or_proposal' THEN 'sourcing' END AS stage,
  CASE kind WHEN 'agreement' THEN 'operative' WHEN 'renewal' THEN 'delta' WHEN 'bid_or_proposal' THEN 'context' END AS role, count(*) AS n
  FROM (SELECT CASE gate WHEN 'yes' THEN 'agreement' WHEN 'no' THEN 'renewal' ELSE CASE WHEN line % 2 = 0 THEN 'bid_or_proposal' ELSE 'unknown' END END AS kind FROM purchases) GROUP BY ALL"""))
def coe01(spark, sf_dir):
    kind = F.when(F.col("gate") == "yes", "agreement").when(F.col("gate") == "no", "renewal").when(F.col("line") % 2 == 0, "bid_or_proposal").otherwise("unknown")
    p = B.purchases(spark, sf_dir).select(kind.alias("kind")).withColumn("to", legacy_stage(F.col("kind")))
    return p.groupBy("kind", F.col("to.stage").alias("stage"), F.col("to.role").alias("role")).agg(F.count("*").alias("n"))
