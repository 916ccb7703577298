"""Pages and their artifacts: routing rows, orientation, recomputed flags, audits, nested artifact lists, XML and text rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .mart import INDEX, NEED, READY, best_variant, first_path, index, readiness
from .pages import ROLLUP, ROUTED, routed


def _routed_rows(name: str, kind: str) -> None:
    @query(name, B.with_views("flagged", f"SELECT doc, page FROM ({ROUTED}) WHERE {kind}"))
    def rows(spark, sf_dir):
        return routed(spark, sf_dir).where(kind).select("doc", "page")


for _name, _kind in (("FLT-08", "markdown"), ("FLT-09", "repair"), ("FLT-10", "vision")):
    _routed_rows(_name, _kind)


def _routed_documents(name: str, kind: str) -> None:
    @query(name, B.with_views("flagged", f"SELECT DISTINCT doc FROM ({ROUTED}) WHERE {kind}"))
    def rows(spark, sf_dir):
        return routed(spark, sf_dir).where(kind).select("doc").distinct()


for _name, _kind in (("SIB-15", "ocr"), ("SIB-24", "vision")):
    _routed_documents(_name, _kind)


@query("FLT-11", B.with_views("flagged", "SELECT doc, page FROM flagged WHERE list_has_any(list_concat(flags, CASE WHEN doc_id % 7 = 0 THEN ['skip_llm_repair'] ELSE [] END), ['likely_blank_page', 'likely_low_information_page', 'skip_llm_repair'])"))
def flt11(spark, sf_dir):
    marked = F.when(F.col("doc_id") % 7 == 0, F.array_append("flags", "skip_llm_repair")).otherwise(F.col("flags"))
    return B.flagged(spark, sf_dir).where(G.any_of(marked, *G.SKIP)).select("doc", "page")


@query("FLT-15", B.with_views("contracts", "SELECT doc, 0 AS page, filename FROM contracts WHERE doc % 9 = 4"))
def flt15(spark, sf_dir):
    """Failed documents have no pages; each is listed once, as page 0."""
    return B.contracts(spark, sf_dir).where("doc % 9 = 4").select("doc", F.lit(0).alias("page"), "filename")


def tokens_of(best: DataFrame) -> DataFrame:
    return best.groupBy("doc").agg(F.sum(T.inventory_tokens(F.col("content"))).alias("tokens"))


@query("FLT-24", B.with_views("contracts best", "SELECT doc, filename FROM contracts WHERE doc IN (SELECT doc FROM best GROUP BY doc HAVING sum(CAST(ceil(length(content) / 4) AS BIGINT)) >= 2000)"))
def flt24(spark, sf_dir):
    heavy = tokens_of(best_variant(B.variants(spark, sf_dir))).where("tokens >= 2000")
    return B.contracts(spark, sf_dir).join(heavy, "doc", "left_semi").select("doc", "filename")


ORIENTED = "SELECT *, CASE WHEN doc_id % 12 = 0 THEN 'valid/' || doc_id END AS valid_path, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 * 90 END AS rotation, CASE WHEN doc_id % 7 <> 0 THEN 'osd' END AS method FROM flagged"
PENDING = "image_path IS NOT NULL AND NOT (valid_path IS NOT NULL AND rotation IS NOT NULL AND method IS NOT NULL)"


def oriented(spark, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return B.flagged(spark, sf_dir).select("doc", "page", "doc_id", "flags", "image_path", F.when(k % 12 == 0, F.concat(F.lit("valid/"), k.cast("string"))).alias("valid_path"), F.when(k % 5 != 0, k % 4 * 90).alias("rotation"), F.when(k % 7 != 0, "osd").alias("method"))


def orientation_pending() -> Column:
    """FLT-18: there is an image, and no validated copy whose rotation and method are known."""
    return G.given(F.col("image_path")) & ~(G.given(F.col("valid_path")) & F.col("rotation").isNotNull() & G.given(F.col("method")))


@query("FLT-18", B.with_views("flagged", f"SELECT doc, page FROM oriented WHERE {PENDING}", oriented=ORIENTED))
def flt18(spark, sf_dir):
    return oriented(spark, sf_dir).where(orientation_pending()).select("doc", "page")


@query("SIB-07", B.with_views("flagged", "SELECT doc_id, coalesce(CASE WHEN doc_id % 24 = 0 THEN valid_path END, CASE WHEN doc_id % 4 = 0 THEN image_path END, valid_path, image_path) AS path FROM oriented", oriented=ORIENTED))
def sib07(spark, sf_dir):
    """The validated image if its file exists, else the source if that exists, else either path."""
    k = F.col("doc_id")
    return oriented(spark, sf_dir).select("doc_id", F.coalesce(F.when(k % 24 == 0, F.col("valid_path")), F.when(k % 4 == 0, F.col("image_path")), "valid_path", "image_path").alias("path"))


@query("SIB-09", B.with_views("flagged", f"SELECT doc FROM oriented GROUP BY doc HAVING bool_or({PENDING})", oriented=ORIENTED))
def sib09(spark, sf_dir):
    return oriented(spark, sf_dir).where(orientation_pending()).select("doc").distinct()


@query("SIB-12", B.with_views("flagged", "SELECT count(*) AS processed, CAST(count_if(rotation <> 0) AS BIGINT) AS rotated, count(*) - CAST(count_if(rotation <> 0) AS BIGINT) AS unchanged FROM oriented WHERE image_path IS NOT NULL", oriented=ORIENTED))
def sib12(spark, sf_dir):
    turned = F.count_if(F.col("rotation") != 0)
    return oriented(spark, sf_dir).where("image_path is not null").agg(F.count("*").alias("processed"), turned.alias("rotated"), (F.count("*") - turned).alias("unchanged"))


@query("SIB-20", B.with_views("flagged", f"SELECT doc, CAST(count_if(markdown) AS BIGINT) AS processed, CAST(count_if(NOT markdown) AS BIGINT) AS skipped FROM ({ROUTED}) GROUP BY doc"))
def sib20(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("doc").agg(F.count_if("markdown").alias("processed"), F.count_if(~F.col("markdown")).alias("skipped"))


def recomputed(spark, sf_dir: str) -> DataFrame:
    """UDF-25: the recommendations dropped and set anew, in the order markdown, repair, vision; each flag once."""
    k = F.col("doc_id")
    stale = F.array_compact(F.array(F.when(k % 3 == 0, "llm_normalization_recommended"), F.when(k % 4 == 0, "llm_repair_recommended"), F.when(k % 5 == 0, "reviewed"), F.when(k % 5 == 0, "reviewed")))
    add = F.array_compact(F.array(F.when(F.col("markdown"), "llm_markdown_recommended"), F.when(F.col("repair"), "llm_repair_recommended"), F.when(F.col("vision"), "llm_vision_markdown_recommended")))
    return routed(spark, sf_dir).select("doc", "page", F.array_distinct(F.concat(G.without(F.concat(stale, "flags"), *G.LLM), add)).alias("flags"))


STALE_LLM = "list_filter([CASE WHEN doc_id % 3 = 0 THEN 'llm_normalization_recommended' END, CASE WHEN doc_id % 4 = 0 THEN 'llm_repair_recommended' END, CASE WHEN doc_id % 5 = 0 THEN 'reviewed' END], lambda x: x IS NOT NULL)"
ANEW = f"""SELECT doc, page, list_concat(list_filter(list_concat({STALE_LLM}, flags), lambda x: NOT list_contains(['llm_markdown_recommended', 'llm_repair_recommended', 'llm_vision_markdown_recommended', 'llm_normalization_recommended'], x)),
  list_filter([CASE WHEN markdown THEN 'llm_markdown_recommended' END, CASE WHEN repair THEN 'llm_repair_recommended' END, CASE WHEN vision THEN 'llm_vision_markdown_recommended' END], lambda x: x IS NOT NULL)) AS flags FROM ({ROUTED})"""


def _base_flags() -> Column:
    """A document's flags before a roll-up, as an aggregate: its own, and stale ones of earlier runs."""
    return F.array_append(F.array_append(G.document_rollup("page_flags"), F.when(F.min("doc_id") % 8 == 0, "has_ocr_pages").otherwise("has_rotated_page_images")), "ocr_still_needs_review")


ROLL = """SELECT doc, list_concat(list_filter(base, lambda f: NOT list_contains([{gone}], f)), list_filter([{new}], lambda x: x IS NOT NULL)) AS flags FROM (SELECT doc, list_concat(CASE WHEN r.flags = '' THEN [] ELSE string_split(r.flags, ',') END,
  [CASE WHEN doc * 4 % 8 = 0 THEN 'has_ocr_pages' ELSE 'has_rotated_page_images' END, 'ocr_still_needs_review']) AS base, o.* EXCLUDE (doc) FROM (SELECT doc, {aggs} FROM {pages} GROUP BY doc) o JOIN rolled r USING (doc))"""


def _roll(gone: tuple[str, ...], pages: str, **rules: str) -> str:
    """SQL of a roll-up: new flags in order, each with its condition over the pages."""
    quoted = ", ".join(f"'{g}'" for g in gone)
    new = ", ".join(f"CASE WHEN c_{name} THEN '{name}' END" for name in rules)
    return ROLL.format(gone=quoted, new=new, aggs=", ".join(f"bool_or({cond}) AS c_{name}" for name, cond in rules.items()), pages=pages)


def _any(*names: str) -> str:
    return "list_has_any(flags, [" + ", ".join(f"'{n}'" for n in names) + "])"


OCR_ROLL = _roll(G.DOC_OCR, "ocr_pages", has_ocr_pages=_any("ocr_attempted"), has_low_quality_ocr_pages=_any("ocr_low_text_density", "ocr_low_confidence", "ocr_suspected_garbled_text"), ocr_improved_some_pages=_any("ocr_improved_over_pdf_text"),
    has_likely_blank_pages=_any("likely_blank_page"), has_low_information_pages=_any("likely_low_information_page"), llm_markdown_recommended=_any("llm_markdown_recommended"), ocr_still_needs_review=_any("llm_repair_recommended"), llm_repair_recommended=_any("llm_repair_recommended"))
LLM_ROLL = _roll(G.DOC_LLM, "ocr_pages", llm_markdown_recommended=_any("llm_markdown_recommended"), llm_repair_recommended=_any("llm_repair_recommended"), ocr_still_needs_review=_any("llm_repair_recommended"), llm_vision_markdown_recommended=_any("llm_vision_markdown_recommended"))
ROTATED_ROLL = _roll(G.DOC_ORIENTATION, "ocr_pages", has_validated_page_images="doc_id % 12 = 0", has_rotated_page_images="doc_id % 5 = 1")


@query("AGG-09", B.with_views("ocr_pages", f"SELECT doc, array_to_string(flags, ',') AS flags FROM ({OCR_ROLL})", rolled=ROLLUP))
def agg09(spark, sf_dir):
    return B.ocr_pages(spark, sf_dir).groupBy("doc").agg(F.array_join(G.ocr_rollup(_base_flags()), ",").alias("flags"))


@query("AGG-10", B.with_views("ocr_pages", f"SELECT doc, array_to_string(flags, ',') AS flags FROM ({LLM_ROLL})", rolled=ROLLUP))
def agg10(spark, sf_dir):
    return B.ocr_pages(spark, sf_dir).groupBy("doc").agg(F.array_join(G.llm_rollup(_base_flags()), ",").alias("flags"))


@query("AGG-11", B.with_views("ocr_pages", f"SELECT doc, array_to_string(flags, ',') AS flags FROM ({ROTATED_ROLL})", rolled=ROLLUP))
def agg11(spark, sf_dir):
    return B.ocr_pages(spark, sf_dir).groupBy("doc").agg(F.array_join(G.orientation_rollup(_base_flags(), F.col("doc_id") % 12 == 0, F.col("doc_id") % 5 == 1), ",").alias("flags"))


@query("UDF-25", B.with_views("flagged", f"SELECT doc, page, array_to_string(flags, ',') AS flags FROM ({ANEW})"))
def udf25(spark, sf_dir):
    return recomputed(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query("AGG-27", B.with_views("flagged", "SELECT count(*) AS pages, " + ", ".join(f"CAST(count_if(list_contains(flags, '{f}')) AS BIGINT) AS {f}" for f in G.LLM) + f" FROM ({ANEW})"))
def agg27(spark, sf_dir):
    return recomputed(spark, sf_dir).agg(F.count("*").alias("pages"), *[F.count_if(G.has(F.col("flags"), f)).alias(f) for f in G.LLM])


@query("AGG-26", B.with_views("flagged", f"SELECT CAST(count_if(ocr) AS BIGINT) AS targets, CAST(count_if(list_contains(flags, 'no_text_extracted')) AS BIGINT) AS without_text, count(DISTINCT CASE WHEN ocr THEN doc END) AS documents FROM ({ROUTED})"))
def agg26(spark, sf_dir):
    return routed(spark, sf_dir).agg(F.count_if("ocr").alias("targets"), F.count_if(G.has(F.col("flags"), "no_text_extracted")).alias("without_text"), F.count_distinct(F.when(F.col("ocr"), F.col("doc"))).alias("documents"))


@query("SET-02", B.with_views("flagged", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(flags, ['ocr_recommended', 'reviewed']))), ',') AS flags FROM flagged"))
def set02(spark, sf_dir):
    extra = F.array(F.lit("ocr_recommended"), F.lit("reviewed"))
    return B.flagged(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_union("flags", extra)), ",").alias("flags"))


@query("SET-03", B.with_views("flagged", "SELECT doc_id, array_to_string(list_filter(list_concat(flags, flags), lambda f: f NOT IN ('ocr_recommended', 'low_text_density')), ',') AS flags FROM flagged"))
def set03(spark, sf_dir):
    """Order and repeats stay."""
    return B.flagged(spark, sf_dir).select("doc_id", F.array_join(G.without(F.concat("flags", "flags"), "ocr_recommended", "low_text_density"), ",").alias("flags"))


WARNINGS = "[CASE WHEN doc_id % 3 = 0 THEN 'Image orientation: ' || source END, 'Page ' || doc_id || ': ' || coalesce(lang, 'no language'), CASE WHEN doc_id % 5 < 2 THEN 'Image orientation: low confidence' END, 'See Image orientation: ' || (doc_id % 7)]"


@query("SET-04", f"SELECT doc_id, array_to_string(list_filter({WARNINGS}, lambda w: NOT starts_with(w, 'Image orientation: ')), ';') AS warnings FROM documents")
def set04(spark, sf_dir):
    """Warnings of the orientation stage go, others stay."""
    k = F.col("doc_id")
    said = F.array_compact(F.array(F.when(k % 3 == 0, F.concat(F.lit("Image orientation: "), F.col("source"))), F.concat(F.lit("Page "), k.cast("string"), F.lit(": "), F.coalesce("lang", F.lit("no language"))), F.when(k % 5 < 2, "Image orientation: low confidence"), F.concat(F.lit("See Image orientation: "), (k % 7).cast("string"))))
    return B.read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(said, lambda w: ~w.startswith("Image orientation: ")), ";").alias("warnings"))


@query("SET-08", B.with_views("pages", "SELECT doc, array_to_string(list_sort(list_distinct(list(page % 3))), ',') AS pages FROM pages GROUP BY doc"))
def set08(spark, sf_dir):
    return B.pages(spark, sf_dir).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set(F.col("page") % 3)), ",").alias("pages"))


@query("SIB-02", B.with_views("contracts best", "SELECT doc, count(b.page) AS n FROM contracts LEFT JOIN (SELECT * FROM best WHERE representation = 'markdown') b USING (doc) GROUP BY doc"))
def sib02(spark, sf_dir):
    n = best_variant(B.variants(spark, sf_dir)).where("representation = 'markdown'").groupBy("doc").agg(F.count("*").alias("n"))
    return B.contracts(spark, sf_dir).select("doc").join(n, "doc", "left").na.fill(0, ["n"])


@query("SIB-03", B.with_views("variants", "SELECT doc, page, md5(nullif(trim(arg_min(content, priority)), '')) AS digest FROM variants GROUP BY doc, page"))
def sib03(spark, sf_dir):
    """The first path decides, even if its file is blank: null then."""
    return first_path(B.variants(spark, sf_dir)).select("doc", "page", F.md5(F.nullif(F.trim("content"), F.lit(""))).alias("digest"))


@query("SIB-04", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def sib04(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("SRC-04", "SELECT doc_id, source || '__' || substr(sha256(coalesce(text, '')), 1, 8) AS key FROM (SELECT doc_id, text, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'document') AS source FROM documents)")
def src04(spark, sf_dir):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return B.read(spark, sf_dir, "documents").select("doc_id", F.concat(T.slug(F.coalesce("source", F.lit(""))), F.lit("__"), F.substring(sha, 1, 8)).alias("key"))


@query("SIB-35", B.with_views("variants", "SELECT doc, page, string_agg(representation, ',' ORDER BY representation) AS present FROM variants WHERE content <> '' GROUP BY doc, page"))
def sib35(spark, sf_dir):
    return B.variants(spark, sf_dir).where("content != ''").groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_list("representation")), ",").alias("present"))


@query("SIB-38", B.with_views("best", "SELECT representation, count(*) AS n FROM best GROUP BY ALL"))
def sib38(spark, sf_dir):
    return best_variant(B.variants(spark, sf_dir)).groupBy("representation").agg(F.count("*").alias("n"))


@query("SIB-43", B.with_views("contracts parties", "SELECT doc, filename FROM contracts WHERE doc NOT IN (SELECT doc FROM parties)"))
def sib43(spark, sf_dir):
    return B.contracts(spark, sf_dir).join(B.parties(spark, sf_dir), "doc", "left_anti").select("doc", "filename")


@query("SIB-55", B.with_views(NEED, f"SELECT doc, blocker FROM ({READY}) WHERE blocker IS NOT NULL"))
def sib55(spark, sf_dir):
    return readiness(spark, sf_dir).where("blocker is not null").select("doc", "blocker")


@query("SIB-56", B.with_views(NEED, f"SELECT doc FROM ({READY}) WHERE blocker IS NULL"))
def sib56(spark, sf_dir):
    return readiness(spark, sf_dir).where("blocker is null").select("doc")


CHANGED = "SELECT doc, CASE WHEN doc % 6 = 0 THEN NULL ELSE filename END AS filename, page_count + CASE WHEN doc % 10 = 0 THEN 1 ELSE 0 END AS page_count FROM contracts WHERE doc % 8 <> 3"


@query("SIB-01", B.with_views("contracts", "SELECT doc, l.doc IS NULL AS missing, c.filename IS DISTINCT FROM l.filename AS filename, c.page_count IS DISTINCT FROM l.page_count AS page_count FROM contracts c FULL JOIN loaded l USING (doc)", loaded=CHANGED))
def sib01(spark, sf_dir):
    """Column by column, what of the loaded row differs; null equals null."""
    c = B.contracts(spark, sf_dir).select("doc", "filename", "page_count")
    far = c.where("doc % 8 != 3").select("doc", F.when(F.col("doc") % 6 != 0, F.col("filename")).alias("far_name"), (F.col("page_count") + F.when(F.col("doc") % 10 == 0, 1).otherwise(0)).alias("far_count"), F.lit(True).alias("loaded"))
    return c.join(far, "doc", "full_outer").select("doc", F.col("loaded").isNull().alias("missing"), (~F.col("filename").eqNullSafe(F.col("far_name"))).alias("filename"), (~F.col("page_count").eqNullSafe(F.col("far_count"))).alias("page_count"))


ARTIFACTS = """SELECT *, row_number() OVER (PARTITION BY o ORDER BY line, kind, path, description) AS place FROM (SELECT l_orderkey AS o, l_linenumber AS line, CASE l_partkey % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' ELSE 'text' END AS kind, 'path/' || (l_suppkey % 4) AS path, 'step ' || (l_partkey % 5) AS description FROM lineitem)"""
NEW_PATH, NEW_STEP = "path/1", "step 3"


def artifacts(spark, sf_dir: str) -> DataFrame:
    """An order's lines as the nested artifact list of a document (o)."""
    k = F.col("l_partkey") % 3
    made = F.struct(F.col("l_linenumber").alias("at"), F.when(k == 0, "xml").when(k == 1, "json").otherwise("text").alias("kind"), F.concat(F.lit("path/"), (F.col("l_suppkey") % 4).cast("string")).alias("path"), F.concat(F.lit("step "), (F.col("l_partkey") % 5).cast("string")).alias("description"))
    return B.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(made)), lambda a: F.struct(a["kind"].alias("kind"), a["path"].alias("path"), a["description"].alias("description"))).alias("artifacts"))


def _shown(artifacts: Column) -> Column:
    return F.array_join(F.transform(artifacts, lambda a: F.concat_ws("|", a["kind"], a["path"], a["description"])), ",")


def upsert_artifact(artifacts: Column, kind: str, path: str, description: str) -> Column:
    """SNK-20: the first artifact with this path or this description is replaced where it stands; without one the new one comes last."""
    new = F.struct(F.lit(kind).alias("kind"), F.lit(path).alias("path"), F.lit(description).alias("description"))
    same = lambda a: (a["path"] == path) | (a["description"] == description)
    first = F.array_position(F.transform(artifacts, same), True)
    return F.when(first > 0, F.transform(artifacts, lambda a, i: F.when(i == first - 1, new).otherwise(a))).otherwise(F.array_append(artifacts, new))


@query("SNK-20", f"""WITH a AS ({ARTIFACTS}), hit AS (SELECT o, min(place) AS first FROM (SELECT o, CASE WHEN path = '{NEW_PATH}' OR description = '{NEW_STEP}' THEN place END AS place FROM a) GROUP BY o),
  new AS (SELECT a.o, place, CASE WHEN place = first THEN 'json|{NEW_PATH}|{NEW_STEP}' ELSE kind || '|' || path || '|' || description END AS one FROM a JOIN hit USING (o) UNION ALL SELECT o, 1000000, 'json|{NEW_PATH}|{NEW_STEP}' FROM hit WHERE first IS NULL)
  SELECT o, string_agg(one, ',' ORDER BY place) AS artifacts FROM new GROUP BY o""")
def snk20(spark, sf_dir):
    return artifacts(spark, sf_dir).select("o", _shown(upsert_artifact(F.col("artifacts"), "json", NEW_PATH, NEW_STEP)).alias("artifacts"))


@query("SNK-21", f"""WITH a AS ({ARTIFACTS}) SELECT o, string_agg(one, ',' ORDER BY place) AS artifacts FROM (SELECT o, place, kind || '|' || path || '|' || description AS one FROM a WHERE NOT (kind = 'xml' AND description = '{NEW_STEP}')
  UNION ALL SELECT DISTINCT o, 1000000, 'xml|new.xml|{NEW_STEP}' FROM a) GROUP BY o""")
def snk21(spark, sf_dir):
    """All of the same kind and description go, the new one comes last."""
    new = F.struct(F.lit("xml").alias("kind"), F.lit("new.xml").alias("path"), F.lit(NEW_STEP).alias("description"))
    rest = F.filter("artifacts", lambda a: ~((a["kind"] == "xml") & (a["description"] == NEW_STEP)))
    return artifacts(spark, sf_dir).select("o", _shown(F.array_append(rest, new)).alias("artifacts"))


@query("STR-04", B.with_views("signals", "SELECT doc_id, symbol FROM signals"))
def str04(spark, sf_dir):
    return B.flagged(spark, sf_dir).select("doc_id", T.symbol_ratio(F.col("norm")).alias("symbol"))


@query("STR-05", B.with_views("signals", "SELECT doc_id, newline FROM signals"))
def str05(spark, sf_dir):
    return B.flagged(spark, sf_dir).select("doc_id", T.newline_ratio(F.col("norm")).alias("newline"))


@query("STR-07", "SELECT doc_id, md5('<![CDATA[' || replace(coalesce(text, ''), ']]>', ']]]]><![CDATA[>') || ']]>') AS digest FROM documents")
def str07(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", F.md5(T.cdata(F.coalesce("text", F.lit("")))).alias("digest"))


@query("STR-12", B.with_views(NEED, f"SELECT doc, coalesce(nullif(trim(governing), ''), nullif(trim(change), ''), nullif(trim(seller), ''), '') AS overview FROM ({INDEX})"))
def str12(spark, sf_dir):
    return index(spark, sf_dir).select("doc", T.first_text(F.col("governing"), F.col("change"), F.col("seller")).alias("overview"))


@query("STR-15", B.with_views("items", r"SELECT thread_id, seq, CASE WHEN length(c) <= 240 THEN c ELSE rtrim(substr(c, 1, 239)) || '...' END AS preview FROM (SELECT thread_id, seq, trim(regexp_replace(coalesce(content_text, ''), '\s+', ' ', 'g')) AS c FROM items)"))
def str15(spark, sf_dir):
    return B.items(spark, sf_dir).select("thread_id", "seq", T.cut(F.col("content_text"), 240).alias("preview"))


FENCED = "CASE doc_id % 4 WHEN 0 THEN '  ```markdown' || chr(10) || t || chr(10) || '``` ' WHEN 1 THEN '```' || chr(10) || t WHEN 2 THEN t || chr(10) || '```' ELSE chr(10) || t || ' ' END"


def strip_fence(text: Column) -> Column:
    """STR-21: what a fence holds, without the white space around it; a fence that isn't opened first stays."""
    bare = T.strip(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"\A[^\n]*(\n|\z)", ""), r"(\A|\n)[ \t]*```[ \t]*\z", "")
    return F.when(bare.startswith("```"), T.strip(inner)).otherwise(bare)


@query("STR-21", rf"""SELECT doc_id, CASE WHEN starts_with(s, '```') THEN regexp_replace(regexp_replace(regexp_replace(s, '^[^\n]*(\n|$)', ''), '(^|\n)[ \t]*```[ \t]*$', ''), '^\s+|\s+$', '', 'g') ELSE s END AS body
  FROM (SELECT doc_id, regexp_replace({FENCED}, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, regexp_replace(substr(sha256(coalesce(text, '')), 1, 10 + doc_id % 9), '[0-3]', ' ', 'g') AS t FROM documents))""")
def str21(spark, sf_dir):
    k, nl = F.col("doc_id") % 4, "\n"
    t = F.regexp_replace(F.expr("substring(sha2(coalesce(text, ''), 256), 1, int(10 + doc_id % 9))"), "[0-3]", " ")
    fenced = F.when(k == 0, F.concat(F.lit("  ```markdown\n"), t, F.lit("\n``` "))).when(k == 1, F.concat(F.lit("```\n"), t)).when(k == 2, F.concat(t, F.lit("\n```"))).otherwise(F.concat(F.lit(nl), t, F.lit(" ")))
    return B.read(spark, sf_dir, "documents").select("doc_id", strip_fence(fenced).alias("body"))


def shown_party(party: Column) -> Column:
    """STR-26: a party as it is shown; blank and unknown ones by a placeholder. The unknown names and the placeholder."""
    known = (T.strip(party) != "") & ~F.lower(T.strip(party)).isin("unknown seller", "unknown buyer")
    return F.when(F.coalesce(known, F.lit(False)), party).otherwise("Not found in initial extraction")


@query("STR-26", B.with_views("classification parties", """SELECT doc, replace(stage, '_', ' ') AS stage, CASE WHEN p IS NULL OR trim(p) = '' OR lower(trim(p)) IN ('unknown seller', 'unknown buyer') THEN 'Not found in initial extraction' ELSE p END AS party
  FROM (SELECT doc, stage, CASE doc % 6 WHEN 0 THEN ' Unknown Seller ' WHEN 1 THEN '  ' WHEN 2 THEN 'unknown buyers' ELSE buyer END AS p FROM classification LEFT JOIN parties USING (doc))"""))
def str26(spark, sf_dir):
    k = F.col("doc") % 6
    raw = F.when(k == 0, " Unknown Seller ").when(k == 1, "  ").when(k == 2, "unknown buyers").otherwise(F.col("buyer"))
    return B.classification(spark, sf_dir).join(B.parties(spark, sf_dir), "doc", "left").select("doc", F.translate("stage", "_", " ").alias("stage"), shown_party(raw).alias("party"))


def data_url(content: Column, kind: str) -> Column:
    """STR-28: the whole content as a data URL; the line breaks that an encoder may add go."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))


@query("STR-28", "SELECT doc_id, 'data:text/plain;base64,' || base64(encode(coalesce(text, ''))) AS url FROM documents")
def str28(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select("doc_id", data_url(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "text/plain").alias("url"))


@query("AGG-02", B.with_views("contracts", "SELECT lang, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM contracts GROUP BY lang"))
def agg02(spark, sf_dir):
    return B.contracts(spark, sf_dir).groupBy("lang").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("AGG-29", B.with_views("notes", "SELECT doc, CAST(coalesce(list_sum(list_transform(range(1, doc % 4 + 1), lambda c: c % 3)), 0) AS BIGINT) AS citations FROM notes WHERE change IS NOT NULL"))
def agg29(spark, sf_dir):
    """Citations of all clauses of a change note; here clause c has c mod 3 of them."""
    clauses = F.when(F.col("doc") % 4 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("doc") % 4), lambda c: F.array_repeat(c, (c % 3).cast("int")))).otherwise(F.array().cast("array<array<bigint>>"))
    return B.notes(spark, sf_dir).where("change is not null").select("doc", F.aggregate(clauses, F.lit(0).cast("long"), lambda n, c: n + F.size(c)).alias("citations"))


@query("JOI-09", B.with_views("pages variants", "SELECT p.doc, p.page, length(v.content) AS chars FROM pages p LEFT JOIN variants v ON p.doc = v.doc AND p.page = v.page AND v.representation = 'vision_markdown'"))
def joi09(spark, sf_dir):
    v = B.variants(spark, sf_dir).where("representation = 'vision_markdown'").select("doc", "page", F.length("content").alias("chars"))
    return B.pages(spark, sf_dir).select("doc", "page").join(v, ["doc", "page"], "left")


@query("PRJ-10", B.with_views("variants", "SELECT doc, page, representation, priority, length(content) AS chars FROM variants WHERE doc = 42"))
def prj10(spark, sf_dir):
    return B.variants(spark, sf_dir).where("doc = 42").select("doc", "page", "representation", "priority", F.length("content").alias("chars"))


@query("PRJ-24", B.with_views("flagged", "SELECT doc, page, filename, chars, array_to_string(flags, ',') AS flags, ocr_path, markdown_path, vision_path FROM flagged"))
def prj24(spark, sf_dir):
    return B.flagged(spark, sf_dir).select("doc", "page", "filename", "chars", F.array_join("flags", ",").alias("flags"), "ocr_path", "markdown_path", "vision_path")


@query("PRJ-30", B.with_views("best", "SELECT doc, page, representation FROM best WHERE doc = 42 AND page IN (1, 2, 9)"))
def prj30(spark, sf_dir):
    """A batch of pages: wanted ones sorted and distinct, those that don't exist left out."""
    wanted = spark.range(1).select(F.explode(F.array_sort(F.array_distinct(F.array(*map(F.lit, (9, 2, 1, 2)))))).alias("page"))
    return best_variant(B.variants(spark, sf_dir).where("doc = 42")).select("doc", "page", "representation").join(wanted, "page").select("doc", "page", "representation")


@query("COE-03", B.with_views("classification", "SELECT doc, CASE WHEN stage = 'active_change' OR role = 'delta' THEN coalesce(change_kind, 'amendment') END AS change_kind FROM classification"))
def coe03(spark, sf_dir):
    return B.classification(spark, sf_dir).select("doc", F.when((F.col("stage") == "active_change") | (F.col("role") == "delta"), F.coalesce("change_kind", F.lit("amendment"))).alias("change_kind"))


def merge_domains(base: Column, overlay: Column, domains: Iterable[str]) -> Column:
    """COE-08: the selected domains of `overlay`, null or not, in place of those of `base`."""
    for name in domains:
        base = base.withField(name, overlay[name])
    return base


DOMAINS = ("identity", "parties", "subject", "term", "economics", "controls")


@query("COE-08", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN (o_orderkey + {i}) % 3 <> 0 THEN '{'new' if d in ('parties', 'term') else 'old'} {d} ' || {'o_custkey' if d in ('parties', 'term') else 'o_orderkey'} END AS {d}" for i, d in enumerate(DOMAINS)) + " FROM orders")
def coe08(spark, sf_dir):
    """An order's key and customer stand for two notes of one document; parties and term are taken anew."""
    note = lambda word, key: F.struct(*[F.when((F.col("o_orderkey") + i) % 3 != 0, F.concat_ws(" ", F.lit(word), F.lit(d), F.col(key).cast("string"))).alias(d) for i, d in enumerate(DOMAINS)])
    return B.read(spark, sf_dir, "orders").select("o_orderkey", merge_domains(note("old", "o_orderkey"), note("new", "o_custkey"), ("parties", "term")).alias("m")).select("o_orderkey", "m.*")


@query("MTH-11", B.with_views("classification", "SELECT doc, round_even(least(confidence, CASE WHEN doc % 3 = 2 THEN 0.90 WHEN doc % 3 = 1 THEN 0.94 ELSE 1.0 END, CASE WHEN doc % 5 = 0 THEN 0.90 ELSE 1.0 END, CASE WHEN doc % 7 = 0 THEN 0.88 ELSE 1.0 END), 2) AS confidence FROM classification"))
def mth11(spark, sf_dir):
    """Caps by the number of warnings and by answers that are missing."""
    k = F.col("doc")
    cap = lambda cond, most: F.when(cond, F.lit(most)).otherwise(F.lit(1.0))
    warnings = k % 3
    return B.classification(spark, sf_dir).select("doc", F.bround(F.least(F.col("confidence").cast("double"), cap(warnings >= 2, 0.90), cap(warnings >= 1, 0.94), cap(k % 5 == 0, 0.90), cap(k % 7 == 0, 0.88)), 2).alias("confidence"))


@query("MTH-08", "SELECT event_id, mean >= 248 AND var <= 12 AND white >= 0.985 AS blank, (var <= 12 AND white >= 0.985) OR (black >= 0.97 AND mean <= 20 AND var <= 150) AS low_information FROM (SELECT event_id, event_id % 256 AS mean, event_id % 30 AS var, event_id % 1000 / 1000 AS white, event_id % 7 / 6 AS black FROM events)")
def mth08(spark, sf_dir):
    e = B.read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 256 as mean", "event_id % 30 as var", "event_id % 1000 / 1000D as white", "event_id % 7 / 6D as black")
    return e.selectExpr("event_id", "mean >= 248 and var <= 12 and white >= 0.985D as blank", "(var <= 12 and white >= 0.985D) or (black >= 0.97D and mean <= 20 and var <= 150) as low_information")


@query("WIN-15", B.with_views("claims", "SELECT turn_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY queued_at, beat NULLS FIRST, turn_id) AS place FROM claims"))
def win15(spark, sf_dir):
    w = Window.partitionBy("thread_id").orderBy("queued_at", F.asc_nulls_first("beat"), "turn_id")
    return B.claims(spark, sf_dir).select("turn_id", "thread_id", F.row_number().over(w).cast("long").alias("place"))
