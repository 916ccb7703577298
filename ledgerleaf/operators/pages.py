"""Page text, signals, routing, tokens, and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .mart import best_variant


@query("STR-01", B.with_views("norm", "SELECT doc_id, length(norm) AS chars, md5(norm) AS digest FROM norm"))
def str01(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", T.normalize_page(F.col("content")).alias("norm")).select("doc_id", F.length("norm").alias("chars"), F.md5("norm").alias("digest"))


@query("STR-03", B.with_views("signals", "SELECT doc_id, alpha, symbol, newline FROM signals"))
def str03(spark, sf_dir):
    n = B.pages(spark, sf_dir).select("doc_id", T.normalize_page(F.col("content")).alias("n"))
    return n.select("doc_id", T.alpha_ratio(F.col("n")).alias("alpha"), T.symbol_ratio(F.col("n")).alias("symbol"), T.newline_ratio(F.col("n")).alias("newline"))


@query("STR-06", B.with_views("pages", """SELECT doc_id, md5(replace(replace(replace(replace(content, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS attribute, md5('<![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>') || ']]>') AS cdata FROM pages"""))
def str06(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", F.md5(T.xml_attribute(F.col("content"))).alias("attribute"), F.md5(T.cdata(F.col("content"))).alias("cdata"))


@query("STR-10", B.with_views("contracts", r"SELECT doc, trim(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '[_-]+', ' ', 'g')) AS title FROM contracts"))
def str10(spark, sf_dir):
    return B.contracts(spark, sf_dir).select("doc", T.humanize_filename(F.col("filename")).alias("title"))


SPACES = r"[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("STR-11", B.with_views("pages", rf"""SELECT doc_id, CASE WHEN length(c) <= 360 THEN c ELSE rtrim(substr(c, 1, 359)) || '...' END AS preview
  FROM (SELECT doc_id, regexp_replace(regexp_replace(content, '{SPACES}+', ' ', 'g'), '^{SPACES}+|{SPACES}+$', '', 'g') AS c FROM pages)"""))
def str11(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", T.cut(F.col("content"), 360).alias("preview"))


@query("STR-18", B.with_views("purchases", "SELECT CASE WHEN buyer IS NULL THEN '(null)' WHEN trim(buyer) = '' THEN '(blank)' ELSE trim(buyer) END AS buyer, CASE WHEN seller IS NULL THEN '(null)' WHEN trim(seller) = '' THEN '(blank)' ELSE trim(seller) END AS seller, count(*) AS n FROM purchases GROUP BY ALL"))
def str18(spark, sf_dir):
    p = B.purchases(spark, sf_dir).select(T.bucket_label(F.col("buyer")).alias("buyer"), T.bucket_label(F.col("seller")).alias("seller"))
    return p.groupBy("buyer", "seller").agg(F.count("*").alias("n"))


@query("STR-20", B.with_views("items", rf"SELECT thread_id, seq, nullif(regexp_replace(regexp_replace(content_text, '{SPACES}+', ' ', 'g'), '^{SPACES}+|{SPACES}+$', '', 'g'), '') AS body FROM items"))
def str20(spark, sf_dir):
    return B.items(spark, sf_dir).select("thread_id", "seq", T.clean(F.col("content_text")).alias("body"))


@query("STR-24", B.with_views("pages", "SELECT doc_id, filename || '__page_' || lpad(CAST(page AS VARCHAR), 4, '0') || '__text.txt' AS artifact FROM pages"))
def str24(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", F.format_string("%s__page_%04d__text.txt", "filename", "page").alias("artifact"))


@query("SRC-03", B.with_views("contracts", "SELECT doc, regexp_replace(regexp_replace(lower(filename), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '__' || substr(sha256(filename), 1, 8) AS doc_key FROM contracts"))
def src03(spark, sf_dir):
    return B.contracts(spark, sf_dir).select("doc", F.concat(T.slug(F.col("filename")), F.lit("__"), F.substring(F.sha2("filename", 256), 1, 8)).alias("doc_key"))


@query("MTH-01", B.with_views("pages", "SELECT doc_id, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length(content) / 4, 0) AS BIGINT)) END AS tokens FROM pages"))
def mth01(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", T.mart_tokens(F.col("content")).alias("tokens"))


@query("MTH-02", B.with_views("pages", "SELECT doc_id, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens FROM pages"))
def mth02(spark, sf_dir):
    return B.pages(spark, sf_dir).select("doc_id", T.inventory_tokens(F.col("content")).alias("tokens"))


@query("MTH-04", """SELECT event_id, round_even(CASE WHEN value > 100 THEN value - 100 ELSE value END + 1.5 * least(event_id % 60, 40) + least(event_id % 500, 400) / 40 + 35 * CASE WHEN event_id % 500 = 0 THEN 0.0 ELSE 0.75 END
  - 25 * CASE WHEN event_id % 500 = 0 THEN 1.0 ELSE 0.125 END - CASE WHEN event_id % 500 = 0 THEN 40 ELSE 0 END - CASE WHEN event_id % 60 < 4 THEN 10 ELSE 0 END, 4) AS score FROM events""")
def mth04(spark, sf_dir):
    e, k = B.read(spark, sf_dir, "events"), F.col("event_id")
    conf = F.when(F.col("value") > 100, F.col("value") - 100).otherwise(F.col("value"))
    return e.select("event_id", G.orientation_score(conf, k % 60, k % 500, F.lit(0.75), F.lit(0.125)).alias("score"))


@query("MTH-06", B.with_views("flagged", "SELECT doc_id, chars, array_to_string(flags, ',') AS flags FROM flagged"))
def mth06(spark, sf_dir):
    return B.flagged(spark, sf_dir).select("doc_id", "chars", F.array_join("flags", ",").alias("flags"))


def routed(spark, sf_dir: str) -> DataFrame:
    """FLT-06..10: which steps each page is a candidate for."""
    p, f, ocr = B.flagged(spark, sf_dir), F.col("flags"), F.col("ocr_path")
    return p.select("doc", "page", "doc_id", "flags", G.ocr_target(f, ocr).alias("ocr"), G.markdown_candidate(f, ocr, F.col("markdown_path")).alias("markdown"), G.repair_candidate(f, ocr, F.col("repair_path")).alias("repair"), G.vision_candidate(f, F.col("image_path"), F.col("vision_path")).alias("vision"))


ROUTED = """SELECT doc, page, doc_id, flags,
  ocr_path IS NULL AND list_has_any(flags, ['no_text_extracted', 'low_text_density', 'suspected_scanned_page', 'suspected_image_only_page', 'suspected_garbled_text', 'ocr_recommended']) AS ocr,
  markdown_path IS NULL AND list_contains(flags, 'possible_table_or_form_content') AND (ocr_path IS NOT NULL OR list_has_any(flags, ['suspected_scanned_page', 'suspected_image_only_page'])) AS markdown,
  repair_path IS NULL AND ((list_contains(flags, 'no_text_extracted') AND list_contains(flags, 'ocr_recommended') AND ocr_path IS NULL) OR (list_contains(flags, 'suspected_garbled_text') AND ocr_path IS NULL)) AS repair,
  vision_path IS NULL AND image_path IS NOT NULL AND list_has_any(flags, ['suspected_scanned_page', 'suspected_image_only_page', 'no_text_extracted', 'possible_table_or_form_content']) AS vision FROM flagged"""


@query("FLT-06", B.with_views("flagged", f"SELECT doc, page, ocr, markdown, repair, vision FROM ({ROUTED})"))
def flt06(spark, sf_dir):
    return routed(spark, sf_dir).select("doc", "page", "ocr", "markdown", "repair", "vision")


@query("FLT-12", B.with_views("flagged", f"SELECT doc_id, 'markdown' AS selector FROM ({ROUTED}) WHERE markdown UNION ALL SELECT doc_id, 'repair' FROM ({ROUTED}) WHERE repair UNION ALL SELECT doc_id, 'vision' FROM ({ROUTED}) WHERE vision"))
def flt12(spark, sf_dir):
    picks = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("markdown", "repair", "vision")]))
    return routed(spark, sf_dir).select("doc_id", F.explode(picks).alias("selector"))


@query("FLT-14", B.with_views("flagged", "SELECT doc_id, markdown_path FROM flagged WHERE markdown_path IS NOT NULL"))
def flt14(spark, sf_dir):
    return B.flagged(spark, sf_dir).where(G.given(F.col("markdown_path"))).select("doc_id", "markdown_path")


@query("FLT-19", B.with_views("flagged", "SELECT doc_id FROM flagged WHERE list_has_any(flags, ['image_render_recommended', 'ocr_recommended'])"))
def flt19(spark, sf_dir):
    return B.flagged(spark, sf_dir).where(G.any_of(F.col("flags"), "image_render_recommended", "ocr_recommended")).select("doc_id")


@query("SET-01", B.with_views("flagged", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(flags, flags))), ',') AS both, array_to_string(list_filter(flags, lambda f: f <> 'ocr_recommended'), ',') AS less FROM flagged"))
def set01(spark, sf_dir):
    f = F.col("flags")
    return B.flagged(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.concat(f, f))), ",").alias("both"), F.array_join(G.without(f, "ocr_recommended"), ",").alias("less"))


HOSTS = r"SELECT page_id // 20 AS message, page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages"


@query("SET-09", f"""SELECT message, array_to_string(list_slice(hosts, 1, 3), ', ') || CASE WHEN len(hosts) > 3 THEN ' +' || (len(hosts) - 3) ELSE '' END AS summary
  FROM (SELECT message, list(host ORDER BY first) AS hosts FROM (SELECT message, host, min(page_id) AS first FROM ({HOSTS}) WHERE host <> '' GROUP BY message, host) GROUP BY message)""")
def set09(spark, sf_dir):
    """The hosts of a message's sources, each once in the order in which they come first: three of them and how many more."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    seen = B.read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 20).alias("message"), "page_id", host.alias("host")).where("host != ''")
    firsts = seen.groupBy("message", "host").agg(F.min("page_id").alias("first"))
    hosts = firsts.groupBy("message").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "host"))), lambda x: x["host"]).alias("hosts"))
    more = F.size("hosts") - 3
    return hosts.select("message", F.concat(F.array_join(F.slice("hosts", 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")).alias("summary"))


ROLLUP = """SELECT doc, array_to_string(list_filter([
  CASE WHEN bool_or(list_has_any(flags, ['low_text_density', 'suspected_garbled_text'])) THEN 'has_low_quality_pages' END,
  CASE WHEN bool_or(list_contains(flags, 'suspected_scanned_page')) THEN 'has_scanned_pages' END,
  CASE WHEN bool_or(list_contains(flags, 'ocr_recommended')) THEN 'ocr_recommended' END,
  CASE WHEN count_if(list_contains(flags, 'suspected_scanned_page')) > 0 AND count_if(list_contains(flags, 'suspected_scanned_page')) >= greatest(count(*), 1) / 2 THEN 'mostly_image_based' END,
  CASE WHEN count(DISTINCT list_sort(flags)) > 1 THEN 'mixed_text_quality' END,
  CASE WHEN bool_or(list_has_any(flags, ['suspected_scanned_page', 'suspected_garbled_text'])) THEN 'manual_review_recommended' END], lambda x: x IS NOT NULL), ',') AS flags FROM flagged GROUP BY doc"""


@query("AGG-08", B.with_views("flagged", ROLLUP))
def agg08(spark, sf_dir):
    return B.flagged(spark, sf_dir).groupBy("doc").agg(F.array_join(G.document_rollup(), ",").alias("flags"))


@query("AGG-12", B.with_views("flagged", f"SELECT 'page' AS level, f AS flag, count(*) AS n FROM (SELECT unnest(flags) AS f FROM flagged) GROUP BY f UNION ALL SELECT 'document', f, count(*) FROM (SELECT unnest(string_split(flags, ',')) AS f FROM ({ROLLUP}) WHERE flags <> '') GROUP BY f"))
def agg12(spark, sf_dir):
    """In one pass: a document's pages by the flags that they have, at most one row for each set of flags, give both levels."""
    alike = B.flagged(spark, sf_dir).groupBy("doc", "flags").agg(F.count("*").alias("n"))
    each = alike.groupBy("doc").agg(G.document_rollup(pages=F.col("n")).alias("f"), F.collect_list(F.struct("flags", "n")).alias("pages"))
    counted = lambda level, flags, n: F.transform(flags, lambda f: F.struct(F.lit(level).alias("level"), f.alias("flag"), n.alias("n")))
    page = F.flatten(F.transform("pages", lambda p: counted("page", p["flags"], p["n"])))
    both = each.select(F.inline(F.concat(page, counted("document", F.col("f"), F.lit(1).cast("long")))))
    return both.groupBy("level", "flag").agg(F.sum("n").alias("n"))


STATES = ("failed", "inventory_only", "needs_image_orientation", "needs_ocr", "needs_llm_markdown", "needs_vision_markdown", "needs_llm_repair", "done_with_review_flag", "done")
ACTIONS = ("manual_review", "normalize_txt", "validate_image_orientation", "normalize_ocr", "normalize_llm_markdown", "normalize_vision_markdown", "normalize_llm_repair", "none", "none")
STATE = f"""SELECT doc, [{', '.join(f"'{s}'" for s in STATES)}][k] AS state, [{', '.join(f"'{a}'" for a in ACTIONS)}][k] AS action FROM (
  SELECT c.doc, CASE WHEN c.doc % 37 = 0 THEN 1 WHEN r.pages IS NULL THEN 2 WHEN turn THEN 3 WHEN ocr THEN 4 WHEN markdown THEN 5 WHEN vision THEN 6 WHEN repair THEN 7 WHEN review THEN 8 ELSE 9 END AS k
  FROM (SELECT DISTINCT doc_id // 4 AS doc FROM documents) c LEFT JOIN (SELECT doc, count(*) AS pages, bool_or(doc_id % 18 = 6) AS turn, bool_or(ocr) AS ocr, bool_or(markdown) AS markdown, bool_or(vision) AS vision, bool_or(repair) AS repair,
    bool_or(list_has_any(flags, ['suspected_scanned_page', 'suspected_garbled_text'])) AS review FROM ({ROUTED}) WHERE doc % 11 <> 5 GROUP BY doc) r ON c.doc = r.doc)"""


def pipeline_state(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """WIN-18: the state of each document (doc, failed) and what is to be done next, the first that fits in a fixed order.

    `pages` has a row for each page: doc, flags, and whether it is to be turned or is a candidate for each step.
    """
    review = F.bool_or(G.any_of(F.col("flags"), "suspected_scanned_page", "suspected_garbled_text"))
    steps = pages.groupBy("doc").agg(F.lit(True).alias("has_pages"), *[F.bool_or(c).alias(c) for c in ("turn", "ocr", "markdown", "vision", "repair")], review.alias("review"))
    fits = [F.col("failed"), F.col("has_pages").isNull(), *[F.col(c) for c in ("turn", "ocr", "markdown", "vision", "repair", "review")], F.lit(True)]
    pick = lambda names: F.coalesce(*[F.when(cond, name) for cond, name in zip(fits, names)])
    return documents.join(steps, "doc", "left").select("doc", pick(STATES).alias("state"), pick(ACTIONS).alias("action"))


def _states(spark, sf_dir: str) -> DataFrame:
    """Every 37th document failed, every 11th has no pages yet, some images are not turned yet."""
    documents = B.pages(spark, sf_dir).select("doc").distinct().withColumn("failed", F.col("doc") % 37 == 0)
    return pipeline_state(documents, routed(spark, sf_dir).where("doc % 11 != 5").withColumn("turn", F.col("doc_id") % 18 == 6))


@query("WIN-18", B.with_views("flagged", STATE))
def win18(spark, sf_dir):
    return _states(spark, sf_dir)


@query("AGG-13", B.with_views("flagged", f"SELECT state, count(*) AS n FROM ({STATE}) GROUP BY state"))
def agg13(spark, sf_dir):
    return _states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


PROFILE = """SELECT doc, count(*) AS pages, CAST(sum(t) AS BIGINT) AS total, round_even(avg(t), 2) AS mean, median(t) AS middle, max(t) AS most, min(t) AS least,
  round_even(coalesce(sum(CASE WHEN r <= 5 THEN t END), 0) / greatest(sum(t), 1), 4) AS top_share, CAST(count_if(t >= 400) AS BIGINT) AS dense
  FROM (SELECT doc, CAST(ceil(length(content) / 4) AS BIGINT) AS t, row_number() OVER (PARTITION BY doc ORDER BY length(content) DESC, page) AS r FROM pages) GROUP BY doc"""


def token_profile(spark, sf_dir: str) -> DataFrame:
    """AGG-16: tokens of a document's pages, how much the five longest hold, how many are dense."""
    p = B.pages(spark, sf_dir).select("doc", "page", T.inventory_tokens(F.col("content")).alias("t"), F.length("content").alias("n"))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "page")))
    share = F.coalesce(F.sum(F.when(F.col("r") <= 5, F.col("t"))), F.lit(0)) / F.greatest(F.sum("t"), F.lit(1))
    return p.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("t").alias("total"), F.bround(F.avg("t"), 2).alias("mean"), F.median("t").alias("middle"), F.max("t").alias("most"), F.min("t").alias("least"), F.bround(share, 4).alias("top_share"), F.count_if(F.col("t") >= 400).alias("dense"))


@query("AGG-16", B.with_views("pages", PROFILE))
def agg16(spark, sf_dir):
    return token_profile(spark, sf_dir)


@query("MTH-09", B.with_views("pages", f"SELECT doc, CASE WHEN total >= 40000 OR (total >= 25000 AND pages >= 25 AND top_share <= 0.45) OR (total >= 25000 AND dense >= 15) THEN 'recommended' WHEN total <= 12000 THEN 'not_needed' ELSE 'borderline' END AS advice FROM ({PROFILE})"))
def mth09(spark, sf_dir):
    return token_profile(spark, sf_dir).select("doc", G.page_notes_advice(F.col("total"), F.col("pages"), F.col("top_share"), F.col("dense")).alias("advice"))


@query("AGG-24", B.with_views("pages", f"SELECT CASE WHEN total <= 12000 THEN 'not_needed' ELSE 'other' END AS advice, count(*) AS n, CAST(sum(total) AS BIGINT) AS tokens FROM ({PROFILE}) GROUP BY ALL"))
def agg24(spark, sf_dir):
    t = token_profile(spark, sf_dir).select(F.when(F.col("total") <= 12000, "not_needed").otherwise("other").alias("advice"), "total")
    return t.groupBy("advice").agg(F.count("*").alias("n"), F.sum("total").alias("tokens"))


@query("AGG-17", B.with_views("variants", "SELECT doc, representation, count(*) AS artifacts, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM variants GROUP BY ALL"))
def agg17(spark, sf_dir):
    return B.variants(spark, sf_dir).groupBy("doc", "representation").agg(F.count("*").alias("artifacts"), F.sum(T.inventory_tokens(F.col("content"))).alias("tokens"))


@query("AGG-18", B.with_views("variants", "SELECT representation, count(DISTINCT doc) AS documents, count(*) AS artifacts, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM variants GROUP BY ALL"))
def agg18(spark, sf_dir):
    by_doc = agg17(spark, sf_dir)
    return by_doc.groupBy("representation").agg(F.count("*").alias("documents"), F.sum("artifacts").alias("artifacts"), F.sum("tokens").alias("tokens"))


@query("WIN-06", B.with_views("pages", "SELECT doc, page, tokens FROM (SELECT doc, page, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc ORDER BY ceil(length(content) / 4) DESC, page) AS r FROM pages) WHERE r <= 2"))
def win06(spark, sf_dir):
    p = B.pages(spark, sf_dir).select("doc", "page", T.inventory_tokens(F.col("content")).alias("tokens"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("tokens"), "page"))).where("r <= 2").drop("r")


@query("WIN-07", B.with_views("pages contracts", f"SELECT doc, filename, total FROM ({PROFILE}) JOIN contracts USING (doc) WHERE total >= 3000"))
def win07(spark, sf_dir):
    return token_profile(spark, sf_dir).where("total >= 3000").join(B.contracts(spark, sf_dir), "doc").select("doc", "filename", "total").orderBy(F.desc("total"), "filename")


@query("WIN-09", B.with_views("best contracts", "SELECT doc, filename, tokens FROM (SELECT doc, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM best GROUP BY doc) JOIN contracts USING (doc) ORDER BY tokens DESC, filename, doc LIMIT 20"))
def win09(spark, sf_dir):
    t = best_variant(B.variants(spark, sf_dir)).groupBy("doc").agg(F.sum(T.inventory_tokens(F.col("content"))).alias("tokens"))
    return t.join(B.contracts(spark, sf_dir).select("doc", "filename"), "doc").orderBy(F.desc("tokens"), "filename", "doc").limit(20)


@query("AGG-32", r"SELECT page_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= greatest(1, length(x) // 2))) / len(w) ELSE 0.0 END AS ratio FROM (SELECT page_id, list_filter(regexp_split_to_array(url, '[/?&=.:#-]+'), lambda x: x <> '') AS w FROM pages)")
def agg32(spark, sf_dir):
    words = F.regexp_replace("url", r"[/?&=.:#-]+", " ")
    return B.read(spark, sf_dir, "pages").select("page_id", T.numeric_token_ratio(words).alias("ratio"))


def page_xml(number: Column, representation: Column, path: Column, flags: Column, content: Column) -> Column:
    """STR-08: the block of one page; without a representation it is missing and empty."""
    empty = F.lit("")
    line = F.concat(F.lit('    <page number="'), number.cast("string"), F.lit('" representation="'), T.xml_attribute(F.coalesce(representation, F.lit("missing"))), F.lit('" source_path="'), T.xml_attribute(F.coalesce(path, empty)), F.lit('">'))
    quality = F.concat(F.lit("      <quality_flags>"), T.xml_attribute(F.array_join(flags, ",")), F.lit("</quality_flags>"))
    body = F.concat(F.lit("      <content>"), T.cdata(F.coalesce(content, empty)), F.lit("</content>"))
    return F.concat_ws("\n", line, quality, body, F.lit("    </page>"))


def document_xml(doc: Column, filename: Column, source: Column, pages: Column, blocks: Column) -> Column:
    """STR-09: the whole document; `blocks` are its pages' blocks in order."""
    tag = lambda name, v: F.concat(F.lit(f"    <{name}>"), v, F.lit(f"</{name}>"))
    head = F.concat(F.lit('<document doc_id="'), T.xml_attribute(doc), F.lit('">'))
    lines = [head, F.lit("  <metadata>"), tag("source_filename", T.xml_attribute(filename)), tag("source_pdf", T.xml_attribute(source)), tag("page_count", pages.cast("string")), F.lit("  </metadata>"), F.lit("  <pages>"), F.array_join(blocks, "\n"), F.lit("  </pages>"), F.lit("</document>")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def page_blocks(spark, sf_dir: str) -> DataFrame:
    """Every page with its block; pages without content stay."""
    best = best_variant(B.variants(spark, sf_dir)).select("doc", "page", "representation", "content")
    p = B.flagged(spark, sf_dir).select("doc", "page", "doc_id", "filename", "flags").join(best, ["doc", "page"], "left")
    path = F.when(F.col("representation").isNotNull(), F.concat_ws("/", F.lit("out & in"), "representation", F.col("doc_id").cast("string")))
    return p.select("doc", "page", "filename", page_xml(F.col("page"), F.col("representation"), path, F.col("flags"), F.col("content")).alias("xml"))


_ESCAPED = lambda c: f"""replace(replace(replace(replace({c}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')"""
BLOCKS = """SELECT f.doc, f.page, f.filename, '    <page number="' || f.page || '" representation="' || coalesce(b.representation, 'missing') || '" source_path="' || coalesce('out &amp; in/' || b.representation || '/' || f.doc_id, '') || '">' || chr(10)
  || '      <quality_flags>' || array_to_string(flags, ',') || '</quality_flags>' || chr(10) || '      <content><![CDATA[' || replace(coalesce(b.content, ''), ']]>', ']]]]><![CDATA[>') || ']]></content>' || chr(10) || '    </page>' AS xml
  FROM flagged f LEFT JOIN best b ON f.doc = b.doc AND f.page = b.page"""
DOCUMENT = f"""SELECT doc, '<document doc_id="d&amp;' || doc || '">' || chr(10) || '  <metadata>' || chr(10) || '    <source_filename>' || {_ESCAPED('min(filename)')} || '</source_filename>' || chr(10) || '    <source_pdf>in/' || {_ESCAPED('min(filename)')} || '</source_pdf>' || chr(10)
  || '    <page_count>' || count(*) || '</page_count>' || chr(10) || '  </metadata>' || chr(10) || '  <pages>' || chr(10) || string_agg(xml, chr(10) ORDER BY page) || chr(10) || '  </pages>' || chr(10) || '</document>' || chr(10) AS xml FROM ({BLOCKS}) GROUP BY doc"""


@query("STR-08", B.with_views("flagged best", f"SELECT doc, page, md5(xml) AS digest, length(xml) AS chars FROM ({BLOCKS})"))
def str08(spark, sf_dir):
    return page_blocks(spark, sf_dir).select("doc", "page", F.md5("xml").alias("digest"), F.length("xml").alias("chars"))


def assembled(spark, sf_dir: str) -> DataFrame:
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("page", "xml"))), lambda p: p["xml"])
    d = page_blocks(spark, sf_dir).groupBy("doc").agg(F.min("filename").alias("filename"), F.count("*").alias("pages"), blocks.alias("blocks"))
    return d.select("doc", document_xml(F.concat(F.lit("d&"), F.col("doc").cast("string")), F.col("filename"), F.concat(F.lit("in/"), "filename"), F.col("pages"), F.col("blocks")).alias("xml"))


@query("STR-09", B.with_views("flagged best", f"SELECT doc, md5(xml) AS digest, length(xml) AS chars FROM ({DOCUMENT})"))
def str09(spark, sf_dir):
    return assembled(spark, sf_dir).select("doc", F.md5("xml").alias("digest"), F.length("xml").alias("chars"))


@query("SNK-12", B.with_views("flagged best", f"SELECT doc, 'assembled/' || doc || '.xml' AS path, octet_length(encode(xml)) AS bytes, sha256(xml) AS digest FROM ({DOCUMENT})"))
def snk12(spark, sf_dir):
    """One file for each document: where it goes, and what it holds."""
    return assembled(spark, sf_dir).select("doc", F.concat(F.lit("assembled/"), F.col("doc").cast("string"), F.lit(".xml")).alias("path"), F.octet_length("xml").alias("bytes"), F.sha2("xml", 256).alias("digest"))
