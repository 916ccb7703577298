"""Lookups, selectors and small reports over pages, contracts, threads and turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .mart import best_variant, is_in, matches
from .pages import ROUTED, routed


@query("PRJ-04", B.with_views("notes pages", "SELECT p.doc, p.page FROM pages p JOIN notes n ON p.doc = n.doc WHERE n.page_notes AND p.page IN (1, 2)"))
def prj04(spark, sf_dir):
    n = B.notes(spark, sf_dir).where("page_notes").select("doc")
    return B.pages(spark, sf_dir).where(is_in(F.col("page"), [1, 2])).join(n, "doc").select("doc", "page")


@query("PRJ-12", B.with_views("claims", "SELECT * FROM claims WHERE turn_id = 77"))
def prj12(spark, sf_dir):
    return B.claims(spark, sf_dir).where("turn_id = 77")


@query("PRJ-20", B.with_views("best variants", "SELECT v.doc, v.page, v.representation FROM variants v JOIN best b ON v.doc = b.doc AND v.page = b.page WHERE v.representation <> b.representation"))
def prj20(spark, sf_dir):
    v = B.variants(spark, sf_dir)
    best = best_variant(v).select("doc", "page", F.col("representation").alias("best"))
    return v.join(best, ["doc", "page"]).where("representation != best").select("doc", "page", "representation")


@query("PRJ-22", B.with_views("items", "SELECT thread_id, seq, CASE item_type WHEN 'reasoning' THEN '' ELSE substr(coalesce(content_text, ''), 1, 240) END AS summary FROM items"))
def prj22(spark, sf_dir):
    return B.items(spark, sf_dir).select("thread_id", "seq", F.when(F.col("item_type") == "reasoning", "").otherwise(F.substring(F.coalesce("content_text", F.lit("")), 1, 240)).alias("summary"))


@query("FLT-05", B.with_views("contracts", "SELECT doc FROM contracts WHERE doc IN (1, 5, 9) OR 1 = 0"))
def flt05(spark, sf_dir):
    return B.contracts(spark, sf_dir).where(is_in(F.col("doc"), [1, 5, 9]) | is_in(F.col("doc"), [])).select("doc")


@query("FLT-07", B.with_views("flagged", f"SELECT doc, string_agg(page, ',' ORDER BY page) AS targets FROM ({ROUTED}) WHERE ocr GROUP BY doc"))
def flt07(spark, sf_dir):
    return routed(spark, sf_dir).where("ocr").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("targets"))


@query("FLT-16", B.with_views("flagged", "SELECT doc_id FROM flagged WHERE list_has_any(flags, ['high_symbol_ratio', 'high_whitespace_noise'])"))
def flt16(spark, sf_dir):
    return B.flagged(spark, sf_dir).where(G.any_of(F.col("flags"), "high_symbol_ratio", "high_whitespace_noise")).select("doc_id")


@query("FLT-17", B.with_views("flagged", "SELECT doc FROM flagged GROUP BY doc HAVING bool_or(list_has_any(flags, ['suspected_scanned_page', 'suspected_garbled_text']))"))
def flt17(spark, sf_dir):
    return B.flagged(spark, sf_dir).groupBy("doc").agg(G.document_rollup().alias("f")).where(G.has(F.col("f"), "manual_review_recommended")).select("doc")


@query("FLT-20", B.with_views("pages", "SELECT doc FROM pages GROUP BY doc HAVING bool_and(content <> '')"))
def flt20(spark, sf_dir):
    return B.pages(spark, sf_dir).groupBy("doc").agg(F.bool_and(F.col("content") != "").alias("done")).where("done").select("doc")


@query("FLT-26", B.with_views("claims", "SELECT DISTINCT thread_id FROM claims WHERE status = 'active' AND worker LIKE 'worker_%'"))
def flt26(spark, sf_dir):
    return B.claims(spark, sf_dir).where((F.col("status") == "active") & F.col("worker").like("worker_%")).select("thread_id").distinct()


@query("FLT-28", B.with_views("items", "SELECT thread_id, seq FROM items WHERE item_type = 'message' AND thread_id IN (1, 2) ORDER BY thread_id, seq DESC LIMIT 5"))
def flt28(spark, sf_dir):
    return B.items(spark, sf_dir).where("item_type = 'message' and thread_id in (1, 2)").select("thread_id", "seq").orderBy("thread_id", F.desc("seq")).limit(5)


@query("FLT-29", B.with_views("claims", "SELECT turn_id, queued_at FROM claims WHERE phase = 'executing_tools' AND status IN ('queued', 'active')"))
def flt29(spark, sf_dir):
    return B.claims(spark, sf_dir).where((F.col("phase") == "executing_tools") & F.col("status").isin("queued", "active")).select("turn_id", "queued_at")


@query("PAG-04", B.with_views("claims", "SELECT turn_id, thread_id FROM claims WHERE thread_id = 8 ORDER BY queued_at, turn_id LIMIT 10 OFFSET 10"))
def pag04(spark, sf_dir):
    return B.claims(spark, sf_dir).where("thread_id = 8").orderBy("queued_at", "turn_id").offset(10).limit(10).select("turn_id", "thread_id")


@query("JOI-08", B.with_views("claims", "SELECT turn_id, thread_id FROM claims WHERE turn_id = (SELECT min(turn_id) FROM claims WHERE status = 'queued' AND worker IS NULL)"))
def joi08(spark, sf_dir):
    c = B.claims(spark, sf_dir)
    first = c.where("status = 'queued' and worker is null").agg(F.min("turn_id").alias("turn_id"))
    return c.join(first, "turn_id", "left_semi").select("turn_id", "thread_id")


@query("JOI-13", B.with_views("items", "SELECT a.thread_id, a.seq AS asked, b.seq AS answered FROM items a JOIN items b ON a.thread_id = b.thread_id AND b.seq = a.seq + 1 WHERE a.role = 'user' AND b.role = 'assistant'"))
def joi13(spark, sf_dir):
    i = B.items(spark, sf_dir)
    asked = i.where("role = 'user'").select("thread_id", F.col("seq").alias("asked"), (F.col("seq") + 1).alias("answered"))
    return asked.join(i.where("role = 'assistant'").select("thread_id", F.col("seq").alias("answered")), ["thread_id", "answered"]).select("thread_id", "asked", "answered")


@query("JOI-17", B.with_views("contracts parties", "SELECT doc, coalesce(buyer, filename) AS label FROM contracts LEFT JOIN parties USING (doc)"))
def joi17(spark, sf_dir):
    return B.contracts(spark, sf_dir).join(B.parties(spark, sf_dir), "doc", "left").select("doc", F.coalesce("buyer", "filename").alias("label"))


@query("AGG-25", B.with_views("flagged", "SELECT count(*) AS pages, CAST(count_if(chars = 0) AS BIGINT) AS blank, CAST(count_if(list_contains(flags, 'ocr_recommended')) AS BIGINT) AS ocr, CAST(count_if(len(flags) > 0) AS BIGINT) AS flagged FROM flagged"))
def agg25(spark, sf_dir):
    return B.flagged(spark, sf_dir).agg(F.count("*").alias("pages"), F.count_if(F.col("chars") == 0).alias("blank"), F.count_if(G.has(F.col("flags"), "ocr_recommended")).alias("ocr"), F.count_if(F.size("flags") > 0).alias("flagged"))


@query("AGG-28", B.with_views("notes", "SELECT doc, CAST((governing IS NOT NULL)::INT + (change IS NOT NULL)::INT AS INTEGER) AS citations FROM notes"))
def agg28(spark, sf_dir):
    return B.notes(spark, sf_dir).select("doc", F.size(F.array_compact(F.array("governing", "change"))).alias("citations"))


@query("WIN-10", B.with_views("variants", "SELECT doc, tokens FROM (SELECT doc, CAST(sum(CAST(ceil(length(content) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM variants WHERE representation = 'markdown' GROUP BY doc) WHERE tokens > 0 ORDER BY tokens DESC, doc LIMIT 15"))
def win10(spark, sf_dir):
    t = B.variants(spark, sf_dir).where("representation = 'markdown'").groupBy("doc").agg(F.sum(T.inventory_tokens(F.col("content"))).alias("tokens"))
    return t.where("tokens > 0").orderBy(F.desc("tokens"), "doc").limit(15)


@query("WIN-11", B.with_views("flagged classification", "SELECT doc, page, confidence FROM (SELECT f.doc, f.page, confidence, row_number() OVER (PARTITION BY f.doc ORDER BY confidence NULLS LAST, len(flags) DESC, f.page) AS r FROM flagged f LEFT JOIN classification c ON f.doc = c.doc) WHERE r = 1"))
def win11(spark, sf_dir):
    j = B.flagged(spark, sf_dir).select("doc", "page", F.size("flags").alias("n")).join(B.classification(spark, sf_dir).select("doc", "confidence"), "doc", "left")
    w = Window.partitionBy("doc").orderBy(F.col("confidence").asc_nulls_last(), F.desc("n"), "page")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", "page", "confidence")


@query("WIN-12", "SELECT user_id, CASE WHEN best >= flat + 5 THEN rot ELSE 0 END AS rotation FROM (SELECT user_id, max(s) AS best, coalesce(max(s) FILTER (rot = 0), 0) AS flat, arg_max(rot, struct_pack(a := s, b := -rot)) AS rot FROM (SELECT user_id, event_id % 4 * 90 AS rot, max(value) AS s FROM events GROUP BY ALL) GROUP BY user_id)")
def win12(spark, sf_dir):
    s = B.read(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4 * 90).alias("rot")).agg(F.max("value").alias("s"))
    b = s.groupBy("user_id").agg(F.max("s").alias("best"), F.coalesce(F.max(F.when(F.col("rot") == 0, F.col("s"))), F.lit(0.0)).alias("flat"), F.max_by("rot", F.struct("s", (-F.col("rot")).alias("low"))).alias("rot"))
    return b.select("user_id", F.when(F.col("best") >= F.col("flat") + 5, F.col("rot")).otherwise(F.lit(0)).alias("rotation"))


@query("WIN-14", B.with_views("claims", "SELECT thread_id, max(queued_at) AS updated FROM claims GROUP BY thread_id ORDER BY updated DESC, thread_id LIMIT 20"))
def win14(spark, sf_dir):
    return B.claims(spark, sf_dir).groupBy("thread_id").agg(F.max("queued_at").alias("updated")).orderBy(F.desc("updated"), "thread_id").limit(20)


@query("WIN-19", B.with_views("flagged", "SELECT doc_id, CASE WHEN repair_path IS NOT NULL THEN 'repair_markdown' WHEN markdown_path IS NOT NULL THEN 'markdown' WHEN vision_path IS NOT NULL THEN 'vision_markdown' WHEN ocr_path IS NOT NULL THEN 'ocr_text' ELSE 'text' END AS best FROM flagged"))
def win19(spark, sf_dir):
    given = [F.when(F.col(c).isNotNull(), n) for c, n in (("repair_path", "repair_markdown"), ("markdown_path", "markdown"), ("vision_path", "vision_markdown"), ("ocr_path", "ocr_text"))]
    return B.flagged(spark, sf_dir).select("doc_id", F.coalesce(*given, F.lit("text")).alias("best"))


@query("SET-05", B.with_views("variants classification", "SELECT DISTINCT doc FROM variants EXCEPT SELECT doc FROM classification"))
def set05(spark, sf_dir):
    return B.variants(spark, sf_dir).select("doc").distinct().join(B.classification(spark, sf_dir), "doc", "left_anti")


@query("SET-06", B.with_views("flagged", f"SELECT doc, page FROM ({ROUTED}) WHERE markdown UNION ALL SELECT doc, page FROM ({ROUTED}) WHERE vision"))
def set06(spark, sf_dir):
    """In one pass: a page that is a candidate for both comes twice."""
    picks = F.array_compact(F.array(F.when(F.col("markdown"), 1), F.when(F.col("vision"), 1)))
    return routed(spark, sf_dir).select("doc", "page", F.explode(picks).alias("pick")).drop("pick")


@query("STR-14", B.with_views("classification", "SELECT doc, CASE stage WHEN 'active_change' THEN 'Active Change' WHEN 'contracting' THEN 'Contracting' ELSE 'Compliance' END AS label FROM classification"))
def str14(spark, sf_dir):
    return B.classification(spark, sf_dir).select("doc", T.title_case(F.col("stage")).alias("label"))


@query("STR-19", B.with_views("notes", "SELECT doc, nullif(concat_ws(chr(10), 'Governing: ' || governing, 'Change: ' || change), '') AS body FROM notes"))
def str19(spark, sf_dir):
    return B.notes(spark, sf_dir).select("doc", F.nullif(F.concat_ws("\n", F.concat(F.lit("Governing: "), "governing"), F.concat(F.lit("Change: "), "change")), F.lit("")).alias("body"))


@query("STR-27", "SELECT event_id, 'k=' || regexp_extract(props, '[0-9]+') AS arguments FROM events")
def str27(spark, sf_dir):
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    return B.read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ", ").alias("arguments"))


METHOD = "CASE doc_id % 3 WHEN 0 THEN 'pdf_text' WHEN 1 THEN 'ocr' ELSE 'vision' END"
LOWEST = "[" + ", ".join(f"'{f}'" for f in G.LOW_QUALITY) + "]"
POOR = "[" + ", ".join(f"'{f}'" for f in G.OCR_POOR) + "]"


@query("MTH-05", B.with_views("ocr_pages", f"""SELECT doc_id, CASE {METHOD} WHEN 'ocr' THEN CASE WHEN list_contains(flags, 'ocr_failed') OR chars = 0 THEN 'ocr_failed'
    WHEN conf >= 80 AND NOT list_has_any(flags, {POOR}) THEN 'ocr_high_confidence' WHEN conf >= 50 AND NOT list_has_any(flags, ['ocr_suspected_garbled_text', 'ocr_not_better_than_pdf_text']) THEN 'ocr_medium_confidence'
    WHEN list_has_any(flags, {POOR}) THEN 'ocr_low_confidence' WHEN chars >= greatest(pdf_chars, 80) THEN 'ocr_medium_confidence' ELSE 'ocr_low_confidence' END
  WHEN 'pdf_text' THEN CASE WHEN list_has_any(list_concat(flags, page_flags), {LOWEST}) THEN 'pdf_text_low_confidence' ELSE 'pdf_text_high_confidence' END ELSE 'other_or_unknown' END AS bucket FROM ocr_pages"""))
def mth05(spark, sf_dir):
    """Each way that a page's text was got, with the flags of that way."""
    k = F.col("doc_id") % 3
    method = F.when(k == 0, "pdf_text").when(k == 1, "ocr").otherwise("vision")
    flags = F.when(k == 0, F.concat("flags", "page_flags")).otherwise(F.col("flags"))
    return B.ocr_pages(spark, sf_dir).select("doc_id", G.confidence_bucket(method, flags, F.col("conf"), F.col("chars"), F.col("pdf_chars")).alias("bucket"))


@query("MTH-07", B.with_views("ocr_pages", "SELECT doc_id, array_to_string(flags, ',') AS flags FROM ocr_pages"))
def mth07(spark, sf_dir):
    return B.ocr_pages(spark, sf_dir).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("COE-10", B.with_views("notes", "SELECT doc, k AS clause, c AS citation, k * 100 + c AS ordinal FROM notes, (SELECT unnest(range(2)) AS k), (SELECT unnest(range(3)) AS c) WHERE change IS NOT NULL"))
def coe10(spark, sf_dir):
    clauses = F.array(*[F.array(*[F.lit(c) for c in range(3)]) for _ in range(2)])
    n = B.notes(spark, sf_dir).where("change is not null").select("doc", F.posexplode(clauses).alias("clause", "cited")).select("doc", "clause", F.posexplode("cited").alias("citation", "c"))
    return n.select("doc", F.col("clause").cast("long").alias("clause"), F.col("citation").cast("long").alias("citation"), (F.col("clause") * 100 + F.col("citation")).cast("long").alias("ordinal"))


@query("PRJ-25", B.with_views("contracts parties", "SELECT doc, filename, seller FROM contracts LEFT JOIN parties USING (doc) WHERE contains(lower(filename), 'src1') OR contains(lower(seller), 'src1')"))
def prj25(spark, sf_dir):
    j = B.contracts(spark, sf_dir).join(B.parties(spark, sf_dir), "doc", "left")
    return j.where(matches("SRC1", "filename", "seller")).select("doc", "filename", "seller")
