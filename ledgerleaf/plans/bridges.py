"""Views of the driver's tables in the shape of the document mart, and the same views as DuckDB SQL.

Four rows of `documents` make the pages of one contract; labels give its classification, the star schema its buyers and
sellers, conversations the timeline of a thread, events the attempts and claims of a queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags as G
from ..functions import text as T

#: representation, priority, divisor of the page id at which it exists, divisor at which it is blank
REPRESENTATIONS = (("repair_markdown", 1, 11, 22), ("markdown", 2, 5, 10), ("vision_markdown", 3, 3, 9), ("ocr_text", 4, 2, 14), ("text", 5, 1, 97))

#: What some pages hold instead of their text, as a bad scan would give; others hold nothing.
GARBLED = "#7 |~ 41% ^^ 9/3 |" * 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns that are costly: each is computed once for a row, whatever reads it later.

    A filter on a computed column is moved beneath it with a copy of its expression for each use; none moves beneath a
    generator whose output it reads.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_made")
    return rows.select("*", made).select(*kept, *[F.col(f"_made.{name}").alias(name) for name in columns])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    doc = F.floor(F.col("doc_id") / 4)
    return d.select(
        doc.alias("doc"),
        (F.col("doc_id") % 4 + 1).alias("page"),
        "doc_id",
        F.when(F.col("doc_id") % 23 == 0, "").when(F.col("doc_id") % 29 == 0, GARBLED).otherwise(F.coalesce("text", F.lit(""))).alias("content"),
        F.concat_ws("_", "source", "lang", F.concat(doc.cast("string"), F.lit(".pdf"))).alias("filename"),
        "lang",
        "source",
        (F.col("doc_id") % 6 == 0).alias("images"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contract: the first of its pages names it."""
    return pages(spark, sf_dir).groupBy("doc").agg(F.min_by("filename", "page").alias("filename"), F.count("*").alias("page_count"), F.sum(F.length("content")).alias("size_bytes"), F.min_by("lang", "page").alias("lang"))


def _signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with normalised text, its ratios and their flags."""
    p = pages(spark, sf_dir).withColumn("norm", T.normalize_page(F.col("content")))
    p = T.with_ratios(p, "norm")
    flags = G.page_signals(F.col("norm"), F.col("images"), (F.col("alpha"), F.col("symbol"), F.col("newline")), F.col("chars"))
    return once(p.drop("content"), norm=F.col("norm"), chars=F.col("chars"), alpha=F.col("alpha"), symbol=F.col("symbol"), newline=F.col("newline"), flags=flags)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with normalised text, signals, and made-up artifact paths."""
    p = _signalled(spark, sf_dir)
    path = lambda k, name: F.when(F.col("doc_id") % k == 0, F.concat(F.lit(f"{name}/"), F.col("doc_id").cast("string")))
    return p.select("doc", "page", "doc_id", "filename", "norm", "chars", "flags", "images", path(2, "ocr").alias("ocr_path"), path(5, "md").alias("markdown_path"), path(11, "repair").alias("repair_path"), path(9, "vision").alias("vision_path"), path(6, "image").alias("image_path"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each representation that a page has; some are blank on purpose."""
    one = [F.when(F.col("doc_id") % every == 0, F.struct(F.lit(name).alias("representation"), F.lit(rank).alias("priority"), F.when(F.col("doc_id") % blank == 0, "").otherwise(F.col("content")).alias("content"))) for name, rank, every, blank in REPRESENTATIONS]
    p = pages(spark, sf_dir).select("doc", "page", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("v"))
    return p.select("doc", "page", "v.*")


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "labels").where("doc_id % 4 = 0")
    doc = F.floor(F.col("doc_id") / 4)
    stage = F.when(F.col("toxic") == 1, "compliance").when(F.col("quality") == 1, "contracting").otherwise("active_change")
    role = F.when(F.col("toxic") == 1, "context").when(F.col("quality") == 1, "operative").otherwise("delta")
    kind = F.when((F.coalesce(F.col("toxic"), F.lit(0)) != 1) & (F.coalesce(F.col("quality"), F.lit(0)) != 1), F.when(doc % 2 == 0, "amendment").otherwise("pricing_update"))
    return first.select(doc.alias("doc"), stage.alias("stage"), role.alias("role"), kind.alias("change_kind"), (F.lit(0.5) + F.col("doc_id") % 50 / 100).alias("confidence"))


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer and seller of every third contract left out, of some only one."""
    c = contracts(spark, sf_dir).select("doc").where("doc % 3 != 2")
    buyer = F.when(F.col("doc") % 5 != 0, F.concat(F.lit("Buyer "), (F.col("doc") % 17).cast("string")))
    seller = F.when(F.col("doc") % 7 != 0, F.concat(F.lit("seller "), (F.col("doc") % 13).cast("string")))
    return c.select("doc", buyer.alias("buyer"), seller.alias("seller"), F.concat(F.lit("category "), (F.col("doc") % 4).cast("string")).alias("category"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by contract: governing, change and page notes that are already done."""
    c = classification(spark, sf_dir)
    return c.select("doc", F.when((F.col("stage") == "contracting") & (F.col("doc") % 2 == 0), F.concat(F.lit("Governs "), F.col("doc").cast("string"))).alias("governing"), F.when((F.col("stage") == "active_change") & (F.col("doc") % 3 != 0), F.concat(F.lit("Changes "), F.col("doc").cast("string"))).alias("change"), (F.col("doc") % 4 == 1).alias("page_notes"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their parties: the workload that grows."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.when(F.col("l_orderkey") % 50 != 0, F.col("c_name")).alias("buyer"), F.when(F.col("l_orderkey") % 40 == 0, F.lit(" ")).otherwise(F.col("s_name")).alias("seller"), F.col("p_type").alias("category"), F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("unclear").alias("gate"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "reasoning").otherwise("message")
    return c.select(F.col("conv_id").alias("thread_id"), (F.col("turn") + 1).alias("seq"), kind.alias("item_type"), "role", F.col("text").alias("content_text"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of a queue: who holds each, in which phase, and the last heartbeat."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    k = F.col("event_id")
    return e.select(
        k.alias("turn_id"),
        F.col("user_id").alias("thread_id"),
        F.when(k % 3 == 0, "queued").when(k % 3 == 1, "active").otherwise("completed").alias("status"),
        F.when(k % 4 == 0, "executing_model").when(k % 4 == 1, "executing_tools").otherwise("assembling_context").alias("phase"),
        F.when(k % 5 != 0, F.concat(F.lit("worker_"), (k % 7).cast("string"))).alias("worker"),
        F.when(k % 5 != 0, T.seconds(F.col("ts"))).alias("beat"),
        T.seconds(F.col("ts")).alias("queued_at"),
    )


def turn_calls(spark: SparkSession, sf_dir: str, tools: bool) -> DataFrame:
    """Events as model calls, or tool calls, of the turns that are in that phase: four calls a turn."""
    e, k = read(spark, sf_dir, "events").select("event_id", "ts"), F.col("event_id")
    turn = k - k % 4 + int(tools)
    return e.select(k.alias("call_id"), turn.alias("turn_id"), F.when(k % 3 == 1, "running").otherwise("completed").alias("status"), F.when(k % 7 != 0, T.seconds(F.col("ts"))).alias("beat"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the flags that a recogniser's run leaves; some images are blank or hold little."""
    p, k = _signalled(spark, sf_dir).withColumn("numeric", T.numeric_token_ratio(F.col("norm"))), F.col("doc_id")
    found = G.ocr_signals(F.col("norm"), k % 100, k % 7 * 400, k % 5 < 2, k % 3 == 0, (F.col("alpha"), F.col("symbol"), F.col("newline"), F.col("numeric")), F.col("chars"))
    p = once(p.withColumnRenamed("flags", "page_flags"), flags=found)
    return p.select("doc", "page", "doc_id", "chars", (k % 100).alias("conf"), (k % 7 * 400).alias("pdf_chars"), "flags", "page_flags")


#: The same views for DuckDB; a query names those it needs.
SQL = {
    "model_calls": """SELECT event_id AS call_id, event_id - event_id % 4 AS turn_id, CASE event_id % 3 WHEN 1 THEN 'running' ELSE 'completed' END AS status, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000000 END AS beat FROM events""",
    "tool_calls": """SELECT event_id AS call_id, event_id - event_id % 4 + 1 AS turn_id, CASE event_id % 3 WHEN 1 THEN 'running' ELSE 'completed' END AS status, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000000 END AS beat FROM events""",
    "ocr_pages": r"""SELECT doc, page, doc_id, chars, conf, p AS pdf_chars, flags AS page_flags, list_filter(['ocr_attempted', CASE WHEN low THEN 'likely_low_information_page' END, CASE WHEN low THEN 'skip_llm_repair' END, CASE WHEN blank THEN 'likely_blank_page' END,
        CASE WHEN blank AND NOT low THEN 'skip_llm_repair' END, CASE WHEN n > 0 THEN 'ocr_succeeded' ELSE 'ocr_failed' END, CASE WHEN n > 0 AND n < 40 THEN 'ocr_low_text_density' END,
        CASE WHEN n > 0 AND conf < 55 THEN 'ocr_low_confidence' END, CASE WHEN n >= 40 AND alpha < 0.35 THEN 'ocr_suspected_garbled_text' END, CASE WHEN n >= 40 AND symbol > 0.35 THEN 'ocr_high_symbol_ratio' END,
        CASE WHEN n >= 80 AND newline > 0.12 THEN 'ocr_high_whitespace_noise' END, CASE WHEN n > 0 AND form THEN 'ocr_possible_table_or_form_content' END, CASE WHEN n > 0 AND conf < 45 AND n < greatest(p, 80) THEN 'ocr_possible_handwriting' END,
        CASE WHEN n > p + 50 THEN 'ocr_improved_over_pdf_text' WHEN n > 0 THEN 'ocr_not_better_than_pdf_text' END, CASE WHEN n > 0 AND form THEN 'llm_markdown_recommended' END,
        CASE WHEN (n = 0 AND NOT blank AND NOT low) OR (n > 0 AND (n < 40 OR conf < 55 OR (n >= 40 AND alpha < 0.35) OR (conf < 45 AND n < greatest(p, 80)))) THEN 'llm_repair_recommended' END], lambda x: x IS NOT NULL) AS flags
        FROM (SELECT *, chars AS n, chars < 15 AND doc_id % 5 < 2 AS blank, chars < 15 AND doc_id % 3 = 0 AS low, doc_id % 100 AS conf, doc_id % 7 * 400 AS p,
            len(list_filter(w, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= greatest(1, length(x) // 2))) / greatest(len(w), 1) > 0.3 AS form
            FROM (SELECT *, list_filter(regexp_split_to_array(norm, '\s+'), lambda x: x <> '') AS w FROM flagged))""",
    "pages": """SELECT doc_id // 4 AS doc, doc_id % 4 + 1 AS page, doc_id,
        CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 29 = 0 THEN '%s' ELSE coalesce(text, '') END AS content,
        concat_ws('_', source, lang, (doc_id // 4) || '.pdf') AS filename, lang, source, doc_id % 6 = 0 AS images FROM documents""".replace("%s", GARBLED),
    "contracts": """SELECT doc, arg_min(filename, page) AS filename, count(*) AS page_count, CAST(sum(length(content)) AS BIGINT) AS size_bytes, arg_min(lang, page) AS lang FROM pages GROUP BY doc""",
    "norm": r"""SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS norm FROM pages""",
    "ratios": r"""SELECT *, length(norm) AS chars, length(regexp_replace(norm, '[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) AS solid,
        length(regexp_replace(norm, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(norm, '[\p{L}\p{N}\s]', '', 'g')) AS symbols, length(norm) - length(replace(norm, chr(10), '')) AS breaks FROM norm""",
    "signals": """SELECT *, CASE WHEN solid > 0 THEN letters / solid ELSE 0.0 END AS alpha, CASE WHEN solid > 0 THEN symbols / solid ELSE 0.0 END AS symbol, CASE WHEN chars > 0 THEN breaks / chars ELSE 0.0 END AS newline FROM ratios""",
    "flagged": """SELECT *, list_filter([
        CASE WHEN chars = 0 THEN 'no_text_extracted' END, CASE WHEN chars > 0 AND chars < 40 THEN 'low_text_density' END,
        CASE WHEN images AND chars = 0 THEN 'suspected_image_only_page' END, CASE WHEN images AND chars = 0 THEN 'suspected_scanned_page' END,
        CASE WHEN images AND chars < 40 THEN 'image_render_recommended' END, CASE WHEN alpha < 0.35 AND chars >= 40 THEN 'suspected_garbled_text' END,
        CASE WHEN symbol > 0.35 AND chars >= 40 THEN 'high_symbol_ratio' END, CASE WHEN newline > 0.12 AND chars >= 80 THEN 'high_whitespace_noise' END,
        CASE WHEN chars < 120 AND (contains(lower(norm), 'page ') OR contains(lower(norm), 'county') OR contains(lower(norm), 'contract') OR contains(lower(norm), 'agreement')) THEN 'possible_header_footer_only' END,
        CASE WHEN contains(norm, chr(9)) OR contains(norm, '  ') OR contains(norm, '|') THEN 'possible_table_or_form_content' END,
        CASE WHEN chars = 0 OR (alpha < 0.35 AND chars >= 40) THEN 'ocr_recommended' END], lambda x: x IS NOT NULL) AS flags,
        CASE WHEN doc_id % 2 = 0 THEN 'ocr/' || doc_id END AS ocr_path, CASE WHEN doc_id % 5 = 0 THEN 'md/' || doc_id END AS markdown_path,
        CASE WHEN doc_id % 11 = 0 THEN 'repair/' || doc_id END AS repair_path, CASE WHEN doc_id % 9 = 0 THEN 'vision/' || doc_id END AS vision_path,
        CASE WHEN doc_id % 6 = 0 THEN 'image/' || doc_id END AS image_path FROM signals""",
    "variants": " UNION ALL ".join(f"SELECT doc, page, '{n}' AS representation, {p} AS priority, CASE WHEN doc_id % {b} = 0 THEN '' ELSE content END AS content FROM pages WHERE doc_id % {e} = 0" for n, p, e, b in REPRESENTATIONS),
    "best": "SELECT * FROM variants WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY priority, representation) = 1",
    "classification": """SELECT doc_id // 4 AS doc, CASE WHEN toxic = 1 THEN 'compliance' WHEN quality = 1 THEN 'contracting' ELSE 'active_change' END AS stage,
        CASE WHEN toxic = 1 THEN 'context' WHEN quality = 1 THEN 'operative' ELSE 'delta' END AS role,
        CASE WHEN coalesce(toxic, 0) <> 1 AND coalesce(quality, 0) <> 1 THEN CASE WHEN doc_id // 4 % 2 = 0 THEN 'amendment' ELSE 'pricing_update' END END AS change_kind,
        0.5 + doc_id % 50 / 100 AS confidence FROM labels WHERE doc_id % 4 = 0""",
    "parties": """SELECT doc, CASE WHEN doc % 5 <> 0 THEN 'Buyer ' || (doc % 17) END AS buyer, CASE WHEN doc % 7 <> 0 THEN 'seller ' || (doc % 13) END AS seller, 'category ' || (doc % 4) AS category FROM contracts WHERE doc % 3 <> 2""",
    "notes": """SELECT doc, CASE WHEN stage = 'contracting' AND doc % 2 = 0 THEN 'Governs ' || doc END AS governing, CASE WHEN stage = 'active_change' AND doc % 3 <> 0 THEN 'Changes ' || doc END AS change, doc % 4 = 1 AS page_notes FROM classification""",
    "purchases": """SELECT l_orderkey * 10 + l_linenumber AS line, CASE WHEN l_orderkey % 50 <> 0 THEN c_name END AS buyer, CASE WHEN l_orderkey % 40 = 0 THEN ' ' ELSE s_name END AS seller, p_type AS category,
        CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' ELSE 'unclear' END AS gate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "items": """SELECT conv_id AS thread_id, turn + 1 AS seq, CASE role WHEN 'system' THEN 'reasoning' ELSE 'message' END AS item_type, role, text AS content_text FROM conversations""",
    "claims": """SELECT event_id AS turn_id, user_id AS thread_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'active' ELSE 'completed' END AS status,
        CASE event_id % 4 WHEN 0 THEN 'executing_model' WHEN 1 THEN 'executing_tools' ELSE 'assembling_context' END AS phase, CASE WHEN event_id % 5 <> 0 THEN 'worker_' || (event_id % 7) END AS worker,
        CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000000 END AS beat, epoch_us(ts) // 1000000 AS queued_at FROM events""",
}
NEEDS = {"ocr_pages": ["flagged"], "contracts": ["pages"], "norm": ["pages"], "ratios": ["norm"], "signals": ["ratios"], "flagged": ["signals"], "variants": ["pages"], "best": ["variants"], "parties": ["contracts"], "notes": ["classification"]}


def with_views(names: str, select: str, **more: str) -> str:
    """`select` behind the named views and those they need; `more` adds views of the query's own."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {select}"
