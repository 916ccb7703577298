"""Runs over pages: which pages go to a model or recogniser, what comes back, what becomes of page and document, and trials of a chosen few.

A page is (doc, page, flags, warnings) with the paths of its artifacts. The model is a column, a struct (result, error);
a page whose call fails keeps its place, with flags and a warning that say so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags as G
from ..plans import bridges as B
from ..plans.catalog import query
from ..plans.shared import written
from .artifacts import ORIENTED, PENDING, orientation_pending, oriented
from .chat import sample

#: Flags of pages and documents that a stage sets.
OCR_FAILED = ("ocr_attempted", "ocr_failed", "llm_repair_recommended")
MARKDOWN = ("llm_markdown_generated", "has_llm_markdown_pages")
REPAIR = ("llm_repair_generated", "has_llm_repair_pages")
VISION = ("llm_vision_markdown_generated", "has_llm_vision_markdown_pages")


def _added(items: Column, more: Sequence[Column]) -> Column:
    """A list with more at its end, each entry once, where it first stands."""
    return F.array_distinct(F.concat(items, F.array(*more)))


def run_pages(pages: DataFrame, wanted: Column, infer: Column, path: str, done: Sequence[str], failed: Sequence[str], said: str) -> DataFrame:
    """SIB-13, SIB-19, SIB-22: `pages` after a run over those that are wanted, with `outcome` (processed, failed, skipped).

    An answer is the new `path`, with the flags of `done`; a failure empties it, with the flags of `failed`, and a
    warning that names the stage. Each page is asked once: what came back is written.
    """
    asked = written(pages.withColumn("_got", F.when(wanted, infer)).withColumn("_wanted", F.coalesce(wanted, F.lit(False))), "pages")
    got, error = F.col("_got"), F.col("_got.error")
    bad = F.col("_wanted") & (error.isNotNull() | got["result"].isNull())
    outcome = F.when(~F.col("_wanted"), "skipped").when(bad, "failed").otherwise("processed")
    new = F.when(~F.col("_wanted"), F.col(path)).when(~bad, got["result"])
    flags = F.when(~F.col("_wanted"), F.col("flags")).when(bad, _added(F.col("flags"), [F.lit(f) for f in failed])).otherwise(_added(F.col("flags"), [F.lit(f) for f in done]))
    warning = F.concat(F.lit(f"{said}: "), F.coalesce(error, F.lit("empty")))
    warnings = F.when(bad, _added(F.col("warnings"), [warning])).otherwise(F.col("warnings"))
    rest = {path: new, "flags": flags, "warnings": warnings}
    return asked.select(*[(rest[c].alias(c) if c in rest else F.col(c)) for c in pages.columns], outcome.alias("outcome"))


def run_counts(pages: DataFrame) -> DataFrame:
    """SIB-14, SIB-19, SIB-22: candidate_documents, processed_documents, processed_pages, failed_pages of a run's pages."""
    each = pages.groupBy("doc").agg(F.count_if(F.col("outcome") == "processed").alias("processed"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    ran = F.col("processed") + F.col("failed")
    return each.agg(F.count_if(ran > 0).alias("candidate_documents"), F.count_if(F.col("processed") > 0).alias("processed_documents"), F.coalesce(F.sum("processed"), F.lit(0)).alias("processed_pages"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_pages"))


def document_flags(documents: DataFrame, pages: DataFrame, made: str, has: str) -> DataFrame:
    """SIB-21, SIB-23: documents (doc, flags) whose flag `has` says whether any page has `made`; it comes last, the others keep their order."""
    any_made = pages.groupBy("doc").agg(F.bool_or(G.has(F.col("flags"), made)).alias("_any"))
    rest = F.array_distinct(G.without(F.col("flags"), has))
    flags = F.when(F.coalesce("_any", F.lit(False)), F.array_append(rest, F.lit(has))).otherwise(rest)
    return documents.join(any_made, "doc", "left").withColumn("flags", flags).drop("_any")


def apply_pages(pages: DataFrame, staged: DataFrame, done: Column, values: dict[str, Column], already: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """SIB-25, SIB-29: pages with what was staged for them (doc, page, ...), and the outcome of each staged row.

    `page_not_found` where there is no such page; `already` where `done` holds, unless forced; else `applied`, and the
    page takes `values`, columns over the page and the staged row as `s`.
    """
    p, s = pages.alias("p"), staged.alias("s")
    same = (F.col("p.doc") == F.col("s.doc")) & (F.col("p.page") == F.col("s.page"))
    judged = s.join(p.withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("_there", F.lit(True)).alias("p"), same, "left")
    outcome = F.when(F.col("_there").isNull(), "page_not_found").when(F.col("_done") & ~F.lit(force), already).otherwise("applied")
    outcomes = judged.select("s.doc", "s.page", outcome.alias("outcome"))
    kept = staged.join(outcomes.where("outcome = 'applied'").select("doc", "page").distinct(), ["doc", "page"], "left_semi").dropDuplicates(["doc", "page"]).withColumn("_hit", F.lit(True))
    met = p.join(kept.alias("s"), same, "left")
    return met.select(*[(F.when(F.col("_hit"), values[c]).otherwise(F.col(f"p.{c}")) if c in values else F.col(f"p.{c}")).alias(c) for c in pages.columns]), outcomes


def usage_totals(summaries: DataFrame, tokens: Sequence[str] = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")) -> DataFrame:
    """SIB-31, SIB-51: documents_with_usage and totals over documents (doc, usage: a struct of tokens, or null); no row where no document has any."""
    with_usage = summaries.where("usage is not null")
    return with_usage.agg(F.count("*").alias("documents_with_usage"), *[F.coalesce(F.sum(F.col(f"usage.{t}")), F.lit(0)).alias(t) for t in tokens]).where("documents_with_usage > 0")


def reported_targets(reports: DataFrame) -> DataFrame:
    """SIB-18: run, doc, page: the targets of stored reports (run, body); reports that can't be read have none."""
    body = F.from_json("body", "targets array<struct<doc_id:long,page_number:long>>")
    return reports.select("run", F.explode(body["targets"]).alias("t")).select("run", F.col("t.doc_id").alias("doc"), F.col("t.page_number").alias("page"))


def there(rows: DataFrame, files: DataFrame, **paths: str) -> DataFrame:
    """`rows` with a boolean for each name in `paths`: whether the file that the column names is among `files` (path); no path is no file."""
    known = files.select("path").distinct()
    for name, column in paths.items():
        met = known.select(F.col("path").alias("_path"), F.lit(True).alias("_there"))
        rows = rows.join(met, F.col(column) == F.col("_path"), "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_path", "_there")
    return rows


def complete_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """SIB-05: pages (text_path, image_path, flags) with `complete`: the text is there, and the image too where flags ask for one."""
    asks = G.any_of(F.col("flags"), "image_render_recommended", "ocr_recommended")
    return there(pages, files, _text="text_path", _image="image_path").withColumn("complete", F.col("_text") & (~F.coalesce(asks, F.lit(False)) | F.col("_image"))).drop("_text", "_image")


def pending_images(pages: DataFrame, files: DataFrame) -> DataFrame:
    """SIB-08: pages whose image is pending and there, and whose validated copy, if one is named, isn't."""
    found = there(pages.where(orientation_pending()), files, _image="image_path", _valid="valid_path")
    return found.where("_image and not _valid").drop("_image", "_valid")


#: Fixed value: what an assembled document is called among a document's artifacts.
ASSEMBLED = "Canonical normalized document assembled from the best available page representation."


def assembled_report(documents: DataFrame) -> DataFrame:
    """SIB-39: doc, filename, path: the first XML artifact of each document (doc, filename, artifacts) that is called the assembled one; null without."""
    fits = F.filter("artifacts", lambda a: (a["kind"] == "xml") & (a["description"] == ASSEMBLED))
    return documents.select("doc", "filename", F.get(F.transform(fits, lambda a: a["path"]), F.lit(0)).alias("path"))


def flat_export(candidates: DataFrame, files: DataFrame, names: Sequence[str], folder: str) -> DataFrame:
    """SNK-16: candidates (doc, page, and a path column for each name) with `linked`: for each artifact that is there the flat name it is exported by."""
    found = there(candidates, files, **{f"_{n}": n for n in names})
    flat = lambda n: F.concat(F.lit(f"{folder}/"), F.concat_ws("__", "doc", F.concat(F.lit("p"), F.lpad(F.col("page").cast("string"), 4, "0")), F.lit(n)))
    linked = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"_{n}"), F.struct(F.lit(n).alias("key"), flat(n).alias("value"))) for n in names])))
    return found.withColumn("linked", linked).drop(*[f"_{n}" for n in names])


def triage(images: DataFrame) -> DataFrame:
    """SIB-32 with UDF-24: images (mean, var, white, black) with what they are taken for, and `keep`: those that hold enough. The bounds."""
    blank = (F.col("mean") >= 248) & (F.col("var") <= 12) & (F.col("white") >= 0.985)
    low = ((F.col("var") <= 12) & (F.col("white") >= 0.985)) | ((F.col("black") >= 0.97) & (F.col("mean") <= 20) & (F.col("var") <= 150))
    return images.withColumns({"likely_blank": blank, "likely_low_information": low, "keep": ~low})


# ---- over the test tables

PAGES = "SELECT doc, page, doc_id, filename, flags, CASE WHEN doc_id % 10 = 1 THEN ['old'] ELSE CAST([] AS VARCHAR[]) END AS warnings, ocr_path, markdown_path, repair_path, vision_path, image_path FROM flagged"


def all_pages(spark, sf_dir: str) -> DataFrame:
    f = B.flagged(spark, sf_dir)
    warnings = F.when(F.col("doc_id") % 10 == 1, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>"))
    return f.select("doc", "page", "doc_id", "filename", "flags", warnings.alias("warnings"), "ocr_path", "markdown_path", "repair_path", "vision_path", "image_path")


def _answers(name: str, every: int) -> Column:
    """A made-up recogniser: every so manieth page fails, some come back empty."""
    k = F.col("doc_id")
    return F.struct(F.when((k % every != 0) & (k % (every + 2) != 1), F.concat(F.lit(f"{name}/new/"), k.cast("string"))).alias("result"), F.when(k % every == 0, F.concat(F.lit("no answer to "), k.cast("string"))).alias("error"))


_FLAGS = "array_to_string(flags, ',') AS flags, array_to_string(warnings, ',') AS warnings"


def _after(wanted: str, path: str, name: str, every: int, done: Sequence[str], failed: Sequence[str], said: str) -> str:
    once = lambda names: f"list_concat(flags, list_filter({list(names)!r}, lambda f: NOT list_contains(flags, f)))" if names else "flags"
    return f"""SELECT doc, page, doc_id, CASE outcome WHEN 'skipped' THEN {path} WHEN 'processed' THEN '{name}/new/' || doc_id END AS path, CASE outcome WHEN 'skipped' THEN flags WHEN 'failed' THEN {once(failed)} ELSE {once(done)} END AS flags,
      CASE WHEN outcome = 'failed' THEN list_append(warnings, '{said}: ' || CASE WHEN doc_id % {every} = 0 THEN 'no answer to ' || doc_id ELSE 'empty' END) ELSE warnings END AS warnings, outcome
      FROM (SELECT *, CASE WHEN NOT ({wanted}) THEN 'skipped' WHEN doc_id % {every} = 0 OR doc_id % {every + 2} = 1 THEN 'failed' ELSE 'processed' END AS outcome FROM ({PAGES}))"""


OCR_WANTED = "ocr_path IS NULL AND list_has_any(flags, {})"
_TRIGGERS = list(G.OCR_TRIGGERS)
OCR_RUN = _after(OCR_WANTED.format(repr(_TRIGGERS)), "ocr_path", "ocr", 7, ("ocr_attempted", "ocr_succeeded"), OCR_FAILED, "OCR: OCR failed")
TABLES_WANTED = "markdown_path IS NULL AND list_has_any(flags, ['possible_table_or_form_content']) AND (ocr_path IS NOT NULL OR list_has_any(flags, ['suspected_scanned_page', 'suspected_image_only_page']))"
MARKDOWN_RUN = _after(TABLES_WANTED, "markdown_path", "md", 5, MARKDOWN[:1], (), "LLM markdown")
GARBLED_WANTED = "repair_path IS NULL AND ocr_path IS NULL AND (list_contains(flags, 'suspected_garbled_text') OR (list_contains(flags, 'no_text_extracted') AND list_contains(flags, 'ocr_recommended')))"
REPAIR_RUN = _after(GARBLED_WANTED, "repair_path", "repair", 6, REPAIR[:1], (), "LLM repair")


def ocr_run(spark, sf_dir: str) -> DataFrame:
    return run_pages(all_pages(spark, sf_dir), G.ocr_target(F.col("flags"), F.col("ocr_path")), _answers("ocr", 7), "ocr_path", ("ocr_attempted", "ocr_succeeded"), OCR_FAILED, "OCR: OCR failed")


def markdown_run(spark, sf_dir: str) -> DataFrame:
    return run_pages(all_pages(spark, sf_dir), G.markdown_candidate(F.col("flags"), F.col("ocr_path"), F.col("markdown_path")), _answers("md", 5), "markdown_path", MARKDOWN[:1], (), "LLM markdown")


def repair_run(spark, sf_dir: str) -> DataFrame:
    return run_pages(all_pages(spark, sf_dir), G.repair_candidate(F.col("flags"), F.col("ocr_path"), F.col("repair_path")), _answers("repair", 6), "repair_path", REPAIR[:1], (), "LLM repair")


def _run_queries(one: str, corpus: str, run, sql: str, path: str) -> None:
    if one:

        @query(one, B.with_views("flagged", f"SELECT doc, page, path, {_FLAGS}, outcome FROM r", r=sql))
        def pages(spark, sf_dir):
            """Every page after the run."""
            return run(spark, sf_dir).select("doc", "page", F.col(path).alias("path"), F.array_join("flags", ",").alias("flags"), F.array_join("warnings", ",").alias("warnings"), "outcome")

    @query(corpus, B.with_views("flagged", "SELECT count(DISTINCT doc) FILTER (outcome <> 'skipped') AS candidate_documents, count(DISTINCT doc) FILTER (outcome = 'processed') AS processed_documents, count(*) FILTER (outcome = 'processed') AS processed_pages, count(*) FILTER (outcome = 'failed') AS failed_pages FROM r", r=sql))
    def counts(spark, sf_dir):
        return run_counts(run(spark, sf_dir))


_run_queries("SIB-13", "SIB-14", ocr_run, OCR_RUN, "ocr_path")
_run_queries("SIB-19-pages", "SIB-19", markdown_run, MARKDOWN_RUN, "markdown_path")
_run_queries("SIB-22-pages", "SIB-22", repair_run, REPAIR_RUN, "repair_path")


def _roll_query(name: str, run, sql: str, made: str, has: str) -> None:
    base = f"CASE WHEN doc % 3 = 0 THEN ['{has}', 'has_scanned_pages'] WHEN doc % 3 = 1 THEN ['mixed_text_quality'] ELSE CAST([] AS VARCHAR[]) END"

    @query(name, B.with_views("flagged", f"SELECT doc, array_to_string(list_concat(list_filter({base}, lambda f: f <> '{has}'), CASE WHEN found THEN ['{has}'] ELSE [] END), ',') AS flags FROM (SELECT doc, bool_or(list_contains(flags, '{made}')) AS found FROM r GROUP BY doc)", r=sql))
    def rolled(spark, sf_dir):
        """Flags of documents after the run; some say already that they have such pages."""
        pages = run(spark, sf_dir)
        old = F.when(F.col("doc") % 3 == 0, F.array(F.lit(has), F.lit("has_scanned_pages"))).when(F.col("doc") % 3 == 1, F.array(F.lit("mixed_text_quality"))).otherwise(F.array().cast("array<string>"))
        documents = pages.select("doc").distinct().withColumn("flags", old)
        return document_flags(documents, pages, made, has).select("doc", F.array_join("flags", ",").alias("flags"))


_roll_query("SIB-21", markdown_run, MARKDOWN_RUN, *MARKDOWN)
_roll_query("SIB-23", repair_run, REPAIR_RUN, *REPAIR)


def _staged(pages: DataFrame) -> DataFrame:
    """Answers for every third page; some are for pages that don't exist."""
    k = F.col("doc_id")
    return pages.where(k % 3 == 0).select("doc", F.when(k % 15 == 0, F.col("page") + 50).otherwise(F.col("page")).alias("page"), F.concat(F.lit("staged/"), k.cast("string")).alias("path"), (k % 4 * 90).alias("turn"))


_STAGED = "SELECT doc, CASE WHEN doc_id % 15 = 0 THEN page + 50 ELSE page END AS page, 'staged/' || doc_id AS path, doc_id % 4 * 90 AS turn FROM q WHERE doc_id % 3 = 0"


def apply_vision(spark, sf_dir: str, force: bool) -> tuple[DataFrame, DataFrame]:
    pages = all_pages(spark, sf_dir)
    values = {"vision_path": F.col("s.path"), "flags": _added(F.col("p.flags"), [F.lit(VISION[0])]), "warnings": _added(F.col("p.warnings"), [F.lit("LLM vision markdown: m | v1")])}
    return apply_pages(pages, _staged(pages), G.given(F.col("p.vision_path")), values, "already_generated", force)


for _suffix, _force in (("", False), ("-force", True)):

    @query("SIB-25" + _suffix, B.with_views("flagged", f"SELECT s.doc, s.page, CASE WHEN q.doc IS NULL THEN 'page_not_found' WHEN q.vision_path IS NOT NULL AND NOT {_force} THEN 'already_generated' ELSE 'applied' END AS outcome FROM s LEFT JOIN q ON q.doc = s.doc AND q.page = s.page", q=PAGES, s=_STAGED))
    def sib25(spark, sf_dir, force=_force):
        """What became of each staged row."""
        return apply_vision(spark, sf_dir, force)[1]


@query("SIB-25-pages", B.with_views("flagged", "SELECT q.doc, q.page, CASE WHEN hit THEN s.path ELSE vision_path END AS vision_path, array_to_string(CASE WHEN hit THEN list_append(flags, 'llm_vision_markdown_generated') ELSE flags END, ',') AS flags, array_to_string(CASE WHEN hit THEN list_append(warnings, 'LLM vision markdown: m | v1') ELSE warnings END, ',') AS warnings FROM (SELECT q.*, s.path, s.doc IS NOT NULL AND vision_path IS NULL AS hit FROM q LEFT JOIN s ON q.doc = s.doc AND q.page = s.page) q LEFT JOIN s ON q.doc = s.doc AND q.page = s.page", q=PAGES, s=_STAGED))
def sib25_pages(spark, sf_dir):
    pages = apply_vision(spark, sf_dir, False)[0]
    return pages.select("doc", "page", "vision_path", F.array_join("flags", ",").alias("flags"), F.array_join("warnings", ",").alias("warnings"))


@query("SIB-29", B.with_views("flagged", "SELECT q.doc, q.page, CASE WHEN hit THEN CASE WHEN s.turn = 0 THEN image_path ELSE s.path END ELSE valid_path END AS valid_path, CASE WHEN hit THEN s.turn ELSE rotation END AS rotation, CASE WHEN hit THEN 'llm_image_orientation' ELSE method END AS method FROM (SELECT q.*, s.doc IS NOT NULL AND NOT (valid_path IS NOT NULL AND rotation IS NOT NULL) AS hit FROM q LEFT JOIN s ON q.doc = s.doc AND q.page = s.page) q LEFT JOIN s ON q.doc = s.doc AND q.page = s.page", q=ORIENTED, s=_STAGED))
def sib29(spark, sf_dir):
    """Pages after the turns of their images were applied; an image that needs none stays in its place."""
    pages = oriented(spark, sf_dir)
    known = G.given(F.col("p.valid_path")) & F.col("p.rotation").isNotNull()
    values = {"valid_path": F.when(F.col("s.turn") == 0, F.col("p.image_path")).otherwise(F.col("s.path")), "rotation": F.col("s.turn"), "method": F.lit("llm_image_orientation")}
    return apply_pages(pages, _staged(pages), known, values, "already_validated")[0].select("doc", "page", "valid_path", "rotation", "method")


@query("SIB-30", B.with_views("flagged", f"SELECT doc, bool_or({PENDING}) AS pending, bool_or(image_path IS NOT NULL) AS any_image FROM o GROUP BY doc HAVING any_image", o=ORIENTED))
def sib30(spark, sf_dir):
    """Documents with images: whether any of them is pending (a run takes those; a forced one takes all)."""
    each = oriented(spark, sf_dir).groupBy("doc").agg(F.bool_or(orientation_pending()).alias("pending"), F.bool_or(G.given(F.col("image_path"))).alias("any_image"))
    return each.where("any_image")


@query("SIB-28", B.with_views("flagged", f"SELECT doc, page, CASE WHEN doc_id % 9 = 2 THEN 'failed' ELSE 'staged' END AS outcome, CASE WHEN doc_id % 9 <> 2 THEN doc_id % 4 * 90 END AS turn FROM o WHERE {PENDING}", o=ORIENTED))
def sib28(spark, sf_dir):
    """A run over the pages whose images are pending: turns, or failures."""
    k = F.col("doc_id")
    asked = oriented(spark, sf_dir).where(orientation_pending()).select("doc", "page", F.struct(F.when(k % 9 != 2, k % 4 * 90).alias("turn"), F.when(k % 9 == 2, "unreadable").alias("error")).alias("got"))
    return asked.select("doc", "page", F.when(F.col("got.error").isNull(), "staged").otherwise("failed").alias("outcome"), F.col("got.turn").alias("turn"))


@query("SIB-16", B.with_views("flagged", f"SELECT doc, page FROM flagged WHERE {OCR_WANTED.format(repr(_TRIGGERS))}"))
def sib16(spark, sf_dir):
    """All pages that a trial could take."""
    return targets(spark, sf_dir)


def targets(spark, sf_dir: str) -> DataFrame:
    return B.flagged(spark, sf_dir).where(G.ocr_target(F.col("flags"), F.col("ocr_path"))).select("doc", "page")


@query("SIB-17", B.with_views("flagged", f"SELECT doc, page FROM flagged WHERE {OCR_WANTED.format(repr(_TRIGGERS))} ORDER BY md5('42/' || doc || '/' || page), doc, page LIMIT 10"))
def sib17(spark, sf_dir):
    """Ten of them, the same on every run."""
    return sample(targets(spark, sf_dir), ["doc", "page"], 10, 42)


@query("SIB-18", "SELECT user_id AS run, event_id AS doc, event_id % 4 + 1 AS page FROM events WHERE user_id % 10 <> 3")
def sib18(spark, sf_dir):
    """The targets of reports of earlier trials, a user's events each; some reports are cut off."""
    e = B.read(spark, sf_dir, "events")
    listed = F.collect_list(F.struct(F.col("event_id").alias("doc_id"), (F.col("event_id") % 4 + 1).alias("page_number")))
    reports = e.groupBy(F.col("user_id").alias("run")).agg(F.to_json(F.struct(listed.alias("targets"))).alias("body"))
    return reported_targets(reports.withColumn("body", F.when(F.col("run") % 10 == 3, F.substring(F.col("body"), F.lit(1), F.length("body") - 2)).otherwise(F.col("body"))))


def _usage_query(name: str, every: int) -> None:
    @query(name, f"SELECT count(*) AS documents_with_usage, CAST(sum(event_id % 1000) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 97) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 89 END), 0) AS BIGINT) AS reasoning_tokens, CAST(sum(event_id % 1000 + event_id % 97) AS BIGINT) AS total_tokens FROM events WHERE event_id % {every} <> 0")
    def totals(spark, sf_dir):
        """One row for a run: documents that reported usage, and their tokens; failed ones count where they did."""
        k = F.col("event_id")
        usage = F.struct((k % 1000).alias("prompt_tokens"), (k % 97).alias("completion_tokens"), F.when(k % 3 != 0, k % 89).alias("reasoning_tokens"), (k % 1000 + k % 97).alias("total_tokens"))
        return usage_totals(B.read(spark, sf_dir, "events").select(k.alias("doc"), F.when(k % every != 0, usage).alias("usage")))


_usage_query("SIB-31", 4)
_usage_query("SIB-51", 7)


def stored_files(spark, sf_dir: str) -> DataFrame:
    """What a listing of the artifact folders might give."""
    k = F.col("doc_id")
    kinds = F.array(F.when(k % 5 != 0, F.concat(F.lit("text/"), k.cast("string"))), F.when(k % 4 != 1, F.concat(F.lit("image/"), k.cast("string"))), F.when(k % 24 == 0, F.concat(F.lit("valid/"), k.cast("string"))), F.when(k % 3 == 0, F.concat(F.lit("md/"), k.cast("string"))))
    return B.read(spark, sf_dir, "documents").select(F.explode(F.array_compact(kinds)).alias("path"))


@query("SIB-05", B.with_views("flagged", "SELECT doc, page, doc_id % 10 <> 7 AND doc_id % 5 <> 0 AND (NOT list_has_any(flags, ['image_render_recommended', 'ocr_recommended']) OR (doc_id % 6 = 0 AND doc_id % 4 <> 1)) AS complete FROM flagged"))
def sib05(spark, sf_dir):
    """Some pages name no text, some files are missing."""
    k = F.col("doc_id")
    pages = B.flagged(spark, sf_dir).select("doc", "page", "flags", "image_path", F.when(k % 10 != 7, F.concat(F.lit("text/"), k.cast("string"))).alias("text_path"))
    return complete_pages(pages, stored_files(spark, sf_dir)).select("doc", "page", "complete")


@query("SIB-08", B.with_views("flagged", f"SELECT doc, page FROM o WHERE {PENDING} AND doc_id % 4 <> 1 AND NOT (valid_path IS NOT NULL AND doc_id % 24 = 0)", o=ORIENTED))
def sib08(spark, sf_dir):
    return pending_images(oriented(spark, sf_dir), stored_files(spark, sf_dir)).select("doc", "page")


@query("SNK-16", B.with_views("flagged", "SELECT doc, page, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 <> 1 THEN 'out/' || doc || '__p' || lpad(CAST(page AS VARCHAR), 4, '0') || '__image_path' END AS image, CASE WHEN doc_id % 15 = 0 THEN 'out/' || doc || '__p' || lpad(CAST(page AS VARCHAR), 4, '0') || '__markdown_path' END AS markdown FROM flagged WHERE image_path IS NOT NULL OR markdown_path IS NOT NULL"))
def snk16(spark, sf_dir):
    """Pages with an image or markdown, and by which flat names those that are there go out."""
    pages = all_pages(spark, sf_dir).where("image_path is not null or markdown_path is not null").select("doc", "page", "image_path", "markdown_path")
    out = flat_export(pages, stored_files(spark, sf_dir), ("image_path", "markdown_path"), "out")
    return out.select("doc", "page", F.col("linked")["image_path"].alias("image"), F.col("linked")["markdown_path"].alias("markdown"))


@query("SIB-39", f"""SELECT o AS doc, 'f' || o AS filename, min(CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 4 = 1 THEN lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '.xml' END) AS path FROM (SELECT l_orderkey AS o, * FROM lineitem) GROUP BY o""")
def sib39(spark, sf_dir):
    """An order's lines are its artifacts."""
    made = F.struct(F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(".xml")).alias("path"), F.when(F.col("l_partkey") % 3 == 0, "xml").otherwise("json").alias("kind"), F.when(F.col("l_suppkey") % 4 == 1, ASSEMBLED).otherwise("another").alias("description"))
    docs = B.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(made)).alias("artifacts"))
    return assembled_report(docs.withColumn("filename", F.concat(F.lit("f"), F.col("doc").cast("string"))))


@query("SIB-32", "SELECT count(*) AS selected, count(*) FILTER (NOT low) AS kept, count(*) FILTER (low) AS filtered, count(*) FILTER (blank) AS blank FROM (SELECT mean >= 248 AND var <= 12 AND white >= 0.985 AS blank, (var <= 12 AND white >= 0.985) OR (black >= 0.97 AND mean <= 20 AND var <= 150) AS low FROM (SELECT event_id % 256 AS mean, event_id % 30 AS var, event_id % 1000 / 1000 AS white, event_id % 7 / 6 AS black FROM events))")
def sib32(spark, sf_dir):
    """The report of a triage: events stand for images' profiles."""
    images = B.read(spark, sf_dir, "events").selectExpr("event_id % 256 as mean", "event_id % 30 as var", "event_id % 1000 / 1000D as white", "event_id % 7 / 6D as black")
    return triage(images).agg(F.count("*").alias("selected"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("filtered"), F.count_if("likely_blank").alias("blank"))
