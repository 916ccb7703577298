"""Runs of stages around a model: what is selected, staged, failed and applied; notes of pages kept up to date; groups that fail are halved.

The model is a column (`infer`), or a rule that says which calls fail; the rest is joins. A run changes nothing but its
own rows; `apply_run` brings them into the canonical table, and `sources.commits` writes that in one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import bridges as B
from ..plans.catalog import query
from ..plans.shared import written
from .mart import anti_upsert
from .pages import best_variant


@dataclass(frozen=True)
class Run:
    """staged (doc, result), failures (doc, error), report (selected, succeeded, failed)."""

    staged: DataFrame
    failures: DataFrame
    report: DataFrame


def eligible(docs: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Documents to run: those that aren't done, or all if forced."""
    return docs if force else docs.join(done.select("doc").distinct(), "doc", "left_anti").select(*docs.columns)


def run_stage(selected: DataFrame, infer: Column, guard: Column | None = None) -> Run:
    """UDF-19: one answer a document. `infer` is a struct (result, error), `guard` an error that keeps a document from being asked.

    A document fails by itself, with its error as a row; the run goes on. Each document is asked once: what came back is written.
    """
    none = F.lit(None).cast("string")
    why = none if guard is None else guard
    asked = written(selected.select("doc", why.alias("refused"), F.when(why.isNull(), infer).alias("got")), "run")
    error = F.coalesce("refused", "got.error")
    report = asked.agg(F.count("*").alias("selected"), F.count_if(error.isNull()).alias("succeeded"), F.count_if(error.isNotNull()).alias("failed"))
    return Run(asked.where(error.isNull()).select("doc", F.col("got.result").alias("result")), asked.where(error.isNotNull()).select("doc", error.alias("error")), report)


@dataclass(frozen=True)
class Applied:
    """canonical (doc, result), outcomes (doc, outcome: applied or skipped), report (seen, applied, skipped)."""

    canonical: DataFrame
    outcomes: DataFrame
    report: DataFrame


def apply_run(canonical: DataFrame, staged: DataFrame, force: bool = False) -> Applied:
    """UDF-20: staged results become canonical; documents that are done already are skipped unless forced."""
    done = canonical.select("doc").distinct().withColumn("done", F.lit(True))
    met = staged.join(done, "doc", "left").withColumn("outcome", F.when(F.col("done") & ~F.lit(force), "skipped").otherwise("applied"))
    new = met.where("outcome = 'applied'").select(*canonical.columns)
    report = met.agg(F.count("*").alias("seen"), F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    return Applied(anti_upsert(canonical, new, ["doc"]), met.select("doc", "outcome"), report)


# ---- notes of pages


def refresh_notes(notes: DataFrame, pages: DataFrame, make: Column, force: bool = False) -> DataFrame:
    """UDF-22: doc, filename, page, digest, note, reused: the notes of all `pages` (doc, filename, page, content).

    A note stays if it is of the same document, file and page and of the same content, told by a digest; `make`, a
    column over `pages`, makes the others. Only digests are joined.
    """
    fresh = pages.select("doc", "filename", "page", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), make.alias("made"))
    old = notes.dropDuplicates(["doc", "filename", "page"]).select("doc", "filename", "page", "digest", F.col("note").alias("old"))
    valid = old.where(F.lit(not force) & F.col("old").isNotNull())
    met = fresh.join(valid, ["doc", "filename", "page", "digest"], "left")
    return met.select("doc", "filename", "page", "digest", F.coalesce("old", "made").alias("note"), F.col("old").isNotNull().alias("reused"))


def changed_documents(notes: DataFrame, refreshed: DataFrame) -> DataFrame:
    """UDF-21: doc, reused, generated, gone: documents with a new note, or with one that no page has any more. Documents without pages stay as they are."""
    counts = refreshed.groupBy("doc").agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("generated"))
    gone = notes.join(refreshed.select("doc", "filename", "page"), ["doc", "filename", "page"], "left_anti").groupBy("doc").agg(F.count("*").alias("gone"))
    return counts.join(gone, "doc", "left").withColumn("gone", F.coalesce("gone", F.lit(0))).where("generated + gone > 0")


def write_notes(folder: str, notes: DataFrame, pages: DataFrame, make: Column, force: bool = False) -> int:
    """Brings the notes under `folder`, one partition a document, up to date; returns how many documents were written anew.

    Partitions of documents that didn't change aren't touched; without changes nothing is written.
    """
    spark = pages.sparkSession
    fresh = written(refresh_notes(notes, pages, make, force), "notes")
    changed = written(changed_documents(notes, fresh).select("doc"), "changed")
    n = changed.count()
    if n:
        rows = fresh.join(changed, "doc", "left_semi").select("filename", "page", "digest", "note", "doc")
        rows.repartition("doc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(folder)
        spark.catalog.refreshByPath(folder)
    return n


# ---- groups that are halved


def halve_groups(docs: DataFrame, domains: tuple[str, ...], outcome: Column) -> tuple[DataFrame, DataFrame]:
    """UDF-10: attempts (doc, way, part, outcome) and results (doc, groups, split, merged, error).

    `outcome` judges an attempt by doc and `part`, its array of domains: null is an answer, `empty` none for want of room,
    other texts are errors. A group that comes back empty is halved, the first half the shorter, and asked again; a
    single domain, or any other error, fails the document, with the first failure in the order of asking (`way`, which
    has a 0 or 1 for each halving). `merged` maps each domain to the way of the group that answered for it.
    """
    front = docs.select("doc", F.lit("").alias("way"), F.array(*map(F.lit, domains)).alias("part"))
    asked = None
    while True:
        now = written(front.withColumn("outcome", outcome), "asked")
        asked = now if asked is None else asked.unionByName(now)
        again = now.where("outcome = 'empty' and size(part) > 1")
        if again.isEmpty():
            break
        half = F.floor(F.size("part") / 2).cast("int")
        sides = F.array(F.struct(F.lit("0").alias("step"), F.slice("part", F.lit(1), half).alias("side")), F.struct(F.lit("1").alias("step"), F.slice("part", half + 1, F.size("part")).alias("side")))
        front = again.select("doc", "way", F.explode(sides).alias("s")).select("doc", F.concat("way", "s.step").alias("way"), F.col("s.side").alias("part"))
    bad = (F.col("outcome") != "empty") | (F.size("part") == 1)
    error = F.min(F.when(F.col("outcome").isNotNull() & bad, F.struct("way", "outcome")))
    answers = F.flatten(F.collect_list(F.when(F.col("outcome").isNull(), F.transform("part", lambda d: F.struct(d.alias("key"), F.col("way").alias("value"))))))
    each = asked.groupBy("doc").agg(F.count("*").alias("groups"), error.alias("bad"), F.max(F.length("way") > 0).alias("split"), answers.alias("found"))
    merged = F.when(F.col("bad").isNull(), F.map_from_entries("found"))
    return asked, each.select("doc", "groups", "split", merged.alias("merged"), F.col("bad.outcome").alias("error"))


# ---- over the test tables


@dataclass(frozen=True)
class Rule:
    """A stage in expressions that Spark and DuckDB read alike, over the columns of `inputs`."""

    routes: str
    done: str
    guard: str
    error: str
    result: str


RULES = {
    "classification": Rule("doc >= 0", "doc % 3 = 0", "CASE WHEN doc % 31 = 7 THEN 'no pages' END", "CASE WHEN stage IS NULL THEN 'no answer' END", "concat(stage, '/', role)"),
    "procurement": Rule("doc >= 0", "doc % 5 = 0", "CASE WHEN pages < 2 THEN 'too short' END", "CASE WHEN buyer IS NULL AND seller IS NULL THEN 'no parties' END", "concat(coalesce(buyer, '?'), ' - ', coalesce(seller, '?'))"),
    "change": Rule("stage = 'active_change'", "change IS NOT NULL", "CASE WHEN change_kind <> 'amendment' AND doc % 7 = 1 THEN 'no kind' END", "CASE WHEN doc % 11 = 5 THEN 'no answer' END", "concat(change_kind, ' of ', filename)"),
}
READY = "doc % 8 <> 7"
INPUTS = "SELECT c.doc, c.filename, c.page_count AS pages, k.stage, k.role, k.change_kind, p.buyer, p.seller, n.governing, n.change FROM contracts c LEFT JOIN classification k USING (doc) LEFT JOIN parties p USING (doc) LEFT JOIN notes n USING (doc)"


def inputs(spark, sf_dir: str) -> DataFrame:
    c = B.contracts(spark, sf_dir).select("doc", "filename", F.col("page_count").alias("pages"))
    k = B.classification(spark, sf_dir).select("doc", "stage", "role", "change_kind")
    return c.join(k, "doc", "left").join(B.parties(spark, sf_dir).select("doc", "buyer", "seller"), "doc", "left").join(B.notes(spark, sf_dir).select("doc", "governing", "change"), "doc", "left")


def canonical(docs: DataFrame, rule: Rule) -> DataFrame:
    return docs.where(F.expr(rule.done)).select("doc", F.concat(F.lit("old "), F.col("doc").cast("string")).alias("result"))


def sample_run(spark, sf_dir: str, rule: Rule, force: bool) -> tuple[DataFrame, Run]:
    docs = inputs(spark, sf_dir)
    ready = docs.where(f"{READY} and {rule.routes}")
    was = canonical(docs, rule)
    return was, run_stage(eligible(ready, was, force), F.struct(F.expr(rule.result).alias("result"), F.expr(rule.error).alias("error")), F.expr(rule.guard))


def _run_sql(rule: Rule, force: bool) -> str:
    return f"SELECT doc, coalesce({rule.guard}, {rule.error}) AS error, {rule.result} AS result FROM ({INPUTS}) WHERE {READY} AND {rule.routes}" + ("" if force else f" AND NOT coalesce({rule.done}, false)")


VIEWS = "contracts classification parties notes"


def _stage_queries(stage: str, ran: str, applied: str) -> None:
    rule = RULES[stage]

    @query(ran, B.with_views(VIEWS, f"SELECT doc, CASE WHEN error IS NULL THEN 'staged' ELSE 'failed' END AS outcome, CASE WHEN error IS NULL THEN result END AS result, error FROM r", r=_run_sql(rule, False)))
    def run(spark, sf_dir):
        """What a run leaves: staged rows and failure rows."""
        _, got = sample_run(spark, sf_dir, rule, False)
        staged = got.staged.select("doc", F.lit("staged").alias("outcome"), "result", F.lit(None).cast("string").alias("error"))
        return staged.unionByName(got.failures.select("doc", F.lit("failed").alias("outcome"), F.lit(None).cast("string").alias("result"), "error"))

    @query(f"{ran}-report", B.with_views(VIEWS, "SELECT count(*) AS selected, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed FROM r", r=_run_sql(rule, False)))
    def report(spark, sf_dir):
        return sample_run(spark, sf_dir, rule, False)[1].report

    was = f"SELECT doc, 'old ' || doc AS result FROM ({INPUTS}) WHERE {rule.done}"

    for suffix, force in (("", False), ("-force", True)):
        skip = "false" if force else f"coalesce({rule.done}, false)"

        @query(applied + suffix, B.with_views(VIEWS, f"SELECT coalesce(r.doc, w.doc) AS doc, CASE WHEN r.doc IS NULL OR skip THEN w.result ELSE r.result END AS result, CASE WHEN r.doc IS NULL THEN 'kept' WHEN skip THEN 'skipped' ELSE 'applied' END AS outcome FROM w FULL JOIN (SELECT r.doc, r.result, {skip} AS skip FROM r JOIN i USING (doc) WHERE error IS NULL) r ON r.doc = w.doc", i=INPUTS, r=_run_sql(rule, True), w=was))
        def apply(spark, sf_dir, force=force):
            """The canonical table after a run over all documents was applied, with what became of each."""
            before, got = sample_run(spark, sf_dir, rule, True)
            after = apply_run(before, got.staged, force)
            return after.canonical.join(after.outcomes, "doc", "left").select("doc", "result", F.coalesce("outcome", F.lit("kept")).alias("outcome"))

    @query(f"{applied}-report", B.with_views(VIEWS, f"SELECT count(*) AS seen, count(*) FILTER (NOT skip) AS applied, count(*) FILTER (skip) AS skipped FROM (SELECT coalesce({rule.done}, false) AS skip FROM r JOIN i USING (doc) WHERE error IS NULL)", i=INPUTS, r=_run_sql(rule, True)))
    def apply_report(spark, sf_dir):
        before, got = sample_run(spark, sf_dir, rule, True)
        return apply_run(before, got.staged).report


_stage_queries("classification", "UDF-19", "UDF-20")
_stage_queries("procurement", "SIB-44", "SIB-45")
_stage_queries("change", "SIB-49", "SIB-50")

def change_guard(stage: Column, kind: Column, routes: str = "active_change") -> Column:
    """SIB-52: why a document can't be asked for its changes: it has no classification, goes elsewhere, or has no kind of change."""
    return F.when(stage.isNull(), "no classification").when(stage != routes, F.concat(F.lit("does not route: "), stage)).when(kind.isNull(), "no kind of change")


@query("SIB-52", B.with_views(VIEWS, f"SELECT doc, CASE WHEN stage IS NULL THEN 'no classification' WHEN stage <> 'active_change' THEN 'does not route: ' || stage WHEN CASE WHEN doc % 6 <> 3 THEN change_kind END IS NULL THEN 'no kind of change' END AS error FROM ({INPUTS})"))
def sib52(spark, sf_dir):
    """Every document asked by name: most fail by the guard, some kinds are missing."""
    docs = inputs(spark, sf_dir)
    got = run_stage(docs, F.struct(F.col("change_kind").alias("result"), F.lit(None).cast("string").alias("error")), change_guard(F.col("stage"), F.when(F.col("doc") % 6 != 3, F.col("change_kind"))))
    return got.staged.select("doc", F.lit(None).cast("string").alias("error")).unionByName(got.failures)


#: The groups of fields of a governing note, in the order in which they are asked for.
DOMAINS = ("identity", "parties", "subject", "term", "economics", "controls", "quality")
#: Which attempts fail, by document and group; the list function's name is the only difference between the engines.
OUTCOME = """CASE WHEN doc % 17 = 5 AND {has}(part, 'term') AND {size}(part) <= 2 THEN 'refused' WHEN {size}(part) >= 4 AND doc % 2 = 0 THEN 'empty'
  WHEN {has}(part, 'economics') AND {size}(part) > 1 AND doc % 3 = 0 THEN 'empty' WHEN {has}(part, 'quality') AND {size}(part) < 3 AND doc % 19 = 3 THEN 'empty' END"""
_ATTEMPTS = f"""a AS (SELECT doc, '' AS way, {list(DOMAINS)!r} AS part FROM d
  UNION ALL SELECT doc, way || s, CASE s WHEN '0' THEN part[1:len(part) // 2] ELSE part[len(part) // 2 + 1:] END FROM (SELECT *, {OUTCOME.format(has='list_contains', size='len')} AS o FROM a), (VALUES ('0'), ('1')) h(s) WHERE o = 'empty' AND len(part) > 1),
j AS (SELECT *, {OUTCOME.format(has='list_contains', size='len')} AS outcome FROM a),
e AS (SELECT doc, count(*) AS groups, max(CAST(way <> '' AS INT)) = 1 AS split, arg_min(outcome, way) FILTER (outcome <> 'empty' OR (outcome = 'empty' AND len(part) = 1)) AS error FROM j GROUP BY doc)"""


def _governing(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = inputs(spark, sf_dir).where(f"{READY} and stage = 'contracting' and governing is null").select("doc")
    return halve_groups(docs, DOMAINS, F.expr(OUTCOME.format(has="array_contains", size="size")))


_D = f"SELECT doc FROM ({INPUTS}) WHERE {READY} AND stage = 'contracting' AND governing IS NULL"


def _recursive(select: str) -> str:
    return B.with_views(VIEWS, select, d=_D).replace("WITH ", "WITH RECURSIVE ", 1).replace(f"d AS ({_D})", f"d AS ({_D}), {_ATTEMPTS}", 1)


@query("UDF-10", _recursive("SELECT doc, way, array_to_string(part, ',') AS part, outcome FROM j"))
def udf10(spark, sf_dir):
    return _governing(spark, sf_dir)[0].select("doc", "way", F.array_join("part", ",").alias("part"), "outcome")


@query("UDF-10-merged", _recursive("SELECT doc, p.domain, way FROM j JOIN e USING (doc), unnest(part) p(domain) WHERE outcome IS NULL AND error IS NULL"))
def udf10_merged(spark, sf_dir):
    """For each domain of a document's note the group that it came with."""
    return _governing(spark, sf_dir)[1].select("doc", F.explode("merged").alias("domain", "way"))


@query("SIB-46", _recursive("SELECT doc, CASE WHEN error IS NULL THEN 'staged' ELSE 'failed' END AS outcome, groups, split, error FROM e"))
def sib46(spark, sf_dir):
    """A run of governing notes: each document with how often it was asked, also where it failed."""
    return _governing(spark, sf_dir)[1].select("doc", F.when(F.col("error").isNull(), "staged").otherwise("failed").alias("outcome"), "groups", "split", "error")


@query("SIB-47", _recursive(f"SELECT i.doc, CASE WHEN governing IS NOT NULL THEN governing ELSE 'split ' || split END AS result, CASE WHEN governing IS NOT NULL THEN 'kept' ELSE 'applied' END AS outcome FROM ({INPUTS}) i LEFT JOIN e USING (doc) WHERE governing IS NOT NULL OR (e.doc IS NOT NULL AND error IS NULL)"))
def sib47(spark, sf_dir):
    was = B.notes(spark, sf_dir).where("governing is not null").select("doc", F.col("governing").alias("result"))
    staged = _governing(spark, sf_dir)[1].where("error is null").select("doc", F.concat(F.lit("split "), F.col("split").cast("string")).alias("result"))
    after = apply_run(was, staged)
    return after.canonical.join(after.outcomes, "doc", "left").select("doc", "result", F.coalesce("outcome", F.lit("kept")).alias("outcome"))


def page_contents(spark, sf_dir: str) -> DataFrame:
    best = best_variant(B.variants(spark, sf_dir)).select("doc", "page", "content")
    return B.pages(spark, sf_dir).select("doc", "page", "doc_id", "filename").join(best, ["doc", "page"], "left").where("doc % 4 = 1")


def old_notes(pages: DataFrame) -> DataFrame:
    """Notes of two thirds of the pages, some of other contents, files or pages that are gone."""
    digest = F.sha2(F.when(F.col("doc_id") % 7 == 2, "other").otherwise(F.coalesce("content", F.lit(""))), 256)
    page = F.when(F.col("doc_id") % 11 == 3, F.col("page") + 100).otherwise(F.col("page"))
    filename = F.when(F.col("doc") % 13 == 4, "renamed.pdf").otherwise(F.col("filename"))
    return pages.where("doc_id % 3 <> 0").select("doc", filename.alias("filename"), page.alias("page"), digest.alias("digest"), F.when(F.col("doc_id") % 10 != 8, F.concat(F.lit("old "), F.col("doc_id").cast("string"))).alias("note"))


def _made() -> Column:
    return F.concat(F.lit("new "), F.length(F.coalesce("content", F.lit(""))).cast("string"))


_PAGES = "SELECT p.doc, p.page, p.doc_id, p.filename, b.content FROM pages p LEFT JOIN best b ON b.doc = p.doc AND b.page = p.page WHERE p.doc % 4 = 1"
_REUSED = "doc_id % 3 <> 0 AND doc_id % 7 <> 2 AND doc_id % 11 <> 3 AND doc % 13 <> 4 AND doc_id % 10 <> 8"


@query("UDF-22", B.with_views("pages best", f"SELECT doc, page, CASE WHEN {_REUSED} THEN 'old ' || doc_id ELSE 'new ' || length(coalesce(content, '')) END AS note, {_REUSED} AS reused FROM q", q=_PAGES))
def udf22(spark, sf_dir):
    pages = page_contents(spark, sf_dir)
    return refresh_notes(old_notes(pages), pages, _made()).select("doc", "page", "note", "reused")


@query("UDF-21", B.with_views("pages best", f"SELECT doc, count_if({_REUSED}) AS reused, count_if(NOT ({_REUSED})) AS generated, count_if(doc_id % 3 <> 0 AND (doc_id % 11 = 3 OR doc % 13 = 4)) AS gone FROM q GROUP BY doc HAVING generated + gone > 0", q=_PAGES))
def udf21(spark, sf_dir):
    """Documents whose notes are replaced."""
    pages = page_contents(spark, sf_dir)
    notes = old_notes(pages)
    return changed_documents(notes, refresh_notes(notes, pages, _made()))


@query("SIB-53", B.with_views("pages best", f"SELECT count(DISTINCT doc) AS documents, count(*) AS pages, count(*) FILTER ({_REUSED}) AS reused, count(*) FILTER (NOT ({_REUSED})) AS generated FROM q", q=_PAGES))
def sib53(spark, sf_dir):
    """The report of a run over page notes."""
    pages = page_contents(spark, sf_dir)
    found = refresh_notes(old_notes(pages), pages, _made())
    return found.agg(F.countDistinct("doc").alias("documents"), F.count("*").alias("pages"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("generated"))
