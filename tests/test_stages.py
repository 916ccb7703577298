"""Runs, their application in one step, notes kept up to date page by page, and halved groups against plain recursion."""

import os

from pyspark.sql import functions as F

from ledgerleaf.operators import stages
from ledgerleaf.sources import commits


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_a_run_fails_by_document_and_is_applied_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d"), (5, "e")], "doc int, answer string")
    was = spark.createDataFrame([(3, "old")], "doc int, result string")
    infer = F.struct(F.upper("answer").alias("result"), F.when(F.col("answer").isNull(), "empty").alias("error"))
    run = stages.run_stage(docs, infer, F.when(F.col("doc") == 5, "not ready"))
    assert rows(run.staged, "doc", "result") == [(1, "A"), (3, "C"), (4, "D")] and rows(run.failures, "doc", "error") == [(2, "empty"), (5, "not ready")]
    assert tuple(run.report.first()) == (5, 3, 2)
    assert rows(stages.eligible(docs, was), "doc") == [(1,), (2,), (4,), (5,)] and stages.eligible(docs, was, True).count() == 5
    store = commits.Store(spark, str(tmp_path))
    store.commit("setup", 0, replaced={"canonical": was})
    for attempt in (True, False):
        got = stages.apply_run(store.read()["canonical"], run.staged)
        assert store.commit("classification", 7, replaced={"canonical": got.canonical}, appended={"outcomes": got.outcomes}) == attempt
    now = store.read()
    assert rows(now["canonical"], "doc", "result") == [(1, "A"), (3, "old"), (4, "D")]
    assert rows(now["outcomes"], "doc", "outcome") == [(1, "applied"), (3, "skipped"), (4, "applied")]
    forced = stages.apply_run(now["canonical"], run.staged, True)
    assert rows(forced.canonical, "doc", "result") == [(1, "A"), (3, "C"), (4, "D")] and tuple(forced.report.first()) == (3, 3, 0)


def files(folder):
    return {os.path.relpath(os.path.join(d, p), folder): os.stat(os.path.join(d, p)).st_mtime_ns for d, _, names in os.walk(folder) for p in names if p.endswith(".parquet")}


def test_notes_are_made_for_changed_pages_only(spark, tmp_path):
    folder, shape = str(tmp_path / "notes"), "doc int, filename string, page int, content string"
    pages = [(d, f"f{d}", p, f"text {d} {p}") for d in range(6) for p in range(1, 4)] + [(9, "f9", 1, None)]
    make = F.concat(F.lit("note "), F.coalesce("content", F.lit("")))
    none = spark.createDataFrame([], "filename string, page int, digest string, note string, doc int")
    write = lambda notes, p: stages.write_notes(folder, notes, spark.createDataFrame(p, shape), make)
    read = lambda: spark.read.parquet(folder)
    assert write(none, pages) == 7
    first = files(folder)
    assert write(read(), pages) == 0 and files(folder) == first
    edited = [(*p[:3], "edited") if p[:3:2] == (2, 3) else p for p in pages if p[0] != 5]  # one page, and a document that isn't asked for
    assert write(read(), edited) == 1
    second = files(folder)
    assert {p.split("/")[0] for p in set(first) ^ set(second)} == {"doc=2"} and all(second[p] == t for p, t in first.items() if p in second)
    assert rows(read().where("doc = 2"), "page", "note") == [(1, "note text 2 1"), (2, "note text 2 2"), (3, "note edited")] and read().where("doc = 5").count() == 3
    assert write(read(), [p for p in edited if p[:3:2] != (2, 1)]) == 1 and rows(read().where("doc = 2"), "page") == [(2,), (3,)]
    assert write(read(), [(0, "renamed", 1, "text 0 1")]) == 1 and rows(read().where("doc = 0"), "filename", "page") == [("renamed", 1)]


def test_notes_of_other_files_pages_or_contents_are_made_anew(spark):
    pages = spark.createDataFrame([(1, "f", p, "same") for p in range(1, 7)], "doc int, filename string, page int, content string")
    good = stages.refresh_notes(spark.createDataFrame([], "doc int, filename string, page int, digest string, note string"), pages, F.lit("x")).first()["digest"]
    old = [(1, "f", 1, good, "kept"), (1, "f", 1, good, "kept"), (1, "g", 2, good, "old"), (1, "f", 3, "other", "old"), (2, "f", 4, good, "old"), (1, "f", 5, good, None)]
    notes = spark.createDataFrame(old, "doc int, filename string, page int, digest string, note string")
    assert rows(stages.refresh_notes(notes, pages, F.lit("new")), "page", "note") == [(1, "kept")] + [(p, "new") for p in range(2, 7)]
    assert stages.refresh_notes(notes, pages, F.lit("new"), True).where("reused").count() == 0


def test_halving_like_recursion(spark):
    domains = stages.DOMAINS

    def outcome(doc, part):
        if doc == 3 and "term" in part and len(part) <= 2:
            return "refused"
        if doc in (1, 3) and len(part) > 1 or doc == 2 and part == ["quality"] or doc == 2 and "quality" in part:
            return "empty"
        return "refused" if doc == 4 else None

    def ask(doc, part, log, way=""):
        log.append((way, part))
        got = outcome(doc, part)
        if got is None:
            return {d: way for d in part}
        if got != "empty" or len(part) == 1:
            raise ValueError(got)
        half = len(part) // 2
        return ask(doc, part[:half], log, way + "0") | ask(doc, part[half:], log, way + "1")

    judged = F.udf(lambda doc, part: outcome(doc, list(part)), "string")
    asked, results = stages.halve_groups(spark.createDataFrame([(i,) for i in range(5)], "doc int"), domains, judged("doc", "part"))
    got = {r.doc: r for r in results.collect()}
    for doc in range(5):
        log = []
        try:
            want = ask(doc, list(domains), log)
            assert got[doc].error is None and got[doc].merged == want and got[doc].groups == len(log) and got[doc].split == (len(log) > 1)
            assert rows(asked.where(F.col("doc") == doc), "way", "part") == sorted(((w, p) for w, p in log), key=str)
        except ValueError as e:
            assert got[doc].merged is None and got[doc].error == str(e)
    assert stages.halve_groups(spark.createDataFrame([], "doc int"), domains, judged("doc", "part"))[1].count() == 0
