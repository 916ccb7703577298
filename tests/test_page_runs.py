"""Runs over pages: failures keep their place, flags stand once, staged rows for no page or a done one, usage that is missing."""

from pyspark.sql import functions as F

from ledgerleaf.operators import page_runs as R

SHAPE = "doc int, page int, flags array<string>, warnings array<string>, path string, answer string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def pages(spark):
    return spark.createDataFrame(
        [
            (1, 1, ["want", "made"], [], None, "a"),
            (1, 2, ["want"], ["stage: no"], "old", None),
            (1, 3, [], [], "old", "x"),
            (2, 1, ["want"], [], None, None),
            (3, 1, None, [], "kept", None),
        ],
        SHAPE,
    )


def run(spark):
    infer = F.struct(F.col("answer").alias("result"), F.when((F.col("doc") == 1) & (F.col("page") == 2), "no").alias("error"))
    return R.run_pages(pages(spark), F.array_contains("flags", "want"), infer, "path", ["made"], ["bad", "want"], "stage")


def test_pages_after_a_run(spark):
    got = run(spark)
    assert got.columns == ["doc", "page", "flags", "warnings", "path", "answer", "outcome"]
    assert rows(got, "doc", "page", "flags", "warnings", "path", "outcome") == [
        (1, 1, ["want", "made"], [], "a", "processed"),
        (1, 2, ["want", "bad"], ["stage: no"], None, "failed"),
        (1, 3, [], [], "old", "skipped"),
        (2, 1, ["want", "bad"], ["stage: empty"], None, "failed"),
        (3, 1, None, [], "kept", "skipped"),
    ]
    assert tuple(R.run_counts(got).first()) == (2, 1, 1, 2) and tuple(R.run_counts(got.limit(0)).first()) == (0, 0, 0, 0)


def test_flags_of_documents(spark):
    docs = spark.createDataFrame([(1, ["has", "b", "b"]), (2, ["a", "has"]), (9, ["has"])], "doc int, flags array<string>")
    assert rows(R.document_flags(docs, run(spark), "made", "has"), "doc", "flags") == [(1, ["b", "has"]), (2, ["a"]), (9, [])]


def test_staged_rows_find_their_pages(spark):
    staged = spark.createDataFrame([(1, 1, "n1"), (1, 1, "n1"), (1, 3, "n3"), (1, 7, "n7"), (8, 1, "n8"), (None, 1, "n")], "doc int, page int, new string")
    done, values = F.col("p.path").isNotNull(), {"path": F.col("s.new")}
    after, outcomes = R.apply_pages(pages(spark), staged, done, values, "already")
    assert rows(outcomes, "doc", "page", "outcome") == sorted([(1, 1, "applied"), (1, 1, "applied"), (1, 3, "already"), (1, 7, "page_not_found"), (8, 1, "page_not_found"), (None, 1, "page_not_found")], key=str)
    assert rows(after, "doc", "page", "path") == [(1, 1, "n1"), (1, 2, "old"), (1, 3, "old"), (2, 1, None), (3, 1, "kept")]
    forced = R.apply_pages(pages(spark), staged, done, values, "already", True)[0]
    assert rows(forced, "doc", "page", "path") == [(1, 1, "n1"), (1, 2, "old"), (1, 3, "n3"), (2, 1, None), (3, 1, "kept")]


def test_usage_and_reports(spark):
    usage = "doc int, usage struct<prompt_tokens:long,completion_tokens:long,reasoning_tokens:long,total_tokens:long>"
    some = spark.createDataFrame([(1, (1, 2, None, 3)), (2, None), (3, (None, 5, 6, 7))], usage)
    assert [tuple(r) for r in R.usage_totals(some).collect()] == [(2, 1, 7, 6, 10)] and R.usage_totals(some.where("doc = 2")).count() == 0
    reports = spark.createDataFrame([(1, '{"targets":[{"doc_id":5,"page_number":2},{"doc_id":6,"page_number":1}]}'), (2, "{cut"), (3, None), (4, "{}")], "run int, body string")
    assert rows(R.reported_targets(reports), "run", "doc", "page") == [(1, 5, 2), (1, 6, 1)]


def test_files_that_are_there(spark):
    files = spark.createDataFrame([("t/1",), ("t/1",), ("i/1",), (None,)], "path string")
    shape = "doc int, page int, text_path string, image_path string, flags array<string>"
    some = spark.createDataFrame([(1, 1, "t/1", None, []), (1, 2, "t/1", "i/1", ["ocr_recommended"]), (1, 3, "t/1", "i/2", ["ocr_recommended"]), (1, 4, None, "i/1", []), (1, 5, "t/2", None, None)], shape)
    assert rows(R.complete_pages(some, files), "page", "complete") == [(1, True), (2, True), (3, False), (4, False), (5, False)]
    out = R.flat_export(some, files, ("text_path", "image_path"), "out")
    assert out.count() == 5 and {r.page: r.linked for r in out.collect()}[2] == {"text_path": "out/1__p0002__text_path", "image_path": "out/1__p0002__image_path"}
