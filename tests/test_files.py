"""File sources and sinks: equal file names in many documents, odd characters in paths, strict manifests, increments, events to several sinks."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import documents as D
from ledgerleaf.sources import files, sinks

PAGES = "doc string, filename string, source_pdf string, page int, representation string, source_path string, flags array<string>, content string"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def corpus(tmp_path):
    """Three documents whose pages have the same file names, in folders with odd names."""
    for name in ("a", "b + ü%20", "c d"):
        pages = [{"page_number": n, "text_path": f"docs/{name}/pages/{n:04d}.txt"} for n in (1, 2, 3)]
        put(tmp_path / "docs" / name / "manifest.json", json.dumps({"doc_id": name, "page_count": 3, "pages": pages, "derived_artifacts": [{"kind": "json", "path": f"docs/{name}/derived/page_notes.json", "description": "n"}]}))
        put(tmp_path / "docs" / name / "pages" / "0001.txt", f"  text of {name}\n")
        put(tmp_path / "docs" / name / "pages" / "0002.txt", " \n")
        put(tmp_path / "docs" / name / "derived" / "page_notes.json", json.dumps({"of": name}))
    return tmp_path


def test_equal_file_names_are_told_apart(spark, corpus):
    m = files.manifests(spark, str(corpus / "docs"))
    got = sorted(((r.doc_id, r.page_number), r.content) for r in files.page_texts(spark, m, str(corpus)).collect())
    assert got == sorted(((d, n), f"text of {d}" if n == 1 else None) for d in ("a", "b + ü%20", "c d") for n in (1, 2, 3))
    notes = {r.doc_id: r.of for r in files.page_notes(spark, m, str(corpus)).select("doc_id", F.try_variant_get("payload", "$.of", "string").alias("of")).collect()}
    assert notes == {d: d for d in notes} and len(notes) == 3


def test_side_files(spark, corpus):
    put(corpus / "broken.json", "{no")
    rows = spark.createDataFrame([(1, "docs/a/derived/page_notes.json", "p"), (2, None, "p"), (3, "none.json", "p"), (4, "broken.json", "p")], "id int, path string, row string")
    got = files.side_files(rows, str(corpus), F.col("path"))
    assert got.columns == ["id", "path", "row", "payload"]
    assert {r.id: r.p for r in got.select("id", F.to_json("payload").alias("p")).collect()} == {1: '{"of":"a"}', 2: None, 3: None, 4: None}


def test_where_notes_lie(spark):
    rows = spark.createDataFrame(
        [
            (1, [("xml", "d/derived/page_notes.json"), ("json", "d/derived/page_notes.json"), ("json", "e/derived/page_notes.json")], "x.xml"),
            (2, [("json", "derived/page_notes.json.bak")], "d/derived/normalized_page_notes.xml"),
            (3, [], "d/other.xml"),
            (4, None, None),
        ],
        "id int, a array<struct<kind:string,path:string>>, n string",
    )
    got = {r.id: r.p for r in rows.select("id", D.page_notes_path(F.col("a"), F.col("n")).alias("p")).collect()}
    assert got == {1: "d/derived/page_notes.json", 2: "d/derived/page_notes.json", 3: None, 4: None}


def test_manifests_refuse_what_they_do_not_know(spark, tmp_path):
    bodies = {
        "good": {"doc_id": "good", "pages": [{"page_number": 1}], "processing_status": {"status": "done", "warnings": []}},
        "odd": {"doc_id": "odd", "colour": 1, "pages": [{"page_number": 1}, {"page_number": 2, "tilt": 3}], "processing_status": {"state": "x"}},
        "types": {"doc_id": 5, "page_count": "3", "pages": {"page_number": 1}, "quality_flags": ["a", 1], "has_text_layer": "yes"},
        "whole": {"doc_id": "whole", "page_count": 2.5},
    }
    for name, body in bodies.items():
        put(tmp_path / name / "manifest.json", json.dumps(body, indent=1))
    put(tmp_path / "broken" / "manifest.json", '{"doc_id": "brok')
    put(tmp_path / "list" / "manifest.json", "[1]")
    got = [(r.doc_id, r.refused, r._corrupt) for r in files.manifests(spark, str(tmp_path)).collect()]
    refused = {d: r for d, r, _ in got if d}
    assert refused["good"] == [] and refused["odd"] == ["$.colour: unknown", "$.processing_status.state: unknown", "$.pages[1].tilt: unknown"] and refused["whole"] == ["$.page_count: not whole"]
    rest = [r for d, r, c in got if d not in ("good", "odd", "whole")]
    assert ["$.doc_id: not string", "$.page_count: not number", "$.has_text_layer: not boolean", "$.quality_flags[1]: not string", "$.pages: not array"] in rest
    assert ["$: not JSON"] in rest and ["$: not object"] in rest and len(got) == 6
    assert any(c and c.startswith('{"doc_id": "brok') for _, _, c in got)
    assert files.manifests(spark, str(tmp_path), ["good", "none"]).count() == 1


def test_assembled_documents_come_back(spark, tmp_path):
    pages = [
        ("d<&>\"1", "f & g.pdf", "in/f.pdf", 2, "text", 'a "q" <b>/0002.txt', ["low", "x"], "  b ]]> c\n<page number=\"9\"> &amp; "),
        ("d<&>\"1", "f & g.pdf", "in/f.pdf", 1, None, None, [], None),
        ("e", "e.pdf", "in/e.pdf", 10, "ocr_text", "p/10.txt", ["x"], "]]>]]>"),
        ("e", "e.pdf", "in/e.pdf", 3, "markdown", "p/3.md", None, ""),
    ]
    sinks.write_documents(spark.createDataFrame(pages, PAGES).coalesce(1), str(tmp_path / "xml"))
    got = files.xml_pages(spark, str(tmp_path / "xml"))
    want = [(d, p, r or "missing", s, f or [], (c or "").strip()) for d, _, _, p, r, s, f, c in pages]
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(want)
    assert {(r.page_number, r.char_count, r.estimated_tokens) for r in got.collect()} == {(2, 31, 8), (1, 0, 0), (10, 6, 2), (3, 0, 0)}
    odd = spark.createDataFrame([("<pages><page><content><![CDATA[x]]></content></page><page number=\"z\" representation=\"\"></page></pages>",), ("none",), (None,)], "xml string")
    rows = [r.p for r in odd.select(D.document_pages(F.col("xml")).alias("p")).collect()]
    assert [tuple(p) for p in rows[0]] == [(0, "missing", None, [], "x"), (0, "missing", None, [], "")] and rows[1] == [] and rows[2] is None


def test_inventory_hashes_new_files_only(spark, tmp_path):
    raw, index = tmp_path / "raw", str(tmp_path / "index")
    run = lambda: files.index_new(spark, str(raw), index, str(tmp_path / "state"))
    put(raw / "My Deal.pdf", "one")
    put(raw / "deep" / "two.pdf", "two")
    put(raw / "skip.txt", "no")
    assert run() == 2 and run() == 0
    put(raw / "copy of two.pdf", "two")
    put(raw / "three.pdf", "three")
    assert run() == 2 and run() == 0
    got = sorted((r.doc_id.split("__")[0], r.source_filename, r.batch) for r in spark.read.json(index).collect())
    assert [g[:2] for g in got] == [("copy_of_two", "copy of two.pdf"), ("my_deal", "My Deal.pdf"), ("three", "three.pdf"), ("two", "two.pdf")] and {g[2] for g in got} == {0, 1}
    put(raw / "again" / "three.pdf", "three")
    assert run() == 1 and spark.read.json(index).count() == 4


def test_events_to_several_sinks(spark, tmp_path):
    """A replayed batch adds no line, and a sink that fails keeps nothing from the others."""
    seen = []

    def fails(batch, n):
        seen.append(n)
        if n == 1:
            raise RuntimeError("no room\nat all")

    sink = sinks.fan_out({"broken": fails, "a": sinks.event_lines(str(tmp_path / "a")), "b": sinks.event_lines(str(tmp_path / "b"))}, sinks.event_lines(str(tmp_path / "lost")))
    shape = "type string, thread_id long, note string"

    def run(checkpoint):
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        spark.createDataFrame([("turn_started", i, None), ("turn_completed", i, "x")], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(str(tmp_path / "state"))
    lines = lambda p: sorted(r.value for r in spark.read.text(str(tmp_path / p)).collect())
    once = lines("a")
    assert once == lines("b") and len(once) == 6 and once[0] == '{"type":"turn_completed","thread_id":0,"note":"x"}' and '{"type":"turn_started","thread_id":2,"note":null}' in once
    assert [json.loads(x) for x in lines("lost")] == [{"sink": "broken", "batch": 1, "error": "no room"}]
    run(str(tmp_path / "other"))  # all batches come again
    assert lines("a") == once and lines("b") == once and sorted(seen) == [0, 0, 1, 1, 2, 2]


def test_kept_and_filtered_with_a_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None)], "id int, keep boolean")
    got = sinks.write_split(rows, "keep", str(tmp_path / "out"))
    assert (got.kept_count, got.filtered_count) == (2, 2) and spark.read.json(str(tmp_path / "out" / "report")).first().kept_count == 2
    assert sorted((r.id, r.bucket) for r in spark.read.json(str(tmp_path / "out" / "items")).collect()) == [(1, "kept"), (2, "filtered"), (3, "kept"), (4, "filtered")]
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).where("keep = 'true'").count() == 2
