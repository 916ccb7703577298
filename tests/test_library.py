"""Every query with SQL against DuckDB, the text rules, sources, sinks and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import flags as G
from ledgerleaf.functions import text as T
from ledgerleaf.operators import mart, timeline, transitions
from ledgerleaf.plans import catalog
from ledgerleaf.sources import files, sinks
from ledgerleaf.streaming import stateful

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


def plain(v):
    return None if v is None else str(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_like_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = catalog.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = [tuple(map(plain, r)) for r in rows.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = [tuple(map(plain, r)) for r in con.execute(f"SELECT {quoted} FROM ({catalog.SQL[name]})").fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_text_rules(spark):
    row = spark.createDataFrame([(" a\t\tb \r\n\r\n\r\n\r\n c ", "x y", "", "my_file-name.v2.pdf", "Straße é")], "a string, b string, c string, d string, e string")
    got = row.select(
        T.normalize_page(F.col("a")).alias("page"),
        T.normalize_ocr(F.col("a")).alias("ocr"),
        T.clean(F.lit("  x   ")).alias("clean"),
        T.cut(F.lit("word " * 200), 20).alias("cut"),
        T.humanize_filename(F.col("d")).alias("title"),
        T.slug(F.col("e")).alias("slug"),
        T.slug(F.col("c")).alias("none"),
        T.mart_tokens(F.lit("x" * 10)).alias("even"),
        T.alpha_ratio(F.lit("é1 ")).alias("alpha"),
        T.bucket_label(F.lit(None).cast("string")).alias("null"),
        T.cdata(F.lit("a]]>b")).alias("cdata"),
    ).first()
    assert got.page == "a b\n\nc" and got.ocr == "a\t\tb\nc" and got.clean == "x" and got.cut == "word word word word..." and got.title == "my file name.v2"
    assert (got.slug, got.none, got.even, got.alpha, got.null, got.cdata) == ("stra_e", "document", 2, 0.5, "(null)", "<![CDATA[a]]]]><![CDATA[>b]]>")


def test_signals(spark):
    df = spark.createDataFrame([("", True), ("short page ", True), ("1234 5678 " * 10, False)], "t string, i boolean")
    got = [r[0] for r in df.select(G.page_signals(F.col("t"), F.col("i"))).collect()]
    assert got[0] == ["no_text_extracted", "suspected_image_only_page", "suspected_scanned_page", "image_render_recommended", "ocr_recommended"]
    assert got[1] == ["low_text_density", "image_render_recommended", "possible_header_footer_only"]
    assert got[2] == ["suspected_garbled_text", "ocr_recommended"]


def test_upsert_and_scope(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, mart.anti_upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert mart.delete_scope(old, new, ["k"]).count() == 1 and mart.delete_scope(old, new, ["k"], F.col("v") == "x").count() == 2


def test_replay_outcomes(spark):
    items = spark.createDataFrame([(1, 1), (1, 2)], "thread_id long, seq long")
    for cursor, want in ((None, ("snapshot", 2, 2)), (1, ("items_appended", 2, 1)), (2, ("thread_updated", 2, 0)), (99, ("reset", 2, 2))):
        r = timeline.replay(items, spark.createDataFrame([(1, cursor)], "thread_id long, cursor long")).first()
        assert (r.event, r.cursor_after, r["items"]) == want


def run_stream(spark, folder, schema, batches, make, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = make(spark.readStream.schema(schema).parquet(str(folder)))
        q = stream.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}-out").collect()


def test_replay_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path / "items", "thread_id long, seq long", [[(1, 1), (1, 2), (2, 1)], [(1, 3), (1, 2)]], stateful.replay_stream, "replay")
    assert sorted(map(tuple, got)) == [(1, "items_appended", 3, 1), (1, "snapshot", 2, 2), (2, "snapshot", 1, 1)]


def test_limit_stream_is_like_batch(spark, tmp_path):
    first, second = [(1, i, 100 * i) for i in range(4)], [(1, i, 100 * i) for i in range(4, 9)] + [(2, 20, 5), (2, 21, 305), (2, 22, 700)]
    got = run_stream(spark, tmp_path / "fail", "user_id long, event_id long, at long", [first, second], lambda s: stateful.limit_failures(s, 4), "limit")
    both = spark.createDataFrame(first + second, "user_id long, event_id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    want = timeline.failures_in_window(both, "user_id", "ts").select("user_id", "event_id", "recent", (F.col("recent") >= 4).alias("blocked")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "My Deal.pdf").write_bytes(b"one")
    (tmp_path / "raw" / "skip.txt").write_bytes(b"no")
    found = files.inventory(spark, str(tmp_path / "raw")).collect()
    assert len(found) == 1 and found[0].doc_id.startswith("my_deal__") and found[0].size == 3
    known = spark.createDataFrame([(found[0].doc_id,)], "doc_id string")
    assert files.inventory(spark, str(tmp_path / "raw"), known=known).count() == 0
    sinks.write_index(spark.createDataFrame([(1, None)], "doc long, buyer string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().doc == "1"


def test_delete_scope_keeps_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a"), (None, "a"), (3, "b"), (3, "b")], "doc int, stage string")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "doc int")
    left = mart.delete_scope(rows, keys, ["doc"], F.col("stage") == "a")
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(1, None), (2, "a"), (None, "a"), (3, "b"), (3, "b")]))
    assert mart.delete_scope(rows, keys, ["doc"]).count() == 4


def test_dispatch_with_wildcards(spark):
    from ledgerleaf.operators import queue

    events = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (3, 6, "a"), (4, None, "a")], "event_id int, thread int, kind string")
    subs = spark.createDataFrame([(1, 5, None), (2, None, "a"), (3, 5, "a"), (4, 7, "a")], "sub int, thread int, kind string")
    got = sorted((r["event_id"], r["sub"]) for r in queue.dispatch(events, subs).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 2), (4, 2)]


def test_text_list(spark):
    from ledgerleaf.operators import queue

    rows = spark.createDataFrame([('["a", "b"]',), ("{}",), ("no",), (None,), ("",)], "c string")
    assert [r[0] for r in rows.select(queue.text_list(F.col("c"))).collect()] == [["a", "b"], [], [], [], []]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_coe13_sends_lengths_not_texts(spark):
    plan = catalog.QUERIES["COE-13"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    collected = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "content_text" not in collected and "chars" in collected


def test_documents_are_chosen_or_refused(spark):
    from ledgerleaf.operators import chat

    rows = spark.range(20).withColumnRenamed("id", "doc")
    ids = lambda df: sorted(r.doc for r in df.collect())
    assert ids(chat.select_documents(rows, "doc", one=3)) == [3] and len(ids(chat.select_documents(rows, "doc"))) == 20
    few = ids(chat.select_documents(rows, "doc", n=5, seed=1))
    assert len(few) == 5 and few == ids(chat.select_documents(rows.repartition(7), "doc", n=5, seed=1)) != ids(chat.select_documents(rows, "doc", n=5, seed=2))
    for wrong in ({"n": 0}, {"n": 21}):
        with pytest.raises(ValueError):
            chat.select_documents(rows, "doc", **wrong)
    with pytest.raises(LookupError):
        chat.select_documents(rows, "doc", one=99)


def test_open_subscriptions_get_every_event(spark):
    from ledgerleaf.operators import queue

    events = spark.createDataFrame([(1, 5, 8, "a"), (2, None, None, None)], "event_id int, thread long, turn long, kind string")
    subs = spark.createDataFrame([(1, None, None, None), (2, 5, None, None), (3, 5, 9, None), (4, None, 8, "a")], "sub int, thread long, turn long, kind string")
    assert sorted(map(tuple, queue.dispatch(events, subs).collect())) == [(1, 1), (1, 2), (1, 4), (2, 1)]
    assert queue.dispatch(events, subs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["FLT-07", "FLT-08", "FLT-09", "FLT-10", "FLT-11", "FLT-16", "FLT-19", "FLT-34", "SIB-15", "SIB-16", "SIB-17", "SIB-24", "MTH-05", "MTH-07", "AGG-09", "AGG-10", "AGG-12", "SET-06"])
def test_texts_are_normalised_once(spark, name):
    """Filters on flags don't move beneath them with copies of what they are made of: a scan's texts are normalised once."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\r\n?") == plan.count("Relation [") <= 4


def test_numeric_tokens(spark):
    texts = ["", "a 1", "12 34a a1", " 1\n", "a1b2 abc12 abcd1", "x", "1-2 3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.numeric_token_ratio(F.col("t"))).collect()] == [0.0, 0.5, 1.0, 1.0, 2 / 3, 0.0, 1.0]


def test_replay_keeps_threads_whole(spark):
    """Rows of a thread meet in one task, also where both sides of the union are dealt by thread and merged by size."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(was, ("4k", "1k", "false", "50")):
            spark.conf.set(k, v)
        got = catalog.QUERIES["STM-04"](spark, SF).groupBy("event").sum("items").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    found = {r.event: r[1] for r in got}
    assert found["snapshot"] == found["heartbeat"] == 0
    assert found["items_appended"] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_new_turns_are_all_appended(spark):
    old = spark.createDataFrame([(1, 5, "active"), (2, 5, "queued")], "turn_id long, thread_id long, status string")
    new = spark.createDataFrame([(2, 5), (3, 6), (3, 6)], "turn_id long, thread_id long")
    assert sorted(map(tuple, transitions.append_turns(old, new).collect())) == [(1, 5, "active"), (2, 5, "queued"), (2, 5, "queued"), (3, 6, "queued"), (3, 6, "queued")]
    assert sorted(map(tuple, transitions.queue_turns(old, new).collect())) == [(1, 5, "active"), (2, 5, "queued"), (3, 6, "queued")]


def test_stored_items_are_not_broadcast(spark):
    plan = catalog.QUERIES["JOI-15"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


PAGE_FLAGS = ["AGG-12", "FLT-19", "SET-06", "FLT-08", "FLT-16", "AGG-10", "SIB-16", "FLT-11", "FLT-34", "AGG-09", "SIB-17", "FLT-07", "MTH-07"]


@pytest.mark.parametrize("name", ["AGG-12", "SET-06", "FLT-34"])
def test_pages_are_read_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", PAGE_FLAGS)
def test_normalised_texts_are_searched_once(spark, name):
    """One pattern runs over a whole normalised text; the others see what isn't a letter. Tokens are looked into only where there are digits."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(norm#") == plan.count("Relation [") == 1
    assert "split(norm#" not in plan and "regexp_count(norm#" not in plan and "regexp_extract_all(norm#" not in plan


@pytest.mark.parametrize("name", ["SIB-16", "SIB-17", "FLT-07"])
def test_whole_texts_are_copied_once(spark, name):
    """Line breaks are counted where letters are gone, symbols where blanks are gone too, and only texts with loose ends are trimmed."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(norm#") == 1 and plan.count("regexp_replace(_bare#") == 2
    assert "StartsWith" in plan and "EndsWith" in plan


def test_normalised_to_the_very_end(spark):
    """Only blanks and line feeds are stripped, and only at the very end, not before a last line separator."""
    texts = ["", " \n a\r\n\r\n\r\n\rb\t \tc \n d \n", "a \u0085", "a  ", "\u000b a\r", "a  b\n \n\n c", "\r\r"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.normalize_page(F.col("t"))).collect()] == ["", "a\n\nb c\nd", "a \u0085", "a  ", "\u000b a", "a b\n\nc", ""]


def test_ratios_of_odd_texts(spark):
    texts = ["", " \n\u0085　", "é1 \U0001d49c٣|", "\u000b- á", "x Ⅰ\n2"]
    rows = T.with_ratios(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [(r.chars, r.alpha, r.symbol, r.newline) for r in rows] == [(0, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 0.25), (6, 0.4, 0.2, 0.0), (5, 1 / 3, 2 / 3, 0.0), (5, 1 / 3, 0.0, 0.2)]


def test_rollup_of_alike_pages(spark):
    """A row that stands for several pages counts as that many."""
    alike = spark.createDataFrame([(1, ["suspected_scanned_page"], 2), (1, [], 3), (2, ["suspected_scanned_page"], 3), (2, [], 3)], "doc int, flags array<string>, n int")
    got = {r.doc: r.f for r in alike.groupBy("doc").agg(G.document_rollup(pages=F.col("n")).alias("f")).collect()}
    assert "mostly_image_based" not in got[1] and "mostly_image_based" in got[2] and "has_scanned_pages" in got[1]
