"""Sinks: index as CSV, assembled XML, kept and dropped rows apart, reports as JSON, events to several places at once."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators.pages import document_xml, page_xml

LOGGER = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]


def write_index(rows: DataFrame, path: str) -> None:
    """SNK-11: CSV with a header; nulls are empty."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns]).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def documents(pages: DataFrame) -> DataFrame:
    """doc, xml: assembled documents from pages (doc, filename, source_pdf, page, representation, source_path, flags, content); every page has its block."""
    block = page_xml(F.col("page"), F.col("representation"), F.col("source_path"), F.col("flags"), F.col("content"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("xml")))), lambda p: p["xml"])
    each = pages.groupBy("doc").agg(F.min("filename").alias("filename"), F.min("source_pdf").alias("source"), F.count("*").alias("n"), blocks.alias("blocks"))
    return each.select("doc", document_xml(F.col("doc").cast("string"), F.col("filename"), F.col("source"), F.col("n"), F.col("blocks")).alias("xml"))


def write_documents(pages: DataFrame, path: str) -> None:
    """SNK-12: assembled documents as text, each whole in one file, several in a file."""
    documents(pages).select("xml").write.mode("overwrite").text(path)


def write_split(rows: DataFrame, keep: str, path: str) -> Row:
    """SNK-17: one folder for each value of `keep`, and a report beside them: how many rows were kept and filtered, and where each lies."""
    rows.write.partitionBy(keep).mode("overwrite").parquet(f"{path}/rows")
    kept = F.coalesce(F.col(keep).cast("boolean"), F.lit(False))
    counts = rows.agg(F.count_if(kept).alias("kept_count"), F.count_if(~kept).alias("filtered_count")).select(F.lit(path).alias("output_dir"), "*")
    write_report(counts, f"{path}/report")
    items = rows.withColumn("bucket", F.when(kept, "kept").otherwise("filtered"))
    items.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/items")
    return counts.first()


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def event_lines(path: str) -> Sink:
    """SNK-13: events as compact JSON lines, a folder for each batch, so a batch that comes again replaces its own lines."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={n}")

    return write


def fan_out(sinks: dict[str, Sink], failures: Sink | None = None) -> Sink:
    """SIB-74: one batch to several sinks; one that fails keeps none of the others from it, and its failure is logged.

    The batch is computed once. `failures` gets a row (sink, batch, error) for each; a failing sink doesn't get the
    batch again, as the stream goes on.
    """

    def write(batch: DataFrame, n: int) -> None:
        held, lost = batch.persist(), []
        try:
            for name, sink in sinks.items():
                try:
                    sink(held, n)
                except Exception as e:  # noqa: BLE001
                    LOGGER.exception("sink %s failed at batch %s", name, n)
                    lost.append((name, n, str(e).splitlines()[0][:500]))
            if lost and failures:
                failures(batch.sparkSession.createDataFrame(lost, "sink string, batch long, error string"), n)
        finally:
            held.unpersist()

    return write
