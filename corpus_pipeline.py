"""The corpus pipeline: documents in, packed training sequences out; each stage is one operator of `ledgerleaf.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import decontaminate, language, packing, secrets, simhash
from ledgerleaf.llm.common import free_name, materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; one without a label gets the predicted language as its `lang`. Labels that were given stay."""
    guess, score = free_name(docs.columns, "guess"), free_name(docs.columns, "guess_score")
    found = language.predict(docs.where(language.has_letter(F.col("text"))), language.fit(docs), lang_as=guess, score_as=score)
    told = F.when((F.coalesce(F.trim("lang"), F.lit("")) == "") & (F.col(guess) != "und"), F.col(guess)).otherwise(F.col("lang"))
    return found.withColumn("lang", told).drop(guess, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets blanked out; n_chars follows the text."""
    return secrets.redact(docs).selectExpr(*["cast(length(text) as long) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and places in sequences; `packing.sequences` joins them."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]
#: SQL can't express linear models, fingerprints or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written in the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
