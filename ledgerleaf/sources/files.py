"""Sources on files: document inventory, manifests, text artifacts, side files, assembled XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import documents as D
from ..functions import text as T

STAGE = "struct<status:string,updated_at:timestamp,version:string,error:string,warnings:array<string>>"
PAGE = "struct<page_number:int,text_path:string,ocr_text_path:string,markdown_path:string,vision_markdown_path:string,repair_markdown_path:string,image_path:string,extraction_method:string,char_count:int,ocr_char_count:int,ocr_confidence:double,warnings:array<string>,quality_flags:array<string>>"
MANIFEST = f"doc_id string, source_filename string, sha256 string, page_count int, has_text_layer boolean, quality_flags array<string>, processing_status {STAGE}, classification_path string, procurement_context_path string, page_notes_path string, pages array<{PAGE}>, derived_artifacts array<struct<kind:string,path:string,description:string>>, _corrupt string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def _hashed(files: DataFrame) -> DataFrame:
    """SRC-02..04: path, filename, size, sha256 and doc_id of files with their content."""
    name = F.element_at(F.split("path", "/"), -1)
    sha = F.sha2("content", 256)
    key = F.concat(T.slug(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit("__"), F.substring(sha, 1, 8))
    return files.select("path", name.alias("filename"), F.col("length").alias("size"), sha.alias("sha256"), key.alias("doc_id"))


def inventory(spark: SparkSession, folder: str, pattern: str = "*.pdf", known: DataFrame | None = None) -> DataFrame:
    """Path, filename, size, sha256 and doc_id of each file; with `known` only those whose doc_id is new. All files are hashed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    found = _hashed(files)
    return found if known is None else found.join(known.select("doc_id").distinct(), "doc_id", "left_anti").select(found.columns)


def index_new(spark: SparkSession, folder: str, index: str, checkpoint: str, pattern: str = "*.pdf") -> int:
    """SRC-01: appends the files that are new since the last run to the index, JSON lines, and returns how many were hashed.

    The checkpoint knows the files of earlier runs, so those aren't read again. A file whose content is indexed already
    under another name keeps its first entry; a batch that is repeated after a failure replaces its own lines.
    """
    hashed = 0

    def append(batch: DataFrame, n: int) -> None:
        nonlocal hashed
        rows = batch.persist()
        hashed += rows.count()
        first = rows.groupBy("doc_id").agg(F.min(F.struct("filename", "path", "size", "sha256")).alias("f")).select("doc_id", "f.*")
        known = _indexed(spark, index, n)
        new = first if known is None else first.join(known, "doc_id", "left_anti")
        lines = new.select("doc_id", F.col("filename").alias("source_filename"), F.col("path").alias("source_pdf"), "sha256", F.lit(None).cast("int").alias("page_count"), F.concat("doc_id", F.lit("/manifest.json")).alias("manifest_path"), F.col("doc_id").alias("doc_dir"))
        lines.sort("source_filename").write.mode("overwrite").option("ignoreNullFields", False).json(f"{index}/batch={n}")
        rows.unpersist()

    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    query = _hashed(files).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return hashed


def _indexed(spark: SparkSession, index: str, before: int) -> DataFrame | None:
    """doc_id of the entries of earlier batches; none before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("doc_id string, batch long").json(index).where(F.col("batch") < before).select("doc_id").distinct()


def _relative(spark: SparkSession, root: str, file: Column) -> Column:
    """A file's path from `root` on, as it reads: without scheme and host, and without percent signs for odd characters."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    plain = F.url_decode(F.replace(F.regexp_replace(file, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return F.substring(plain, F.lit(len(whole) + 2), F.length(plain))


def texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (from `root` on) and value of all text files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(_relative(spark, root, F.col("_metadata.file_path")).alias("path"), "value")


def side_files(rows: DataFrame, root: str, path: Column, pattern: str = "*.json") -> DataFrame:
    """SRC-10: `rows` with `payload`, the JSON file that `path` names from `root` on, as a variant.

    No path, no such file, or a file that isn't JSON gives null; `rows` may have any other columns.
    """
    spark = rows.sparkSession
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), path.alias("path"))
    met = kept.join(texts(spark, root, pattern), "path", "left")
    return met.select("row.*", F.try_parse_json("value").alias("payload"))


def manifests(spark: SparkSession, folder: str, doc_ids: list[str] | None = None) -> DataFrame:
    """SRC-06..08: manifests by a fixed schema and `refused`, what in each doesn't belong to it (unknown members, other types).

    One read: the text is parsed twice where it lies. What isn't JSON keeps its text in `_corrupt`. No ids mean no filter.
    """
    shape = StructType.fromDDL(MANIFEST)
    known = StructType([f for f in shape.fields if f.name != "_corrupt"])
    files = spark.read.text(f"{folder}/*/manifest.json", wholetext=True)
    node = F.try_parse_json("value")
    rows = files.select(F.from_json("value", shape, {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"), F.when(node.isNull(), F.array(F.lit("$: not JSON"))).otherwise(D.refusals(node, known)).alias("refused"))
    rows = rows.select("m.*", "refused")
    return rows.where(F.col("doc_id").isin(doc_ids)) if doc_ids else rows


def page_texts(spark: SparkSession, manifest: DataFrame, root: str, kind: str = "text_path") -> DataFrame:
    """SRC-12: doc_id, page_number, content of the text artifacts, whose paths are from `root` on; a missing or blank file gives null."""
    pages = manifest.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", F.col(f"p.{kind}").alias("path"))
    return pages.join(texts(spark, root), "path", "left").select("doc_id", "page_number", F.nullif(T.strip(F.col("value")), F.lit("")).alias("content"))


def page_notes(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """SRC-11 with SRC-10: doc_id and payload of the notes of each document; null without notes."""
    return side_files(manifest.select("doc_id", "derived_artifacts", "page_notes_path"), root, D.page_notes_path(F.col("derived_artifacts"), F.col("page_notes_path"))).select("doc_id", "payload")


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13 with SIB-33: the pages of assembled documents, each with its length and estimated tokens."""
    docs = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    # one file may hold several documents, as a distributed sink writes them
    whole = docs.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<document\b[^>]*>.*?</document>"), F.lit(0))).alias("xml"))
    return pages_of(whole, F.col("xml"), F.regexp_extract("xml", r'<document doc_id="([^"]*)"', 1))


def pages_of(docs: DataFrame, xml: Column, doc: Column) -> DataFrame:
    """doc, page_number, representation, source_path, quality_flags, content, char_count, estimated_tokens."""
    pages = docs.select(D.unescaped(doc).alias("doc"), F.explode(D.document_pages(xml)).alias("p")).select("doc", "p.*")
    return pages.select("*", F.length("content").alias("char_count"), T.inventory_tokens(F.col("content")).alias("estimated_tokens"))
