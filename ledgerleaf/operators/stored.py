"""Queries over stored documents: JSON that is refused, assembled XML taken apart again, where notes lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import documents as D
from ..functions import text as T
from ..plans import bridges as B
from ..plans.catalog import query
from .pages import assembled

USER = StructType([StructField("user", LongType())])
TAG = StructType([StructField("n", LongType())])
EVENT = StructType([StructField("k", IntegerType(), False), StructField("by", USER, False), StructField("tags", ArrayType(TAG))])

#: Events' properties in a larger object, wrong in ways that the id says; Spark and DuckDB read this expression alike.
BODY = """concat('{"k":', CASE event_id % 7 WHEN 0 THEN '"text"' WHEN 1 THEN '1.5' WHEN 2 THEN 'null' ELSE substr(props, 7, length(props) - 7) END,
  CASE event_id % 5 WHEN 0 THEN ',"by":7' WHEN 1 THEN '' ELSE concat(',"by":{"user":', event_id, CASE WHEN event_id % 3 = 0 THEN ',"odd":1' ELSE '' END, '}') END,
  ',"tags":[', CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '{"n":1},{"n":2,"odd":true}' WHEN 2 THEN '{"n":"x"},5' ELSE 'null,{"n":3}' END, ']',
  CASE WHEN event_id % 11 = 0 THEN ',"a b":{"deep":[]}' ELSE '' END, CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END)"""


@query("SRC-07", """SELECT event_id, refused = '' AS accepted, refused FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '$: not JSON' ELSE concat_ws('; ', CASE WHEN event_id % 11 = 0 THEN '$.a b: unknown' END,
  CASE event_id % 7 WHEN 0 THEN '$.k: not number' WHEN 1 THEN '$.k: not whole' WHEN 2 THEN '$.k: missing' END, CASE WHEN event_id % 5 = 0 THEN '$.by: not object' WHEN event_id % 5 = 1 THEN '$.by: missing' WHEN event_id % 3 = 0 THEN '$.by.odd: unknown' END,
  CASE event_id % 4 WHEN 1 THEN '$.tags[1].odd: unknown' WHEN 2 THEN '$.tags[0].n: not number; $.tags[1]: not object' END) END AS refused FROM events)""")
def src07(spark, sf_dir):
    """Which bodies are taken, and what the others are refused for."""
    node = F.try_parse_json("body")
    refused = F.when(node.isNull(), F.array(F.lit("$: not JSON"))).otherwise(D.refusals(node, EVENT))
    rows = B.read(spark, sf_dir, "events").select("event_id", F.expr(BODY).alias("body")).select("event_id", refused.alias("r"))
    return rows.select("event_id", (F.size("r") == 0).alias("accepted"), F.array_join("r", "; ").alias("refused"))


def parsed(spark, sf_dir: str) -> DataFrame:
    """The assembled documents' pages, read back from the XML."""
    return assembled(spark, sf_dir).select("doc", F.explode(D.document_pages(F.col("xml"))).alias("p")).select("doc", "p.*")


_BACK = "SELECT f.doc, f.page AS page_number, coalesce(b.representation, 'missing') AS representation, 'out & in/' || b.representation || '/' || f.doc_id AS source_path, array_to_string(flags, ',') AS flags, regexp_replace(regexp_replace(coalesce(b.content, ''), '^\\s+', ''), '\\s+$', '') AS content FROM flagged f LEFT JOIN best b ON f.doc = b.doc AND f.page = b.page"


@query("SRC-13", B.with_views("flagged best", f"SELECT doc, page_number, representation, source_path, flags, md5(content) AS digest FROM ({_BACK})"))
def src13(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc", "page_number", "representation", "source_path", F.array_join("quality_flags", ",").alias("flags"), F.md5("content").alias("digest"))


@query("SIB-33", B.with_views("flagged best", f"SELECT doc, page_number, representation, flags, length(content) AS char_count, (length(content) + 3) // 4 AS estimated_tokens FROM ({_BACK})"))
def sib33(spark, sf_dir):
    """Token records of the pages of assembled documents."""
    return parsed(spark, sf_dir).select("doc", "page_number", "representation", F.array_join("quality_flags", ",").alias("flags"), F.length("content").alias("char_count"), T.inventory_tokens(F.col("content")).alias("estimated_tokens"))


@query("SRC-11", """SELECT l_orderkey AS o, coalesce(min(CASE WHEN l_partkey % 3 = 0 AND l_suppkey % 4 = 1 THEN lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '/derived/page_notes.json' END),
  CASE l_orderkey % 3 WHEN 0 THEN 'd' || l_orderkey || '/derived/page_notes.json' END) AS path FROM lineitem GROUP BY l_orderkey""")
def src11(spark, sf_dir):
    """Where the notes lie: an order's lines are the artifacts, two of three manifests name no XML that could tell."""
    made = F.struct(F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("place"), F.when(F.col("l_partkey") % 3 == 0, "json").otherwise("xml").alias("kind"), F.when(F.col("l_suppkey") % 4 == 1, "derived/page_notes.json").otherwise("derived/other.json").alias("tail"))
    lists = B.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(made)).alias("a"))
    listed = F.transform("a", lambda a: F.struct(a["kind"].alias("kind"), F.concat_ws("/", a["place"], a["tail"]).alias("path")))
    named = F.when(F.col("o") % 3 == 0, F.concat(F.lit("d"), F.col("o").cast("string"), F.lit("/derived/normalized_page_notes.xml"))).when(F.col("o") % 3 == 1, "derived/elsewhere.xml")
    return lists.select("o", D.page_notes_path(listed, named).alias("path"))
