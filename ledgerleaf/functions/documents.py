"""Column rules over stored documents: JSON held against a schema, assembled XML taken apart, places of side files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, StringType, StructType, TimestampType

from . import text as T

PAGE = "struct<page_number:int,representation:string,source_path:string,quality_flags:array<string>,content:string>"


def json_kind(node: Column) -> Column:
    """object, array, string, boolean, null or number, of a variant."""
    t = F.schema_of_variant(node)
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


def _expected(kind: DataType) -> str:
    if isinstance(kind, (StructType, MapType)):
        return "object"
    if isinstance(kind, ArrayType):
        return "array"
    if isinstance(kind, (IntegralType, FractionalType)):
        return "number"
    return "boolean" if isinstance(kind, BooleanType) else "string" if isinstance(kind, (StringType, TimestampType)) else "any"


def refusals(node: Column, kind: DataType, path: Column | str = "$", needed: bool = True) -> Column:
    """SRC-07: what in a JSON variant doesn't belong to a schema, as an array of "path: reason".

    Unknown members at any depth, values of another sort, numbers with a fraction where whole ones are due, and members
    that are missing although the schema has them not null. The check is one expression, as deep as the schema.
    """
    at = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<string>")
    said = lambda why: F.array(F.concat(at, F.lit(f": {why}")))
    found = json_kind(node)
    absent = F.coalesce(found == "null", F.lit(True))
    missing = said("missing") if needed else none
    wrong = found != _expected(kind) if _expected(kind) != "any" else F.lit(False)
    inner = none
    if isinstance(kind, StructType):
        unknown = F.transform(F.array_except(F.json_object_keys(F.to_json(node)), F.array(*[F.lit(f.name) for f in kind.fields])), lambda k: F.concat(at, F.lit("."), k, F.lit(": unknown")))
        inner = F.concat(unknown, *[refusals(F.try_variant_get(node, f"$['{f.name}']", "variant"), f.dataType, F.concat(at, F.lit(f".{f.name}")), not f.nullable) for f in kind.fields])
    elif isinstance(kind, ArrayType):
        entries = F.filter(F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"].isNotNull())
        inner = F.flatten(F.transform(entries, lambda e: refusals(e["x"], kind.elementType, F.concat(at, F.lit("["), e["i"].cast("string"), F.lit("]")), not kind.containsNull)))
    elif isinstance(kind, IntegralType):
        inner = F.when(F.try_variant_get(node, "$", "decimal(38,9)") % 1 != 0, said("not whole")).otherwise(none)
    return F.when(absent, missing).when(wrong, said(f"not {_expected(kind)}")).otherwise(inner)


def unescaped(c: Column) -> Column:
    """Text of an XML attribute; the ampersand comes last, so that nothing is read twice."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def document_pages(xml: Column) -> Column:
    """SRC-13: the pages of an assembled document as an array of `PAGE`, in the order of the text.

    A page without a number has 0, without a representation `missing`, without a source null; content is what the CDATA
    section holds, joined again where it had to be cut, without white space around it.
    """
    part = lambda c, pattern: F.regexp_extract(c, pattern, 1)

    def page(block: Column) -> Column:
        head = part(block, r"<page\b([^>]*)>")
        named = lambda name: unescaped(part(head, rf'\b{name}="([^"]*)"'))
        flags = F.split(unescaped(T.strip(part(block, r"(?s)<quality_flags>(.*?)</quality_flags>"))), ",")
        content = F.replace(part(block, r"(?s)<content><!\[CDATA\[(.*?)\]\]></content>"), F.lit("]]]]><![CDATA[>"), F.lit("]]>"))
        return F.struct(
            F.coalesce(named("number").try_cast("int"), F.lit(0)).alias("page_number"),
            F.coalesce(F.nullif(named("representation"), F.lit("")), F.lit("missing")).alias("representation"),
            F.nullif(named("source_path"), F.lit("")).alias("source_path"),
            F.filter(flags, lambda f: f != "").alias("quality_flags"),
            T.strip(content).alias("content"),
        )

    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<page\b[^>]*>.*?</page>"), F.lit(0)), page)


def page_notes_path(artifacts: Column, notes_path: Column) -> Column:
    """SRC-11: where the notes of a document lie: the first JSON artifact in the place of notes, else beside the XML that the manifest names."""
    fits = F.filter(artifacts, lambda a: (a["kind"] == "json") & a["path"].endswith("/derived/page_notes.json"))
    beside = F.replace(notes_path, F.lit("normalized_page_notes.xml"), F.lit("page_notes.json"))
    return F.coalesce(F.get(F.transform(fits, lambda a: a["path"]), F.lit(0)), F.when(beside != notes_path, beside))
