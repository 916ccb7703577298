"""Text rules as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any kind, as the inside of a character class.
_WIDE = "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2000))) + "-" + "".join(map(chr, (0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = f"[\\s{_WIDE}]"
_BREAKS = "".join(map(chr, (0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)))


def strip(c: Column) -> Column:
    """Cut white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def _named(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` uses it."""
    return F.transform(F.array(c), f)[0]


def normalize_page(c: Column) -> Column:
    """Line ends to LF, runs of blanks to one, lines stripped, at most one empty line in a row, stripped.

    Patterns run over a text only where it holds what they replace; a search for fixed text costs a fraction of one.
    """
    some = lambda c, marks, pattern, to: _named(c, lambda x: F.when(reduce(or_, [x.contains(m) for m in marks]), F.regexp_replace(x, pattern, to)).otherwise(x))
    c = some(c, ["\r"], r"\r\n?", "\n")
    c = some(c, ["\t", "  "], r"[ \t]+", " ")
    c = some(c, [" \n", "\n "], r" ?\n ?", "\n")
    c = some(c, ["\n\n\n"], r"\n{3,}", "\n\n")
    loose = lambda x: reduce(or_, [at(m) for at in (x.startswith, x.endswith) for m in (" ", "\n")])
    return _named(c, lambda x: F.when(loose(x), F.btrim(x, F.lit(" \n"))).otherwise(x))  # trimming looks at every character


def normalize_ocr(c: Column) -> Column:
    """Stripped lines, without the empty ones."""
    lines = F.transform(F.split(c, f"\r\n|[{_BREAKS}]"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _others(c: Column) -> Column:
    """What isn't a letter: a small part of most texts, so that the rest is counted there."""
    return F.regexp_replace(c, r"\p{L}+", "")


def _bare(others: Column) -> Column:
    """Without the common white space."""
    return F.replace(F.replace(others, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))


def _dark(bare: Column) -> Column:
    """What is neither a letter nor white space."""
    return F.regexp_replace(bare, f"{SPACE}+", "")


def solid(c: Column) -> Column:
    """How many characters aren't white space."""
    return letters(c) + F.length(_dark(_bare(_others(c))))


def letters(c: Column) -> Column:
    return F.length(c) - F.length(_others(c))


def symbols(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s]+", ""))


def line_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def alpha_ratio(c: Column) -> Column:
    return _share(letters(c), solid(c))


def symbol_ratio(c: Column) -> Column:
    return _share(symbols(c), solid(c))


def newline_ratio(c: Column) -> Column:
    return _share(line_breaks(c), F.length(c))


def with_ratios(rows: DataFrame, text: str) -> DataFrame:
    """Adds chars, a text column's length, and its alpha, symbol and newline ratios; each text is counted once, in steps of their own."""
    c, others, bare, chars = F.col(text), F.col("_others"), F.col("_bare"), F.col("chars")
    counted = rows.withColumns({"chars": F.length(c), "_others": _others(c)})
    counted = counted.withColumns({"_letters": chars - F.length(others), "_breaks": line_breaks(others), "_bare": _bare(others)})
    counted = counted.withColumns({"_dark": F.length(_dark(bare)), "_symbols": symbols(bare)})
    counted = counted.withColumn("_solid", F.col("_letters") + F.col("_dark"))
    share = {"alpha": ("_letters", "_solid"), "symbol": ("_symbols", "_solid"), "newline": ("_breaks", "chars")}
    return counted.withColumns({k: _share(F.col(a), F.col(b)) for k, (a, b) in share.items()}).drop("_solid", "_letters", "_symbols", "_breaks", "_others", "_bare", "_dark")


def clean(c: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def cut(c: Column, limit: int) -> Column:
    """Collapsed text, cut one short of `limit` and marked by dots if longer."""
    c = F.coalesce(clean(c), F.lit(""))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("...")))


def humanize_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"[_-]+", " "))


def first_text(*cs: Column) -> Column:
    """The first that isn't blank, stripped; else the empty text."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs], F.lit(""))


def bucket_label(c: Column) -> Column:
    return F.when(c.isNull(), "(null)").otherwise(F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("(blank)")))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^_+|_+$", ""), F.lit("")), F.lit("document"))


def xml_attribute(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def title_case(c: Column) -> Column:
    return F.initcap(F.translate(c, "_-", "  "))


def mart_tokens(c: Column) -> Column:
    """Length over four, half to even, at least 1; 0 for an empty text."""
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.bround(n / 4, 0).cast("long")))


def inventory_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def numeric_token_ratio(c: Column) -> Column:
    """Share of the tokens at least half of whose characters are digits; only texts and tokens that hold a digit are looked into."""
    digits = lambda w: F.length(F.regexp_replace(w, r"[^0-9]+", ""))
    many = lambda words: F.size(F.filter(words, lambda w: (w != "") & (digits(w) >= F.greatest(F.lit(1), F.floor(F.length(w) / 2)))))
    tokens = lambda x: F.regexp_extract_all(x, F.lit(r"([^\s0-9]*+[0-9]\S*+)|\S++"), F.lit(1))  # each that holds a digit, an empty text for each other
    return _named(c, lambda x: F.when(x.rlike("[0-9]"), _named(tokens(x), lambda words: _share(many(words), F.size(words)))).otherwise(F.lit(0.0)))


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp as it reads, whatever the session's time zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
