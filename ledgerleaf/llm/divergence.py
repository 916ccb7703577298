"""Source divergence audit: how far each source's words stray from the other sources and from their language.

A task counts the terms of its texts and builds a byte trie of them for each language, a radix trie in preorder: a leaf's
path leaves that of the leaf before after `shared` bytes and goes on by an edge of its own, and the leaf has how many
documents hold the term and a counter for each source that does. At `ENTRIES` counters the tries are written, in pieces
of `PIECE` leaves, and new ones begun. Places sampled from the written pieces cut the terms into ranges of prefixes.
Pieces are cut where a range ends, so each range's pieces meet in one task, which merges them, `MERGED` leaves at a time,
and keeps the terms that enough documents hold. A last walk over the kept terms, in UTF-8 order, streams two things at
once: sums of f for each pair of sources, and the best terms of each group, where of equal values the term met first
stands first.

Terms are UTF-8 bytes without ASCII other than letters; A-Z alone are lower-cased, so each is what the same pattern over
code points gives. p = 1 + floor(unit * (count + 1) / (N + V)), f = floor((p - q)^2 / q), in whole numbers throughout
(longs; Python's integers where a count is too large for them).

Memory: the counters of a task; a range's distinct terms, and there are `RANGES` ranges for each shuffle partition; sums
for at most `CELLS` pairs of sources at a time; languages, or bands of one language's sources, beyond that go in further
passes over the kept terms. No source is a shuffle key before its terms are counted, and a term comes to its range once
for each piece, however frequent it is.

Defined results: null text, lang and source are empty strings; repeated rows count each as a document; a language none
of whose terms is kept has value 0 for every pair and no terms; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
ENTRIES = 600_000
PIECE = 4_096
MERGED = 500_000
RANGES = 4
#: Pieces of tries that the ends of ranges are chosen from, and bytes of a term that an end keeps.
SAMPLE, PREFIX = 20_000, 32
#: Pairs of sources, and sources, that one pass holds sums and totals for.
CELLS = 4_000_000
GROUPS = 200_000
#: Code units of a text that are counted at a time.
SLICE = 1 << 20

#: ASCII letters in lower case, other ASCII as blanks, bytes of longer characters as they are.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
KEPT = "lang string, term binary, sources array<string>, counts array<long>"
PACKED = "lang string, first binary, last binary, sources array<string>, shared binary, sizes binary, edges binary, docs binary, width binary, who binary, counts binary"


class Trie:
    """A radix trie in preorder: terms in byte order, and for each leaf its documents and the counters of `width` sources (`who`)."""

    def __init__(self, sources: list[str], terms: list[bytes], docs: np.ndarray, width: np.ndarray, who: np.ndarray, counts: np.ndarray):
        self.sources, self.terms, self.docs, self.width, self.who, self.counts = sources, terms, docs, width, who, counts

    @classmethod
    def of(cls, docs: Counter, occur: dict[str, Counter]) -> Trie:
        """From the documents of each term and the counts of each source."""
        terms, sources = sorted(docs), sorted(occur)
        place = {t: i for i, t in enumerate(terms)}
        leaf = np.concatenate([np.fromiter(map(place.__getitem__, occur[s]), np.int64, len(occur[s])) for s in sources])
        counts = np.concatenate([np.fromiter(occur[s].values(), np.int64, len(occur[s])) for s in sources])
        who = np.repeat(np.arange(len(sources)), [len(occur[s]) for s in sources])
        order = np.argsort(leaf, kind="stable")
        return cls(sources, terms, np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)), np.bincount(leaf, minlength=len(terms)), who[order], counts[order])

    def cut(self, a: int, b: int) -> Trie:
        """Leaves a to b."""
        ends = np.r_[0, np.cumsum(self.width)]
        some = slice(ends[a], ends[b])
        return Trie(self.sources, self.terms[a:b], self.docs[a:b], self.width[a:b], self.who[some], self.counts[some])

    def pack(self, lang: str) -> tuple:
        """A row of `PACKED`: of each term only the edge, what follows the bytes that it shares with the term before."""
        most = min(64, max(map(len, self.terms)))
        head = np.array(self.terms, f"S{most}").view(np.uint8).reshape(-1, most)
        other = head[1:] != head[:-1]
        shared = np.r_[0, np.where(other.any(1), other.argmax(1), most)] if len(head) > 1 else np.zeros(1, int)
        edges = [t[k:] for t, k in zip(self.terms, shared.tolist())]
        sizes = np.fromiter(map(len, edges), np.int64, len(edges))
        data = [x.astype(k).tobytes() for x, k in ((shared, "u1"), (sizes, "<u4"), (self.docs, "<i8"), (self.width, "<u4"), (self.who, "<u4"), (self.counts, "<i8"))]
        return lang, self.terms[0], self.terms[-1], self.sources, data[0], data[1], b"".join(edges), *data[2:]

    @classmethod
    def unpack(cls, sources: list[str], shared: bytes, sizes: bytes, edges: bytes, *rest: bytes) -> Trie:
        terms, term, at = [], b"", 0
        for k, n in zip(shared, np.frombuffer(sizes, "<u4").tolist()):
            term = term[:k] + edges[at : at + n]
            terms.append(term)
            at += n
        return cls(sources, terms, *(np.frombuffer(x, k).astype(np.int64) for x, k in zip(rest, ("<i8", "<u4", "<u4", "<i8"))))

    @classmethod
    def merge(cls, tries: list[Trie]) -> Trie:
        """One trie of several: equal leaves become one, counters of the same source are added."""
        sources = sorted({s for t in tries for s in t.sources})
        place = {s: i for i, s in enumerate(sources)}
        coded = pa.array([term for t in tries for term in t.terms], pa.binary()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        leaf = rank[coded.indices.to_numpy()]
        docs = np.zeros(len(order), np.int64)
        np.add.at(docs, leaf, np.concatenate([t.docs for t in tries]))
        who = np.concatenate([np.array([place[s] for s in t.sources], np.int64)[t.who] for t in tries])
        key = np.repeat(leaf, np.concatenate([t.width for t in tries])) * len(sources) + who
        by = np.argsort(key, kind="stable")
        key = key[by]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, counts = key[begins], np.add.reduceat(np.concatenate([t.counts for t in tries])[by], begins)
        return cls(sources, coded.dictionary.take(pa.array(order)).to_pylist(), docs, np.bincount(key // len(sources), minlength=len(docs)), key % len(sources), counts)

    def kept(self, lang: str, least: int) -> Iterator[pa.RecordBatch]:
        """Rows of `KEPT` for the terms that at least so many documents hold."""
        names = pa.array(self.sources, pa.string())
        good = self.docs >= least
        leaf = np.flatnonzero(good)
        inside = np.repeat(good, self.width)
        width, who, counts = self.width[good], self.who[inside], self.counts[inside]
        ends = np.r_[0, np.cumsum(width)]
        for i in range(0, len(leaf), 5_000):
            j = min(i + 5_000, len(leaf))
            offsets, some = pa.array((ends[i : j + 1] - ends[i]).astype(np.int32)), slice(ends[i], ends[j])
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (names.take(pa.array(who[some])), pa.array(counts[some]))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (j - i), pa.string()), pa.array([self.terms[k] for k in leaf[i:j]], pa.binary()), *lists], ["lang", "term", "sources", "counts"])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the terms of a text; a long text comes in slices that end between terms."""
    if len(text) <= SLICE:
        yield text.translate(FOLD).split()
        return
    rest = b""
    for i in range(0, len(text), SLICE):
        data = rest + text[i : i + SLICE].translate(FOLD)
        cut = data.rfind(b" ") + 1
        rest = data[cut:]
        yield data[:cut].split()
    yield rest.split()


def _rows(rows: list[tuple], ranges: list[int] | None = None) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 7]
    names = [n.split()[0] for n in PACKED.split(", ")]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    if ranges is not None:
        cols, names = [pa.array(ranges, pa.int32()), *cols], ["range", *names]
    return pa.RecordBatch.from_arrays(cols, names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: dict[str, Counter] = defaultdict(Counter)
    occur: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def spill() -> Iterator[pa.RecordBatch]:
        for lang in sorted(docs):
            if docs[lang]:
                trie = Trie.of(docs[lang], occur[lang])
                for i in range(0, len(trie.terms), PIECE):
                    yield _rows([trie.cut(i, min(i + PIECE, len(trie.terms))).pack(lang)])
        docs.clear()
        occur.clear()

    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                seen: set[bytes] | None = None
                for found in _terms(text):
                    occur[lang][source].update(found)
                    seen = set(found) if seen is None else seen.union(found)
                docs[lang].update(seen)
            if sum(len(c) for sources in occur.values() for c in sources.values()) >= ENTRIES:
                yield from spill()
    yield from spill()


def _cut(ends: list[tuple[str, bytes]]):
    """Gives pieces the number of their range of prefixes; a piece that goes on beyond a range is cut there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lang, first, last, *packed = row
                at, to = bisect_right(ends, (lang, first)), bisect_right(ends, (lang, last))
                if at == to:
                    yield _rows([row], [at])
                    continue
                trie, begin = Trie.unpack(*packed), 0
                for k in range(at, to + 1):
                    end = len(trie.terms) if k == to else bisect_right(trie.terms, False, key=lambda t: (lang, t) >= ends[k])  # noqa: B023
                    if end > begin:
                        yield _rows([trie.cut(begin, end).pack(lang)], [k])
                    begin = end

    return run


def _merge(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tries, size = None, [], 0
        for batch in batches:
            for k, lang, _, _, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, lang) != now:
                    if tries:
                        yield from Trie.merge(tries).kept(now[1], min_docs)
                    now, tries, size = (k, lang), [], 0
                tries.append(Trie.unpack(*packed))
                size += len(tries[-1].terms)
                if size >= MERGED and len(tries) > 1:
                    whole = Trie.merge(tries)
                    # a range with that many distinct terms waits until half as many again have come
                    tries, size = [whole], min(len(whole.terms), MERGED // 2)
        if tries:
            yield from Trie.merge(tries).kept(now[1], min_docs)

    return run


def share(count: np.ndarray, total: np.ndarray, kept: int, unit: int = UNIT) -> np.ndarray:
    """p for counts in groups of the given totals, exact at any size."""
    big = int(count.max(initial=0)) >= (1 << 62) // unit
    count, total = (count.astype(object), total.astype(object)) if big else (count, total)
    return (1 + unit * (count + 1) // (total + kept)).astype(np.int64)


def stray(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Audit:
    """Sums of f by pair of sources (rows `lo` to `hi` of them) and the best terms, for one language."""

    def __init__(self, kept: int, total: int, sources: list[str], totals: list[int], lo: int, hi: int, top: int):
        self.kept, self.total, self.lo, self.hi, self.top = kept, total, lo, hi, top
        self.sources, self.totals = sources, np.array(totals, np.int64)
        self.place = {s: i for i, s in enumerate(sources)}
        self.sums = np.zeros((hi - lo, len(sources)), np.int64)
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]

    def take(self, terms: list[bytes], sources: list[list[str]], counts: list[list[int]]) -> None:
        width = len(self.sources)
        step = max(1, (1 << 19) // width)
        for i in range(0, len(terms), step):
            self._some(terms[i : i + step], sources[i : i + step], counts[i : i + step])

    def _some(self, terms: list[bytes], sources: list[list[str]], counts: list[list[int]]) -> None:
        n = np.zeros((len(terms), len(self.sources)), np.int64)
        for row, s, c in zip(n, sources, counts):
            row[[self.place[x] for x in s]] = c
        p = share(n, self.totals, self.kept)
        for g in range(self.lo, self.hi):
            self.sums[g - self.lo] += stray(p[:, g : g + 1], p).sum(0)
        q = share(n.sum(1), np.array([self.total], np.int64), self.kept)[:, None]
        t, g = np.nonzero((n > 0) & (p > q) & (np.arange(len(self.sources)) >= self.lo) & (np.arange(len(self.sources)) < self.hi))
        value = stray(p[t, g], q[t, 0])
        # earlier terms stand first among equals: what is kept comes before what is new, and sorting is stable
        group, value, term = np.r_[self.best[0], g], np.r_[self.best[1], value], np.r_[self.best[2], np.array(terms, object)[t]]
        order = np.lexsort((-value, group))
        group, value, term = group[order], value[order], term[order]
        first = np.searchsorted(group, group)
        good = np.arange(len(group)) - first < self.top
        self.best = [group[good], value[good], term[good]]

    def rows(self) -> Iterator[tuple[str, str, bytes, int]]:
        for i, j in zip(*np.nonzero(self.sums)):
            yield self.sources[i + self.lo], "pair", self.sources[j].encode(), int(self.sums[i, j])
        for g, v, term in zip(*self.best):
            yield self.sources[g], "term", term, int(v)


def _audit(plan: dict[str, tuple], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Audit] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            cols = [c.to_pylist() for c in batch.columns[1:]]
            cut = [i for i in range(len(langs)) if i == 0 or langs[i] != langs[i - 1]]
            for a, b in zip(cut, [*cut[1:], len(langs)]):
                if langs[a] not in found:
                    found[langs[a]] = Audit(*plan[langs[a]], top)
                found[langs[a]].take(*(c[a:b] for c in cols))
        for lang, one in found.items():
            rows = list(one.rows())
            for i in range(0, len(rows), 10_000):
                some = list(zip(*rows[i : i + 10_000]))
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some[0]), pa.string()), *[pa.array(c, k) for c, k in zip(some, kinds)]], ["lang", "source", "part", "item", "value"])

    return run


def _passes(totals: DataFrame) -> Iterator[dict[str, tuple]]:
    """What each pass needs to know: lang -> (kept terms, total, sources, their totals, first and last source of a band)."""
    plan, cells, groups = {}, 0, 0
    for row in totals.toLocalIterator():
        sources, counts = zip(*sorted((r["source"], r["n"]) for r in row["groups"]))
        width = len(sources)
        band = max(1, CELLS // width)
        for lo in range(0, width, band):
            hi = min(width, lo + band)
            if plan and (row["lang"] in plan or cells + width * (hi - lo) > CELLS or groups + width > GROUPS):
                yield plan
                plan, cells, groups = {}, 0, 0
            plan[row["lang"]] = (row["kept"], sum(counts), list(sources), list(counts), lo, hi)
            cells, groups = cells + width * (hi - lo), groups + width
    if plan:
        yield plan


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows for each other source of the language, `term` rows for its `top` terms."""
    spark = docs.sparkSession
    said: dict[str, Column] = {n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))}
    told = docs.select(*[c.alias(n) for n, c in said.items()])
    tries = materialize(told.mapInArrow(_count, PACKED), "tries", "zstd")
    places = tries.select("lang", "first").orderBy(F.xxhash64("lang", "first", F.monotonically_increasing_id())).limit(SAMPLE).collect()
    places, ranges = sorted((r["lang"], bytes(r["first"])[:PREFIX]) for r in places), RANGES * partitions(spark)
    ends = sorted({places[len(places) * i // ranges] for i in range(1, ranges)}) if places else []
    pieces = tries.mapInArrow(_cut(ends), f"range int, {PACKED}").repartition(partitions(spark), "range").sortWithinPartitions("range", "lang")
    kept = materialize(pieces.mapInArrow(_merge(min_docs), KEPT), "terms")
    pairs = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    by_source = pairs.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = told.select("lang", "source").distinct()
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    # one row a language that has kept terms, as long as its list of sources, which the pairs square
    totals = groups.join(by_source, ["lang", "source"], "left").join(size, "lang").groupBy("lang").agg(F.first("kept").alias("kept"), F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))).alias("groups"))
    shape = "lang string, source string, part string, item binary, value long"
    found = spark.createDataFrame([], shape)
    for plan in _passes(totals):
        wanted = kept.where(F.col("lang").isin(list(plan))) if len(plan) <= 1_000 else kept.join(F.broadcast(spark.createDataFrame([(x,) for x in plan], "lang string")), "lang", "left_semi").select(*kept.columns)
        walk = wanted.sortWithinPartitions("lang", "term")  # a task may read several ranges: ties need them in order
        found = found.unionByName(materialize(walk.mapInArrow(_audit(plan, top), shape), "audit"))
    # every pair is a row of the result, also those whose sum is 0
    sides = groups.groupBy("lang").agg(F.collect_list("source").alias("others"))
    every = groups.join(sides, "lang").select("lang", "source", F.explode("others").alias("item")).where("item <> source")
    sums = found.where("part = 'pair'").select("lang", "source", F.col("item").cast("string").alias("item"), "value")
    pair = every.withColumn("value", F.lit(0).cast("long")).unionByName(sums.where("item <> source")).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.unionByName(term.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS kept FROM k GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 1)) // (coalesce(gn.total, 0) + v.kept) AS HUGEINT) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN gn ON g.lang = gn.lang AND g.source = gn.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT)
  FROM p JOIN (SELECT lc.lang, term, 1 + (1000000000 * (CAST(n AS HUGEINT) + 1)) // (ln.total + v.kept) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)) q ON p.lang = q.lang AND p.term = q.term
  WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
"""
