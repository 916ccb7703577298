"""Benchmark decontamination: a BM25 inverted index of the test items, asked with every training passage.

Test items are the indexed side. Their number, mean length, longest length and each term's document frequency are taken
over the whole list by aggregation, so that a score doesn't depend on how the list is split. The list is split by a hash
of the text into parts of bounded size; each part's index is built where its items lie and written to the shared folder.
Bundles of indexes, up to `PASS_BYTES` together, go to every task, which asks one after the other with the same texts:
one pass over the documents for each bundle, which is one pass in all up to some hundred thousand items.

A document is cut into passages of two and a half times the longest item's words, half overlapping, so an item's copy
lies whole in one even with a fifth more words in it. A hit counts if the shingles of the item's question and of its
answer (the part after the last `?`) both occur in the passage, `OVERLAP` or more of each. A question or answer of fewer
than `SHORT` words is held by its words instead, one or a fifth of them missing at most, and the shingles of the item as
a whole decide; so do they alone where an item has no question mark.

Each item has its own threshold: the least score that a passage can have which passes this check, that is the item's
own score less its heaviest terms, as many as may be missing. So no verified pair is lost before the check. Weights are
divided by that threshold, which makes it 1 for all.

A search has three steps. An item whose copy may lack `lost` terms at most holds at least `sure` of its `lost + sure`
rarest ones in any passage that passes, so only these few postings of each item are read for all passages of a batch at
once, and items that reach that count are candidates: what is read grows with the matches of rare terms, not with the
list. Then each term's block maxima bound the blocks of the candidates; a block below the threshold is skipped. What is
left runs WAND over the postings, with the same block maxima, and returns every candidate at or above the threshold.

Defined results: a null or blank text or item matches nothing; repeated rows and items each get their rows; either
table may be empty; other columns of `docs` pass through `clean` untouched and don't matter elsewhere.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
OVERLAP, SHINGLE, SHORT = 0.8, 5, 10
BLOCK = 8
#: Terms of an item that are counted beyond those that a copy may lack.
SURE = 8
#: Bounds of a part.
MAX_ITEMS, MAX_WORDS = 4_096, 400_000
#: Bytes of written indexes that are sent to the tasks at once.
PASS_BYTES = 128 << 20
#: Words of a batch that are scored at once; with several indexes each is loaded once for so many words.
CHUNK = 1_000_000
#: Cells (passages times items) that are counted at once.
CELLS = 1 << 22


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> list[str]:
    """The part up to the last `?` and the rest, or the text alone where either would be empty."""
    at = text.rfind("?") + 1
    return [text[:at], text[at:]] if words_of(text[:at]) and words_of(text[at:]) else [text]


def _groups(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Runs of equal keys, and the values of each."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[first], np.split(value, first[1:]) if len(key) else []


def shingles(words: list[str], k: int = SHINGLE) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def needed(n: int, overlap: float = OVERLAP) -> int:
    return math.ceil(overlap * n - 1e-9)


class Item:
    """What a passage must hold of an item; `lost` is how many of its terms may be missing at most."""

    def __init__(self, text: str, overlap: float = OVERLAP):
        parts = [words_of(p) for p in question_answer(text)]
        self.short = [w for w in parts if len(parts) > 1 and len(w) < SHORT]
        self.long = [shingles(w) for w in ([sum(parts, [])] if self.short else parts)]
        self.need = [needed(len(s), overlap) for s in self.long]
        self.lost = sum(len(s) - n for s, n in zip(self.long, self.need))

    def held(self, words: set[str], grams: Callable[[int], set]) -> tuple[float, float] | None:
        """(question overlap, answer overlap) in a passage, if it holds the item."""
        shares = []
        for s, n in zip(self.long, self.need):
            have = sum(g in grams(len(s[0])) for g in s)
            if have < n:
                return None
            shares.append(have / len(s))
        for w in self.short:
            have = sum(x in words for x in w)
            if len(w) - have > max(len(w) > 2, len(w) // 5):
                return None
            shares.append(have / len(w))
        return shares[0], shares[-1]


class Index:
    """Postings by term in item order, with weights over the item's threshold, and each term's maximum in each block that it is in.

    `n`, `mean`, `width` and `df` are those of the whole list; without them the given items are the list.
    """

    def __init__(self, ids: pa.Array, texts: list[str], df: dict[str, int] | None = None, n: int | None = None, mean: float | None = None, longest: int | None = None, overlap: float = OVERLAP):
        words = [words_of(t) for t in texts]
        df = df or Counter(t for w in words for t in set(w))
        n, mean = n or len(texts), mean or sum(map(len, words)) / max(1, len(words))
        self.ids, self.texts, self.overlap = ids, texts, overlap
        self.half = math.ceil(1.25 * (longest or max(map(len, words), default=1)))
        self.terms = {t: k for k, t in enumerate(sorted({t for w in words for t in w}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        rare: list[list[int]] = [[] for _ in self.terms]
        self.share, self.sure = [], np.ones(len(texts), np.int32)  # of its own score that an item's threshold is
        for d, (w, text) in enumerate(zip(words, texts)):
            tf, lost = Counter(w), Item(text, overlap).lost
            raw = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            own, heaviest = sum(raw.values()), sorted(raw.values(), reverse=True)
            least = max(own - sum(heaviest[:lost]), own / 100)
            self.share.append(least / own)
            for t, x in raw.items():
                postings[self.terms[t]].append((d, x / least))
            self.sure[d] = max(1, min(SURE, len(tf) - lost))
            for t in sorted(tf, key=lambda t: (df[t], t))[: lost + int(self.sure[d])]:
                rare[self.terms[t]].append(d)
        self.blocks = max(1, -(-len(texts) // BLOCK))
        begins = lambda lists: np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)].astype(np.int64)
        self.begin = array("q", begins(postings).tolist())
        self.item = array("i", [d for p in postings for d, _ in p])
        self.weight = array("d", [x for p in postings for _, x in p])
        self.rare_begin, self.rare = begins(rare), np.array([d for x in rare for d in x], np.int64)
        self.ready()

    def ready(self) -> Index:
        """What is made when an index is loaded: the block maxima, a list for each term."""
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.begin))
        block, weight = np.array(self.item, np.int64) // BLOCK, np.nextafter(np.array(self.weight, np.float32), np.float32(np.inf))
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.max_block, self.max = block[first], (np.maximum.reduceat(weight, first) if len(first) else weight).astype(float)
        self.max_begin = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.peak = np.maximum.reduceat(self.max, self.max_begin[:-1]).tolist() if len(first) else []
        self.made: dict[int, Item] = {}
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("max_block", "max", "max_begin", "peak", "made")}

    def held(self, item: int, words: set[str], grams: Callable[[int], set]) -> tuple[float, float] | None:
        if item not in self.made:
            if len(self.made) > 10_000:
                self.made.clear()
            self.made[item] = Item(self.texts[item], self.overlap)
        return self.made[item].held(words, grams)

    def maxima(self, terms: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The maximum of each term in each of the blocks, 0 where it isn't in one."""
        counts = self.max_begin[terms + 1] - self.max_begin[terms]
        at = np.arange(int(counts.sum())) + np.repeat(self.max_begin[terms] - np.r_[0, np.cumsum(counts)[:-1]], counts)
        k = np.searchsorted(blocks, self.max_block[at])
        here = blocks[np.minimum(k, len(blocks) - 1)] == self.max_block[at]
        out = np.zeros((len(terms), len(blocks)))
        out[np.repeat(np.arange(len(terms)), counts)[here], k[here]] = self.max[at[here]]
        return out

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(passage, items) of the passages that hold enough of some items' rarest terms; rows in the order of the passages."""
        step, size = max(1, CELLS // len(self.texts)), len(self.texts)
        first = int(passage[0])
        cuts = np.searchsorted(passage, np.arange(first, int(passage[-1]) + 1 + step, step))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            begin = self.rare_begin[term[a:b]]
            counts = self.rare_begin[term[a:b] + 1] - begin
            at = np.arange(int(counts.sum())) + np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts)
            low = int(passage[a])
            cell = np.repeat(passage[a:b] - low, counts) * size + self.rare[at]
            rows, items = np.nonzero(np.bincount(cell, minlength=(int(passage[b - 1]) - low + 1) * size).reshape(-1, size) >= self.sure)
            for r, some in zip(*_groups(rows, items)):
                yield low + int(r), some

    def wand(self, terms: list[int], items: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all of the given items (in order) at or above the threshold; scores are over the thresholds."""
        item, weight, begin = self.item, self.weight, self.begin
        blocks = sorted({i // BLOCK for i in items})
        place = {block: k for k, block in enumerate(blocks)}
        top = self.maxima(np.array(terms, np.int64), np.array(blocks, np.int64)).tolist() if items else []
        cursors, out, slack = [], [], 1 - 1e-5
        for j, t in enumerate(terms if items else ()):
            at = bisect_left(item, items[0], begin[t], begin[t + 1])
            if at < begin[t + 1]:
                cursors.append([item[at], at, t, top[j]])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += self.peak[c[2]]
                if bound >= slack:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            n = bisect_left(items, pivot)
            if n == len(items):
                break
            to, block = pivot, pivot // BLOCK
            k = place.get(block)
            if items[n] > pivot:
                to = items[n]
            elif sum(c[3][k] for c in cursors if c[0] <= pivot or c[0] // BLOCK == block) < slack:
                to = (block + 1) * BLOCK
            elif cursors[0][0] == pivot:
                score = sum(weight[c[1]] for c in cursors if c[0] == pivot)
                if score >= 1 - 1e-9:
                    out.append((pivot, score))
                to = pivot + 1
            for c in cursors:
                if c[0] >= to:
                    break
                c[1] = bisect_left(item, to, c[1], begin[c[2] + 1])
                c[0] = item[c[1]] if c[1] < begin[c[2] + 1] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def search(self, texts: list[tuple[int, list[str]]], found: list[dict[int, tuple[float, float, float]]]) -> None:
        """Adds item -> (best score as a share of the item's own, question overlap, answer overlap) to the place of each text (place, words)."""
        half, get, size = self.half, self.terms.get, len(self.terms)
        keys, owners, first = [], [], 0
        for d, words in texts:
            ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            at = np.flatnonzero(ids >= 0)
            passage = first + at // half
            keys.append(passage * size + ids[at])
            late = at >= half  # also in the passage that began half a passage before
            keys.append((passage[late] - 1) * size + ids[at[late]])
            last = max(0, len(words) - 1) // half + 1
            owners += [(d, words, p * half) for p in range(last)]
            first += last
        keys = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]))
        if not len(keys):
            return
        passage, term = keys // size, keys % size
        for p, items in self.candidates(passage, term):
            a, b = np.searchsorted(passage, (p, p + 1))
            blocks, of = np.unique(items // BLOCK, return_inverse=True)
            items = items[(self.maxima(term[a:b], blocks).sum(0) >= 1 - 1e-4)[of]]
            if not len(items):
                continue
            d, words, s = owners[p]
            words, made = words[s : s + 2 * half], {}
            grams = lambda k: made.get(k) or made.setdefault(k, set(shingles(words, k)))  # noqa: E731, B023
            for item, score in self.wand(term[a:b].tolist(), items.tolist()):
                shares = self.held(item, grams(1) and {g[0] for g in grams(1)}, grams)
                if shares:
                    got = (score * self.share[item], *shares)
                    found[d][item] = max(found[d].get(item, got), got)


def hits(indexes: list[Index | bytes], docs: list[str | None]) -> list[list[tuple[pa.Array, int, tuple[float, float, float]]]]:
    """For each text the verified (ids, place in ids, (score, question overlap, answer overlap)), index by index in order."""
    out: list[list] = [[] for _ in docs]

    def ask(texts: list[tuple[int, list[str]]]) -> None:
        for one in indexes:
            index = pickle.loads(one).ready() if isinstance(one, bytes) else one
            found: list[dict] = [{} for _ in docs]
            index.search(texts, found)
            for d, _ in texts:
                out[d] += [(index.ids, k, v) for k, v in sorted(found[d].items())]

    texts, n = [], 0
    for d, text in enumerate(docs):
        if text:
            texts.append((d, words_of(text)))
            n += len(texts[-1][1])
        if n >= CHUNK:
            ask(texts)
            texts, n = [], 0
    if texts:
        ask(texts)
    return out


def indexes(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", max_items: int = MAX_ITEMS) -> DataFrame:
    """(part, data): the written indexes of all items, each of about `max_items` items and `MAX_WORDS` words at most."""
    rows = bench.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = bench.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([words_of(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, words], ["item_id", "text", "words"])

    items = materialize(rows.mapInArrow(cut, f"item_id {kind}, text string, words array<string>").where("size(words) > 0"), "items")
    n, total, longest = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(1))).first()
    parts = max(1, -(-n // max_items), -(-total // MAX_WORDS))
    items = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int"))
    terms = items.select("part", F.explode(F.array_distinct("words")).alias("word"))
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    known = terms.distinct().join(df, "word").select(F.col("part").alias("of"), "word", "df")

    def build(items: pa.Table, known: pa.Table) -> pa.Table:
        items = items.sort_by([("text", "ascending"), ("item_id", "ascending")])
        df = dict(zip(known.column("word").to_pylist(), known.column("df").to_pylist()))
        index = Index(items.column("item_id").combine_chunks(), items.column("text").to_pylist(), df, n, total / n, longest)
        return pa.table({"part": pa.array([items.column("part")[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(index, 5)], pa.binary())})

    return materialize(items.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(build, "part int, data binary"), "indexes")


def bundles(written: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[bytes]]:
    """The written indexes, as many at once as `pass_bytes` allow: what the driver holds and sends is bounded."""
    sizes = written.select("part", F.octet_length("data").alias("n")).orderBy("part").collect()  # one row for thousands of items
    while sizes:
        take = max(1, sum(np.cumsum([r["n"] for r in sizes]) <= pass_bytes))
        now, sizes = [r["part"] for r in sizes[:take]], sizes[take:]
        yield [bytes(r["data"]) for r in written.where(F.col("part").isin(now)).orderBy("part").collect()]


def _passes(docs: DataFrame, bench: DataFrame, max_items: int, pass_bytes: int) -> Iterator[tuple[Callable, bool]]:
    """For each bundle, a function that gives the hits of a task's texts, and whether it is the only one."""
    written = indexes(bench, max_items=max_items)
    alone = written.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0] <= pass_bytes
    for bundle in bundles(written, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(bundle)

        def opened(sent=sent) -> Callable[[list[str | None]], list[list]]:
            several = sent.value
            loaded = [pickle.loads(b).ready() for b in several] if len(several) == 1 else several
            return lambda texts: hits(loaded, texts)

        yield opened, alone
        if not alone:
            sent.unpersist()


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_items: int = MAX_ITEMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each verified pair; score is a share of the item's own."""
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    shape = f"doc_id {doc_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    rows, out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), None
    for opened, alone in _passes(docs, bench, max_items, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], opened=opened) -> Iterator[pa.RecordBatch]:
            ask = opened()
            for batch in batches:
                met = [(i, *h) for i, one in enumerate(ask(batch.column(1).to_pylist())) for h in one]
                if met:
                    ids = pa.concat_arrays([ids.slice(k, 1) for _, ids, k, _ in met])
                    cols = [pa.array([v[j] for *_, v in met], pa.float64()) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([m[0] for m in met], pa.int64())), ids, *cols], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, shape)
        part = part if alone else materialize(part, "hits")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], shape)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", max_items: int = MAX_ITEMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`docs` without the documents that hold a test item; filtered where they lie, with no shuffle."""
    at = docs.columns.index(text_col)
    for opened, alone in _passes(docs, bench, max_items, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], opened=opened) -> Iterator[pa.RecordBatch]:
            ask = opened()
            for batch in batches:
                yield batch.filter(pa.array([not h for h in ask(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if alone else materialize(docs, "clean")
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
