"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte bigrams and trigrams of the lower-cased whole text, as shares. Both steps use linear support
vector machines with squared hinge loss, trained on a bounded sample of distinct labelled texts (`max_rows`, evenly over
the languages, each with some); all documents are scored by summing weights along the text, in windows, so memory doesn't grow with length.

Defined results: a null text, one without letters, or any text where nothing could be learned gives `und` and 0;
a null or blank label is none; repeated rows each get their row; an empty table gives no rows; only the id, text and
language columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, free_name, table

#: Families of common languages; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "mr", "ur", "pa"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BUCKETS = 1 << 12
#: Bound of the training sample.
MAX_ROWS = 1_600
SCALE = 20.0
STEP = 1 << 20


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _windows(texts: pa.Array) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Grams of each text, and windows of (documents, where each begins in the window, buckets of bigrams and trigrams)."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    totals = np.maximum(np.diff(offsets) - 1, 0) + np.maximum(np.diff(offsets) - 2, 0)

    def go():
        for a in range(int(offsets[0]), int(offsets[-1]), STEP):
            b = min(a + STEP, int(offsets[-1]))
            x = np.zeros(b - a + 2, np.uint32)
            tail = data[a : min(b + 2, int(offsets[-1]))]
            x[: len(tail)] = tail
            two = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B)
            three = two + x[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
            h = np.stack([(two ^ (two >> 15)) >> np.uint32(4), (three ^ (three >> 15)) >> np.uint32(4)]).astype(np.int64) % BUCKETS
            # grams that would reach over the end of their text count in an extra bucket without weight
            ends = offsets[1:]
            for back, rows in ((1, slice(0, 2)), (2, slice(1, 2))):
                at = ends - back
                at = at[(at >= a) & (at < b)] - a
                h[rows, at] = BUCKETS
            docs = np.arange(np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left"))
            docs = docs[np.diff(offsets)[docs] > 0]
            yield docs, np.maximum(offsets[docs], a) - a, h

    return totals, go()


def sums(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight along each text, by model; weights: (models, BUCKETS + 1)."""
    totals, windows = _windows(texts)
    out = np.zeros((len(texts), len(weights)))
    for docs, begins, h in windows:
        for m, w in enumerate(weights):
            out[docs, m] += np.add.reduceat(w[h[0]] + w[h[1]], begins)
    return out / np.maximum(totals, 1)[:, None]


def features(texts: pa.Array) -> np.ndarray:
    totals, windows = _windows(texts)
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for docs, begins, h in windows:
        for d, a, b in zip(docs, begins, [*begins[1:], h.shape[1]]):
            out[d] += np.bincount(h[:, a:b].ravel(), minlength=BUCKETS + 1)
    out[:, BUCKETS] = 0
    return out / np.maximum(totals, 1)[:, None].astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Weights, the last of them the bias, by accelerated gradient descent on the squared hinge loss; classes count alike."""
    x = np.hstack([SCALE * x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (1e-3 + 2 * c * float(v @ (x.T @ (share * (x @ v)))) * 1.05)
    w = z = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (1e-3 * z - 2 * c * (x.T @ (share * y * slack)))
        z = new + t / (t + 3) * (new - w)
        w = new
    return w


class Model:
    """Pairs of families and pairs of languages within a family, each with a linear function."""

    def __init__(self, langs: np.ndarray, x: np.ndarray):
        self.langs = sorted(set(langs))
        self.family = {g: FAMILY.get(g, g) for g in self.langs}
        self.families = sorted(set(self.family.values()))
        of = np.array([self.family[g] for g in langs])
        self.pairs = [("family", p, q) for p, q in combinations(self.families, 2)]
        self.pairs += [("lang", p, q) for p, q in combinations(self.langs, 2) if self.family[p] == self.family[q]]
        weights = []
        for kind, p, q in self.pairs:
            names = of if kind == "family" else langs
            rows = (names == p) | (names == q)
            weights.append(svm(x[rows], np.where(names[rows] == p, 1, -1).astype(np.float32)))
        self.weights = np.array(weights, np.float32).reshape(len(weights), BUCKETS + 1)

    def _choose(self, margins: np.ndarray, kind: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The name with the most votes of its pairs, weighed by how sure they are, and its share."""
        votes = np.zeros((len(margins), len(names)))
        for m, (k, p, q) in enumerate(self.pairs):
            if k == kind and p in names and q in names:
                sure = 1 / (1 + np.exp(-np.clip(4 * margins[:, m], -50, 50)))
                votes[:, names.index(p)] += sure
                votes[:, names.index(q)] += 1 - sure
        return votes.argmax(1), votes.max(1) / max(1, len(names) - 1) if len(names) > 1 else np.ones(len(margins))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if not self.langs:
            return out, score
        w = self.weights
        flat = np.hstack([w[:, :BUCKETS], np.zeros((len(w), 1), np.float32)])
        margins = SCALE * sums(texts, flat) + w[:, -1]
        fam, p_fam = self._choose(margins, "family", self.families)
        for f, name in enumerate(self.families):
            rows = fam == f
            names = [g for g in self.langs if self.family[g] == name]
            best, p = self._choose(margins[rows], "lang", names)
            out[rows], score[rows] = np.array(names, object)[best], p_fam[rows] * p
        return out, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learn from documents whose fold (crc32 mod 4) is not 2; of each language's distinct texts the first by a hash."""
    text = F.col(text_col)
    rows = docs.where((fold(id_col, 4) != 2) & (F.trim(F.col(lang_col).cast("string")) != "") & has_letter(text)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    # copies of a text count once, in the rate and in the sample, so a large group of them can neither fill nor thin it
    rows = rows.withColumn("mark", F.xxhash64("text"))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "mark").distinct().groupBy("lang").count().collect()}
    each = max(4, max_rows // max(1, len(counts)))
    share = F.lit(0)
    for lang, n in counts.items():  # more than are needed, so that none of many languages is left with too few by chance
        share = F.when(F.col("lang") == lang, min(1_000_000, 1_000_000 * (2 * each + 32) // n + 1)).otherwise(share)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in features(part.column(2))], pa.binary())], ["lang", "mark", "x"])

    marked = rows.where(F.pmod(F.col("mark"), F.lit(1_000_000)) < share)
    drawn = marked.groupBy("lang", "mark").agg(F.first("text").alias("text"))
    sample = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("_n") <= each).drop("_n")
    got = sorted(sample.mapInArrow(make, "lang string, mark long, x binary").collect())
    x = np.array([np.frombuffer(r["x"], np.float32)[:BUCKETS] for r in got], np.float32).reshape(len(got), BUCKETS)
    return Model(np.array([r["lang"] for r in got], object), x)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """`docs` with the language and its score appended; columns of these names are replaced."""
    rest = [c for c in docs.columns if c.lower() not in (lang_as.lower(), score_as.lower())]
    letters = free_name(rest, "letters")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], has_letter(F.col(text_col)).alias(letters))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                lang, score = sent.value.predict(part.column(part.schema.get_field_index(text_col)))
                none = ~part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                lang[none], score[none] = "und", 0
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*rest, lang_as, score_as])

    schema = rows.drop(letters).withColumns({lang_as: F.lit(""), score_as: F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return predict(docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text"), model).drop("text")
