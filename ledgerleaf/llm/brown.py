"""Brown class-based n-grams: exchange clustering, class transitions, word emissions, smoothed log probability.

Each task tokenises its documents once and writes them in blocks of about `BLOCK_BYTES` of text: the distinct words of
the block with their counts, and the tokens as places in that list. Texts are never moved; a block's vocabulary is what is
joined, so a frequent word is one row a block, and many blocks share a partition.

1. Counts of all training words, from the blocks' lists; N and V from these.
2. Bigram counts, over all training text, of the `HEAD` most frequent words. Exchange clustering moves each of these to
   the class that raises the class-bigram likelihood most, until a round moves none or `SWEEPS` rounds are done.
3. Every other training word is assigned by the same gain, in one batch, from the classes of its neighbours in the head,
   counted over all training text. Words that never stand beside a head word, and unseen words, form classes beside
   these by their longest known ending, a rule learned from the head.
4. The blocks' lists meet the words' counts and classes in a join; each block is written with its list's codes.
5. Class transitions over all training tokens, the number of training words and tokens of each class, and the scores.

p(w | previous) = MIX * p(class of w | class of previous) * p(w | class of w) + (1 - MIX) * p(w); all three are
add-one smoothed, with one unseen word in each class and in the whole.

Defined results: a null text counts as empty and is its end alone; a null id counts as the empty text in the fold;
repeated rows are counted and scored each; with nothing to learn from every token has probability one; an empty table
gives no rows; only the id and text columns are used.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table

#: What stands for the end of a text in the counts; no word can hold a line break.
END = "\n"
HEAD = 1_024
CLASSES = 32
SWEEPS = 8
MIX = 0.7
ENDINGS = (4, 3, 2, 1)
BLOCK_BYTES = 12 << 20
#: Tokens that are scored at once.
SCORED = 250_000
#: A cell and its count, as they are sent.
CELL = np.dtype([("cell", "<u2"), ("n", "<u4")])
CACHE = 300_000
MARKS = b".,;:!?\"'()[]|%$#&*"


def exchange(w: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each word from bigram counts w[i, j], by the exchange algorithm."""
    n = len(w)
    of = np.arange(n) % max(1, min(classes, n))
    k = int(of.max(initial=-1)) + 1
    if k < 2:
        return of
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    z = np.eye(k)[of]
    after, before = w @ z, w.T @ z
    t = z.T @ after
    for _ in range(sweeps):
        moved = 0
        for i in range(n):
            a, own = of[i], w[i, i]
            row, col = after[i].copy(), before[i].copy()
            if not row.any() and not col.any():
                continue
            t[a] -= row
            t[:, a] -= col
            t[a, a] += own
            row[a] -= own
            col[a] -= own
            up = f(t + row) - f(t)
            across = f(t + col[:, None]) - f(t)
            diag = np.arange(k)
            both = f(t[diag, diag] + row + col + own) - f(t[diag, diag])
            out, into = t.sum(1), t.sum(0)
            gain = up.sum(1) - up[diag, diag] + across.sum(0) - across[diag, diag] + both - f(out + row.sum() + own) + f(out) - f(into + col.sum() + own) + f(into)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            t[b] += row
            t[:, b] += col
            t[b, b] += own
            if b != a:
                of[i] = b
                after[:, a] -= w[:, i]
                after[:, b] += w[:, i]
                before[:, a] -= w[i]
                before[:, b] += w[i]
                moved += 1
        if not moved:
            break
    return of


def gains(t: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exchange gain of each class, less what all classes share, for words that have none yet; `t`: class bigrams; `word` rises from 0 without gaps.

    A cell is j where n tokens of class j follow the word, and classes + j where they precede it.
    """
    k, words = len(t), int(word[-1]) + 1
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    table = np.vstack([t.T, t])  # row of a cell: what each class has there
    begins = np.flatnonzero(np.r_[True, np.diff(word) > 0])
    at = table[cell]
    gain = np.add.reduceat(f(at + n[:, None]) - f(at), begins)
    both = np.zeros((words, 2 * k))
    both[word, cell] = n
    row, col, diag = both[:, :k], both[:, k:], np.diag(t)
    gain += f(diag + row + col) + f(diag) - f(diag + row) - f(diag + col)
    out, into = t.sum(1) + col, t.sum(0) + row  # the neighbours' tokens count whatever class the word gets
    return gain - f(out + row.sum(1, keepdims=True)) + f(out) - f(into + col.sum(1, keepdims=True)) + f(into)


class Classes:
    """Class of a word without one by its neighbours: its own if it is in the head, else one beside that of its longest known ending; the end's is last."""

    def __init__(self, head: list[bytes], counts: list[int], of: np.ndarray):
        self.n = int(of.max(initial=0)) + 1
        self.end = 2 * self.n + 1
        self.head = {w: int(c) for w, c in zip(head, of)}
        votes: dict[bytes, Counter] = {}
        for w, n, c in zip(head, counts, of):
            core = w.strip(MARKS)
            for k in ENDINGS:
                if len(core) >= k:
                    votes.setdefault(core[-k:], Counter())[int(c)] += n
        self.ending = {e: min(v, key=lambda c: (-v[c], c)) for e, v in votes.items()}
        self.cache: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.end + 1

    def of(self, word: bytes) -> int:
        got = self.cache.get(word)
        if got is None:
            got = self.head.get(word)
            if got is None:
                core = word.strip(MARKS)
                got = next((self.n + self.ending[core[-k:]] for k in ENDINGS if core[-k:] in self.ending), 2 * self.n)
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.cache[word] = got
        return got

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}


def words_of(data: bytes | None) -> list[bytes]:
    """`bytes.lower` changes A-Z alone, and `bytes.split` cuts at space and 0x09 to 0x0D."""
    return (data or b"").lower().split()


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed: most of the upper planes is zero."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _blocks(block_bytes: int):
    """Rows of documents (doc_id, held_out, text) to rows of blocks; a text ends with token 0, the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, held, docs, size = defaultdict(count(1).__next__), [], [], [], 0

        def block() -> pa.RecordBatch:
            lens = np.array([len(t) for t in tokens], np.int32)
            flat = np.concatenate(tokens)
            n = np.bincount(flat[np.repeat(~np.array(held, bool), lens)], minlength=len(ids) + 1)
            words = pa.array([END.encode(), *ids], pa.binary()).cast(pa.string())
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            cols = [listed(pa.concat_arrays(docs)), listed(pa.array(held, pa.bool_())), listed(pa.array(lens)), pa.array([packed(flat.astype("<u4"))], pa.binary()), listed(words), listed(pa.array(n.astype(np.int64)))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lens", "tokens", "words", "n"])

        for batch in batches:
            for i, (out, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                words = words_of(data.as_py())
                tokens.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) if words else np.zeros(0, np.int64))
                tokens[-1] = np.append(tokens[-1], 0)
                held.append(out)
                docs.append(batch.column(0).slice(i, 1))
                size += len(data.as_py() or b"") + 16
                if size >= block_bytes:
                    yield block()
                    ids, tokens, held, docs, size = defaultdict(count(1).__next__), [], [], [], 0
        if tokens:
            yield block()

    return run


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, pa.Scalar]]]:
    """(tokens, the document of each, whether it is held out) and the other columns of each block."""
    for i in range(batch.num_rows):
        row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
        lens = row["lens"].values.to_numpy()
        held = row["held_out"].values.to_numpy(zero_copy_only=False).astype(bool)
        yield unpacked(row["tokens"].as_py(), "<u4"), np.repeat(np.arange(len(lens)), lens), np.repeat(held, lens), row


def _matrix_rows(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(m)
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j].astype(np.int64))], ["a", "b", "n"])


def _sum_matrix(rows: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks of (a, b, n) cells; a matrix of fixed size."""
    got = rows.groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((size, size))
    out[got["a"].to_numpy(dtype=int), got["b"].to_numpy(dtype=int)] = got["n"].to_numpy(dtype=float)
    return out


def head_bigrams(blocks: DataFrame, head: list[bytes]) -> np.ndarray:
    sent = blocks.sparkSession.sparkContext.broadcast({w.decode(errors="surrogateescape"): i for i, w in enumerate(head)})
    size = len(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, m = sent.value.get, np.zeros(size * size, np.int64)
        for batch in batches:
            for tokens, doc, held, row in rows_of(batch):
                words = row["words"].values.to_pylist()
                of = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))[tokens]
                a, b = of[:-1], of[1:]
                ok = (a >= 0) & (b >= 0) & ~held[:-1] & (doc[1:] == doc[:-1])
                cell, n = np.unique(a[ok] * size + b[ok], return_counts=True)
                m[cell] += n
        yield _matrix_rows(m.reshape(size, size))

    return _sum_matrix(blocks.select("held_out", "lens", "tokens", "words").mapInArrow(run, "a int, b int, n long"), size)


def cells_of(tokens: np.ndarray, doc: np.ndarray, held: np.ndarray, head: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, cell, n) in order: what stands beside each word of a block's list outside the head; `head`: each word's class there, else -1."""
    of = head[tokens]
    ok = ~held[:-1] & (doc[1:] == doc[:-1])
    own = (of < 0) & (tokens > 0)
    after, before = ok & own[:-1] & (of[1:] >= 0), ok & own[1:] & (of[:-1] >= 0)
    keys = np.r_[tokens[:-1][after] * np.int64(2 * k) + of[1:][after], tokens[1:][before] * np.int64(2 * k) + k + of[:-1][before]]
    key, n = np.unique(keys.astype(np.int64), return_counts=True)
    return key // (2 * k), key % (2 * k), n


def neighbours(blocks: DataFrame, classes: Classes) -> DataFrame:
    """word, cells (packed `CELL`s): in each block, how often head words of each class stand beside each other word; cells as in `gains`."""
    sent, k = blocks.sparkSession.sparkContext.broadcast({w.decode(errors="surrogateescape"): c for w, c in classes.head.items()}), classes.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            for tokens, doc, held, row in rows_of(batch):
                words = row["words"].values
                word, cell, n = cells_of(tokens, doc, held, np.fromiter(map(get, words.to_pylist(), repeat(-1)), np.int64, len(words)), k)
                if len(cell):
                    found, begins = np.unique(word, return_index=True)
                    packed = np.zeros(len(cell), CELL)
                    packed["cell"], packed["n"] = cell, n
                    ends = pa.py_buffer((np.r_[begins, len(cell)] * CELL.itemsize).astype(np.int32).tobytes())
                    lists = pa.Array.from_buffers(pa.binary(), len(found), [None, ends, pa.py_buffer(packed.tobytes())])
                    out = pa.RecordBatch.from_arrays([words.take(pa.array(found)), lists], ["word", "cells"])
                    yield from (out.slice(s, 10_000) for s in range(0, out.num_rows, 10_000))

    return blocks.select("held_out", "lens", "tokens", "words").mapInArrow(run, "word string, cells binary")


def best_classes(t: np.ndarray, owner: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of greatest gain of each word; `owner` rises from 0 without gaps."""
    out = []
    for s in range(0, int(owner[-1]) + 1 if len(owner) else 0, 2_000):
        a, b = np.searchsorted(owner, (s, s + 2_000))
        out.append(gains(t, owner[a:b] - s, cell[a:b], n[a:b].astype(float)).argmax(1))
    return np.concatenate([*out, np.zeros(0, np.int64)])


def assign(beside: DataFrame, t: np.ndarray) -> DataFrame:
    """word, class: the class of greatest gain for each word of `neighbours`. A word's rows stream by in order; only their sum is held."""
    sent, cells = beside.sparkSession.sparkContext.broadcast(t), 2 * len(t)

    def best(words: pa.Array, *found: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = best_classes(sent.value, *found).astype(np.int32)
        yield from (pa.RecordBatch.from_arrays([words.slice(s, 10_000), pa.array(of[s : s + 10_000])], ["word", "class"]) for s in range(0, len(words), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, none = pa.array([], pa.string()), np.zeros(0, np.int64)
        held_cell, held_n = none, none
        for batch in batches:
            if not batch.num_rows:
                continue
            word, lists = pa.concat_arrays([held, batch.column(0)]), batch.column(1)
            packed = np.frombuffer(b"".join(lists.to_pylist()), CELL)
            size = pc.binary_length(lists).to_numpy() // CELL.itemsize
            new = np.r_[True, pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)]
            of = np.cumsum(new) - 1
            key = np.repeat(of, np.r_[[len(held_cell)] * len(held), size].astype(int)) * cells + np.r_[held_cell, packed["cell"].astype(np.int64)]
            key, at = np.unique(key, return_inverse=True)
            n, owner, cell = np.bincount(at, np.r_[held_n, packed["n"].astype(np.int64)]), key // cells, key % cells
            words, last = word.filter(pa.array(new)), owner == of[-1]  # the last word may go on in the next batch
            yield from best(words[:-1], owner[~last], cell[~last], n[~last])
            held, held_cell, held_n = words[-1:], cell[last], n[last]
        if len(held):
            yield from best(held, np.zeros(len(held_cell), np.int64), held_cell, held_n)

    return beside.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, class int")


def classed(counts: DataFrame, given: DataFrame, classes: Classes) -> DataFrame:
    """`counts` with a class for every word: the given one, else by `classes`."""
    sent = counts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(class_of(sent.value, batch.column(0), batch.column(2)).astype(np.int32))], ["word", "c", "class"])

    return counts.join(given, "word", "left").select("word", "c", "class").mapInArrow(run, "word string, c long, class int")


def transitions(coded: DataFrame, size: int, end: int) -> np.ndarray:
    """Counts of (class of the previous token, class) of the training texts; a text begins after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(size * size, np.int64)
        for batch in batches:
            for tokens, _, held, row in rows_of(batch):
                of = (unpacked(row["code"].as_py(), "<i8") % size)[tokens]
                last = np.r_[end, of[:-1]]  # each text ends with an end
                m += np.bincount((last * size + of)[~held], minlength=size * size)
        yield _matrix_rows(m.reshape(size, size))

    return _sum_matrix(coded.select("held_out", "lens", "tokens", "code").mapInArrow(run, "a int, b int, n long"), size)


def class_of(c: Classes, words: pa.Array, given: pa.Array) -> np.ndarray:
    """The class that a word was given, else the one that `c` has for it."""
    pairs = zip(words.cast(pa.binary()).to_pylist(), given.to_pylist())
    return np.fromiter((k if k is not None else c.end if w == END.encode() else c.of(w) for w, k in pairs), np.int64, len(words))


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, n_classes: int = CLASSES, mix: float = MIX, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns where `held_out` doesn't hold."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shape = f"doc_id array<{kind}>, held_out array<boolean>, lens array<int>, tokens binary, words array<string>, n array<long>"
    # written with its number: a block is known by it from here on
    blocks = materialize(rows.mapInArrow(_blocks(block_bytes), shape).withColumn("block", F.monotonically_increasing_id()), "blocks", "zstd")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "w")).select("block", "pos", "w.words", "w.n").withColumnRenamed("words", "word")
    counts = materialize(listed.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(head).collect()
    names = [r["word"].encode() for r in top]
    pairs = head_bigrams(blocks, names)
    classes = Classes(names, [r["c"] for r in top], exchange(pairs, n_classes))
    size, end = len(classes), classes.end
    z = np.eye(classes.n)[[classes.head[w] for w in names]] if names else np.zeros((0, classes.n))
    given = assign(neighbours(blocks, classes), z.T @ pairs @ z)
    counts = materialize(classed(counts, given, classes), "classed-counts")
    sizes = np.zeros(size)
    for r in counts.groupBy("class").count().collect():  # one row for each class
        sizes[r["class"]] = r["count"]
    sent = sc.broadcast(classes)

    def encode(block: pa.Table, known: pa.Table) -> pa.Table:
        """The block with count * classes + class of each word of its list."""
        given, pos = known.column("code").combine_chunks(), known.column("pos").to_numpy()
        none = np.flatnonzero(given.is_null().to_numpy(zero_copy_only=False))
        code = np.zeros(known.num_rows, "<i8")
        code[pos] = given.fill_null(0).to_numpy()
        if len(none):  # words without a count have a class alone
            code[pos[none]] = [sent.value.end if w == END else sent.value.of(w.encode()) for w in known.column("unseen").combine_chunks().take(pa.array(none)).to_pylist()]
        return block.select(["doc_id", "held_out", "lens", "tokens"]).append_column("code", pa.array([packed(code)], pa.binary()))

    # of words with a class only the place goes on to the blocks
    known = listed.select("block", "pos", "word").join(counts, "word", "left").select(F.col("block").alias("of"), "pos", (F.col("c") * size + F.col("class")).alias("code"), F.when(F.col("class").isNull(), F.col("word")).otherwise("").alias("unseen"))
    texts = blocks.select("block", "doc_id", "held_out", "lens", "tokens")
    coded = texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(encode, f"doc_id array<{kind}>, held_out array<boolean>, lens array<int>, tokens binary, code binary")
    coded = materialize(coded, "coded", "zstd")
    steps = transitions(coded, size, end)
    log_step = np.log(steps + 1) - np.log(steps.sum(1, keepdims=True) + size)
    model = sc.broadcast((log_step, np.log(steps.sum(0) + sizes + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, of = model.value
        for batch in batches:
            for at, _, _, row in rows_of(batch):
                c, k = np.divmod(unpacked(row["code"].as_py(), "<i8"), size)
                seen = np.log(c + 1.0)
                uni, word = seen - np.log(tokens + vocabulary + 1), seen - of[k]
                lens = row["lens"].values.to_numpy()
                ends = np.cumsum(lens, dtype=np.int64)
                cuts = np.r_[0, np.flatnonzero(np.diff(ends // SCORED)) + 1, len(lens)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):  # some documents at a time
                    begin = ends[lo] - lens[lo]
                    part = at[begin : ends[hi - 1]]
                    now = k[part]
                    last = np.r_[end, now[:-1]]  # each text ends with an end
                    p = np.logaddexp(np.log(mix) + step[last, now] + word[part], np.log1p(-mix) + uni[part]) if tokens else np.zeros(len(part))
                    begins = ends[lo:hi] - lens[lo:hi] - begin
                    total = lambda x: pa.array(np.add.reduceat(x, begins))  # noqa: E731, B023
                    cols = [row["doc_id"].values.slice(lo, hi - lo), row["held_out"].values.slice(lo, hi - lo), pa.array(lens[lo:hi].astype(np.int64)), total((c > 0)[part].astype(np.int64)), pa.array(np.full(hi - lo, tokens, np.int64)), total(uni[part] / np.log(10)), total(p / np.log(10))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) == 2)
