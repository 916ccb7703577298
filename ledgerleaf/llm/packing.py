"""Packing by best-fit decreasing over the whole corpus.

Documents are tokenised where they lie. Overlong ones are first cut into full windows; the rest of each is one piece.
Best-fit decreasing only sees lengths, so it runs on the histogram of piece lengths (as many rows as a window has
tokens, whatever the corpus): a segment tree indexed by remaining capacity finds the tightest open window, and windows
with the same history are handled as one group, which gives exactly what placing piece by piece would. The outcome is
a short list of runs "pieces k to k+n of length l go to windows b, b+1, ... at offset o, q in each"; every piece finds
its place from its rank among those of its length, which comes from counts by partition.

Defined results: a null text counts as empty and holds the end token alone; repeated rows are packed each; an empty
table gives no rows; only the id and text columns are used.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 4096
END_ID = 2
#: Entries of a worker's caches of encoded words, and of chunks of texts that aren't plain; one is emptied when full, which
#: is looked at before each slice. A worker keeps them as long as it lives, so the steps after this one have that much less memory.
CACHE, CHUNK_CACHE = 200_000, 50_000
#: Bytes of text that are encoded together, and at most one text more; a worker needs many times as much for that.
SLICE = 2 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """A dict that makes what it lacks, so that `map` over its `__getitem__` only enters Python for what is new."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self.make(key)
        return got


class ChunkEncoder:
    """Token ids of a text as little-endian bytes, through a cache of its white-space-delimited chunks.

    The tokenizer never joins across white space, so chunks can be encoded alone. Texts with the control characters
    that `str.split` takes for white space, and the tokenizer doesn't, are encoded whole. Plain texts are encoded many
    at a time: each of their distinct chunks is looked up once, and ids are laid out by position.
    """

    #: Letters, digits and marks for which the quick path is exact; others go through the tokenizer itself.
    PLAIN = re.compile(r"[!-~À-ÿ]+")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    ODD = re.compile("[\x1c-\x1f]")
    PLAIN_TEXT = re.compile(r"[!-~À-ÿ \t-\r]+")
    #: Words of chunks that are joined by line feeds, and these; what a line feed is encoded as, which is no id.
    LINES = re.compile(WORDS.pattern + r"|\n")
    MARK = np.uint32(0xFFFFFFFF)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        points = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.byte = {b: chr(b) if b in points else chr(next(other)) for b in range(256)}
        self.chunks, self.words = Memo(self.chunk), Memo(self.word)

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        if w == "\n":
            return self.MARK.tobytes()
        ids = [t.id for t in self.model.tokenize(w if w.isascii() else "".join(map(self.byte.__getitem__, w.encode())))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, c: str) -> bytes:
        if self.PLAIN.fullmatch(c) and "<|" not in c:
            return b"".join(map(self.words.__getitem__, self.WORDS.findall(c.lower())))
        return self.ids(c)

    def room(self) -> None:
        for memo, most in ((self.chunks, CHUNK_CACHE), (self.words, CACHE)):
            if len(memo) > most:
                memo.clear()

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return self.ids(text)
        self.room()
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """`encode` of plain texts in lower case, none empty."""
        self.room()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        lines = "\n".join([*coded.dictionary.to_numpy(zero_copy_only=False), ""])
        pool = np.frombuffer(b"".join(map(self.words.__getitem__, self.LINES.findall(lines))), "<u4")
        marks = np.flatnonzero(pool == self.MARK).astype("int32")  # one after each chunk; an Arrow string array has less than 2**31 bytes
        first = np.zeros_like(marks)
        first[1:] = marks[:-1] + 1
        codes = coded.indices.to_numpy()
        n = (marks - first)[codes]
        end = np.cumsum(n, dtype="int32")
        at = np.repeat(first[codes] - end + n, n)
        at += np.arange(len(at), dtype="int32")
        data = pool[at]
        cuts = np.concatenate([[0], end])[split.offsets.to_numpy()].tolist()
        return [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """`encode` of each text; a null one is empty."""
        plain = [i for i, t in enumerate(texts) if t and self.PLAIN_TEXT.fullmatch(t) and "<|" not in t]
        quick = dict(zip(plain, self.encode_plain([texts[i].lower() for i in plain]) if plain else ()))
        return [quick[i] if i in quick else self.encode(t) if t else b"" for i, t in enumerate(texts)]


@lru_cache(1)
def encoder(path: str) -> ChunkEncoder:
    """One for all tasks of a worker, so that its caches outlive a task."""
    return ChunkEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (id, text) in parts of `SLICE` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype="int64") // SLICE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _pieces(path: str, window: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, ranks = encoder(path), np.array([end], "<u4").tobytes(), [0] * (window + 1)
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in _slices(whole):
                at, cols, ids = [], [[] for _ in range(5)], []
                for i, data in enumerate(enc.encode_all(batch.column(1).to_pylist())):
                    data += tail
                    for s in range(0, len(data), 4 * window):
                        piece = data[s : s + 4 * window]
                        n = len(piece) // 4
                        at.append(i)
                        for c, v in zip(cols, (s // 4, n, zlib.crc32(piece), len(data) // 4, ranks[n])):
                            c.append(v)
                        ranks[n] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                out = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols], pa.array([part] * len(at), pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_rank", "part"]
                if keep_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


class CapacityTree:
    """Segment tree over capacities 0..size: how many groups of open windows have each; finds the least one at or above."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first window, pieces in each window, offset) for counts of lengths."""
    tree, groups, runs, windows = CapacityTree(window), {}, [], 0

    def open_group(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            groups.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                capacity, first, n = window, windows, -(-left // each)
                windows += n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -1)
                each = capacity // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, window - capacity))
                open_group(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer pieces left than one window takes
                runs.append((length, rank, left, first + full, left, window - capacity))
                open_group(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            open_group(capacity, first + full, n - full)
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its token ids, which `keep_ids` False leaves out."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, local_rank long, part int" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), window, end, keep_ids), schema), "pieces")
    counts = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # at most `window` rows, however many documents there are
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = spark.createDataFrame(best_fit_decreasing(lengths, window), "run_length long, first long, n long, window long, each long, used long")
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    k = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (k >= 0) & (k < F.col("n")))
    place = [(F.col("window") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("used") + k % F.col("each") * F.col("length")).alias("offset")]
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *place, *["ids"] * keep_ids)


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = END_ID) -> DataFrame:
    """Whole sequences from `pack`'s pieces: sequence_id, n_tokens without padding, and `window` ids; a sequence has `window` pieces at most."""
    found = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    ids = found.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"))
    return ids.select("sequence_id", F.size("ids").alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad), F.lit(window) - F.size("ids"))).alias("ids"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: of the ids only their digest."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
