"""SentencePiece encoding and decoding through one table of distinct chunks.

Where no piece crosses a whitespace marker (none has a marker after another character), a normalised text falls apart
into chunks, each a run of markers and what follows up to the next, that can be segmented alone. Tasks cut their texts
into blocks, bounded by distinct chunks and by characters, and make of each block a list of its distinct chunks and the
number of a chunk for each position. The lists, dealt by a hash of the chunk, come together in a table where every
distinct chunk of the corpus is segmented once. Its ids go back to the blocks, whose positions they are joined to: ids of
a text are those of its chunks in order, and so is the decoded text, which a block makes once for each of its chunks.

Two shuffles: to the table, and from it to the blocks. Lists of distinct chunks, then their ids, move, and the numbers
once, beside the lists, to where their block's ids will come; texts never do. Numbers are small for frequent chunks (place in the bucket's list, by falling frequency, times the number
of buckets, plus the bucket) and are packed by bytes of equal weight. A block is made again alike if its task is, as long
as its rows come in the same order, as those of files do. A task holds one block, or `TABLE` chunks of the table (beyond that it is begun anew, and a chunk
may be segmented again). Buckets grow with the shuffle partitions. A model whose pieces cross markers, or with marks of
the user's own, has its texts encoded whole, where they lie.

Defined results: a null text is empty and has no ids; repeated rows are encoded each; null ids stay null; an empty table
gives no rows; only the id and text columns are used. Ids are those of the library without begin or end ids, and the
decoded text is its `decode(ids)`.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CUT = re.compile(f"[^{MARK}](?={MARK})")
#: A block ends after the text with which it has so many distinct chunks, or characters.
VOCABULARY = 800_000
CHARS = 32_000_000
TABLE = 1_000_000
#: Characters of a long text that are cut into chunks at a time.
SLICE = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def _model(path: str):
    """The library's processor, and one that adds no marker before a text and takes none from a decoded one."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    whole = SentencePieceProcessor(model_proto=proto.SerializeToString())
    bare = pb.ModelProto.FromString(proto.SerializeToString())
    bare.normalizer_spec.add_dummy_prefix = False
    return whole, SentencePieceProcessor(model_proto=bare.SerializeToString()), proto


@cache
def separable(path: str) -> bool:
    """Whether chunks can be segmented alone: no piece goes on past a marker that follows another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = _model(path)[2]
    spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
    if not (spec.escape_whitespaces and spec.add_dummy_prefix) or spec.remove_extra_whitespaces or spec.precompiled_charsmap or proto.trainer_spec.treat_whitespace_as_suffix:
        return False
    own = any(p.type == kinds.USER_DEFINED for p in proto.pieces)
    return not own and any(p.piece == MARK for p in proto.pieces) and not any(p.type in (kinds.NORMAL, kinds.UNUSED) and CUT.search(p.piece) for p in proto.pieces)


def _chunks(text: str) -> Iterator[list[str]]:
    at = 0
    while len(text) - at > SLICE:
        cut = CUT.search(text, at + SLICE)
        if cut is None:
            break
        yield CHUNK.findall(text, at, cut.end())
        at = cut.end()
    yield CHUNK.findall(text, at)


def _packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Compressed numbers, bytes of equal weight together."""
    planes = np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(items: list[bytes], width: int = 1) -> bytes:
    """Compressed strings with their sizes; `width`: bytes of the numbers that they are made of."""
    sizes = np.fromiter(map(len, items), "<u4", len(items))
    planes = [x.view(np.uint8).reshape(-1, w).T.tobytes() for x, w in ((sizes, 4), (np.frombuffer(b"".join(items), np.uint8), width))]
    return zstandard.ZstdCompressor(level=1).compress(len(items).to_bytes(4, "little") + b"".join(planes))


def _unpack(data: bytes, width: int = 1) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:4], "little")
    flat = lambda planes, w: np.ascontiguousarray(planes.reshape(w, -1).T)
    ends = np.cumsum(flat(np.frombuffer(data, np.uint8, 4 * n, 4), 4).view("<u4").ravel(), dtype=np.int64).tolist()
    whole = flat(np.frombuffer(data, np.uint8, -1, 4 + 4 * n), width).tobytes() if ends and ends[-1] else b""
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class _Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(path: str, buckets: int):
    names, kinds = ["to", "block", "bucket", "data"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, first, made = _model(path)[0].normalize, TaskContext.get().partitionId() << 32, 0
        number, codes, counts, keys, size = _Numbers(), array("I"), [], [], 0

        def block() -> pa.RecordBatch:
            # equal frequencies in the order of the words, which packs better
            at, old = np.frombuffer(codes, np.uint32), list(number)
            first_by = sorted(range(len(old)), key=old.__getitem__)
            words, place = [old[i].encode() for i in first_by], np.empty(len(old), np.int64)
            place[first_by] = np.arange(len(old))
            at = place[at]
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.lexsort((-np.bincount(at, minlength=len(words)), of))
            begins = np.searchsorted(of[order], np.arange(buckets + 1))
            code = np.empty(len(of), np.int64)
            code[order] = (np.arange(len(of)) - begins[of[order]]) * buckets + of[order]
            here = first + made
            rows = [(here, here, -1, pickle.dumps((keys, _packed(np.array(counts, np.int64)), _packed(code[at]))))]
            rows += [(-1 - b, here, b, _pack([words[i] for i in order[begins[b] : begins[b + 1]]])) for b in range(buckets) if begins[b] < begins[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    before = len(codes)
                    for some in _chunks(normal(text)) if text else ():
                        codes.extend(map(number.__getitem__, some))
                    keys.append(k)
                    counts.append(len(codes) - before)
                    size += len(text or "")
                    if len(number) >= VOCABULARY or size >= CHARS:
                        yield block()
                        made += 1
                        number, codes, counts, keys, size = _Numbers(), array("I"), [], [], 0
        if keys:
            yield block()

    return run


def _segment(path: str, kind: str):
    """Lists of chunks -> their ids; each distinct chunk goes through the library once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare, known = _model(path)[1], {}
        for whole in batches:
            for batch in (whole.slice(i, 16) for i in range(0, whole.num_rows, 16)):
                out = []
                for held in map(_unpack, batch.column(3).to_pylist()):
                    fresh = [w for w in held if w not in known]
                    for i in range(0, len(fresh), 20_000):
                        some = fresh[i : i + 20_000]
                        known.update(zip(some, (np.array(x, kind).tobytes() for x in bare.encode([w.decode() for w in some], num_threads=1))))
                    out.append(_pack([known[w] for w in held], np.dtype(kind).itemsize))
                    if len(known) > TABLE:
                        known = {}
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["to", "bucket", "ids"])

    return run


def _surfaces(path: str) -> list[bytes]:
    """What the library shows for each id: a byte, nothing for control marks, else the piece with blanks for markers."""
    model = _model(path)[0]
    shown = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode()
    return [model.decode([i]).encode() if model.is_unknown(i) else shown(i) for i in range(model.vocab_size())]


def _join(path: str, kind: str, key: pa.DataType, buckets: int):
    """A block's positions and what the table gave for its lists: ids and text of each document."""
    names, kinds = ["id", "ids", "decoded"], [key, pa.list_(pa.int32()), pa.string()]

    def run(heads: pa.Table, lists: pa.Table) -> pa.Table:
        surface, size, out = _surfaces(path), np.dtype(kind).itemsize, []
        held = {b: _unpack(ids, size) for b, ids in zip(lists["bucket"].to_pylist(), lists["ids"].to_pylist())}
        ids = [i for b in range(buckets) for i in held.get(b, ())]
        begins = np.cumsum([0, *[len(held.get(b, ())) for b in range(buckets)]])
        shown = [b"".join(map(surface.__getitem__, np.frombuffer(i, kind).tolist())) for i in ids]
        for keys, counts, codes in map(pickle.loads, heads["data"].to_pylist()):
            code = _unpacked(codes)
            at, counts = begins[code % buckets] + code // buckets, _unpacked(counts).astype(np.int64)
            ends, i = np.cumsum(counts), 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - counts[i] + 200_000, "right")))
                found, said = [], []
                for d in range(i, j):
                    some = at[ends[d] - counts[d] : ends[d]].tolist()
                    found.append(b"".join(map(ids.__getitem__, some)))
                    said.append(b"".join(map(shown.__getitem__, some))[1:])  # without the marker that stands before every text
                offsets = np.cumsum([0, *[len(f) // size for f in found]], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(found), kind).astype(np.int32))
                out.append(pa.RecordBatch.from_arrays([pa.array(keys[i:j], key), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(said, pa.binary()).cast(pa.string())], names))
                i = j
        return pa.Table.from_batches(out, pa.schema(list(zip(names, kinds))))

    return run


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)[0]
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ids = model.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(model.decode(ids, num_threads=1), pa.string())], ["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """id, ids array<int>, decoded: a row for each of `docs`. `model` is a path that the driver and all executors have."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = rows.schema["id"].dataType
    shape = f"id {key.simpleString()}, ids array<int>, decoded string"
    if not separable(model):
        return rows.mapInArrow(_whole(model), shape)
    buckets = buckets or 2 * partitions(spark)
    kind = "<u2" if _model(model)[0].vocab_size() <= 1 << 16 else "<u4"
    blocks = rows.mapInArrow(_blocks(model, buckets), "to long, block long, bucket int, data binary").repartition("to")
    # one exchange for both: the optimiser would move a plain condition, or fewer columns, below it and make the blocks twice
    listed = (F.col("bucket") >= 0).cast("long") + F.floor(F.rand(0))
    segmented = blocks.where(listed == 1).mapInArrow(_segment(model, kind), "to long, bucket int, ids binary")
    return blocks.where(listed == 0).groupBy("to").cogroup(segmented.groupBy("to")).applyInArrow(_join(model, kind, to_arrow_type(key), buckets), shape)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), default_model())
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
