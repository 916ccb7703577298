"""Encoding and decoding held against the library itself: white space, markers in texts, other scripts, control characters, long texts, small blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import pieces

DOCS = "doc_id long, text string, ids string, block string"
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "▁", "▁a", "a▁▁b", " ▁ ", "\x00a", "<s> hi</s>", "<0x41> <unk>", "日本 語の文 ▁本", "é é", "​ x", "\n\n\t x\r\n", "12 345  6789", "😀 👩‍👩‍👧 x", "a b　c", "퟿\U0010ffff", "x" * 5000, " " * 300 + "y"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.default_model())


def made(seed, n):
    rng = random.Random(seed)
    bits = ["the", "The", "ing", " ", "  ", "   ", "▁", "\n", "\t", "ß", "語", "日本", "123", "é", "😀", "'s", ".", ",", "\x7f", "qzx", "der"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def check(spark, library, texts, **more):
    rows = [(i if i % 50 else None, t, "x", "y") for i, t in enumerate(texts, 1)]
    found = pieces.encode(spark.createDataFrame(rows, DOCS).repartition(3), pieces.default_model(), **more).collect()
    want = [library.encode(t or "") for t in texts]
    assert sorted((r["id"] or 0, r["ids"], r["decoded"]) for r in found) == sorted((r[0] or 0, i, library.decode(i)) for r, i in zip(rows, want))


def test_like_the_library(spark, library):
    rng = random.Random(4)
    long = " ".join(rng.choice(["word", "other", "Zahl", "語"]) + str(rng.randrange(3000)) for _ in range(30_000))
    check(spark, library, ODD + [None] + made(1, 400) + [long, long] + ODD[:5])


def test_small_blocks_tables_and_slices(spark, library, monkeypatch):
    small = {"VOCABULARY": 30, "CHARS": 300, "TABLE": 20, "SLICE": 7}
    texts = ODD + made(2, 150)
    for name in ("_blocks", "_segment"):

        def patched(*args, original=getattr(pieces, name)):
            run = original(*args)

            def inner(batches):
                for k, v in small.items():
                    setattr(pieces, k, v)
                yield from run(batches)

            return inner

        monkeypatch.setattr(pieces, name, patched)
    check(spark, library, texts, buckets=3)


def test_chunks_keep_the_text():
    for text in [t.replace(" ", "▁") for t in ODD + made(3, 200)]:
        assert "".join(c for some in pieces._chunks(text) for c in some) == text


def test_crossing_pieces_are_found(tmp_path, library, spark):
    from sentencepiece import sentencepiece_model_pb2 as pb

    assert pieces.separable(pieces.default_model())
    with open(pieces.default_model(), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.pieces[-1].piece = "of▁the"
    path = tmp_path / "crossing.model"
    path.write_bytes(proto.SerializeToString())
    assert not pieces.separable(str(path))
    got = pieces.encode(spark.createDataFrame([(1, "out of the", "", "")], DOCS), str(path)).first()
    assert got["decoded"] == "out of the"


def test_blocks_are_made_once(spark):
    """Both the table and the join read one exchange."""
    found = pieces.encode(spark.createDataFrame([(1, "a b", "", "")], DOCS), pieces.default_model())
    assert len(found.collect()) == 1
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    assert pieces.encode(spark.createDataFrame([], DOCS), pieces.default_model()).collect() == []


def test_query_digests(spark, library, tmp_path):
    texts = ODD + [None]
    spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.op12_sentencepiece(spark, str(tmp_path)).orderBy(F.col("doc_id"))
    assert [tuple(r) for r in got.collect()] == want
