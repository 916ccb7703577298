"""SimHash near-duplicates over vantage-point trees.

1. Every text gets a 64-bit fingerprint from its word shingles; documents with one fingerprint collapse to one node.
2. A top vantage-point tree, made from a bounded sample, deals the nodes to shards by Hamming distance. A node goes to
   the shard that owns it and, as a query, to those shards on one side that the triangle inequality can't rule out.
3. Each shard builds its own tree and prunes its branches by the same bound, so every pair within `radius` is compared
   exactly in one shard. A shard returns a spanning forest of its links, never the pairs of a group.
4. Components grow from the forests by alternating star contractions, as joins with tables written between rounds.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows with one id stay separate
rows; null ids never name a component unless it has no other; an empty table gives no rows; only the id and text
columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, materialize, table

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Nodes that make the top tree, and those for each shard where there are many: what the driver sees, not what is searched.
SAMPLE = 20_000
PER_SHARD = 16
SHARD_ROWS = 32_768
#: At most 131,072 shards, so the top tree is made from two million fingerprints (16 MB) at most.
MAX_DEPTH = 17
LEAF = 256


def _fingerprints(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            out = []
            for data in batch.column(1):
                words = (data.as_py() or b"").lower().split()
                n = max(1, len(words) - k + 1) if words else 0
                ones = np.zeros(64, np.int64)
                for s in range(0, n, 1 << 16):
                    part = words[s : s + (1 << 16) + k - 1]
                    grams = zip(*(part[j:] for j in range(k))) if len(words) >= k else [words]
                    hashes = np.array([h(b" ".join(g), seed) for g in grams], "<u8")
                    ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out.append(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0] if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["doc_id", "mark", "fp"])

    return run


def mark_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows with one id apart), fp (the 64 bits as a signed long) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), mark_of(text_col))
    return rows.mapInArrow(_fingerprints(k, seed), f"doc_id {docs.schema[id_col].dataType.simpleString()}, mark long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(fps: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, radius, and which rows lie within; of a few candidates the one whose distances spread most."""
    picks = fps[:: max(1, len(fps) // 5)][:5]
    point = max(picks, key=lambda p: np.var(_distance(fps[:: max(1, len(fps) // 500)], p)))
    d = _distance(fps, point)
    mid = int(np.median(d))
    inner = d <= mid
    if inner.all():
        mid -= 1
        inner = d <= mid
    return None if inner.all() or not inner.any() else (point, mid, inner)


def top_tree(fps: np.ndarray, depth: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inner, outer); a child below zero is the shard -1 - child."""
    nodes, shards = [], [0]

    def grow(rows: np.ndarray, left: int) -> int:
        got = _split(rows) if left and len(rows) > 1 else None
        if got is None:
            shards[0] += 1
            return -shards[0]
        at = len(nodes)
        nodes.append(None)
        point, mid, inner = got
        nodes[at] = (int(point), mid, grow(rows[inner], left - 1), grow(rows[~inner], left - 1))
        return at

    grow(fps, depth)
    return nodes


def _route(nodes: list, radius: int):
    """(shard, fp, own): a node's own shard, and the later shards whose region lies within `radius`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            todo = [(0 if nodes else -1, np.arange(len(fps)), np.ones(len(fps), bool))]
            while todo:
                at, rows, own = todo.pop()
                if not len(rows):
                    continue
                if at < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), -1 - at, np.int32)), pa.array(fps[rows].view(np.int64)), pa.array(own)], ["shard", "fp", "own"])
                    continue
                point, mid, inner, outer = nodes[at]
                d = _distance(fps[rows], np.uint64(point)).astype(int)
                # shards are numbered inner side first: a query only goes on to later ones, which still meets each pair once
                near = d <= mid
                todo.append((inner, rows[near | (~own & (d <= mid + radius))], own[near | (~own & (d <= mid + radius))]))
                goes = (~near & own) | (d > mid - radius)
                todo.append((outer, rows[goes], (own & ~near)[goes]))

    return run


def _forest(radius: int):
    """The links of one shard as (a, b) rows: every linked node and the root of its tree."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy().view(np.uint64)
        owned = np.flatnonzero(frame["own"].to_numpy())
        label = np.arange(len(fps))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def compare(members: np.ndarray, queries: np.ndarray) -> None:
            nonlocal label
            step = max(1, (1 << 20) // len(members))
            for s in range(0, len(queries), step):
                q = queries[s : s + step]
                i, j = np.nonzero(_distance(fps[q][:, None], fps[members][None, :]) <= radius)
                pairs = np.stack([label[q[i]], label[members[j]]], 1)
                pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
                if len(pairs):
                    for x, y in pairs.tolist():
                        x, y = root(x), root(y)
                        parent[max(x, y)] = min(x, y)
                    to = np.arange(len(fps))
                    to[list(parent)] = [root(x) for x in list(parent)]
                    label = to[label]

        def search(members: np.ndarray, queries: np.ndarray) -> None:
            if not len(queries) or not len(members):
                return
            got = _split(fps[members]) if len(members) > LEAF else None
            if got is None:
                return compare(members, queries)
            point, mid, inner = got
            d = _distance(fps[queries], point).astype(int)
            search(members[inner], queries[d <= mid + radius])
            search(members[~inner], queries[d > mid - radius])

        search(owned, np.arange(len(fps)))
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[linked].view(np.int64), "b": fps[label[linked]].view(np.int64)})

    return run


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """A spanning forest (a, b) of all links between distinct fingerprints (column fp)."""
    n = nodes.count()
    depth = 0
    while n > shard_rows << depth and depth < MAX_DEPTH:
        depth += 1
    sample = max(sample, PER_SHARD << depth)
    part = min(1.0, sample / max(1, n))
    seen = nodes.where(F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(1_000_000_000)) < int(part * 1_000_000_000)).limit(2 * sample)
    tree = top_tree(np.sort(seen.select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)), depth) if depth else []
    dealt = nodes.select("fp").mapInArrow(_route(tree, radius), "shard int, fp long, own boolean")
    return dealt.groupBy("shard").applyInPandas(_forest(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of `edges` (a, b) reaches."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours go to the least one
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        edges = materialize(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, mark, fp, root, component_id: the smallest id that a row reaches over links of `radius` differing bits or fewer."""
    prints = materialize(fingerprints(docs, id_col, text_col, k, seed), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(known, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id, then mark; null ids come last. Of equal rows one stays."""
    counts = near_duplicates(docs, id_col, text_col).groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "n")).alias("best")
    kept = materialize(counts.groupBy("root").agg(best).select("best.*"), "kept")
    rows = docs.select(as_row(docs), F.col(id_col).alias("id"), mark_of(text_col).alias("own"))
    rest = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")), "left_semi").select("row.*")
    return rest.dropDuplicates([id_col, text_col]) if kept.where("n > 1").limit(1).count() else rest


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
