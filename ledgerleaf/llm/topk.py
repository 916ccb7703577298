"""Exact top-k inner-product search over ball trees.

Candidates are dealt to shards of about `shard_rows` vectors by a hash of the id, so equal vectors spread evenly; each
shard becomes a ball tree, one row of a written table. Queries are packed into blocks, one row each; blocks grow with the
root of the number of queries, up to `BLOCK_BYTES`, since every block costs another pass of the trees. A task takes one
block and streams the trees past it: nodes are visited best first, by falling upper bound of the inner product, and the
k-th score found so far, shared over all shards of the block, prunes what follows. Memory is one block and one tree.

Components are integers (floor of `scale` times the value), so scores are exact: bounds are widened for rounding and
leaves are scored in double precision, where all products and sums are whole numbers below 2**53; beyond that in longs.

Defined results: vectors null, empty or with null or non-finite components, and rows with a null id, take no part;
shorter vectors are padded with zeros; rows with a query's own id are no candidates for it; other repeated rows count
each; a query with fewer than k candidates gets all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SHARD_ROWS = 1_024
BLOCK_ROWS = 256
BLOCK_BYTES = 8 << 20
LEAF = 128
NONE = np.iinfo(np.int64).min


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """A ball tree: points in leaf order and, for each node, centre, radius, least id, children or the slice of its leaf."""
    order, nodes = [], []

    def grow(rows: np.ndarray) -> int:
        pts = x[rows].astype(float)
        centre = pts.mean(0)
        d = np.sqrt(((pts - centre) ** 2).sum(1))
        at = len(nodes)
        nodes.append(None)
        left = right = -1
        start = sum(map(len, order))
        if len(rows) > leaf and d.max() > 0:
            a = pts[d.argmax()]
            b = pts[((pts - a) ** 2).sum(1).argmax()]
            side = pts @ (a - b)
            cut = np.argsort(side, kind="stable")
            left = grow(rows[cut[: len(cut) // 2]])
            right = grow(rows[cut[len(cut) // 2 :]])
        else:
            order.append(rows)
        nodes[at] = (centre, d.max(), ids[rows].min(), left, right, start, start + len(rows))
        return at

    grow(np.arange(len(ids)))
    rows = np.concatenate(order)
    cols = [np.array(c) for c in zip(*nodes)]
    small = np.int16 if np.abs(x).max(initial=0) < 2**15 else np.int64
    return {"ids": ids[rows], "x": x[rows].astype(small), "centre": cols[0], "radius": cols[1], "least": cols[2], "left": cols[3], "right": cols[4], "start": cols[5], "end": cols[6]}


class Search:
    """A block of queries and the best k of each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q.astype(float) ** 2).sum(1))
        self.score = np.full((len(ids), k), NONE)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def _may(self, rows: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        kth = self.score[rows, -1]
        return (bound > kth) | (kth == NONE) | ((bound == kth) & (least < self.id[rows, -1]))

    def visit(self, t: dict) -> None:
        """Best first: for each query, leaves by falling bound, a leaf's being the least on its way from the root, until none can reach the k-th score found so far."""
        q = self.q.astype(float)
        reach = q @ t["centre"].T + self.norm[:, None] * t["radius"]
        slack = 1e-9 * self.norm[:, None] * (np.sqrt((t["centre"] ** 2).sum(1)) + t["radius"]) + 1e-6
        bound = np.floor(reach + slack)
        for node in np.flatnonzero(t["left"] >= 0):  # nodes stand before their children
            for child in (t["left"][node], t["right"][node]):
                bound[:, child] = np.minimum(bound[:, child], bound[:, node])
        leaves = np.flatnonzero(t["left"] < 0)
        order = np.argsort(-bound[:, leaves], axis=1, kind="stable")
        for r in range(len(leaves)):
            node = leaves[order[:, r]]
            best = bound[np.arange(len(q)), node]
            if not ((best >= self.score[:, -1]) | (self.score[:, -1] == NONE)).any():
                break
            now = np.flatnonzero(self._may(np.arange(len(q)), best, t["least"][node]))
            for leaf in np.unique(node[now]):
                self._take(now[node[now] == leaf], t["ids"][t["start"][leaf] : t["end"][leaf]], t["x"][t["start"][leaf] : t["end"][leaf]])

    def _take(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        q = self.q[rows]
        if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52:
            score = (q.astype(float) @ x.T.astype(float)).astype(np.int64)
        else:
            score = q @ x.T.astype(np.int64)
        own = ids[None, :] == self.ids[rows][:, None]
        score = np.hstack([self.score[rows], np.where(own, NONE, score)])
        ids = np.hstack([self.id[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, own.shape))])
        best = np.lexsort((ids, -score.astype(float) if abs(score[score != NONE]).max(initial=0) < 2**53 else ~score), axis=-1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, best, 1)
        self.id[rows] = np.take_along_axis(ids, best, 1)

    def result(self) -> pa.RecordBatch:
        found = self.score != NONE
        i, j = np.nonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array((j + 1).astype(np.int32)), pa.array(self.id[found]), pa.array(self.score[found])], ["query_id", "rank", "vec_id", "score"])


def _matrix(frame: pd.DataFrame, dim: int) -> np.ndarray:
    out = np.zeros((len(frame), dim), np.int64)
    for row, v in zip(out, frame["v"]):
        row[: len(v)] = v
    return out


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, search = None, None
        for batch in batches:
            for b, part, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if b != block:
                    if search is not None:
                        yield search.result()
                    block, search = b, None
                if part < 0:
                    search = Search(*pickle.loads(data), k)
                elif search is not None:
                    search.visit(pickle.loads(data))
        if search is not None:
            yield search.result()

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int | None = None, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row where `is_query` holds (a condition on `vectors`)."""
    x = lambda e: e.cast("double")
    fine = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) != float("inf")))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda e: F.floor(x(e) * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asked, dim = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, min(BLOCK_BYTES // (8 * max(1, dim)), math.isqrt(64 * asked)))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build(frame["id"].to_numpy(), _matrix(frame, dim), leaf)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "data": [pickle.dumps(tree, 5)]})

    def bundle(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "part": [-1], "data": [pickle.dumps((frame["id"].to_numpy(), _matrix(frame, dim)), 5)]})

    trees = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard").applyInPandas(plant, "shard int, data binary")
    trees = materialize(trees, "trees")
    packed = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks))).groupBy("block").applyInPandas(bundle, "block int, part int, data binary")
    # the stated query set against all rows, in blocks: each block meets every tree
    sent = trees.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("shard").alias("part"), "data")
    met = packed.unionByName(sent).repartition(min(4 * blocks, 4096), "block").sortWithinPartitions("block", "part")
    return met.mapInArrow(_scan(k), "query_id long, rank int, vec_id long, score long")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
