"""Embedding whitening by a compensated covariance.

x = floor(scale * entry) + shift, a whole number. Passes over the vectors: (1) their number and sums, exact; (2) the
covariance; (3) deviations and whitened components, written as one row a vector; over these (4) means and (5) the
covariance that shows how well the whitening worked.

Covariances: a vector is centred first, x - S/n as a sum of two doubles (the whole part of the mean is taken off exactly,
the rest by an error-free subtraction). Centred vectors are cut into slices of `BITS` bits on a grid that a block of rows
shares, so that products of slices, summed over the block, fit a double without rounding: an error-free transformation of
the outer products, which then are plain matrix products. Their sums are added up in double-double: a high part, and a
low part that takes the error of each addition. Tasks return both parts by rows of the matrix, merged in two rounds of
shuffles, first those of `FAN` tasks each; the driver sees one matrix (dimension squared, whatever the number of vectors). LAPACK's symmetric solver, `numpy.linalg.eigh`, reduces it to tridiagonal form and solves that by
divide and conquer. Eigenvectors get the sign that makes their largest entry positive.

Defined results: vectors null or with null or non-finite entries take no part, nor do those with an entry of 2**40 or
more in size, whose x and sums couldn't be kept exact; shorter vectors are padded with zeros; repeated rows and null ids
count each; components without variance (eigenvalue within rounding of 0: one vector, equal vectors, fewer vectors than
dimensions) are left out, so then there are fewer rows, or none; deviation is null where it exceeds a long; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LIMIT = 2.0**40
#: Rows of a block, and bits of a slice: 2 * BITS + log2(BLOCK) + 1 are below the 53 of a double.
BLOCK = 1024
BITS = 20
SLICES = 6
FAN = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and the error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double (high, low) plus (more, rest)."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + rest))


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """A block's numbers high + low cut into slices of `BITS` bits, each a multiple of a power of two that the block shares."""
    out = []
    top = np.abs(high).max(initial=0.0)
    if not top:
        return out
    grid = math.frexp(top)[1]
    for _ in range(SLICES):
        grid -= BITS
        big = math.ldexp(1.5, grid + 52)
        part = (high + big) - big
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


def outer(high: np.ndarray, low: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`total` plus the outer products of the rows of high + low."""
    for i in range(0, len(high), BLOCK):
        cut = slices(high[i : i + BLOCK], low[i : i + BLOCK])
        for a in range(len(cut)):
            for b in range(a, min(len(cut), SLICES - a)):
                product = cut[a].T @ cut[b]  # without rounding
                total = add(*total, product)
                if a != b:
                    total = add(*total, product.T)
    return total


def _matrix(column: pa.Array, dim: int, fill: int = 0) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.full((len(sizes), dim), fill, values.dtype)
    out[np.arange(dim)[None, :] < sizes[:, None]] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK))


def _sums(dim: int, fill: int):
    """(j, n, s): a task's number of vectors and the sum of their entry j, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in _blocks(batches):  # entries are below 2**51 in size, so the sum of a block fits a long
            total = [a + b for a, b in zip(total, _matrix(batch.column("x"), dim, fill).sum(0).tolist())]
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["j", "n", "s"])

    return run


class Centre:
    """Means s/n of whole numbers, split in a whole part, a double and what that lacks."""

    def __init__(self, n: int, sums: list[int], fill: int = 0):
        self.n, self.dim, self.fill = n, len(sums), fill
        self.whole, self.rest = (np.array(c, np.int64) for c in zip(*(divmod(s, n) for s in sums)))
        parts = [Fraction(int(r), n) for r in self.rest]
        self.high = np.array([float(f) for f in parts])
        self.low = np.array([float(f - Fraction(h)) for f, h in zip(parts, self.high.tolist())])

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x less the whole part of the mean, and x less the mean as double-double."""
        near = _matrix(column, self.dim, self.fill) - self.whole
        high, low = two_sum(near.astype(float), -self.high)
        return near, high, low - self.low

    def deviation(self, near: np.ndarray) -> list[int | None]:
        """Sum of (n * x - s)^2 for each row, exact; null beyond a long."""
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        off = near if self.dim * most * most < 1 << 63 else near.astype(object)
        return [int(v) if v < 1 << 63 else None for v in ((self.n * off - self.rest) ** 2).sum(1).tolist()]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, i, high, low): one for each (part, i), added up in double-double."""

    def row(key: tuple[int, int], total: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        cols = [pa.array([k], pa.int32()) for k in key] + [pa.array([t], pa.list_(pa.float64())) for t in total]
        return pa.RecordBatch.from_arrays(cols, ["part", "i", "high", "low"])

    now, total = None, None
    for batch in batches:
        for part, i, high, low in zip(*(c.to_pylist() for c in batch.columns)):
            pair = np.array(high), np.array(low)
            if (part, i) == now:
                total = add(*total, *pair)
            else:
                if now is not None:
                    yield row(now, total)
                now, total = (part, i), pair
    if now is not None:
        yield row(now, total)


def _together(rows: DataFrame, work: Callable) -> tuple[np.ndarray, np.ndarray] | None:
    """The sum, in double-double, of the matrices that `work` returns for each task; none without rows."""
    shape = "part int, i int, high array<double>, low array<double>"
    found = rows.mapInArrow(work, shape)
    for fan in (F.floor(F.col("part") / FAN).cast("int"), F.lit(0)):
        found = found.withColumn("part", fan).repartition("part", "i").sortWithinPartitions("part", "i").mapInArrow(_merge, shape)
    matrix = sorted((r["i"], r["high"], r["low"]) for r in found.collect())
    return (np.array([m[1] for m in matrix]), np.array([m[2] for m in matrix])) if matrix else None


def _task(size: tuple[int, int], step: Callable):
    """A task's total of `step(batch, total)` over blocks of rows, one row of the matrix a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = (np.zeros(size), np.zeros(size)), False
        for batch in _blocks(batches):
            total, seen = step(batch, total), True
        if seen:
            part = TaskContext.get().partitionId()
            cols = [pa.array([part] * size[0], pa.int32()), pa.array(range(size[0]), pa.int32()), *[pa.array(list(t), pa.list_(pa.float64())) for t in total]]
            yield pa.RecordBatch.from_arrays(cols, ["part", "i", "high", "low"])

    return run


def covariance(rows: DataFrame, centre: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of column x of `rows` in double-double, divisor n."""

    def step(batch: pa.RecordBatch, total: tuple) -> tuple:
        _, high, low = centre.read(batch.column("x"))
        return outer(high, low, total)

    high, low = _together(rows, _task((centre.dim, centre.dim), step))
    return high / centre.n, low / centre.n


def components(high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues by falling size, their eigenvectors in columns, and the trace; at most k, and only those above rounding."""
    e, v = np.linalg.eigh(high + low)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    good = e > max(e[0], 0.0) * len(high) * 2.0**-50
    e, v = e[good], v[:, good]
    return e, v * np.sign(v[np.abs(v).argmax(0), np.arange(len(e))]), math.fsum([*np.diag(high), *np.diag(low)])


def _identity_error(written: DataFrame, n: int, k: int) -> float:
    """Largest entry of the covariance of `w` less the identity, from the written values, centred on their own mean."""

    def add_up(batch: pa.RecordBatch, total: tuple) -> tuple:
        w = _matrix(batch.column("w"), k)
        exact = np.array([[math.fsum(c) for c in w.T.tolist()]])
        return add(*total, exact)

    high, low = _together(written, _task((1, k), add_up))
    means = [(Fraction(h) + Fraction(l)) / n for h, l in zip(high[0].tolist(), low[0].tolist())]
    near = np.array([float(m) for m in means])
    rest = np.array([float(m - Fraction(h)) for m, h in zip(means, near.tolist())])

    def spread(batch: pa.RecordBatch, total: tuple) -> tuple:
        high, low = two_sum(_matrix(batch.column("w"), k), -near)
        return outer(high, low - rest, total)

    high, low = _together(written, _task((k, k), spread))
    return float(np.abs((high - n * np.eye(k) + low) / n).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, n, deviation, whitened array<double>, explained array<double>, identity_error: a row for each vector that takes part."""
    from pyspark.sql.pandas.types import to_arrow_type

    x = lambda e: e.cast("double")
    fine = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < LIMIT))
    rows = vectors.where(fine).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda e: F.floor(x(e) * scale) + shift).alias("x"))
    key = rows.schema["id"].dataType
    shape = f"id {key.simpleString()}, deviation long, w array<double>"
    none = vectors.sparkSession.createDataFrame([], shape).select("id", F.lit(0).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.col("w").alias("explained"), F.lit(0.0).alias("identity_error"))
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return none
    sums = sorted((r["j"], int(r["n"]), int(r["s"])) for r in rows.select("x").mapInArrow(_sums(dim, shift), "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    centre = Centre(sums[0][1], [s[2] for s in sums], shift)
    high, low = covariance(rows.select("x"), centre)
    e, v, trace = components(high, low, k)
    if not len(e):
        return none
    axes, arrow = v / np.sqrt(e), to_arrow_type(key)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            near, d, rest = centre.read(batch.column("x"))
            w = d @ axes + rest @ axes
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow), pa.array(centre.deviation(near), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["id", "deviation", "w"])

    written = materialize(rows.mapInArrow(project, shape), "whitened")
    off = _identity_error(written.select("w"), centre.n, len(e))
    return written.select("id", F.lit(centre.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.array(*[F.lit(float(s)) for s in e / trace]).alias("explained"), F.lit(off).alias("identity_error"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened"), F.col("c.explained"), "identity_error")
