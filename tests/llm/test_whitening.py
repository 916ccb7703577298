"""Whitening against whole-number brute force: shares, signs, padding, non-finite entries, equal vectors, large numbers, empty tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerleaf.llm import whitening as wh

VECS = "vec_id long, embedding array<float>, label int, x string, w string"
WIDE = VECS.replace("float", "double")


def brute(rows, k=8):
    """n, deviations and covariance, in fractions; whitened values by numpy from those."""
    fine = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 2**40 for c in v)]
    dim = max((len(v) for _, v in fine), default=0)
    x = [[math.floor(1024 * float(c)) + 100_000 for c in [*v, *[0.0] * (dim - len(v))]] for _, v in fine]
    n = len(x)
    s = [sum(c) for c in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    cent = [[n * a - b for a, b in zip(row, s)] for row in x]
    cov = [[Fraction(sum(r[a] * r[b] for r in cent), n**3) for b in range(dim)] for a in range(dim)]
    return fine, n, dev, cov, np.array([[float(Fraction(c, n)) for c in r] for r in cent])


def made(n=300, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.geomspace(1, 0.05, dim)
    return [(i, [float(c) for c in np.float32(r)], 1, "a", "b") for i, r in enumerate(rng.normal(size=(n, dim)) @ mix)]


def check(spark, rows, schema=VECS):
    fine, n, dev, cov, cent = brute(rows)
    got = wh.whiten(spark.createDataFrame(rows, schema).repartition(5)).collect()
    e, v = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    want = sorted((i is None, i or 0, d, np.abs(w).round(6).tolist()) for (i, _), d, w in zip(fine, dev, cent @ v / np.sqrt(e)))
    have = sorted((r["id"] is None, r["id"] or 0, r["deviation"], np.abs(r["whitened"]).round(6).tolist()) for r in got)
    assert [h[:3] for h in have] == [w[:3] for w in want] and {r["n"] for r in got} == {n}
    assert np.allclose([h[3] for h in have], [w[3] for w in want], atol=1e-5)
    assert np.allclose(got[0]["explained"], e / float(sum(cov[i][i] for i in range(len(cov)))), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    w = np.array([r["whitened"] for r in got])
    assert abs(np.abs(np.cov(w.T, bias=True) - np.eye(w.shape[1])).max()) < 1e-9
    return got


def test_against_whole_numbers(spark):
    rows = made()
    odd = [(900, None, 1, "", ""), (901, [1.0, None], 1, "", ""), (902, [math.nan, 1.0], 1, "", ""), (903, [math.inf], 1, "", ""), (904, [], 1, "", ""), (905, [0.5, -2.0], 1, "", ""), (None, [1.0] * 12, 1, "", "")]
    check(spark, rows + odd + rows[:40] + [rows[7]] * 100)


def test_covariance_is_that_of_fractions(spark):
    """Large means and tiny spreads in one table: the double-double sums give every entry to the last bits of a double."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(1e6 + a), float(-1e9 + 1e-3 * b), float(1e5 * c), float(c + a)], 1, "", "") for i, (a, b, c) in enumerate(rng.normal(size=(2500, 3)))]
    _, n, _, cov, _ = brute(rows)
    x = spark.createDataFrame([(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v, *_ in rows], "id long, x array<long>").repartition(7)
    sums = [sum(c) for c in zip(*(r["x"] for r in x.collect()))]
    high, low = wh.covariance(x.select("x"), wh.Centre(n, sums))
    for a in range(4):
        for b in range(4):
            assert abs(Fraction(float(high[a, b])) + Fraction(float(low[a, b])) - cov[a][b]) <= abs(cov[a][b]) * Fraction(1, 2**52)


def test_slices_and_sums_lose_nothing():
    rng = np.random.default_rng(5)
    high = rng.normal(size=(100, 3)) * 10.0 ** rng.integers(-6, 6, (100, 3))
    low = high * 2.0**-54 * rng.uniform(-1, 1, (100, 3))
    cut = wh.slices(high, low)
    for i in range(100):
        for j in range(3):
            left = Fraction(high[i, j]) + Fraction(low[i, j]) - sum(Fraction(c[i, j]) for c in cut)
            assert abs(left) <= Fraction(float(np.abs(high).max())) / 2**100
    total = wh.outer(high, low, (np.zeros((3, 3)), np.zeros((3, 3))))
    for a in range(3):
        for b in range(3):
            exact = sum((Fraction(h[a]) + Fraction(l[a])) * (Fraction(h[b]) + Fraction(l[b])) for h, l in zip(high, low))
            assert abs(Fraction(total[0][a, b]) + Fraction(total[1][a, b]) - exact) <= Fraction(float(np.abs(high).max())) ** 2 / 2**85


def test_without_variance_and_empty(spark):
    one = [(1, [1.0, 2.0], 1, "", "")]
    for rows in ([], one, one * 5, [(1, None, 1, "", "")], [(1, [], 1, "", "")]):
        assert wh.whiten(spark.createDataFrame(rows, VECS)).collect() == []
    got = wh.whiten(spark.createDataFrame([*one, (2, [2.0, 4.0], 1, "", "")], VECS)).collect()
    assert [len(r["whitened"]) for r in got] == [1, 1] and sorted(round(r["whitened"][0]) for r in got) == [-1, 1]


def test_deviation_beyond_longs(spark):
    rows = [(i, [c * 2.0**30], 1, "", "") for i, c in enumerate((-1.0, 1.0, 500.0))]
    _, _, dev, _, _ = brute(rows)
    got = {r["id"]: r["deviation"] for r in wh.whiten(spark.createDataFrame(rows, WIDE)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(dev)}


def test_query(spark, tmp_path):
    rows = made(40, 10, 2)
    spark.createDataFrame(rows, VECS).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = wh.op13_whiten(spark, str(tmp_path)).collect()
    assert len(got) == 320 and {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {40}
    share = {r["component"]: r["explained"] for r in got}
    assert sorted(share.values(), reverse=True) == [share[c] for c in range(1, 9)]
    assert got[0]["identity_error"] == pytest.approx(0, abs=1e-10)
