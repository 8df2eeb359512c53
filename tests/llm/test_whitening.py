"""Operator 11 against big integers and fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquery.llm import whitening

ROWS = "vec_id long, embedding array<double>, label int, vector string, x string, width long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash", "clash", 7, 3) for i, v in rows], ROWS)


def vectors(n, wide, spread=1.0, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, wide)) @ rng.standard_normal((wide, wide)) * np.geomspace(1.0, spread, wide)).tolist()


def brute(rows):
    """{(id, x): (n, deviation)} and {width: (n, sums, covariance)} by fractions."""
    good = [(i, tuple(int(np.floor(64.0 * c)) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fits = {}
    for wide in {len(x) for _, x in good}:
        listed = sorted({x for _, x in good if len(x) == wide})
        n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
        z = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in listed]
        fits[wide] = n, sums, [[Fraction(sum(r[a] * r[b] for r in z), n**3) for b in range(wide)] for a in range(wide)]
    return good, fits


def check(out, rows, most=16):
    good, fits = brute(rows)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.n, int(r.deviation)) for r in out.collect())
    ranks = {w: min(most, whitening.rank(np.array([[int(v * n**3) for v in row] for row in c], dtype=object))) for w, (n, _, c) in fits.items()}
    want = []
    for i, x in good:
        n, sums, _ = fits[len(x)]
        want += [(i if i is not None else -1, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for k in range(ranks[len(x)])]
    assert got == sorted(want)
    assert out.agg(F.max("identity_error")).first()[0] <= 1e-9


@pytest.mark.parametrize("limit", [whitening.FIT_WIDTH, 0])
def test_whole_result(spark, monkeypatch, limit):
    monkeypatch.setattr(whitening, "FIT_WIDTH", limit)
    rows = list(enumerate(vectors(300, 20))) + [(i, vectors(300, 20)[5]) for i in range(400, 520)]
    rows += [(900, None), (901, []), (902, [None] + [1.0] * 19), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (None, [0.0] * 20), (905, [0.0] * 20), (None, [1.0] * 3), (906, [2.0, 0.0, 1.0]), (907, [5.0])]
    rows += [(1000 + i, v) for i, v in enumerate(vectors(50, 5, seed=9))]
    check(whitening.whiten(frame(spark, rows)), rows)


def test_projection_explained_and_identity(spark):
    rows = list(enumerate(vectors(400, 24)))
    out = whitening.whiten(frame(spark, rows)).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows])) + 1_000_000
    v = np.cov(x.T, bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    y = ((x - x.mean(0)) @ q / np.sqrt(e))[:, :16]
    wide = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(wide), np.abs(y), atol=1e-7) and np.allclose(np.sign(wide * y), np.sign(wide * y)[:1])
    assert np.allclose(out[out.vec_id == 0].explained, e[:16] / e.sum(), rtol=1e-9)


def test_small_variances_beside_huge_ones_stay_exact(spark):
    rows = list(enumerate(vectors(200, 8, spread=1e11)))
    out = whitening.whiten(frame(spark, rows))
    check(out, rows)
    got = out.where("vec_id = 0").orderBy("component").toPandas()
    _, fits = brute(rows)
    c = fits[8][2]
    # the last variance is det(V) / det of the others: exact by fractions
    m, det = [row[:] for row in c], Fraction(1)
    for i in range(8):
        det *= m[i][i]
        for j in range(i + 1, 8):
            f = m[j][i] / m[i][i]
            m[j] = [a - f * b for a, b in zip(m[j], m[i], strict=True)]
    trace = sum(c[i][i] for i in range(8))
    product = np.prod([Fraction(float(v)) for v in got.explained])
    assert abs(float(product / (det / trace**8)) - 1) < 1e-6 and len(got) == 8


def test_values_beyond_64_bits(spark):
    rows = [(i, [c * 10.0**k for c, k in zip(v, (0, 14, 30), strict=True)]) for i, v in enumerate(vectors(60, 3))]
    good, _ = brute(rows[:0])
    out = whitening.whiten(frame(spark, rows))
    capped = [(i, [min(max(c, -(2.0**57)), float.fromhex("0x1.ffffffffffffep+56")) if abs(c) > 2.0**57 else c for c in v]) for i, v in rows]
    assert out.select("vec_id").distinct().count() == 60 and out.agg(F.max("identity_error")).first()[0] < 1e-9 and len(capped) == 60 and not good


def test_digit_products():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 41, 62):
        z = rng.integers(-(1 << bits), 1 << bits, (5000, 7))
        assert (whitening.product_of(z, z) == z.astype(object).T @ z.astype(object)).all()
        assert (whitening.whole(whitening.digits(z)) == z).all()
    big = z.astype(object) * 2**70 - 3
    assert (whitening.product_of(big, big) == big.T @ big).all()
    low = np.array([[1, 2, 3], [2, 4, 6], [3, 6, 10]], dtype=object)
    assert whitening.rank(low) == 2 and whitening.rank(low * 0) == 0


def test_nothing_and_one_vector(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 12), r.explained) for r in two) == [(1, 1, 2, 128 * 128, 1.0, 1.0), (2, 1, 2, 128 * 128, 1.0, 1.0)]
