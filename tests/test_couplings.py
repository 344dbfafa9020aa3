"""Wigner symbols, products, rotations and isotropic series against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.operators import couplings, filters, isotropic, rotations, spectra


def symbol(j1, j2, j3, m1, m2, m3):
    """Racah's sum, for small degrees."""
    if m1 + m2 + m3 or j1 < abs(j2 - j3) or j1 > j2 + j3 or abs(m1) > j1 or abs(m2) > j2 or abs(m3) > j3:
        return 0.0
    f = math.factorial
    total = 0.0
    for t in range(j1 + j2 + j3 + 1):
        parts = (t, j3 - j2 + t + m1, j3 - j1 + t - m2, j1 + j2 - j3 - t, j1 - t - m1, j2 - t + m2)
        if min(parts) >= 0:
            total += (-1) ** t / math.prod(map(f, parts))
    delta = f(j1 + j2 - j3) * f(j1 - j2 + j3) * f(-j1 + j2 + j3) / f(j1 + j2 + j3 + 1)
    return (-1) ** (j1 - j2 - m3) * total * math.sqrt(delta * math.prod(f(j + m) * f(j - m) for j, m in ((j1, m1), (j2, m2), (j3, m3))))


def test_families_equal_racah():
    pairs = np.array([(a, b) for a in range(9) for b in range(9)])
    for m2 in range(-5, 6):
        for m3 in range(-5, 6):
            w = couplings.wigner_families(pairs[:, 0], pairs[:, 1], m2, m3)
            want = [[symbol(j, a, b, -m2 - m3, m2, m3) for j in range(w.shape[1])] for a, b in pairs.tolist()]
            assert np.abs(w - want).max() < 1e-12, (m2, m3)


def test_large_families_are_orthogonal():
    j2, j3 = 90, 75
    for m1 in (0, 7, -60):
        rows = []
        for m2 in range(-j2, j2 + 1):
            m3 = -m1 - m2
            if abs(m3) <= j3:
                rows.append(couplings.wigner_families(np.array([j2]), np.array([j3]), m2, m3)[0])
        w = np.array(rows)[:, max(abs(m1), j2 - j3) : j2 + j3 + 1]
        j = np.arange(max(abs(m1), j2 - j3), j2 + j3 + 1)
        assert np.allclose((w.T @ w) * np.sqrt(np.outer(2 * j + 1, 2 * j + 1)), np.eye(len(j)), atol=1e-9)


def field(seed, lmax, name="f"):
    r = np.random.default_rng(seed)
    return [(name, l, m, float(r.normal()), float(r.normal()) if m else 0.0) for l in range(lmax + 1) for m in range(l + 1)]


FIELD = "field string, l int, m int, c double, s double"


def test_product_of_two_fields(spark):
    f, g = spark.createDataFrame(field(1, 5), FIELD), spark.createDataFrame(field(2, 4), FIELD)
    cells = couplings.multiplier(f, 5, 4)
    values = filters.to_values(g).select(F.col("key").alias("col_key"), F.col("value").alias("x"))
    product = cells.join(values, "col_key").groupBy(F.lit("p").alias("field"), F.col("row_key").alias("key")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))
    r = np.random.default_rng(3)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(r.uniform(0, 360, 30), r.uniform(-90, 90, 30), strict=True)], "lon double, lat double")
    got = spectra.synthesise(points, f, 5, value="a")
    got = spectra.synthesise(got, g, 4, value="b")
    got = spectra.synthesise(got, filters.to_coefficients(product), 9, value="ab").collect()
    assert np.allclose([q["a"] * q["b"] for q in got], [q["ab"] for q in got], atol=1e-9)
    # The same by the triples, and cut at a degree.
    t = couplings.gaunt(spark, 4, 5).where("l1 = 3 and m1 = 2 and q1 = 1 and l2 = 5 and m2 = 1 and q2 = 0").collect()
    want = {(l, m, 1) for l in (2, 4, 6, 8) for m in (1, 3) if abs(symbol(l, 3, 5, -m, 2, m - 2)) > 1e-12}
    assert {(q["l"], q["m"], q["q"]) for q in t} == want and len(want) > 5
    assert couplings.multiplier(f, 5, 4, 2).where(F.substring("row_key", 5, 3).cast("int") > 2).count() == 0


def turned(lon, lat, a, b, c):
    x = np.array([math.cos(lat) * math.cos(lon + c), math.cos(lat) * math.sin(lon + c), math.sin(lat)])
    y = np.array([x[0] * math.cos(b) + x[2] * math.sin(b), x[1], x[2] * math.cos(b) - x[0] * math.sin(b)])
    return math.atan2(y[1], y[0]) + a, math.asin(max(-1.0, min(1.0, y[2])))


def test_rotated_fields(spark):
    rows = field(4, 12) + field(5, 7, None)
    df = spark.createDataFrame(rows, FIELD)
    a, b, c = 0.3, 2.2, -1.9
    g = rotations.rotate(df, a, b, c).cache()
    r = np.random.default_rng(6)
    at = list(zip(r.uniform(-3, 3, 25).tolist(), r.uniform(-1.5, 1.5, 25).tolist(), strict=True))
    pts = [(k, *np.degrees(p).tolist(), *np.degrees(turned(*p, a, b, c)).tolist()) for k, p in enumerate(at)]
    points = spark.createDataFrame(pts, "k int, lon double, lat double, lon2 double, lat2 double")
    for name in ("f", None):
        pick = F.col("field").eqNullSafe(F.lit(name))
        got = spectra.synthesise(spectra.synthesise(points, g.where(pick), 12), df.where(pick), 12, "lon2", "lat2", "want").collect()
        assert np.allclose([q["value"] for q in got], [q["want"] for q in got], atol=1e-9)
    back = {(q["field"], q["l"], q["m"]): (q["c"], q["s"]) for q in rotations.rotate(g, -c, -b, -a, buckets=2).collect()}
    assert len(back) == len(rows) and all(np.allclose(back[q[:3]], q[3:], atol=1e-10) for q in rows)
    d = rotations.wigner_d(150, 1.0)
    assert np.allclose(d @ d.T, np.eye(301), atol=1e-10)
    assert rotations.rotate(df.limit(0), a, b, c).count() == 0
    g.unpersist()


def test_series_have_closed_forms(spark):
    theta = [0.5, 3.0, 60.0, 120.0, 180.0]
    points = spark.createDataFrame([(t,) for t in theta] + [(None,), (0.0,)], "theta double")
    # 1 / sqrt(1 - 2 x t + x^2) = sum x^l P_l, and its derivative.
    x = 0.9
    a = spark.createDataFrame([(l, x**l) for l in range(400)], "l int, a double")
    for derivative in (False, True):
        got = [r["value"] for r in isotropic.evaluate(points, a, derivative=derivative).collect()]
        t = np.cos(np.radians(theta))
        root = 1 - 2 * x * t + x * x
        want = -np.sin(np.radians(theta)) * x * root**-1.5 if derivative else root**-0.5
        assert np.allclose(got[:5], want, rtol=1e-9, atol=1e-12) and got[5] is None and got[6] is not None
    # A constant spectrum and a spectrum 1 / l: nothing but their limits is left.
    n = 3
    const = spark.createDataFrame([(l, 2.0 + (0.5 / l if l else 0.0)) for l in range(n)], "l int, a double")
    for derivative in (False, True):
        got = [r["value"] for r in isotropic.evaluate(points, const, derivative=derivative, constant=2.0, inverse=0.5).collect()]
        one, two = isotropic.closed_sums(np.radians(theta), derivative)
        assert np.allclose(got[:5], 2 * one + 0.5 * two) and got[6] is None
    # Abel sums of the truncated series tend to the closed forms.
    r = 1 - 1e-3
    long = np.array([r**l for l in range(20_000)])
    inv = np.array([0.0] + [r**l / l for l in range(1, 20_000)])
    th = np.radians(np.array([20.0, 75.0, 140.0]))
    for derivative in (False, True):
        one, two = isotropic.closed_sums(th, derivative)
        assert np.allclose(isotropic.legendre_sum(th, long, derivative), one, rtol=2e-2, atol=1e-2) and np.allclose(isotropic.legendre_sum(th, inv, derivative), two, rtol=2e-2, atol=1e-2)
    disk = isotropic.disk_spectrum(spark, 30.0, 2000)
    got = [q["value"] for q in isotropic.evaluate(spark.createDataFrame([(10.0,), (50.0,)], "theta double"), disk).collect()]
    assert got == pytest.approx([1.0, 0.0], abs=5e-2)
    g = isotropic.green_spectra(spark.createDataFrame([(2, -1.0, 0.03, -0.3)], "n int, h double, l double, k double"), 6371e3, 6e24)
    assert g["geoid"].first()["a"] == pytest.approx(6371e3 / 6e24 * 0.7)
