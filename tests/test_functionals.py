"""Functionals there and back, and Gaussian weights against quadrature."""

import math

import numpy as np
import pytest

from keyfold.operators import functionals as K


def test_functionals_there_and_back(spark):
    love = spark.createDataFrame([(n, -0.3 - n, 0.02 * n + 0.1, -0.3 / (n + 1)) for n in range(5)], "n int, h double, l double, k double")
    rows = [(n, m, 1.0 + n, 2.0 * m, 0.1, 0.2) for n in range(5) for m in range(n + 1)]
    f = spark.createDataFrame(rows, "l int, m int, c double, s double, sc double, ss double")
    for kind in K.KINDS:
        back = K.scale(K.scale(f, kind, love), kind, love, inverse=True)
        got = {(r["l"], r["m"]): r for r in back.collect()}
        for n, m, c, s, sc, ss in rows:
            r = got[n, m]
            if kind == "gravity_anomaly" and n == 1:
                assert r["c"] is None
            else:
                assert np.allclose([r["c"], r["s"], r["sc"], r["ss"]], [c, s, sc, ss])
    assert K.scale(f, "geoid").where("l = 2").first()["c"] == 3 * K.RADIUS
    assert K.scale(f, "uplift").first()["c"] is None and K.scale(f.limit(0), "water", love).count() == 0
    with pytest.raises(ValueError):
        K.scale(f, "none")


def test_recursive_gauss_weights(spark):
    w = K.gauss_recursive(500e3, 60)
    x, q = np.polynomial.legendre.leggauss(400)
    bell = q * np.exp(-math.log(2) / (1 - math.cos(500e3 / K.RADIUS)) * (1 - x))
    want = [bell @ np.polynomial.legendre.Legendre.basis(n)(x) / bell.sum() for n in range(31)]
    assert w[0] == 1 and np.allclose(w[:31], want, atol=1e-6) and len(w) == 61
    far = K.gauss_recursive(2000e3, 60)
    stop = next(k for k, v in enumerate(far) if v < 1e-7)
    assert not any(far[stop + 1 :])
    f = spark.createDataFrame([(0, 0, 1.0, 0.0), (2, 1, 1.0, 2.0), (90, 3, 1.0, 1.0)], "l int, m int, c double, s double")
    assert [(r["c"], r["s"]) for r in K.smooth(f, w).orderBy("l").collect()] == [(1.0, 0.0), (w[2], 2 * w[2]), (0.0, 0.0)]
