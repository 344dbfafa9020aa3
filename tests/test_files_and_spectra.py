"""Readers and writers on small files, and spectra against closed forms."""

import math

import numpy as np
import pytest

from keyfold.operators import keyed, spectra
from keyfold.sources import files


def test_keyed_table(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"{'STAT' + str(k):24s} {k}.5 -1.0D+02\n" for k in range(3)) + "short\n")
    got = {(r["row_key"], r["col_no"]): r["value"] for r in files.keyed_table(spark, str(tmp_path / "t.txt")).collect()}
    assert got[("STAT2", 0)] == 2.5 and got[("STAT0", 1)] == -100.0 and len(got) == 6


def test_love_numbers_and_series(spark, tmp_path):
    (tmp_path / "a.love").write_text("# n h l k\n 0 -1.673 INF INF\n 1 -0.29 0.113 0. CE\n 1 -1.29 -0.887 -1. CM\n 1 -0.268 0.134 0.021 CF\n 2 -1.001 0.0295 -0.3075\n")
    got = {r["n"]: r for r in files.love_numbers(spark, str(tmp_path / "a.love"), "CM").collect()}
    assert got[0]["k"] is None and got[1]["k"] == -1.0 and got[2]["h"] == -1.001 and len(got) == 3
    moved = {r["n"]: r for r in spectra.degree_one_frame(files.love_numbers(spark, str(tmp_path / "a.love"), "CM"), "CE").collect()}
    assert moved[1]["h"] == pytest.approx(-0.29) and moved[1]["l"] == pytest.approx(0.113) and moved[2]["l"] == 0.0295
    (tmp_path / "c20.txt").write_text("2001.126 -1.369000e-11 5.04e-11\nnote\n2001.202 1.5e-11 3.8e-11\n")
    rows = files.number_columns(spark, str(tmp_path / "c20.txt"), ["year", "c20", "sigma"]).orderBy("year").collect()
    assert [r["c20"] for r in rows] == [-1.369e-11, 1.5e-11]


def test_tide_gauges(spark, tmp_path):
    (tmp_path / "ab1.met").write_text(f" {1999.0417:10.4f};{7001:6d};{2:2d};000\n {1999.125:10.4f};{-99999:6d};{0:2d};001\n")
    got = files.tide_monthly(spark, str(tmp_path / "ab1.met")).orderBy("time").collect()
    assert (got[0]["sid"], got[0]["mm"], got[0]["missing_days"], got[0]["flag"]) == ("ab1", 7001, 2, "000") and got[1]["mm"] is None
    (tmp_path / "ab1.rlr").write_text(f" 1999; {7001:5d};N;000\n")
    year = files.tide_yearly(spark, str(tmp_path / "ab1.rlr")).collect()
    assert (year[0]["time"], year[0]["mm"], year[0]["incomplete"]) == (1999.5, 7001, "N")
    line = f"{'ab1':5s}; {48.38:10.6f}; {-4.494:11.6f}; {'BREST':40s}; {'190':3s}; {'091':3s}; {'N':1s}; {1807.0417:9.4f}; {2010.9583:9.4f}\n"
    (tmp_path / "list.txt").write_text(line)
    cat = files.tide_catalogue(spark, str(tmp_path / "list.txt")).collect()
    assert cat[0].asDict() == {"sid": "ab1", "lat": 48.38, "lon": -4.494, "name": "BREST", "coast": "190", "station": "091", "flag": "N", "t0": 1807.0417, "tn": 2010.9583}


@pytest.mark.parametrize("layout", ["short", "linear"])
def test_coefficients_round_trip(spark, tmp_path, layout):
    rows = [(l, m, l + m / 10 + 1e-9, (l - m / 7) * (m > 0), 1e-12 * l, 2e-12 * m) for l in range(4) for m in range(l + 1)]
    sh = spark.createDataFrame(rows, "l int, m int, c double, s double, sigma_c double, sigma_s double")
    files.write_coefficients(sh, str(tmp_path / "out"), layout)
    back = {(r["l"], r["m"]): r for r in files.coefficients(spark, str(tmp_path / "out"), layout, lmax=2).collect()}
    assert len(back) == 6
    for l, m, c, s, ec, es in rows:
        if l <= 2:
            assert back[l, m]["c"] == pytest.approx(c, rel=1e-13) and back[l, m]["s"] == pytest.approx(s, rel=1e-13) and back[l, m]["sigma_c"] == pytest.approx(ec)


def test_icgem(spark, tmp_path):
    (tmp_path / "g.gfc").write_text("max_degree 2\nend_of_head\ngfc 0 0 1.0D+00 0.0D+00 0.0 0.0\ngfc    2    1 -2.5e-10 1.5e-09 1e-13 1e-13\n")
    got = {(r["l"], r["m"]): (r["c"], r["s"]) for r in files.coefficients(spark, str(tmp_path / "g.gfc"), "icgem").collect()}
    assert got == {(0, 0): (1.0, 0.0), (2, 1): (-2.5e-10, 1.5e-9)}


def test_legendre_is_normalised():
    x, w = np.polynomial.legendre.leggauss(80)
    for l, m, p in spectra.legendre(60, x):
        assert (w @ p**2) / (2 if m == 0 else 4) == pytest.approx(1.0, abs=1e-9)


def test_analysis_returns_what_was_synthesised(spark):
    rng = np.random.default_rng(4)
    rows = [(l, m, float(rng.normal()), float(rng.normal()) * (m > 0)) for l in range(5) for m in range(l + 1)]
    coeffs = spark.createDataFrame(rows, "l int, m int, c double, s double")
    step = 2.0
    grid = spark.range(180).selectExpr(f"(id + 0.5) * {step} AS lon").crossJoin(spark.range(90).selectExpr(f"-90 + (id + 0.5) * {step} AS lat"))
    got = {(r["l"], r["m"]): (r["c"], r["s"]) for r in spectra.analyse(spectra.synthesise(grid, coeffs, 4), 4, step).collect()}
    for l, m, c, s in rows:
        assert got[l, m] == pytest.approx((c, s), abs=5e-3)
    assert spectra.analyse(grid.limit(0).withColumn("value", grid["lon"]), 2, step).count() == 0


def test_strict_match_and_empty_selection(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(1, "p")], "k long, b string")
    with pytest.raises(ValueError):
        keyed.strict_match(a, b, "k")
    with pytest.raises(ValueError):
        keyed.not_empty(a.where("k > 5"))
    assert keyed.strict_match(b, a, "k", whole_right=False).count() == 1 and math.isclose(keyed.not_empty(a).count(), 2)
