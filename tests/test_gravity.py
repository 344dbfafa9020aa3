"""Coefficient files in all layouts, their headers and epochs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.sources import files, gravity

ROWS = [(l, m, 1.5e-6 * (l + 1) + m, -2.5e-7 * m, 1e-9 * (l + 1), 2e-9 * (m + 1)) for l in range(4) for m in range(l + 1)]


def frame(spark):
    return spark.createDataFrame(ROWS, "l int, m int, c double, s double, sigma_c double, sigma_s double")


@pytest.mark.parametrize("layout", ["icgem", "grace", "generic", "short", "linear"])
def test_round_trip(spark, tmp_path, layout):
    path = str(tmp_path / layout)
    (files.write_coefficients if layout in ("short", "linear") else gravity.write)(frame(spark), path, layout)
    got = {(r["l"], r["m"]): (r["term"], r["c"], r["s"], r["sigma_c"]) for r in gravity.read(spark, path, layout).collect()}
    assert len(got) == len(ROWS)
    for l, m, c, s, e, _ in ROWS:
        t, *v = got[l, m]
        assert t == "static" and np.allclose(v, [c, s, e], rtol=1e-13)
    assert gravity.read(spark, path, layout, 1).count() == 3
    with pytest.raises(ValueError):
        gravity.read(spark, path, "other")


def test_terms_and_headers(spark, tmp_path):
    (tmp_path / "a.gfc").write_text("product_type gravity_field\nmodelname X\nearth_gravity_constant 0.3986004415E+15\nradius 6378136.3\nmax_degree 3\nend_of_head\ngfct 2 0 1.0 0.0 0.1 0.0\ntrnd 2 0 0.5 0.0 0.0 0.0\nasin 2 0 2.0 0.0 0.0 0.0 1.0\nacos 2 0 4.0 0.0 0.0 0.0 0.5\ngfc 3 1 1.0D-01 2.0 0.1 0.2\nnote 9 9 9\n")
    (tmp_path / "b.grace").write_text("FIRST GSM-2_2005032-2005059_0027_EIGEN_G---_0004\nCMMNT GRCOF2 text\nEARTH 0.39860044150E+15 0.63781364600E+07\nSHM 120 120 1.00 fully normalized\nGRCOF2 2 1 -1.5E-10 2.5E-09 1E-13 2E-13 20050201.0\nGRDOTA 2 1 1.0E-12 -1.0E-12 0 0 20050201.0\n")
    (tmp_path / "c.gins").write_text("FIELD 20454_20463\n\n" + f"{2:3d}{1:3d}   {-1.5e-10:21.14E}{2.5e-9:21.14E} {1e-13:13.6E}{2e-13:13.6E}\n" + f"{2:3d}{1:3d}DOT{9.0:21.14E}{9.0:21.14E}\n")
    (tmp_path / "d.err").write_text("CALSDV   2 1 1.0E-12 2.0E-12 0.0 0.0\n")
    (tmp_path / "e.lin").write_text("GCN   2  1              1.0 0.1\nGSN   2  1              2.0 0.2\n")
    (tmp_path / "f.short").write_text("META    2 2005.0 2005.5 2006.0\n    2    1 1.0 2.0\n")
    (tmp_path / "g.txt").write_text("2 1 1.0 2.0\n3 0 5.0\n")
    said = {r["path"].rpartition("/")[2]: r for r in gravity.describe(spark, str(tmp_path)).collect()}
    assert {k: v["layout"] for k, v in said.items()} == {"a.gfc": "icgem", "b.grace": "grace", "c.gins": "gins", "d.err": "calsdv", "e.lin": "linear", "f.short": "short", "g.txt": "generic"}
    assert (said["a.gfc"]["lmax"], said["a.gfc"]["gm"], said["a.gfc"]["radius"]) == (3, 0.3986004415e15, 6378136.3)
    assert (said["b.grace"]["lmax"], said["b.grace"]["radius"]) == (120, 6378136.46) and said["b.grace"]["start"] == pytest.approx(2005 + 32 / 365)
    assert (said["f.short"]["lmax"], said["f.short"]["centre"]) == (2, 2005.5) and said["d.err"]["lmax"] == 2
    a = gravity.read(spark, str(tmp_path / "a.gfc"), "icgem")
    assert {r["term"] for r in a.collect()} == {"static", "trend", "annual_sin", "semiannual_cos"}
    w = 2 * math.pi * 0.1
    now = {(r["l"], r["m"]): r["c"] for r in gravity.at_time(a, 2005.1, 2005.0).collect()}
    assert now[2, 0] == pytest.approx(1 + 0.05 + 2 * math.sin(w) + 4 * math.cos(2 * w)) and now[3, 1] == pytest.approx(0.1)
    b = {r["term"]: r for r in gravity.read(spark, str(tmp_path / "b.grace"), "grace").collect()}
    assert b["static"]["s"] == 2.5e-9 and b["trend"]["c"] == 1e-12
    c = gravity.read(spark, str(tmp_path / "c.gins"), "gins").collect()
    assert len(c) == 1 and c[0]["c"] == -1.5e-10 and c[0]["sigma_s"] == 2e-13
    d = gravity.read(spark, str(tmp_path / "d.err"), "calsdv").first()
    assert (d["c"], d["sigma_c"], d["sigma_s"]) == (None, 1e-12, 2e-12)
    g = {(r["l"], r["m"]): (r["c"], r["s"], r["sigma_c"]) for r in gravity.read(spark, str(tmp_path / "g.txt"), "generic").collect()}
    assert g == {(2, 1): (1.0, 2.0, None), (3, 0): (5.0, 0.0, None)}


def test_epochs_of_names(spark):
    one = lambda name, kind: spark.range(1).select(gravity.epoch(F.lit(name), kind).alias("e")).first()["e"]
    e = one("GSM-2_2004001-2004366_x", "grace")
    assert (e["start"], e["end"]) == (pytest.approx(2004 + 1 / 366), pytest.approx(2005.0))
    e = one("a_b_20089_20454", "gins")  # 2005-01-01 and 2006-01-01
    assert (e["start"], e["end"]) == (pytest.approx(2005.0), pytest.approx(2006.0))
    e = one("model 20050101 - 20060702 x", "icgem")
    assert e["start"] == pytest.approx(2005.0) and e["end"] == pytest.approx(2006 + 182 / 365)
    assert one("nothing", "icgem")["centre"] is None
    with pytest.raises(ValueError):
        gravity.epoch(F.lit("x"), "other")


def test_pole_between_days(spark, tmp_path):
    from keyfold.operators import series

    rows = [(51544 + k, 0.01 * k, -0.02 * k, 0.1, 0.001 * k) for k in range(5) if k != 3]
    path = str(tmp_path / "pole")
    files.write_earth_orientation(spark.createDataFrame(rows, "mjd int, x double, y double, ut1 double, lod double"), path)
    assert open(next((tmp_path / "pole").glob("part-*"))).readline().startswith("2000   1   1  51544")
    known = files.earth_orientation(spark, path)
    assert sorted(r["mjd"] for r in known.collect()) == [51544.0, 51545.0, 51546.0, 51548.0]
    ask = spark.createDataFrame([(t,) for t in (51543.5, 51544.0, 51544.25, 51546.0, 51546.5, 51548.0, 51548.5)] + [(None,)], "mjd double")
    got = {r["mjd"]: r["x"] for r in series.interpolate_steps(ask, known, "mjd", ["x"], 1.0).collect()}
    assert got[51544.25] == pytest.approx(0.0025) and got[51544.0] == 0.0 and got[51546.0] == pytest.approx(0.02) and got[51548.0] == pytest.approx(0.04)
    assert got[51543.5] is None and got[51546.5] is None and got[51548.5] is None and got[None] is None
