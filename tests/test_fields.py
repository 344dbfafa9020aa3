"""Filters, grids and derivatives of fields against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.operators import filters, grids, spectra

LM = "field string, l int, m int, c double, s double, sc double, ss double"


def fields(spark, lmax, names, seed=0):
    r = np.random.default_rng(seed)
    rows = [(n, l, m, float(r.normal()), float(r.normal()) if m else 0.0, abs(float(r.normal())), abs(float(r.normal())) if m else 0.0) for n in names for l in range(lmax + 1) for m in range(l + 1)]
    return spark.createDataFrame(rows, LM), rows


def vectors(rows, names, kind):
    out = {}
    for n, l, m, c, s, sc, ss in rows:
        out[n, f"GCN {l:3d}{m:3d}"] = (c, sc)
        if m:
            out[n, f"GSN {l:3d}{m:3d}"] = (s, ss)
    return out


def test_block_filter_of_degree_sixty(spark):
    lmax, names = 60, ["a", "b", "c", None]
    df, rows = fields(spark, lmax, names)
    values = filters.to_values(df)
    x = vectors(rows, names, 0)
    r = np.random.default_rng(3)
    keys = sorted({k for _, k in x if int(k[4:7]) >= 2})
    groups = {}
    for k in keys:
        groups.setdefault((k[:3], k[7:10]), []).append(k)
    normals, want = [], {}
    for g in groups.values():
        a = r.normal(size=(len(g), len(g) + 3))
        n = a @ a.T
        normals += [(g[i], g[j], float(n[i, j])) for i in range(len(g)) for j in range(i, len(g))]
        reg = np.diag([0.3 * int(k[4:7]) ** 1.5 for k in g])
        want.update({(g[i], g[j]): v for (i, j), v in np.ndenumerate(np.linalg.solve(n + reg, n))})
    cells = spark.createDataFrame(normals, "row_key string, col_key string, value double")
    w = filters.power_law_weights(cells.withColumn("block", filters.order_block(F.col("row_key"))), 0.3, 1.5).cache()
    got = {(q["row_key"], q["col_key"]): q["value"] for q in w.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)
    ref = spark.createDataFrame([(k, 0.5) for k in keys[:40]], "key string, value double")
    refs = dict.fromkeys(keys[:40], 0.5)
    for transpose, complement, reference in ((False, False, None), (True, True, None), (False, False, ref)):
        back = {(q["field"], q["key"]): (q["value"], q["sigma"]) for q in filters.apply(values, w, transpose=transpose, complement=complement, reference=reference, buckets=3).collect()}
        assert back.keys() == x.keys()
        for n in names:
            for g in groups.values():
                m = np.array([[want[i, j] for j in g] for i in g])
                m = m.T if transpose else m
                m = np.eye(len(g)) - m if complement else m
                off = np.array([refs.get(k, 0.0) if reference is not None else 0.0 for k in g])
                v = m @ (np.array([x[n, k][0] for k in g]) - off) + off
                e = np.sqrt(m**2 @ np.array([x[n, k][1] for k in g]) ** 2)
                assert np.allclose([back[n, k][0] for k in g], v, atol=1e-8) and np.allclose([back[n, k][1] for k in g], e, atol=1e-8)
        assert back["a", "GCN   1  0"] == pytest.approx(x["a", "GCN   1  0"])  # no block knows it
    dropped = filters.apply(values.drop("sigma"), w, drop=True)
    assert dropped.columns == ["field", "key", "value"] and dropped.count() == len(names) * len(keys)
    w.unpersist()


def test_storage_forms_agree(spark):
    """One symmetric matrix as triangle or full, in one block or two."""
    a = np.array([[2.0, 0.5, 0, 0], [0.5, 1, 0, 0], [0, 0, 3, -1], [0, 0, -1, 4]])
    keys = ["GCN   2  0", "GCN   3  0", "GCN   4  1", "GCN   5  1"]
    values = spark.createDataFrame([("f", k, float(i + 1), 0.1) for i, k in enumerate(keys)] + [("f", keys[0], 1.0, 0.0), ("f", "GCN   9  9", 5.0, 1.0)], "field string, key string, value double, sigma double")
    outs = []
    for blocks in ([0, 0, 0, 0], [0, 0, 1, 1]):
        for sym in (True, False):
            cells = [(str(blocks[i]), keys[i], keys[j], float(a[i, j])) for i in range(4) for j in range(4) if blocks[i] == blocks[j] and (not sym or i <= j)]
            df = spark.createDataFrame(cells, "block string, row_key string, col_key string, value double")
            outs.append(sorted((r["key"], round(r["value"], 9), round(r["sigma"], 9)) for r in filters.apply(values, df, symmetric=sym).collect()))
    assert outs[0] == outs[1] == outs[2] == outs[3]
    assert [v for _, v, _ in outs[0]][:4] == pytest.approx(a @ [2, 2, 3, 4])
    bad = filters.power_law_weights(spark.createDataFrame([("b", keys[0], keys[0], -5.0)], "block string, row_key string, col_key string, value double"), 0.0, 1.0)
    assert [r["value"] for r in bad.collect()] == [None]
    assert filters.apply(values.limit(0), bad).count() == 0


def test_coefficients_there_and_back(spark):
    df, rows = fields(spark, 5, ["x"])
    back = {(r["l"], r["m"]): (r["c"], r["s"], r["sc"], r["ss"]) for r in filters.to_coefficients(filters.to_values(df)).collect()}
    assert back == {(r[1], r[2]): r[3:] for r in rows}


def test_decorrelation_takes_polynomials_away(spark):
    w = filters.window_decorrelation(list(range(4, 30, 2)), 7, 2)
    x = np.array([3 - 2 * l + 0.25 * l * l for l in range(4, 30, 2)])
    assert np.allclose(w @ x, 0, atol=1e-9)
    rough = np.tile([1.0, -1.0], 7)[:13]
    assert np.abs(w @ rough).min() > 0.3
    cells = filters.decorrelation(12, 4, 5, 1, spark)
    one = {(r["row_key"], r["col_key"]): r["value"] for r in cells.where("block = 'GSN0050'").collect()}
    m = filters.window_decorrelation([6, 8, 10, 12], 5, 1)
    assert np.allclose([one[f"GSN {6 + 2 * i:3d}  5", f"GSN {6 + 2 * j:3d}  5"] for i in range(4) for j in range(4)], m.ravel())
    assert cells.select("block").distinct().count() == 2 * sum(1 for k in range(4, 13) for p in (0, 1) if any(l % 2 == p for l in range(k, 13)))


def grid(spark, n, shift):
    step = 180 / n
    lat = [90 - (i + shift) * step for i in range(n + (shift == 0))]
    lon = [(j + shift) * step for j in range(2 * n)]
    return spark.createDataFrame([(x, y) for y in lat for x in lon], "lon double, lat double"), step


@pytest.mark.parametrize("shift", [0.5, 0.0])
def test_rings_give_the_field_back(spark, shift):
    df, rows = fields(spark, 20, ["x"], 5)
    points, step = grid(spark, 44, shift)
    g = spectra.synthesise(points, df, 20).repartition(7)
    got = {(r["l"], r["m"]): (r["c"], r["s"]) for r in grids.analyse_rings(g, 20, step).collect()}
    assert all(np.allclose(got[r[1], r[2]], r[3:5], atol=1e-10) for r in rows)
    if shift:
        area = {(r["l"], r["m"]): (r["c"], r["s"]) for r in grids.analyse_rings(g, 6, step, weights="area").collect()}
        plain = {(r["l"], r["m"]): (r["c"], r["s"]) for r in spectra.analyse(g, 6, step).collect()}
        assert all(np.allclose(area[k], plain[k], atol=1e-10) for k in plain)
        with pytest.raises(ValueError):
            grids.analyse_rings(g, 40, step)


def test_round_trip_at_degree_120(spark):
    rows = [(l, m, 1.0 / (1 + l + m), 0.5 / (1 + l) if m else 0.0) for l in (0, 1, 60, 119, 120) for m in range(0, l + 1, 7)]
    df = spark.createDataFrame(rows, "l int, m int, c double, s double")
    points, step = grid(spark, 242, 0.5)
    by = spectra.synthesise(points, df, 120).select(F.lit("k").alias("name"), "lon", "lat", "value")
    got = {(r["l"], r["m"]): (r["c"], r["s"]) for r in grids.analyse_rings(by, 120, step, ["name"]).collect()}
    want = {(l, m): (c, s) for l, m, c, s in rows}
    assert len(got) == 121 * 122 // 2 and max(abs(got[k][i] - want.get(k, (0, 0))[i]) for k in got for i in (0, 1)) < 1e-9


def test_what_a_grid_is(spark):
    for shift, kind in ((0.5, "pixel"), (0.0, "gridline")):
        g, step = grid(spark, 12, shift)
        r = grids.inspect(g).first()
        assert r["registration"] == kind and r["equidistant"] and r["global_lon"] and r["global_lat"] and r["complete"] and abs(r["step"] - step) < 1e-12 and not r["greenwich"]
    west = g.withColumn("lon", F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")))
    r = grids.inspect(west).first()
    assert r["greenwich"] and r["registration"] == "gridline" and r["global_lon"]
    r = grids.inspect(g.where("lon < 90 and lat > 0 and not (lon = 15 and lat = 45)")).first()
    assert not r["global_lon"] and not r["global_lat"] and not r["complete"] and r["equidistant"]
    assert not grids.inspect(g.withColumn("lon", F.when(F.col("lon") == 15, 16.0).otherwise(F.col("lon")))).first()["equidistant"]
    with pytest.raises(Exception, match="lattice"):
        grids.analyse_rings(g.withColumn("value", F.lit(1.0)).withColumn("lon", F.col("lon") + F.when(F.col("lat") == 0, F.col("lon") / 7).otherwise(0.0)), 3, step).collect()


def test_derivatives_and_errors(spark):
    df, rows = fields(spark, 9, ["x"], 7)
    r = np.random.default_rng(1)
    at = [(float(a), float(b)) for a, b in zip(r.uniform(0, 360, 20), r.uniform(-85, 85, 20), strict=True)]
    h = 1e-4
    moved = [(k, a + da, b + db) for k, (a, b) in enumerate(at) for da, db in ((0, 0), (h, 0), (-h, 0), (0, h), (0, -h))]
    got = spectra.synthesise(spark.createDataFrame(moved, "k int, lon double, lat double"), df, 9)
    for what in ("east", "north", "error", "east_error", "north_error"):
        got = spectra.synthesise(got, df if "error" not in what else df.select("l", "m", F.col("sc").alias("c"), F.col("ss").alias("s")), 9, value=what, what=what)
    rows_ = got.collect()
    for k, (_, b) in enumerate(at):
        five = rows_[5 * k : 5 * k + 5]
        v, rad = [x["value"] for x in five], math.radians(h)
        assert five[0]["east"] == pytest.approx((v[1] - v[2]) / (2 * rad) / math.cos(math.radians(b)), rel=1e-5, abs=1e-4)
        assert five[0]["north"] == pytest.approx((v[3] - v[4]) / (2 * rad), rel=1e-5, abs=1e-4)
    # Errors: the root of the squares of single coefficients' results.
    some = [x for x in rows if x[1] <= 2]
    pts = spark.createDataFrame(moved[:5], "k int, lon double, lat double")
    errs = spark.createDataFrame([(l, m, sc, ss) for _, l, m, _, _, sc, ss in some], "l int, m int, c double, s double")
    for what, plain in (("error", "value"), ("east_error", "east"), ("north_error", "north")):
        total = np.zeros(5)
        for _, l, m, _, _, sc, ss in some:
            for c, s in ((sc, 0.0), (0.0, ss)):
                if c or s:
                    one = spark.createDataFrame([(l, m, c, s)], "l int, m int, c double, s double")
                    total += np.array([x["v"] for x in spectra.synthesise(pts, one, 2, value="v", what=plain).collect()]) ** 2
        assert np.allclose([x["v"] for x in spectra.synthesise(pts, errs, 2, value="v", what=what).collect()], np.sqrt(total))
    pole = spark.createDataFrame([(0.0, 90.0), (None, 3.0)], "lon double, lat double")
    assert [x["v"] for x in spectra.synthesise(pole, df, 4, value="v", what="east").collect()] == [None, None]
