"""Combination, autoregression, intervals, time terms and tiles against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.operators import autoregression, intervals, systems, tiles, time_terms

CELL = "sys string, row_key string, col_key string, value double"
RHS = "sys string, row_key string, value double, x0 double"


def system(spark, parts):
    """Systems of {name: (N, d, x0, ltpl, nobs, stime, etime)}."""
    cells, rhs, stats = [], [], []
    for name, (n, d, x0, ltpl, nobs, t0, t1) in parts.items():
        k = [f"p{i}" for i in range(len(d))]
        cells += [(name, k[i], k[j], float(n[i, j])) for i in range(len(d)) for j in range(i, len(d))]
        rhs += [(name, k[i], float(d[i]), None if x0 is None else float(x0[i])) for i in range(len(d))]
        stats.append((name, nobs, float(ltpl), 0, 0, t0, t1, None if t0 is None else (t0 + t1) / 2))
    return systems.Systems(spark.createDataFrame(cells, CELL), spark.createDataFrame(rhs, RHS), spark.createDataFrame(stats, systems.STATS))


def about(a, y, x0):
    r = y - a @ x0
    return a.T @ a, a.T @ r, x0, r @ r, len(y)


def test_combination_of_different_apriori(spark):
    r = np.random.default_rng(0)
    a, b, truth = r.normal(size=(30, 2)), r.normal(size=(40, 2)), np.array([3.0, 5.0])
    parts = {"a": (*about(a, a @ truth, np.zeros(2)), 0.0, 1.0), "b": (*about(b, b @ truth, np.array([10.0, -10.0])), 1.0, 4.0)}
    s = system(spark, parts)
    groups = s.stats.selectExpr("sys", "'g' grp")
    for how, mean in (("mean", [5.0, -5.0]), ("span", [7.5, -7.5])):
        both = systems.combine(s, groups, how)
        x0 = {q["row_key"]: q["x0"] for q in both.rhs.collect()}
        assert np.allclose([x0["p0"], x0["p1"]], mean)
        sol = systems.solve(both)
        assert np.allclose([x0[q["row_key"]] + q["x"] for q in sol.x.orderBy("row_key").collect()], truth)
        assert abs(sol.stats.first()["ltpl"]) < 1e-6 and both.stats.first()["etime"] == 4.0
    got = systems.variance_components(s, groups, s.stats.selectExpr("sys", "1.0D cv")).collect()
    assert len(got) == 2 and all(abs(q["vce"]) < 1e-8 for q in got) and abs(sum(q["contribution"] for q in got) - 2) < 1e-8
    with pytest.raises(ValueError):
        systems.combine(s, groups, "agree")
    with pytest.raises(ValueError):
        systems.combine(s, groups, "other")
    still = s._replace(stats=s.stats.withColumn("etime", F.col("stime")))
    with pytest.raises(Exception, match="time span"):
        systems.combine(still, groups, "span").rhs.collect()
    same = system(spark, {"a": parts["a"], "b": (*about(b, b @ truth, np.zeros(2)), None, None)})
    agreed = systems.combine(same, groups, "agree")
    assert np.allclose([q["x"] for q in systems.solve(agreed).x.orderBy("row_key").collect()], truth)


def test_components_with_different_apriori(spark):
    """The components are those of the same systems about one a-priori."""
    r = np.random.default_rng(1)
    a, b = r.normal(size=(200, 2)), r.normal(size=(300, 2))
    ya, yb = a @ [1, 2] + r.normal(size=200), b @ [1, 2] + 3 * r.normal(size=300)
    out = []
    for xa, xb in ((np.zeros(2), np.zeros(2)), (np.array([4.0, -1.0]), np.array([-2.0, 7.0]))):
        s = system(spark, {"a": (*about(a, ya, xa), 0.0, 1.0), "b": (*about(b, yb, xb), 0.0, 1.0)})
        got = systems.variance_components(s, s.stats.selectExpr("sys", "'g' grp"), s.stats.selectExpr("sys", "1.0D cv")).orderBy("sys").collect()
        out.append([q["vce"] for q in got])
    assert np.allclose(*out) and abs(out[0][1] / 9 - 1) < 0.3


def test_too_large_systems_are_refused(spark, monkeypatch):
    monkeypatch.setattr(systems, "MAX_UNKNOWNS", 3)
    s = system(spark, {"a": (np.eye(4), np.ones(4), np.zeros(4), 9.0, 9, 0.0, 1.0)})
    with pytest.raises(Exception, match="unknowns"):
        systems.solve(s).x.collect()


def ar_series(n, phi, seed):
    r, x = np.random.default_rng(seed), np.zeros(n + 200)
    for t in range(len(phi), len(x)):
        x[t] = sum(p * x[t - k - 1] for k, p in enumerate(phi)) + r.normal()
    return x[200:]


def yule_walker(x, p):
    d = x - x.mean()
    g = np.array([d[k:] @ d[: len(d) - k] for k in range(p + 1)]) / (len(x) - 1)
    m = g[np.abs(np.subtract.outer(range(p), range(p)))]
    phi = np.linalg.solve(m, g[1:])
    return g, phi, g[0] - phi @ g[1:]


def test_models_of_order_three(spark):
    series = {"a": ar_series(900, [0.5, -0.3, 0.1], 1), "b": ar_series(700, [0.9], 2), None: ar_series(300, [0.2, 0.2], 3)}
    rows = [(k, float(t), float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("c", 0.0, 1.0), ("c", 1.0, 1.0), ("a", None, 9.0), ("a", 5.5, None)]
    df = spark.createDataFrame(rows, "k string, t double, y double").repartition(5)
    got = {q["k"]: q for q in autoregression.model(autoregression.autocovariances(df, "k", "t", "y", 3), "k").collect()}
    for k, x in series.items():
        if k is None:
            continue
        g, phi, sig2 = yule_walker(x, 3)
        assert np.allclose(got[k]["parameters"], phi) and got[k]["sig2"] == pytest.approx(sig2) and got[k]["n"] == len(x)
        rho = autoregression.correlation(phi)
        band = sig2 / (1 - phi @ rho[1:]) * rho
        if abs(band[0]) <= 2.1 * abs(band[1]):
            band[0] = 2.1 * abs(band[1])
        assert np.allclose(got[k]["band"], band)
    assert got["c"]["band"] is None and got["c"]["parameters"] is None


@pytest.mark.parametrize("order", [1, 3])
def test_weighted_fit_equals_dense(spark, order):
    n = 400
    t = np.arange(n) / 10.0
    y = 4 + 0.3 * (t - 15) + ar_series(n, [0.3, 0.1, 0.05], 5)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)] + [("few", 1.0, 2.0)], "k string, t double, y double").repartition(3)
    terms = {"p0": F.lit(1.0), "p1": F.col("t") - 15}
    fit, models = autoregression.two_pass_fit(df, "k", "t", "y", terms, order)
    band = {q["k"]: q["band"] for q in models.collect()}["a"]
    c = np.zeros((n, n))
    for k, v in enumerate(band):
        c += np.diag([v] * (n - k), k) + (np.diag([v] * (n - k), -k) if k else 0)
    a = np.column_stack([np.ones(n), t - 15])
    w = np.linalg.inv(c)
    nn = a.T @ w @ a
    x = np.linalg.solve(nn, a.T @ w @ y)
    got = {(q["sys"], q["name"]): q for q in fit.collect()}
    assert {k for k, _ in got} == {"a"}
    s0 = math.sqrt((y @ w @ y - x @ nn @ x) / (n - 2))
    for i, name in enumerate(("p0", "p1")):
        assert got["a", name]["x"] == pytest.approx(x[i], rel=1e-9) and got["a", name]["sigma"] == pytest.approx(s0 * math.sqrt(np.linalg.inv(nn)[i, i]), rel=1e-6)


def test_intervals_and_their_order(spark):
    iv = [("a", "1", None, 10.0, "P", 1), ("a", "2", 10.0, 20.0, "P", 2), ("a", "3", 12.0, None, "P", 3), ("a", "v", 0.0, 99.0, "V", 0), ("a", "short", 14.0, 14.5, "P", 0), (None, "n", 0.0, 9.0, "P", 1)]
    table = spark.createDataFrame(iv, "k string, solution string, start double, end double, kind string, rank int")
    pts = [("a", -50.0), ("a", 10.0), ("a", 11.0), ("a", 14.2), ("a", 20.0), ("a", 25.0), ("a", 40.0), ("b", 3.0), (None, 3.0), ("a", None), ("a", 11.0)]
    points = spark.createDataFrame(pts, "k string, t double")
    for width in (0.5, 7.0, 1000.0):
        got = intervals.solution_at(points, table, "k", "t", 30.0, 1.0, width)
        want = [("a", -50.0, "1"), ("a", 10.0, None), ("a", 11.0, "2"), ("a", 14.2, "2"), ("a", 20.0, "3"), ("a", 25.0, "3"), ("a", 40.0, None), ("b", 3.0, None), (None, 3.0, None), ("a", None, None), ("a", 11.0, "2")]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = intervals.solution_at(points, table, "k", "t", 30.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert intervals.solution_at(points.limit(0), table, "k", "t", 30.0).count() == 0


def test_reference_positions_fall_back(spark):
    cum = [(s, so, k, c, float(i + 10 * (k == "STA")), 2000.0) for s, so in (("a", "1"), ("a", "----"), ("b", "1")) for i, (k, c) in enumerate((k, c) for k in ("STA", "VEL") for c in "XYZ")][:-1]
    cumulative = spark.createDataFrame(cum, "s string, solution string, kind string, component string, value double, epoch double")
    points = spark.createDataFrame([("a", "X", "1", 2003.0), ("a", "X", "9", 2003.0), ("b", "X", "1", 2003.0)], "s string, component string, solution string, t double")
    got = [tuple(q) for q in intervals.reference_positions(points, cumulative, "s", "t").orderBy("s", "solution").collect()]
    assert got == [("a", "X", "1", 2003.0, 10 + 3 * 3.0, "1"), ("a", "X", "9", 2003.0, 10 + 3 * 3.0, "----"), ("b", "X", "1", 2003.0, None, None)]


def test_time_terms_equal_the_stacked_fit(spark):
    """Epochs of two parameters, expanded and combined, solve as one adjustment."""
    r = np.random.default_rng(4)
    parts, rows, obs = {}, [], []
    for e in range(12):
        t = 2000 + e / 5
        a = r.normal(size=(6, 3))
        y = r.normal(size=6)
        parts[f"e{e}"] = (*about(a, y, np.zeros(3)), t, t)
        dt = t - 2001
        f = [1, dt, math.cos(2 * math.pi * dt), math.sin(2 * math.pi * dt)]
        rows.append(np.column_stack([a[:, [0]] * f, a[:, [1]], a[:, [2]]]))
        obs.append(y)
    s = system(spark, parts)
    times = s.stats.select("sys", F.col("stime").alias("t"))
    got = time_terms.expand(s, times, 2001.0, mean="^p[01]$", trend="^p0$", annual="^p0$", squeeze=True)
    both = systems.combine(got, s.stats.selectExpr("sys", "'g' grp"))
    x = {q["row_key"]: q["x"] for q in systems.solve(both).x.collect()}
    want = np.linalg.lstsq(np.vstack(rows), np.concatenate(obs), rcond=None)[0]
    assert np.allclose([x[k] for k in ("p0", "TR_p0", "AC_p0", "AS_p0", "p1", "p2")], want)
    loose = time_terms.expand(s, times, 2001.0, polynomial="^p0$", degree=2, semiannual="^p1$")
    assert {q["row_key"] for q in loose.rhs.select("row_key").distinct().collect()} == {"P0_p0", "P1_p0", "P2_p0", "SC_p1", "SS_p1"}
    long = systems.Systems(s.cells.limit(0), s.rhs.limit(1).withColumn("row_key", F.lit("k" * 24)), s.stats)
    assert time_terms.expand(long, times, 0.0, trend="").rhs.first()["row_key"] == "TR_" + "k" * 21


def upper(spark, m, keys):
    return spark.createDataFrame([(keys[i], keys[j], float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))], "row_key string, col_key string, value double")


def test_tiles_equal_numpy(spark):
    r = np.random.default_rng(6)
    n = 50
    a = r.normal(size=(n, n + 5))
    m, keys = a @ a.T, [f"k{i:03d}" for i in range(n)]
    cells = upper(spark, m, keys)
    b = r.normal(size=(n, 2))
    rhs = spark.createDataFrame([(keys[i], c + 1, float(b[i, c])) for i in range(n) for c in range(2)], "row_key string, rhs_no int, value double")
    f = tiles.factor(cells, rhs, tile=20)
    low = np.zeros((n, n))
    for q in tiles.factor_cells(f).collect():
        low[int(q["row_key"][1:]), int(q["col_key"][1:])] = q["value"]
    assert np.allclose(low, np.linalg.cholesky(m))
    for got in (tiles.solve(f), tiles.solve(f, rhs)):
        x = np.zeros((n, 2))
        for q in got.collect():
            x[int(q["row_key"][1:]), q["rhs_no"] - 1] = q["value"]
        assert np.allclose(x, np.linalg.solve(m, b))
    assert tiles.condition(cells, tile=25, rounds=3) == pytest.approx(np.linalg.cond(m, 1), rel=1e-6)
    bad = upper(spark, np.diag([1.0, -1.0, 2.0]), ["a", "b", "c"])
    one = spark.createDataFrame([("a", 1, 1.0)], "row_key string, rhs_no int, value double")
    assert {q["value"] for q in tiles.solve(tiles.factor(bad, one, tile=2)).collect()} == {None}
    assert tiles.solve(tiles.factor(bad.limit(0), one.limit(0))).count() == 0


def test_two_thousand_unknowns(spark):
    """No task sees more than a row of tiles and the pivot's row."""
    r = np.random.default_rng(7)
    n = 2000
    d = r.uniform(1, 2, n)
    u = r.normal(size=n) / 40
    m = np.diag(d) + np.outer(u, u)  # its inverse is known in closed form
    table = spark.createDataFrame([(k, float(u[k]), float(d[k])) for k in range(n)], "i long, u double, d double")
    left, right = table, table.select(F.col("i").alias("j"), F.col("u").alias("v"))
    cells = left.crossJoin(right).where("i <= j").select(F.format_string("k%04d", "i").alias("row_key"), F.format_string("k%04d", "j").alias("col_key"), (F.col("u") * F.col("v") + F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0)).alias("value"))
    b = r.normal(size=n)
    rhs = spark.createDataFrame([(f"k{k:04d}", 1, float(b[k])) for k in range(n)], "row_key string, rhs_no int, value double")
    got = {q["row_key"]: q["value"] for q in tiles.solve(tiles.factor(cells, rhs, tile=512)).collect()}
    assert np.allclose([got[f"k{k:04d}"] for k in range(n)], np.linalg.solve(m, b))
