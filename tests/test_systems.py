"""Whole normal-equation systems against numpy."""

import numpy as np
import pytest

from keyfold.operators import systems

KEYS = ["a1", "a2", "b1", "c1", "c2"]


def make(spark, seeds, keys=KEYS, nobs=40):
    """Systems of random designs, and their arrays by name."""
    cells, rhs, stats, raw = [], [], [], {}
    for k in seeds:
        r = np.random.default_rng(k)
        a = r.normal(size=(nobs, len(keys)))
        y = a @ np.arange(1.0, len(keys) + 1) + r.normal(size=nobs) * (1 + k)
        n, d = a.T @ a, a.T @ y
        name = f"s{k}"
        raw[name] = (n, d, float(y @ y), nobs)
        cells += [(name, keys[i], keys[j], float(n[i, j])) for i in range(len(keys)) for j in range(i, len(keys))]
        rhs += [(name, key, float(v), 0.0) for key, v in zip(keys, d, strict=True)]
        stats.append((name, nobs, float(y @ y), 0, 0, float(k), float(k + 2), float(k + 1)))
    s = systems.Systems(
        spark.createDataFrame(cells, "sys string, row_key string, col_key string, value double"),
        spark.createDataFrame(rhs, "sys string, row_key string, value double, x0 double"),
        spark.createDataFrame(stats, systems.STATS),
    )
    return s, raw


def as_arrays(s, name, keys):
    n, place = np.zeros((len(keys), len(keys))), {k: i for i, k in enumerate(keys)}
    for r in s.cells.where(f"sys = '{name}'").collect():
        n[place[r["row_key"]], place[r["col_key"]]] = n[place[r["col_key"]], place[r["row_key"]]] = r["value"]
    d = {r["row_key"]: r["value"] for r in s.rhs.where(f"sys = '{name}'").collect()}
    return n, np.array([d[k] for k in keys]), s.stats.where(f"sys = '{name}'").first()


def test_reduce_a_block(spark):
    s, raw = make(spark, [0, 1])
    got = systems.reduce(s, "^[ac]1$")
    gone, kept = [0, 3], [1, 2, 4]
    for name, (n, d, ltpl, _) in raw.items():
        part = np.linalg.inv(n[np.ix_(gone, gone)])
        m, v, st = as_arrays(got, name, [KEYS[i] for i in kept])
        assert np.allclose(m, n[np.ix_(kept, kept)] - n[np.ix_(kept, gone)] @ part @ n[np.ix_(gone, kept)])
        assert np.allclose(v, d[kept] - n[np.ix_(kept, gone)] @ part @ d[gone])
        assert np.isclose(st["ltpl"], ltpl - d[gone] @ part @ d[gone]) and st["nred"] == 2
    # The kept parameters have the same solution, sigma and residuals as in the whole system.
    x, y = ({(r["sys"], r["row_key"]): (r["x"], r["sigma"]) for r in systems.solve(t).x.collect()} for t in (s, got))
    assert all(np.allclose(x[k], v) for k, v in y.items()) and len(y) == 6


def test_solve_and_truncate(spark):
    s, raw = make(spark, [2])
    n, d, ltpl, nobs = raw["s2"]
    full, cut = systems.solve(s), systems.solve(s, keep=3)
    assert np.allclose([r["x"] for r in full.x.orderBy("row_key").collect()], np.linalg.solve(n, d))
    inv = np.linalg.inv(n)
    assert np.allclose([r["value"] for r in full.covariance.orderBy("row_key", "col_key").collect()], inv[np.triu_indices(5)])
    st = full.stats.first()
    assert np.isclose(st["ltpl"], ltpl - d @ inv @ d) and np.isclose(st["sigma0"], np.sqrt((ltpl - d @ inv @ d) / (nobs - 5)))
    e, v = np.linalg.eigh(n)
    pseudo = v[:, 2:] @ np.diag(1 / e[2:]) @ v[:, 2:].T
    assert np.allclose([r["x"] for r in cut.x.orderBy("row_key").collect()], pseudo @ d)
    assert np.allclose([r["x"] for r in systems.solve(s, keep=99).x.orderBy("row_key").collect()], np.linalg.solve(n, d))


def test_apriori_moves_and_returns(spark):
    s, raw = make(spark, [3])
    n, d, ltpl, _ = raw["s3"]
    new = spark.createDataFrame([("a1", 2.0), ("c2", -1.0)], "row_key string, x double")
    dx = np.array([2.0, 0, 0, 0, -1.0])
    moved = systems.change_apriori(s, "add", new)
    _, v, st = as_arrays(moved, "s3", KEYS)
    assert np.allclose(v, d - n @ dx) and np.isclose(st["ltpl"], ltpl - 2 * d @ dx + dx @ n @ dx)
    _, v, st = as_arrays(systems.change_apriori(moved, "set"), "s3", KEYS)
    assert np.allclose(v, d) and np.isclose(st["ltpl"], ltpl)
    for mode, values, want in (("forget", None, 0.0), ("replace", new, 2.0)):
        got = systems.change_apriori(moved, mode, values)
        assert got.rhs.where("row_key = 'a1'").first()["x0"] == want and np.allclose(as_arrays(got, "s3", KEYS)[1], d - n @ dx)
    only = systems.change_apriori(s, "add", new, "^a")
    assert np.allclose(as_arrays(only, "s3", KEYS)[1], d - n @ [2.0, 0, 0, 0, 0])


def test_groups_of_same_keys_and_disagreement(spark):
    (s, _), (t, _) = make(spark, [0, 1]), make(spark, [2], KEYS[:2])
    both = systems.Systems(*(a.unionByName(b) for a, b in zip(s, t, strict=True)))
    assert {tuple(r) for r in systems.same_keys(both).collect()} == {("s0", "s0"), ("s1", "s0"), ("s2", "s2")}
    got = systems.combine(both, systems.same_keys(both))
    row = got.stats.where("sys = 's0'").first()
    assert (row["nobs"], row["stime"], row["etime"], row["ctime"]) == (80, 0.0, 3.0, 1.5)
    assert systems.apriori_disagrees(both, systems.same_keys(both)).count() == 0
    off = both._replace(rhs=both.rhs.selectExpr("sys", "row_key", "value", "if(sys = 's1' and row_key = 'a1', 1e-9, x0) x0"))
    assert [r["row_key"] for r in systems.apriori_disagrees(off, systems.same_keys(off)).collect()] == ["a1"]


def test_components_find_the_noise(spark):
    """Three systems with noise of 1, 2 and 3: their variances come out."""
    s, _ = make(spark, [0, 1, 2], KEYS, 4000)
    groups = s.stats.selectExpr("sys", "'all' grp")
    got = {r["sys"]: (r["cv"], r["convergence"]) for r in systems.iterate_components(s, groups, 3).collect()}
    for k in range(3):
        assert abs(got[f"s{k}"][0] / (1 + k) ** 2 - 1) < 0.15 and abs(got[f"s{k}"][1] - 1) < 1e-3
    total = systems.variance_components(s, groups, s.stats.selectExpr("sys", "1.0D cv")).agg({"contribution": "sum"}).first()[0]
    assert abs(total - len(KEYS)) < 1e-8


def test_singular_and_empty_systems(spark):
    s, _ = make(spark, [0], KEYS, 3)
    got = systems.solve(s)
    assert all(r["x"] is None or abs(r["x"]) < 1e20 for r in got.x.collect()) and got.stats.first()["sigma0"] is None
    zero = s._replace(cells=s.cells.limit(0))
    assert [r["x"] for r in systems.solve(zero).x.collect()] == [None] * 5
    none = systems.Systems(*(t.limit(0) for t in s))
    assert systems.solve(none).x.count() == 0 and systems.reduce(none, "a").stats.count() == 0
    with pytest.raises(ValueError):
        systems.solve(s, keep=0)
    with pytest.raises(ValueError):
        systems.change_apriori(s, "other")
