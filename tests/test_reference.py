"""Queries against their SQL at the smallest scale, and the dense parts
against numpy on small systems."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.functions import columns as C
from keyfold.operators import keyed, normals, series
from keyfold.plans import registry

SF = "/root/testdata/sf0.001"
CELLS = "row_key long, col_key long, value double"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got, cols = duck.execute(registry.oracle_sql()[name]), sorted(df.columns)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in got.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_every_query_has_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_dense_results_match_numpy(spark):
    a = np.random.default_rng(1).normal(size=(5, 5))
    n = a @ a.T + np.eye(5)
    cells = spark.createDataFrame([(0, i, j, float(n[i, j])) for i in range(5) for j in range(5)], "sys long, " + CELLS)
    for what, want in (("inverse", np.linalg.inv(n)), ("cholesky", np.linalg.cholesky(n).T)):
        for r in normals.dense(cells, what).collect():
            assert math.isclose(r["value"], want[r["row_key"], r["col_key"]], abs_tol=1e-9)
    e = [r["value"] for r in normals.dense(cells, "eigen").orderBy("row_key").collect()]
    assert np.allclose(e, np.linalg.eigvalsh(n))


def test_fit_recovers_known_terms(spark):
    t = np.linspace(0, 28, 200)
    y = 3 + 0.5 * (t - 15) + 2 * np.cos(2 * np.pi * (t - 15) / 7) - np.sin(2 * np.pi * (t - 15) / 7)
    df = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(t, y, strict=True)] + [("one", 1.0, 2.0), ("a", None, 1.0), ("a", 1.0, None)], "k string, t double, y double")
    got = {(r["sys"], r["name"]): r["x"] for r in series.fit_terms(df.where("t is not null"), "k", "t", "y", 15.0, [7.0]).collect()}
    for name, want in (("p0", 3), ("p1", 0.5), ("c0", 2), ("s0", -1)):
        assert abs(got["a", name] - want) < 1e-8
    assert got["one", "p0"] is None or got["one", "p0"] == got["one", "p0"]


def test_interpolation_edges(spark):
    known = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "k string, t double, y double")
    ask = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0, 3.0, 4.0)] + [("b", 1.0)], "k string, t double")
    got = {(r["k"], r["t"]): r["y"] for r in series.interpolate(ask, known, "k", "t", "y").collect()}
    assert got == {("a", 0.0): None, ("a", 1.0): 10.0, ("a", 2.0): 20.0, ("a", 3.0): 30.0, ("a", 4.0): None, ("b", 1.0): None}


def test_empty_and_null_cells(spark):
    none = spark.createDataFrame([], CELLS)
    some = spark.createDataFrame([(1, 1, 2.0), (1, None, 3.0), (2, 1, None)], CELLS)
    assert keyed.matmul(none, some).count() == 0 and keyed.gram(none).count() == 0 and keyed.correlation(none).count() == 0
    assert keyed.add(some, none).count() == 3
    assert {(r["row_key"], r["col_key"]): r["value"] for r in keyed.matmul(some, some).collect()}[1, 1] == 4.0


def test_calculator_goes_left_to_right(spark):
    row = spark.range(1).select(C.calculate("2+3*4", {}).alias("a"), C.calculate("x/0", {"x": F.lit(1.0)}).alias("b")).first()
    assert (row["a"], row["b"]) == (20.0, None)
    assert C.glob_pattern("a*|b") == "^(a.*|b)$"
