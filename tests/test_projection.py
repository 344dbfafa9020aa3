"""The column list of a keyed system and edits of its metadata."""

import pytest

from keyfold.operators import projection as P


@pytest.fixture(scope="module")
def system(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ix int, key string")
    vectors = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (1, 2, 3.0), (3, 2, None)], "row_ix int, vec_no int, value double")
    cells = spark.createDataFrame([(1, 1, 4.0), (1, 2, 5.0), (2, 2, 9.0), (3, 3, -1.0)], "row_ix int, col_ix int, value double")
    return keys, vectors, cells


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("ix").collect()]


def test_columns(system):
    assert rows(P.project(*system, "s,v1+v2*10,d")) == [("a", 50.0, 4.0), ("b", 40.0, 9.0), ("c", 0.0, -1.0)]
    assert rows(P.project(*system, "r,c2,100*c2/v1,i")) == [(2.0, 5.0, 250.0, 1), (3.0, 9.0, 225.0, 2), (None, 0.0, None, 3)]
    assert rows(P.project(*system, "m")) == [([4.0, 5.0],), ([9.0],), ([-1.0],)]
    assert rows(P.project(system[0], None, system[2], "m,c1", transposed=True)) == [([4.0], 4.0), ([5.0, 9.0], 5.0), ([-1.0], 0.0)]
    for text, t in (("q", False), ("v1", True)):
        with pytest.raises(ValueError):
            P.project(*system, text, transposed=t)
    with pytest.raises(ValueError):
        P.project(system[0], None, system[2], "v1")
    assert rows(P.project(system[0].limit(0), system[1], system[2], "s,v1")) == []


def test_vectors_become_columns(system):
    got = {(r["row_key"], r["col_key"]): r["value"] for r in P.vectors_to_matrix(system[0], system[1], ["ONE"]).collect()}
    assert got == {("a", "ONE"): 2.0, ("b", "ONE"): 4.0, ("a", "VEC2"): 3.0, ("c", "VEC2"): None}


def test_metadata_edits(spark):
    meta = spark.createDataFrame([("f", "long", 0, "Nobs", 1, None), ("f", "long", 1, "N", 2, None), ("f", "readme", 0, "x", None, None), ("g", "double", 0, "L", None, 0.5)], "file string, kind string, place int, name string, long_value long, double_value double")
    got = {(r["file"], r["kind"], r["name"]): (r["place"], r["long_value"], r["double_value"]) for r in P.edit_metadata(meta, {"Nobs": 9}, None, ["L"], ["y"]).collect()}
    assert got[("f", "long", "Nobs")][1] == 9 and got[("f", "long", "N")] == (1, 2, None) and ("g", "double", "L") not in got
    assert got[("f", "readme", "y")][0] >= 1 and got[("g", "readme", "y")][0] >= 0 and len(got) == 6
