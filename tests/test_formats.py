"""Round trips of sectioned text files and of binary matrices."""

import os

import numpy as np
import pytest

from keyfold.sources import binary, sinex

CELLS = "row_ix int, col_ix int, value double"


def parameters(spark, n):
    rows = [(k, "STAX", f"S{k % 1000:03d}", "A", "1", "26:001:43200", "m", "2", (-1) ** k * 1234567.123456789 / k, k / 7) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "ix int, type string, site string, point string, solution string, epoch string, unit string, constraint string, value double, sigma double"), rows


@pytest.mark.parametrize("single", [True, False])
def test_sinex_round_trip(spark, tmp_path, single):
    df, rows = parameters(spark, 40)
    low = np.tril(np.random.default_rng(1).normal(size=(40, 40)))
    cells = spark.createDataFrame([(i + 1, j + 1, float(low[i, j])) for i in range(40) for j in range(40)], CELLS)
    site = spark.createDataFrame([(1, "ABCD", "A", "10001M001", "a place", -75.5, -0.25, 12.5), (2, "EFGH", "B", "10002M001", "another", 359.99999, 89.5, -3.0)], "ix int, site string, point string, domes string, description string, lon double, lat double, height double")
    stats = spark.createDataFrame([(1, "NUMBER OF OBSERVATIONS", 12345.0), (2, "VARIANCE FACTOR", 0.75)], "ix int, name string, value double")
    path = f"file://{tmp_path}/a.snx"
    sinex.write(spark, path, {"parameters": 40, "created": "26:001:00000", "content": "X"}, [(sinex.SITES, sinex.site_lines(site)), (sinex.STATISTICS, sinex.statistics_lines(stats)), (sinex.ESTIMATE, sinex.estimate_lines(df)), (sinex.APRIORI, sinex.estimate_lines(df, sigma=False)), ("SOLUTION/MATRIX_ESTIMATE L COVA", sinex.matrix_lines(cells)), ("OTHER/BLOCK", spark.createDataFrame([(1, " x")], "ix int, line string"))], single=single)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        found = sinex.lines(spark, path, folders=True)
        got = {r["ix"]: r for r in sinex.estimates(found).collect()}
        assert len(got) == 40 and all(np.isclose(got[r[0]]["value"], r[8], rtol=1e-14) and np.isclose(got[r[0]]["sigma"], r[9], rtol=1e-5) and got[r[0]]["site"] == r[2] for r in rows)
        assert sinex.estimates(found, sinex.APRIORI).where("sigma is null").count() == 40
        assert sinex.estimates(found, include="*S00*", exclude="*S003*").count() == 8
        back = np.zeros((40, 40))
        for r in sinex.matrices(found).collect():
            back[r["row_ix"] - 1, r["col_ix"] - 1] = r["value"]
            assert (r["matrix"], r["triangle"], r["content"]) == ("MATRIX_ESTIMATE", "L", "COVA")
        assert np.allclose(back, low, rtol=1e-13, atol=1e-300)
        keyed = sinex.keyed_matrix(found, rows=("*S001*", None), cols=(None, "*S002*")).collect()
        assert len(keyed) == 39
        s = {r["site"]: r for r in sinex.sites(found).collect()}
        assert s["ABCD"]["lon"] == -75.5 and s["ABCD"]["lat"] == -0.25 and s["ABCD"]["domes"] == "10001M001" and abs(s["EFGH"]["lon"] - 360) < 1e-4
        assert {r["name"]: r["value"] for r in sinex.statistics(found).collect()} == {"NUMBER OF OBSERVATIONS": 12345.0, "VARIANCE FACTOR": 0.75}
        assert [r["line"] for r in sinex.block(found, "OTHER/BLOCK").collect()] == [" x"]
        assert sinex.header(spark, path, folders=True).first()["parameters"] == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sinex_lines_outside_sections(spark, tmp_path):
    (tmp_path / "b.snx").write_text("%=SNX 2.02 ABC 26:001:00000 ABC 26:001:00000 26:002:00000 P 00003 2 S\n*c\n stray\n+A/B\n*note\n one\n-A/B\n between\n+SOLUTION/ESTIMATE\n     1 STAX   ABCD  A    1 26:001:00000 m    2 -1.23D+03\n     x\n-SOLUTION/ESTIMATE\n%ENDSNX\n")
    (tmp_path / "empty.snx").write_text("")
    found = sinex.lines(spark, str(tmp_path))
    assert [r["line"] for r in found.where("section = 'A/B'").collect()] == [" one"]
    assert [(r["ix"], r["value"], r["sigma"]) for r in sinex.estimates(found).collect()] == [(1, -1230.0, None)]


FORMS = [(f, e) for f in binary.FORMS for e in (True, False)]


@pytest.mark.parametrize("form,little", FORMS)
def test_binary_round_trip(spark, tmp_path, form, little):
    n, m = 7, 7 if form != "FULL2DVN" else 4
    full = np.random.default_rng(2).normal(size=(n, m))
    ends = [2, 3, 7] if form.startswith("BD") else []
    cells = spark.createDataFrame([(i + 1, j + 1, float(full[i, j])) for i in range(n) for j in range(m)], CELLS)
    rows, cols = [f"row {k}" for k in range(n)], [f"col {k}" for k in range(m)]
    vec = spark.createDataFrame([(k + 1, v, float(k * v)) for k in range(n) for v in (1, 2)], "row_ix int, vec_no int, value double")
    path = f"{tmp_path}/x.bin"
    binary.write(path, cells, form, rows, cols, ends, vec, {"Nobs": 1 << 40}, {"LtPL": 0.1}, ["a line"], "what it is", little, values=5)
    with open(path, "rb") as f:
        assert f.read(2) == (b"BI" if little else b"IB")
    got = {(r["row_ix"] - 1, r["col_ix"] - 1): r["value"] for r in binary.read(spark, path, values=6).collect()}
    block = np.searchsorted(ends, np.arange(n), side="right") if ends else np.zeros(n, int)
    upper = form in binary.SYMMETRIC + binary.BLOCKS_SYMMETRIC
    want = {(i, j): full[i, j] for i in range(n) for j in range(m) if (not upper or i <= j) and (not ends or block[i] == block[j]) and (form not in binary.DIAGONAL or i == j)}
    assert got == want
    index = binary.read(spark, path, "index").first()
    assert (index["type"], index["rows"], index["cols"], index["vectors"], index["little_endian"], index["description"]) == (form, n, m, 2, little, "what it is")
    assert {(r["kind"], r["name"], r["long_value"], r["double_value"]) for r in binary.read(spark, path, "meta").collect()} == {("readme", "a line", None, None), ("long", "Nobs", 1 << 40, None), ("double", "LtPL", None, 0.1)}
    keys = {(r["axis"], r["ix"]): r["key"] for r in binary.read(spark, path, "keys").collect()}
    two = form in binary.BLOCKS_FULL + binary.FULL + binary.RECTANGLE
    assert keys[1, 3] == "row 2" and keys[2, 3] == ("col 2" if two else "row 2")
    assert {(r["vec_no"], r["row_ix"]): r["value"] for r in binary.read(spark, path, "vectors", 3).collect()} == {(v, k + 1): k * v for k in range(n) for v in (1, 2)}


def test_binary_index_reads_no_cells(spark, tmp_path):
    cells = spark.createDataFrame([(1, 1, 1.0)], CELLS)
    path = f"{tmp_path}/y.bin"
    binary.write(path, cells, "FULLSQVN", [f"k{k}" for k in range(100)])
    os.truncate(path, os.path.getsize(path) - 8 * 100 * 100)  # without its matrix
    assert binary.read(spark, path, "index").first()["values"] == 10_000 and binary.read(spark, path, "keys").count() == 200
    with pytest.raises(ValueError):
        binary.write("s3://a/b", cells, "SYMVN___", ["a"])
    (tmp_path / "no.bin").write_bytes(b"xx")
    with pytest.raises(Exception, match="no binary matrix"):
        binary.read(spark, f"{tmp_path}/no.bin", "index").collect()


def test_binary_old_versions(spark, tmp_path):
    import struct

    keys = [b"a".ljust(24), b"b".ljust(24)]
    head = b"IB" + b"NV2.1 " + b"SYMV1___" + b"old".ljust(80) + struct.pack(">6i", 1, 0, 2, 2, 3, 1) + b"n".ljust(24) + struct.pack(">i", 9)
    (tmp_path / "old.bin").write_bytes(head + b"".join(keys) + struct.pack(">2d", 7, 8) + struct.pack(">3d", 1, 2, 3))
    path = f"{tmp_path}/old.bin"
    assert {(r["row_key"], r["col_key"]): r["value"] for r in binary.read(spark, path).collect()} == {("a", "a"): 1.0, ("a", "b"): 2.0, ("b", "b"): 3.0}
    assert [r["value"] for r in binary.read(spark, path, "vectors").orderBy("row_ix").collect()] == [7.0, 8.0]
    assert binary.read(spark, path, "meta").first()["long_value"] == 9


def test_places_of_large_triangles():
    at = np.array([0, 1, 2, 3, 10**12, 10**15 + 7, (1 << 50) - 1])
    r, c = binary._triangle(at)
    assert np.array_equal(c * (c + 1) // 2 + r, at) and (r <= c).all() and (r >= 0).all()
