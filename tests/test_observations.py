"""Observation equations against the synthesis of fields and vectors in space."""

import math

import numpy as np
import pytest

from keyfold.operators import observations as O
from keyfold.operators import spectra

PLACES = [("A", 10.0, 50.0, "EU", 2003.5), ("B", -70.0, -33.0, None, 2001.0), ("C", 200.0, 0.0, "PA", None), ("D", None, 1.0, "PA", 2000.0)]


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(PLACES, "station string, lon double, lat double, plate string, t double")


@pytest.mark.parametrize("kind", O.KINDS)
def test_spectra_are_displacements(spark, places, kind):
    """A coefficient vector times the rows is the synthesised, scaled field."""
    r = np.random.default_rng(1)
    love = spark.createDataFrame([(n, -0.1 * n, 0.02 * n, -0.3 / (n + 1)) for n in range(6)], "n int, h double, l double, k double")
    up, side = O.spectral_factors(love, kind, 1, 5)
    rows = [(l, m, float(r.normal()), float(r.normal()) if m else 0.0) for l in range(1, 6) for m in range(l + 1)]
    values = {f"{q}N {l:3d}{m:3d}": v for l, m, c, s in rows for q, v in (("C", c), ("S", s)) if q == "C" or m}
    got = {}
    for x in O.spectral(places, love, kind, 1, 5).collect():
        got[x["station"], x["component"]] = got.get((x["station"], x["component"]), 0.0) + x["value"] * values[x["col_key"][1:]]
        assert x["col_key"][0] == {"load": "T", "uplift_ratio": "U" if x["col_key"][4:7].strip() == "1" else "P", "poloidal": "V"}.get(kind, "G")
    points = places.where("lon is not null")
    for component, by, what in (("H", up, "value"), ("E", side, "east"), ("N", side, "north")):
        df = spark.createDataFrame([(l, m, c * float(by[l]), s * float(by[l])) for l, m, c, s in rows], "l int, m int, c double, s double")
        for x in spectra.synthesise(points, df, 5, what=what).collect():
            assert got.get((x["station"], component), 0.0) == pytest.approx(x["value"], abs=1e-9 * max(1.0, abs(x["value"])))


def test_rotations_of_rows(spark, places):
    """Translations and rotations in space, whatever the station."""
    cells = O.rotated(O.helmert(places), places).collect()
    got = {(x["station"], x["component"], x["col_key"]): x["value"] for x in cells}
    for s, lon, lat, *_ in PLACES[:3]:
        p = np.array([math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat))])
        for k, a in enumerate("XYZ"):
            for j, b in enumerate("XYZ"):
                assert got[s, b, f"HT{a}"] == pytest.approx(float(k == j), abs=1e-12)
            assert got[s, a, "HSC"] == pytest.approx(O.RADIUS * 1e-9 * p[k])
            turn = np.cross(np.eye(3)[k], p) * O.ARCSECOND
            assert [got[s, b, f"HR{a}"] for b in "XYZ"] == pytest.approx(turn, abs=1e-6)
    plates = {(x["station"], x["component"], x["col_key"]): x["value"] for x in O.euler_plates(places).collect()}
    assert {k[2][4:] for k in plates} == {"EU", "PA"} and {k[1] for k in plates} == {"E", "N"}
    helmert = {(x["station"], x["component"], x["col_key"]): x["value"] for x in O.helmert(places).collect()}
    for (s, c, k), v in plates.items():
        assert v == pytest.approx(helmert[s, c, "HR" + k[2]])


def test_terms_of_stations(places):
    got = {(x["station"], x["component"], x["col_key"]): x["value"] for x in O.station_terms(places, True, True, {"AN": 1.0}).collect()}
    assert got["A", "H", "SHP A"] == 3.5 and got["B", "E", "SE  B"] == 1.0 and got["A", "N", "SNCAN" "A"] == pytest.approx(math.cos(2 * math.pi * 2003.5))
    assert ("C", "H", "SH  C") in got and ("C", "H", "SHP C") not in got and not [k for k in got if k[0] == "D"]
    gate = O.gated(O.helmert(places), "^STA[EN] A").select("station", "component").distinct().collect()
    assert {tuple(x) for x in gate} == {("A", "E"), ("A", "N")}
    assert O.helmert(places.limit(0)).count() == 0
    with pytest.raises(ValueError):
        O.spectral_factors(None, "other", 1, 2)
    geo = {(x["component"], x["col_key"]): x["value"] for x in O.geocenter(places.where("station = 'C'"), 2.0, 3.0).collect()}
    assert geo["H", "SXB"] == pytest.approx(2 * math.cos(math.radians(200))) and geo["N", "SZB"] == pytest.approx(3.0)
