"""Queries on observation equations: customers as stations, nations as plates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations as O  # noqa: E741
from .fields import _DP, _P
from .functionals import _LOVE, love
from .registry import query
from .relations import _ST, stations

_BASE = f"WITH {_ST}, b AS (SELECT c_custkey AS station, radians(lon) AS x, radians(lat) AS y, CAST(c_custkey % 9 AS VARCHAR) AS plate, 1990 + c_custkey % 25 AS t FROM st)"
_A = repr(O.ARCSECOND)
_UP, _EAST, _NORTH = ("cos(y) * cos(x)", "cos(y) * sin(x)", "sin(y)"), ("-sin(x)", "cos(x)", "0"), ("-sin(y) * cos(x)", "-sin(y) * sin(x)", "cos(y)")


def places(spark, d):
    k = F.col("c_custkey")
    return stations(spark, d).select(k.alias("station"), "lon", "lat", (k % 9).cast("string").alias("plate"), (1990 + k % 25).cast("double").alias("t"))


def _cells(df):
    return df.select("station", "component", "col_key", (F.round("value", 6) + 0.0).alias("value"))


def _sql(rows) -> str:
    return " UNION ALL ".join(f"SELECT station, '{c}' AS component, {k} AS col_key, round({v}, 6) + 0.0 AS value FROM b" for c, k, v in rows)


_HELMERT = [(c, f"'HT{a}'", v) for c, axes in zip("HEN", (_UP, _EAST, _NORTH)) for a, v in zip("XYZ", axes)] + [("H", "'HSC'", repr(O.RADIUS * 1e-9))]
_HELMERT += [("E", f"'HR{a}'", f"{v} * {_A}") for a, v in zip("XYZ", _NORTH)] + [("N", f"'HR{a}'", f"-({v}) * {_A}") for a, v in zip("XYZ", _EAST)]


@query("g2_helmert_rows", f"{_BASE} {_sql(_HELMERT)}")
def g2(spark, d):
    return _cells(O.helmert(places(spark, d)))


_TERMS = [(c, f"'S{c}  ' || station", "1.0") for c in "HEN"] + [(c, f"'S{c}P ' || station", "(t - 2000)::DOUBLE") for c in "HEN"] + [(c, f"'S{c}{q}1y' || station", f"{f}(t * 2 * pi() / 3)") for c in "HEN" for q, f in (("C", "cos"), ("S", "sin"))]


@query("g4_station_terms", f"{_BASE} {_sql(_TERMS)}")
def g4(spark, d):
    return _cells(O.station_terms(places(spark, d), True, True, {"1y": 3.0}))


_PLATES = [("E", f"'PR{a}_' || plate", f"{v} * {_A}") for a, v in zip("XYZ", _NORTH)] + [("N", "'PRX_' || plate", f"sin(x) * {_A}"), ("N", "'PRY_' || plate", f"-cos(x) * {_A}")]


@query("g5_plate_rows", f"{_BASE} {_sql(_PLATES)}")
def g5(spark, d):
    return _cells(O.euler_plates(places(spark, d)))


@query(
    "g1_load_rows",
    f"""{_BASE}, {_LOVE}, p AS (SELECT station, x, sin(y) AS t, cos(y) AS u FROM b), k(l, m) AS (VALUES (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)), w AS (SELECT station, x, u, l, m, {_P} AS p, {_DP} AS dp, h * 3 * {O.RHO_WATER} / ((2 * l + 1) * {O.RHO_EARTH}) AS up, q * 3 * {O.RHO_WATER} / ((2 * l + 1) * {O.RHO_EARTH}) AS side FROM p CROSS JOIN k JOIN lv ON l = n),
c AS (SELECT station, c.component, printf('T%sN %3d%3d', c.q, l, m) AS col_key, CASE c.component WHEN 'H' THEN up * p * CASE c.q WHEN 'C' THEN cos(m * x) ELSE sin(m * x) END WHEN 'E' THEN side * p / u * m * CASE c.q WHEN 'C' THEN -sin(m * x) ELSE cos(m * x) END ELSE side * dp * CASE c.q WHEN 'C' THEN cos(m * x) ELSE sin(m * x) END END AS value FROM w CROSS JOIN (VALUES ('H', 'C'), ('H', 'S'), ('E', 'C'), ('E', 'S'), ('N', 'C'), ('N', 'S')) c(component, q) WHERE m > 0 OR c.q = 'C')
SELECT station, component, col_key, round(value, 6) + 0.0 AS value FROM c WHERE abs(value) > 1e-6""",
)
def g1(spark, d):
    """Displacements by loads of degrees 1 and 2; cells of rounding size are left out."""
    return _cells(O.spectral(places(spark, d), love(spark), "load", 1, 2).where("abs(value) > 1e-6"))


@query(
    "g6_rotated_rows",
    f"{_BASE} SELECT station, c.component, 'HTX' AS col_key, CASE c.component WHEN 'X' THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM b CROSS JOIN (VALUES ('X'), ('Y'), ('Z')) c(component) WHERE station % 2 = 0 UNION ALL SELECT station, c.component, 'HSC', round({O.RADIUS * 1e-9!r} * CASE c.component WHEN 'X' THEN cos(y) * cos(x) WHEN 'Y' THEN cos(y) * sin(x) ELSE sin(y) END, 6) + 0.0 FROM b CROSS JOIN (VALUES ('X'), ('Y'), ('Z')) c(component) WHERE station % 2 = 0",
)
def g6(spark, d):
    """Helmert rows of stations with even numbers, turned to X, Y, Z: a
    translation along X is then 1, 0, 0."""
    at = places(spark, d)
    cells = O.gated(O.helmert(at), "[02468] *$").where("col_key in ('HTX', 'HSC')")
    return _cells(O.rotated(cells, at))


_GEO = [(c, f"'S{a}B'", f"{k} * ({v})") for c, k, axes in zip("HEN", (-0.27, 0.11, 0.11), (_UP, _EAST, _NORTH)) for a, v in zip("XYZ", axes)]


@query("g3_geocenter_displacements", f"{_BASE} {_sql(_GEO)}")
def g3(spark, d):
    return _cells(O.geocenter(places(spark, d), -0.27, 0.11))
