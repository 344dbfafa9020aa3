"""Observation equations of station displacements, as cells of design matrices.

Stations (station, lon, lat in degrees[, plate][, t in years]) have a row for
each component: STAH, STAE, STAN (height, east, north) and the station's name.
Every builder is a projection that emits the cells (station, component,
row_key, col_key, value) of a group of unknowns, so a design matrix is their
union; `rotated` turns its rows into STAX, STAY, STAZ.

Defined results: a station without a position has no rows; a station without a
plate or time has none for the unknowns that need it; at a pole the east
components of spectra are left out; empty tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functionals import RHO_EARTH, RHO_WATER
from .spectra import RADIUS, legendre

ARCSECOND = RADIUS * math.pi / (180 * 3600)
COMPONENTS = ("H", "E", "N")
#: Reference year of trends.
YEAR = 2000.0
KINDS = ("load", "stokes", "uplift_ratio", "poloidal", "stokes_solid")


def _rows(stations: DataFrame, cells: list[tuple[str, Column, Column]]) -> DataFrame:
    """Rows of (component, unknown, value); null values don't exist."""
    one = [F.struct(F.lit(c).alias("component"), k.alias("col_key"), v.cast("double").alias("value")) for c, k, v in cells]
    got = stations.where("lon is not null and lat is not null").select("station", F.inline(F.array(*one)))
    return got.where("value is not null and col_key is not null").select("station", "component", row_key("component").alias("row_key"), "col_key", "value")


def row_key(component: str) -> Column:
    return F.rpad(F.concat(F.lit("STA"), F.col(component), F.lit(" "), F.col("station").cast("string")), 24, " ")


def _axes() -> tuple[list[Column], list[Column], list[Column]]:
    """Unit vectors up, east and north."""
    x, y = F.radians("lon"), F.radians("lat")
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)], [-F.sin(x), F.cos(x), F.lit(0.0)], [-F.sin(y) * F.cos(x), -F.sin(y) * F.sin(x), F.cos(y)]


def helmert(stations: DataFrame) -> DataFrame:
    """Translations (m), scale (ppb) and rotations (arcs) of a network."""
    up, east, north = _axes()
    cells = [(c, F.lit(f"HT{a}"), v) for c, axes in zip(COMPONENTS, (up, east, north), strict=True) for a, v in zip("XYZ", axes, strict=True)]
    cells.append(("H", F.lit("HSC"), F.lit(RADIUS * 1e-9)))
    cells += [("E", F.lit(f"HR{a}"), v * ARCSECOND) for a, v in zip("XYZ", north, strict=True)]
    cells += [("N", F.lit(f"HR{a}"), -v * ARCSECOND) for a, v in zip("XYZ", east, strict=True)]
    return _rows(stations, cells)


def geocenter(stations: DataFrame, h1: float, l1: float) -> DataFrame:
    """Displacements by the three components of geocenter motion, SXB, SYB and
    SZB, for the Love numbers of degree 1 of a frame."""
    by = {"H": h1, "E": l1, "N": l1}
    cells = [(c, F.lit(f"S{a}B"), v * by[c]) for c, axes in zip(COMPONENTS, _axes(), strict=True) for a, v in zip("XYZ", axes, strict=True)]
    return _rows(stations, cells)


def euler_plates(stations: DataFrame) -> DataFrame:
    """Rotations (arcs) of each station's plate; they move nothing up."""
    x, y = F.radians("lon"), F.radians("lat")
    name = lambda a: F.concat(F.lit(f"PR{a}_"), F.trim("plate"))
    east = (-F.sin(y) * F.cos(x), -F.sin(y) * F.sin(x), F.cos(y))
    north = (F.sin(x), -F.cos(x))
    cells = [("E", name(a), v * ARCSECOND) for a, v in zip("XYZ", east, strict=True)]
    return _rows(stations, cells + [("N", name(a), v * ARCSECOND) for a, v in zip("XY", north, strict=True)])


def station_terms(stations: DataFrame, mean: bool = True, trend: bool = False, periods: dict[str, float] | None = None) -> DataFrame:
    """Unknowns of each component of a station: mean (SH, SE, SN), trend since
    2000 (SHP, ...), and cosine and sine of periods in years, {tag: period}."""
    cells = []
    label = lambda tag: F.concat(F.lit(tag), F.col("station").cast("string"))
    for c in COMPONENTS:
        if mean:
            cells.append((c, label(f"S{c}  "), F.lit(1.0)))
        if trend:
            cells.append((c, label(f"S{c}P "), F.col("t") - YEAR))
        for tag, period in (periods or {}).items():
            w = F.col("t") * (2 * math.pi / period)
            cells += [(c, label(f"S{c}C{tag}"), F.cos(w)), (c, label(f"S{c}S{tag}"), F.sin(w))]
    return _rows(stations, cells)


def spectral_factors(love: DataFrame | None, kind: str, lmin: int, lmax: int) -> tuple[np.ndarray, np.ndarray]:
    """What a coefficient of a degree moves up, and sideways; love (n, h, l, k).
    For uplift_ratio h is the ratio, and degree 1 moves as it is."""
    if kind not in KINDS or lmin < 1:
        raise ValueError("no such kind, or degrees below 1")
    h, l, k = (np.zeros(lmax + 1) for _ in range(3))  # noqa: E741
    if love is not None:
        for r in love.where(F.col("n") <= lmax).select("n", "h", "l", "k").collect():  # one row a degree
            h[r["n"]], l[r["n"]], k[r["n"]] = r["h"] or 0.0, r["l"] or 0.0, r["k"] or 0.0
    n = np.arange(lmax + 1)
    if kind == "load":
        by = 3 * RHO_WATER / ((2 * n + 1) * RHO_EARTH)
        return h * by, l * by
    if kind == "poloidal":
        return np.zeros(lmax + 1), np.ones(lmax + 1)
    if kind == "uplift_ratio":
        up = h * RADIUS
        up[1] = 1.0
        return up, np.zeros(lmax + 1)
    by = RADIUS / (1 + k) if kind == "stokes_solid" else RADIUS
    return h * by, l * by


_TAG = {"load": "T", "stokes": "G", "stokes_solid": "G", "uplift_ratio": "P", "poloidal": "V"}


def spectral(stations: DataFrame, love: DataFrame | None, kind: str, lmin: int, lmax: int) -> DataFrame:
    """Displacements by coefficients of degrees lmin to lmax: keys such as
    TCN, degree, order.  Stations stream by; each makes (lmax + 1)^2 cells a component."""
    held = stations.sparkSession.sparkContext.broadcast(spectral_factors(love, kind, lmin, lmax))
    letter = _TAG[kind]
    name = stations.schema["station"].dataType.simpleString()

    def run(batches):
        up, side = held.value
        for batch in batches:
            x, y = (np.radians(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in ("lon", "lat"))
            t, u = np.sin(y), np.cos(y)
            flat = np.where(u < 1e-12, np.nan, u)
            before, last = None, -1
            for l, m, p in legendre(lmax, t):  # noqa: E741
                if m != last:
                    last, before = m, np.zeros(len(t))
                slope = (math.sqrt((l * l - m * m) * (2 * l + 1) / max(2 * l - 1, 1)) * before - l * t * p) / flat
                before = p
                if l < lmin:
                    continue
                tag = "U" if kind == "uplift_ratio" and l == 1 else letter
                for q, f, g in (("C", np.cos(m * x), -m * np.sin(m * x)), ("S", np.sin(m * x), m * np.cos(m * x))):
                    if q == "S" and not m:
                        continue
                    for c, v in (("H", up[l] * p * f), ("E", side[l] * p * g / flat), ("N", side[l] * slope * f)):
                        some = np.flatnonzero(np.isfinite(v) & (v != 0))
                        if len(some):
                            at, n = pa.array(some), len(some)
                            yield pa.RecordBatch.from_arrays([batch.column("station").take(at), pa.array([c] * n), pa.array([f"{tag}{q}N {l:3d}{m:3d}"] * n), pa.array(v[some])], names=["station", "component", "col_key", "value"])

    got = stations.where("lon is not null and lat is not null").select("station", "lon", "lat").mapInArrow(run, f"station {name}, component string, col_key string, value double")
    return got.select("station", "component", row_key("component").alias("row_key"), "col_key", "value")


def gated(cells: DataFrame, pattern: str) -> DataFrame:
    """Cells of the rows whose key matches; the others' unknowns don't act there."""
    return cells.where(F.col("row_key").rlike(pattern))


def rotated(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """The same unknowns for rows STAX, STAY, STAZ: each station's three rows
    times the transposed rotation, in one aggregation."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col("component") == c, F.col("value"))), F.lit(0.0)).alias(c)
    rows = cells.groupBy("station", "col_key").agg(*(part(c) for c in COMPONENTS)).join(stations.select("station", "lon", "lat"), "station")
    axes = _axes()
    turned = [F.struct(F.lit(a).alias("component"), sum((F.col(c) * axis[k] for c, axis in zip(COMPONENTS, axes, strict=True)), F.lit(0.0)).alias("value")) for k, a in enumerate("XYZ")]
    got = rows.select("station", "col_key", F.inline(F.array(*turned)))
    return got.select("station", "component", row_key("component").alias("row_key"), "col_key", "value")
