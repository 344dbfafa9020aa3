"""Spherical-harmonic fields: (l, m, c, s) with 4-pi-normalised functions.

A spectrum is small (at most (lmax + 1)^2 rows, which is checked before it is
sent anywhere); points and grids are large and stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The highest degree; bounds what a task holds.
MAX_DEGREE = 720
# Mean radius in m, Love number and amplitude of the permanent tide.
RADIUS = 6378136.46
TIDE_HEIGHT, TIDE_LOVE = -0.31460, 0.30190


def legendre(lmax: int, sin_lat: np.ndarray, only: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """l, m, P of the 4-pi-normalised associated Legendre functions at each
    sine of latitude, order by order; memory doesn't grow with lmax.  With
    only, of that order alone.

    Within an order, by the usual three-term recursion in l; from order to
    order, by that of the sectoral functions.  A sectoral value below 1e-290 is
    carried as 0: all of its order is then negligible there up to lmax."""
    cos_lat = np.sqrt(np.maximum(1 - sin_lat**2, 0.0))
    sectoral = np.ones_like(sin_lat)
    for m in range(lmax + 1):
        if m:
            sectoral = sectoral * cos_lat * math.sqrt((2 * m + 1) / (2 * m) * (2 if m == 1 else 1))
            sectoral = np.where(sectoral < 1e-290, 0.0, sectoral)
        if only is not None and m < only:
            continue
        if only is not None and m > only:
            return
        below, now = np.zeros_like(sin_lat), sectoral
        yield m, m, now
        for l in range(m + 1, lmax + 1):  # noqa: E741
            a = math.sqrt((2 * l + 1) * (2 * l - 1) / ((l - m) * (l + m)))
            b = math.sqrt((2 * l + 1) * (l + m - 1) * (l - m - 1) / ((2 * l - 3) * (l + m) * (l - m))) if l > m + 1 else 0.0
            below, now = now, a * sin_lat * now - b * below
            yield l, m, now


def _spectrum(coeffs: DataFrame, lmax: int, sum_c: Column | None = None, sum_s: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two triangles c[l, m], s[l, m]; coefficients that aren't there are 0."""
    if lmax > MAX_DEGREE:
        raise ValueError(f"degrees beyond {MAX_DEGREE}")
    sums = coeffs.where((F.col("l") <= lmax) & (F.col("m") <= F.col("l")) & (F.col("m") >= 0)).groupBy("l", "m").agg((F.sum("c") if sum_c is None else sum_c).alias("c"), (F.sum("s") if sum_s is None else sum_s).alias("s"))
    c, s = np.zeros((lmax + 1, lmax + 1)), np.zeros((lmax + 1, lmax + 1))
    for r in sums.collect():  # at most (lmax + 1)^2 / 2 rows
        c[r["l"], r["m"]], s[r["l"], r["m"]] = r["c"] or 0.0, r["s"] or 0.0
    return c, s


def synthesise(points: DataFrame, coeffs: DataFrame, lmax: int, lon: str = "lon", lat: str = "lat", value: str = "value", what: str = "value") -> DataFrame:
    """points (degrees) with a column of the field: one pass, no shuffle.

    what: `value`; `east`, `north`, its derivatives along the unit sphere;
    `error`, `east_error`, `north_error`, what independent errors of the
    coefficients (c and s then hold sigmas) make of them.  Null positions have
    null values; so do derivatives at the poles, where they have no direction."""
    kind, error = what.removesuffix("_error"), what.endswith("error")
    if what not in ("value", "east", "north", "error", "east_error", "north_error"):
        raise ValueError(f"no such result: {what}")
    c, s = _spectrum(coeffs, lmax, F.sqrt(F.sum(F.col("c") ** 2)) if error else None, F.sqrt(F.sum(F.col("s") ** 2)) if error else None)
    held = points.sparkSession.sparkContext.broadcast((c, s))
    out = points.withColumn(value, F.lit(None).cast("double")).schema

    def run(batches):
        c, s = held.value
        for batch in batches:
            theta, phi = (np.radians(batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)) for k in (lat, lon))
            t, u = np.sin(theta), np.cos(theta)
            if kind in ("east", "north"):
                u = np.where(u < 1e-12, np.nan, u)
            total, last, before = np.zeros(batch.num_rows), -1, None
            for l, m, p in legendre(lmax, t):  # noqa: E741
                if m != last:
                    cos, sin, last, before = np.cos(m * phi), np.sin(m * phi), m, np.zeros(batch.num_rows)
                a, b, f = c[l, m], s[l, m], p
                if kind == "east":  # d/dlon / cos(lat): cosine and sine change places
                    a, b, f = m * b, -m * a, p / u
                    if error:
                        b = -b
                elif kind == "north":
                    f = (math.sqrt((l * l - m * m) * (2 * l + 1) / max(2 * l - 1, 1)) * before - l * t * p) / u
                before = p
                if a or b:
                    total += ((f * a * cos) ** 2 + (f * b * sin) ** 2) if error else f * (a * cos + b * sin)
            total = np.sqrt(total) if error else total
            if kind in ("east", "north"):
                total = np.where(np.isnan(u), np.nan, total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, mask=np.isnan(total))], names=[*batch.schema.names, value])

    return points.mapInArrow(run, out)


def analyse(grid: DataFrame, lmax: int, step: float, by: list[str] | None = None, lon: str = "lon", lat: str = "lat", value: str = "value") -> DataFrame:
    """`by`, l, m, c, s of fields on the centres of a global grid with this
    step in degrees, by quadrature with the exact areas of the cells.  Each
    batch gives partial sums, so the shuffle holds spectra and no grid."""
    by = by or []
    if lmax > MAX_DEGREE:
        raise ValueError(f"degrees beyond {MAX_DEGREE}")
    kinds = dict(grid.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "l int", "m int", "c double", "s double"])
    half = math.radians(step) / 2

    def run(batches):
        for batch in batches:
            theta, phi, z = (batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (lat, lon, value))
            theta, phi = np.radians(theta), np.radians(phi)
            known = ~np.isnan(theta + phi + z)
            area = np.where(known, np.nan_to_num(z) * (np.sin(theta + half) - np.sin(theta - half)) * 2 * half / (4 * math.pi), 0.0)
            names = list(zip(*(batch.column(k).to_pylist() for k in by), strict=True)) if by else [()] * batch.num_rows
            index = {n: k for k, n in enumerate(dict.fromkeys(names))}
            which, n = np.array([index[x] for x in names], np.int64), len(index)
            rows, last = [], -1
            for l, m, p in legendre(lmax, np.sin(np.nan_to_num(theta))):  # noqa: E741
                if m != last:
                    cos, sin, last = np.cos(m * np.nan_to_num(phi)) * area, np.sin(m * np.nan_to_num(phi)) * area, m
                rows.append((l, m, np.bincount(which, p * cos, n), np.bincount(which, p * sin, n)))
            if n:
                size = len(rows)
                keys = [[x[j] for x in index for _ in range(size)] for j in range(len(by))]
                cols = [np.tile([r[0] for r in rows], n), np.tile([r[1] for r in rows], n), np.array([r[2] for r in rows]).T.ravel(), np.array([r[3] for r in rows]).T.ravel()]
                kind = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(k, batch.schema.field(b).type) for k, b in zip(keys, by, strict=True)), *(pa.array(c, t) for c, t in zip(cols, kind, strict=True))], names=[*by, "l", "m", "c", "s"])

    partial = grid.select(*by, lon, lat, value).mapInArrow(run, out)
    return partial.groupBy(*by, "l", "m").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def add_fields(fields: list[tuple[float, DataFrame]]) -> DataFrame:
    """l, m, c, s of the weighted sum of fields, coefficient by coefficient."""
    parts = [f.select("l", "m", (F.col("c") * w).alias("c"), (F.col("s") * w).alias("s")) for w, f in fields]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("l", "m").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))


def permanent_tide(coeffs: DataFrame, sign: int = 1) -> DataFrame:
    """The field with the permanent tide added (1) or taken away (-1)."""
    tide = sign * TIDE_HEIGHT * TIDE_LOVE / (RADIUS * math.sqrt(4 * math.pi))
    return coeffs.withColumn("c", F.when((F.col("l") == 2) & (F.col("m") == 0), F.col("c") + tide).otherwise(F.col("c")))


def degree_one_frame(love: DataFrame, frame: str) -> DataFrame:
    """Love numbers (n, h, l, k) with degree 1 moved to another origin."""
    shift = {"CM": 1 + F.col("k"), "CF": (F.col("h") + 2 * F.col("l")) / 3, "CE": F.col("k"), "CL": F.col("l"), "CH": F.col("h")}
    if frame not in shift:
        raise ValueError(f"unknown frame {frame}")
    by = F.when(F.col("n") == 1, shift[frame]).otherwise(F.lit(0.0))
    return love.withColumn("by", by).withColumns({k: F.col(k) - F.col("by") for k in ("h", "l", "k")}).drop("by")
