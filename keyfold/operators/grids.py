"""Global grids: what they are, and their spectra by Fourier transforms of rings.

A grid is (by..., lon, lat, value), degrees.  `inspect` tells its step and
registration; `analyse_rings` transforms each ring of latitude by an FFT and
sends ring spectra, not cells, to the sum over rings of an order.

Defined results: null values count as zero, rows with a null position don't
count; a grid with cells off its lattice isn't equidistant to inspect, and
analyse_rings raises on it; repeated cells add; grids of null names are left
out of inspect; an empty grid gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectra import MAX_DEGREE, legendre

#: Values of rings that a task holds before it passes their spectra on.
RING_VALUES = 1 << 23


def inspect(grid: DataFrame, by: list[str] | None = None, tolerance: float = 1e-5) -> DataFrame:
    """by..., nlon, nlat, step (of latitudes), lon0, lat0, equidistant (lattice,
    one step in both directions), global_lon, global_lat, complete (a cell at
    each node), registration (pixel, gridline or null), greenwich (the grid is
    centred there).  Two passes over the grid, and no order of it."""
    by = by or []
    size = grid.groupBy(*by).agg(F.count("*").alias("cells"), F.countDistinct("lon").alias("nlon"), F.countDistinct("lat").alias("nlat"), *(f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("low", F.min), ("high", F.max))))
    step = lambda c: F.try_divide(F.col(f"high_{c}") - F.col(f"low_{c}"), F.col(f"n{c}") - 1)
    size = size.withColumns({"step": F.coalesce(step("lat"), F.lit(0.0)), "step_lon": F.coalesce(step("lon"), F.lit(0.0))})
    joined = grid.select(*by, "lon", "lat").join(size, by) if by else grid.select("lon", "lat").crossJoin(F.broadcast(size))  # one row
    off = lambda c, s: F.abs(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(s)) - F.round(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(s))))
    odd = joined.groupBy(*by).agg(F.greatest(F.max(off("lon", "step_lon")), F.max(off("lat", "step"))).alias("off"))
    got = size.join(odd, by) if by else size.crossJoin(odd)
    near = lambda a, b: F.abs(a - b) < tolerance * F.col("step")
    left = F.when(F.col("low_lon") < -tolerance, F.lit(-180.0)).otherwise(F.lit(0.0))
    return got.select(
        *by,
        "nlon",
        "nlat",
        "step",
        F.col("low_lon").alias("lon0"),
        F.col("low_lat").alias("lat0"),
        ((F.col("off") < tolerance) & (F.abs(F.col("step") - F.col("step_lon")) < tolerance * F.col("step"))).alias("equidistant"),
        (360 - (F.col("high_lon") - F.col("low_lon")) < F.col("step") * (1 + tolerance)).alias("global_lon"),
        (180 - (F.col("high_lat") - F.col("low_lat")) < F.col("step") * (1 + tolerance)).alias("global_lat"),
        (F.col("cells") == F.col("nlon") * F.col("nlat")).alias("complete"),
        F.when(near(F.col("low_lon"), left), "gridline").when(near(F.col("low_lon"), left + F.col("step") / 2), "pixel").alias("registration"),
        (F.col("low_lon") < -tolerance).alias("greenwich"),
    )


def ring_weights(lat: np.ndarray, step: float, how: str) -> np.ndarray:
    """Weights of rings at these latitudes (degrees), which sum to 2.

    area: the cells' share of the sphere.  exact: the quadrature that is exact
    for all products of two functions up to the degree that the grid allows, of
    cell centres or, with an even number of rings, of rings from the north pole
    on (the south pole has no weight)."""
    n = round(180 / step)
    theta = np.radians(90 - lat)
    if how == "area":
        half = math.radians(step) / 2
        return np.maximum(np.sin(np.minimum(np.radians(lat) + half, math.pi / 2)) - np.sin(np.maximum(np.radians(lat) - half, -math.pi / 2)), 0.0)
    place = (90 - lat) / step
    if np.allclose(place - np.floor(place), 0.5, atol=1e-6):
        k = np.arange(1, n // 2 + 1)
        edge = np.where(2 * k == n, 0.5, 1.0)
        return 2 / n * (1 - 2 * (edge * np.cos(2 * np.outer(theta, k)) / (4 * k**2 - 1)).sum(axis=1))
    if np.allclose(place, np.round(place), atol=1e-6):
        if n % 2:
            raise ValueError("exact weights of grid lines need an even number of rings")
        l = np.arange(n // 2)  # noqa: E741
        w = 4 / n * np.sin(theta) * (np.sin(np.outer(theta, 2 * l + 1)) / (2 * l + 1)).sum(axis=1)
        return np.where(np.round(place) == n, 0.0, w)
    raise ValueError("rings are neither at cell centres nor on grid lines")


def analyse_rings(grid: DataFrame, lmax: int, step: float, by: list[str] | None = None, weights: str = "exact", lon: str = "lon", lat: str = "lat", value: str = "value") -> DataFrame:
    """by..., l, m, c, s of fields on a global grid with this step in degrees.

    First a task gathers its rows by ring, fills what is missing with zeros and
    transforms each ring; as all is linear, a ring may be spread over tasks.
    Then each order's ring spectra meet in one group, where Legendre functions
    of that order are summed over the rings."""
    by = by or []
    ring = round(360 / step)
    if lmax > MAX_DEGREE or 2 * lmax >= ring or (weights == "exact" and 2 * lmax > ring // 2 - 1):
        raise ValueError("the grid is too coarse for that degree")
    kinds = dict(grid.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    comma = ", " if by else ""
    spectra = f"{keys}{comma}ring double, m int, re double, im double"

    def transform(batches):
        held: dict[tuple, np.ndarray] = {}
        types = None

        def passed():
            names, rows = list(held), np.array(list(held.values())).reshape(len(held), 2 + ring)
            f = np.fft.rfft(rows[:, 2:], axis=1)[:, : lmax + 1] * np.exp(-1j * np.outer(np.radians(rows[:, 1]), np.arange(lmax + 1)))
            many = lmax + 1
            cols = [pa.array([k[j] for k in names for _ in range(many)], types[b]) for j, b in enumerate(by)]
            cols += [pa.array(np.repeat(rows[:, 0], many)), pa.array(np.tile(np.arange(many), len(names)), pa.int32()), pa.array(f.real.ravel()), pa.array(-f.imag.ravel())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*by, "ring", "m", "re", "im"])

        for batch in batches:
            types = {b: batch.schema.field(b).type for b in by}
            phi, x, z = (batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (lat, lon, value))
            fine = ~np.isnan(phi + x)
            names = list(zip(*(batch.column(k).to_pylist() for k in by), strict=True)) if by else [()] * batch.num_rows
            index: dict[tuple, list[int]] = {}
            for k in np.flatnonzero(fine):
                index.setdefault((*names[k], round(phi[k], 9)), []).append(int(k))
            for name, rows in index.items():
                if name not in held:
                    start = x[rows[0]] - math.floor(x[rows[0]] / step + 1e-9) * step  # offset of the lattice
                    held[name] = np.concatenate([[phi[rows[0]], start], np.zeros(ring)])
                one = held[name]
                place = (x[rows] - one[1]) / step
                if np.abs(place - np.round(place)).max() > 1e-5:
                    raise ValueError("longitudes off the lattice")
                np.add.at(one, 2 + np.round(place).astype(int) % ring, np.nan_to_num(z[rows]))
                if len(held) * (ring + 2) > RING_VALUES:
                    yield passed()
        if held:
            yield passed()

    def total(rings: pa.Table) -> pa.Table:
        m = rings.column("m")[0].as_py()
        phi, re, im = (rings.column(c).to_numpy() for c in ("ring", "re", "im"))
        w = ring_weights(phi, step, weights) * math.radians(step) / (4 * math.pi)
        p = np.array([x for l, k, x in order(m, np.sin(np.radians(phi)))])  # noqa: E741
        n = len(p)
        cols = [pa.array([rings.column(b)[0].as_py()] * n, rings.schema.field(b).type) for b in by]
        cols += [pa.array(np.arange(m, m + n), pa.int32()), pa.array(np.full(n, m), pa.int32()), pa.array(p @ (w * re)), pa.array(p @ (w * im))]
        return pa.Table.from_arrays(cols, names=[*by, "l", "m", "c", "s"])

    def order(m, t):
        return legendre(lmax, t, m)

    ringed = grid.select(*by, lon, lat, value).mapInArrow(transform, spectra)
    return ringed.groupBy(*by, "m").applyInArrow(total, f"{keys}{comma}l int, m int, c double, s double")
