"""Functionals of spherical-harmonic fields: degree-dependent factors on
(l, m, c, s[, sc, ss]) spectra, smoothing weights, replaced coefficients.

Love numbers come as a table (n, h, l, k) with one row a degree, joined by
degree; a degree without Love numbers has null coefficients where they are
needed.  Everything is a projection and at most one join with that table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectra import MAX_DEGREE, RADIUS

# GM, mean densities of earth and sea water, share of the ocean in the earth's surface.
GM, RHO_EARTH, RHO_WATER, OCEAN = 0.3986004415e15, 5517.0, 1025.0, 0.70802102076271
WATER = RADIUS * RHO_EARTH / (3 * RHO_WATER)
KINDS = ("geoid", "water", "geocentric_water", "uplift", "sea_level", "total_load", "horizontal", "radial_acceleration", "gravity_anomaly")


def factor(kind: str, degree: Column, h: Column, l: Column, k: Column, degree_zero: float = 1 / OCEAN) -> Column:  # noqa: E741
    """What a Stokes coefficient of a degree is multiplied by.

    degree_zero: for sea_level, the share of degree 0: 1 / OCEAN, its negative
    (eustatic rise), or 1."""
    radius, micro = F.lit(RADIUS), F.lit(GM * 1e8 / RADIUS**2)
    known = {
        "geoid": radius + 0 * degree,
        "water": WATER * (2 * degree + 1) / (1 + k),
        "geocentric_water": WATER * (2 * degree + 1) / (1 + k) - radius * h / (1 + k),
        "uplift": radius * h,
        "sea_level": F.when(degree == 0, F.lit(degree_zero * WATER)).otherwise(radius * (1 + k - h)),
        "total_load": 1 + k,
        "horizontal": radius * l,
        "radial_acceleration": (degree + 1) * micro,
        "gravity_anomaly": (degree - 1) * micro,
    }
    if kind not in known:
        raise ValueError(f"no such functional: {kind}")
    return known[kind]


def scale(coeffs: DataFrame, kind: str, love: DataFrame | None = None, inverse: bool = False, degree_zero: float = 1 / OCEAN) -> DataFrame:
    """coeffs as another functional, or back; sigmas sc, ss too.  A factor of
    zero has no inverse: null."""
    rows = coeffs
    if love is not None:
        rows = rows.join(love.select(F.col("n").alias("l"), F.col("h").alias("love_h"), F.col("l").alias("love_l"), F.col("k").alias("love_k")), "l", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("love_h", "love_l", "love_k")})
    by = factor(kind, F.col("l"), F.col("love_h"), F.col("love_l"), F.col("love_k"), degree_zero)
    put = lambda c: F.try_divide(F.col(c), by) if inverse else F.col(c) * by
    return rows.withColumns({c: put(c) for c in ("c", "s", "sc", "ss") if c in coeffs.columns}).select(*coeffs.columns)


def gauss_recursive(radius: float, lmax: int, least: float = 1e-7) -> list[float]:
    """Weights of degrees 0 to lmax of a Gaussian with this half-width in m, by
    the recursion of Jekeli; from the first weight below `least` on, 0 (that
    weight itself stays)."""
    if not 0 < radius or lmax > MAX_DEGREE:
        raise ValueError("a positive radius and no degree beyond the highest")
    b = math.log(2) / (1 - math.cos(radius / RADIUS))
    out = [1.0, (1 + math.exp(-2 * b)) / (1 - math.exp(-2 * b)) - 1 / b]
    while len(out) <= lmax and (len(out) == 2 or out[-1] >= least):
        n = len(out) - 1
        out.append(out[-2] - (2 * n + 1) / b * out[-1])
    return (out + [0.0] * (lmax + 1))[: lmax + 1]


def smooth(coeffs: DataFrame, weights: list[float]) -> DataFrame:
    """coeffs times a weight of each degree; 0 beyond the weights."""
    table = F.array(*(F.lit(float(w)) for w in weights))
    by = F.coalesce(F.get(table, F.col("l")), F.lit(0.0))
    return coeffs.withColumns({c: F.col(c) * by for c in ("c", "s", "sc", "ss") if c in coeffs.columns})


def replace_c20(coeffs: DataFrame, series: DataFrame, start: str = "stime", end: str = "etime") -> DataFrame:
    """C20 of fields with a time span (columns start and end) from a series
    (t, c20): the mean inside the span; 0 where the series has nothing there.

    The series is one value a month; it is joined with the distinct spans."""
    spans = coeffs.where("l = 2 and m = 0").select(start, end).distinct()
    inside = (F.col("t") >= F.col(start)) & (F.col("t") <= F.col(end))
    mean = spans.join(series.select("t", "c20"), inside, "left").groupBy(start, end).agg(F.coalesce(F.avg("c20"), F.lit(0.0)).alias("new_c20"))
    hit = (F.col("l") == 2) & (F.col("m") == 0) & F.col("new_c20").isNotNull()
    return coeffs.join(mean, [start, end], "left").withColumn("c", F.when(hit, F.col("new_c20")).otherwise(F.col("c"))).select(*coeffs.columns)


def add_rates(coeffs: DataFrame, rates: DataFrame, time: str = "t", origin: float = 2000.0) -> DataFrame:
    """coeffs (with a column of decimal years) plus rates (l, m, c, s) a year
    since the origin; coefficients without a rate stay."""
    rate = rates.groupBy("l", "m").agg(F.sum("c").alias("rate_c"), F.sum("s").alias("rate_s"))
    rows, dt = coeffs.join(rate, ["l", "m"], "left"), F.col(time) - origin
    return rows.withColumns({c: F.col(c) + F.coalesce(F.col(f"rate_{c}"), F.lit(0.0)) * dt for c in ("c", "s")}).select(*coeffs.columns)
