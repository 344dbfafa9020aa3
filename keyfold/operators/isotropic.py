"""Functions of the distance from a point: series of Legendre polynomials.

A spectrum (l, a) is small and goes to the tasks; points (colatitudes) are
large and stay where they are.  Series whose coefficients don't fall off
converge by taking their limit apart: a_l = constant + inverse / l + rest, where
the sums of P_l and of P_l / l are known in closed form.

Defined results: null colatitudes, and 0 where a limit is singular, have null
values; coefficients that aren't there count as zero.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The highest degree of a spectrum.
MAX_TERMS = 100_000


def closed_sums(theta: np.ndarray, derivative: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of P_l (from l = 0) and of P_l / l (from l = 1), or their derivatives."""
    s, c = np.sin(theta / 2), np.cos(theta / 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        if derivative:
            return -c / (4 * s * s), -c / 2 * (1 / s + 1 / (1 + s))
        return 1 / (2 * s), -np.log(s * (1 + s))


def legendre_sum(theta: np.ndarray, a: np.ndarray, derivative: bool) -> np.ndarray:
    """Sum of a[l] P_l(cos theta), or of its derivative by theta."""
    t, total = np.cos(theta), np.zeros_like(theta)
    before, now, d_before, d_now = np.zeros_like(t), np.ones_like(t), np.zeros_like(t), np.zeros_like(t)
    for l, x in enumerate(a):  # noqa: E741
        if x:
            total += x * (d_now if derivative else now)
        after = ((2 * l + 1) * t * now - l * before) / (l + 1)
        # P'(l + 1) = P'(l - 1) + (2l + 1) P(l)
        d_after = d_before + (2 * l + 1) * now
        before, now, d_before, d_now = now, after, d_now, d_after
    return -np.sin(theta) * total if derivative else total


def evaluate(points: DataFrame, spectrum: DataFrame, theta: str = "theta", value: str = "value", derivative: bool = False, constant: float = 0.0, inverse: float = 0.0) -> DataFrame:
    """points (colatitudes in degrees) with sum a_l P_l(cos theta), or its
    derivative by theta (radians).

    constant, inverse: what the coefficients tend to, constant + inverse / l;
    the series then goes on to infinity with those."""
    top = spectrum.agg(F.max("l")).first()[0]
    if top is not None and top > MAX_TERMS:
        raise ValueError(f"degrees beyond {MAX_TERMS}")
    a = np.zeros(0 if top is None else top + 1)
    for r in spectrum.groupBy("l").agg(F.sum("a").alias("a")).collect():  # one row a degree
        a[r["l"]] = r["a"] or 0.0
    l = np.arange(len(a))  # noqa: E741
    a = a - constant - np.divide(inverse, l, out=np.zeros(len(a)), where=l > 0)
    held = points.sparkSession.sparkContext.broadcast(a)
    out = points.withColumn(value, F.lit(None).cast("double")).schema

    def run(batches):
        for batch in batches:
            x = np.radians(batch.column(theta).cast(pa.float64()).to_numpy(zero_copy_only=False))
            got = legendre_sum(x, held.value, derivative)
            if constant or inverse:
                one, two = closed_sums(x, derivative)
                got = got + (constant * one if constant else 0.0) + (inverse * two if inverse else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, mask=~np.isfinite(got))], names=[*batch.schema.names, value])

    return points.mapInArrow(run, out)


def green_spectra(love: DataFrame, radius: float, mass: float) -> dict[str, DataFrame]:
    """Spectra (l, a) of the displacement by a unit point load, from Love
    numbers (n, h, l, k): up (of P_l), tangential (of dP_l), geoid (of P_l)."""
    by = radius / mass
    n = F.col("n").cast("int").alias("l")
    return {"up": love.select(n, (by * F.col("h")).alias("a")), "tangential": love.select(n, (by * F.col("l")).alias("a")), "geoid": love.select(n, (by * (1 + F.col("k"))).alias("a"))}


def disk_spectrum(spark, radius_degrees: float, lmax: int) -> DataFrame:
    """l, a of a disk of height 1: a_0 = (1 - cos) / 2, a_l = (P_(l-1) - P_(l+1)) / 2."""
    t = math.cos(math.radians(radius_degrees))
    p = [1.0, t]
    for l in range(1, lmax + 1):  # noqa: E741
        p.append(((2 * l + 1) * t * p[l] - l * p[l - 1]) / (l + 1))
    rows = [(0, (1 - t) / 2)] + [(l, (p[l - 1] - p[l + 1]) / 2) for l in range(1, lmax + 1)]
    return spark.createDataFrame(rows, "l int, a double")
