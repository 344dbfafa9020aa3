"""Rotation of fields by Euler angles, degree by degree.

Degrees don't mix, so a degree of all fields of a bucket is one group: its
Wigner matrix is made once, by recursion, for all of them.

Defined results: coefficients that aren't there count as zero, nulls too; a
degree that a field lacks stays lacking; empty tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectra import MAX_DEGREE


def wigner_d(degree: int, beta: float) -> np.ndarray:
    """d[m' + l, m + l] of this degree, from half-integer degree to degree:
    each is an average of products of the one before with cos and sin of beta/2."""
    p, q = math.cos(beta / 2), math.sin(beta / 2)
    d = np.ones((1, 1))
    for n in range(1, 2 * degree + 1):
        i, k = np.arange(n, dtype=float)[:, None], np.arange(n, dtype=float)[None, :]
        new = np.zeros((n + 1, n + 1))
        new[:-1, :-1] += np.sqrt((n - i) * (n - k)) * d * p
        new[1:, :-1] += np.sqrt((i + 1) * (n - k)) * d * q
        new[:-1, 1:] -= np.sqrt((n - i) * (k + 1)) * d * q
        new[1:, 1:] += np.sqrt((i + 1) * (k + 1)) * d * p
        d = new / n
    return d


def _turn(c: np.ndarray, s: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [m, field] of f(lon + angle)."""
    m = np.arange(len(c))[:, None] * angle
    return c * np.cos(m) + s * np.sin(m), s * np.cos(m) - c * np.sin(m)


def rotate_degree(c: np.ndarray, s: np.ndarray, d: np.ndarray, alpha: float, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [m, field] of g(x) = f(Rz(alpha) Ry(beta) Rz(gamma) x), for
    d the Wigner matrix of beta."""
    degree = len(c) - 1
    c, s = _turn(c, s, alpha)
    m = np.arange(1, degree + 1)[:, None]
    a = np.zeros((2 * degree + 1, c.shape[1]), complex)
    a[degree] = c[0]
    a[degree + 1 :] = (-1.0) ** m * (c[1:] - 1j * s[1:]) / math.sqrt(2)
    a[:degree] = ((c[1:] + 1j * s[1:]) / math.sqrt(2))[::-1]
    b = d @ a
    c, s = np.zeros_like(c), np.zeros_like(s)
    c[0] = b[degree].real
    c[1:], s[1:] = (math.sqrt(2) * (-1.0) ** m * b[degree + 1 :]).real, -(math.sqrt(2) * (-1.0) ** m * b[degree + 1 :]).imag
    return _turn(c, s, gamma)


def rotate(coeffs: DataFrame, alpha: float, beta: float, gamma: float, field: str = "field", buckets: int = 16) -> DataFrame:
    """field, l, m, c, s of g(x) = f(R x), R = Rz(alpha) Ry(beta) Rz(gamma), in
    radians.  The inverse is rotate(g, -gamma, -beta, -alpha)."""
    kind = coeffs.schema[field].dataType.simpleString()
    value = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    rows = coeffs.where("m between 0 and l").groupBy(F.col(field).alias("field"), F.col("l").cast("int").alias("l"), F.col("m").cast("int").alias("m")).agg(value("c"), value("s"))

    def one(part: pa.Table) -> pa.Table:
        degree = part.column("l")[0].as_py()
        if degree > MAX_DEGREE:
            raise ValueError(f"degrees beyond {MAX_DEGREE}")
        names: dict = {}
        col = np.array([names.setdefault(f, len(names)) for f in part.column("field").to_pylist()])
        m = part.column("m").to_numpy()
        c, s = np.zeros((degree + 1, len(names))), np.zeros((degree + 1, len(names)))
        c[m, col], s[m, col] = part.column("c").to_numpy(), np.where(m > 0, part.column("s").to_numpy(), 0.0)
        c, s = rotate_degree(c, s, wigner_d(degree, beta), alpha, gamma)
        n = degree + 1
        return pa.table({"field": pa.array([f for f in names for _ in range(n)], part.schema.field("field").type), "l": pa.array(np.full(n * len(names), degree), pa.int32()), "m": pa.array(np.tile(np.arange(n), len(names)), pa.int32()), "c": c.T.ravel(), "s": s.T.ravel()})

    got = rows.groupBy("l", F.pmod(F.xxhash64("field"), F.lit(buckets)).alias("bucket"))
    return got.applyInArrow(one, f"field {kind}, l int, m int, c double, s double").withColumnRenamed("field", field)
