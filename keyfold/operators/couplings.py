"""Wigner 3-j symbols, products of spherical harmonics, and the matrices that
multiply a field by another.

A product of two functions of orders m1 and m2 has the orders m1 + m2 and
|m1 - m2|; its degrees go in steps of two.  Only such cells are made, in one
task for each pair of orders, for all degrees at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import coefficient_key
from .spectra import _spectrum

_BIG = 1e100


def wigner_families(j2: np.ndarray, j3: np.ndarray, m2: int, m3: int) -> np.ndarray:
    """w[n, j]: the symbols (j j2[n] j3[n]; -m2-m3 m2 m3) of all j from 0 on.

    Three-term recursion in j from both ends, vectorised over families: upward
    as far as the symbols grow, downward to there, so that both run in the
    stable direction.  The families are joined at the turning point, and
    normalised by sum (2j + 1) w^2 = 1 with the sign of the largest j."""
    j2, j3 = np.asarray(j2, float), np.asarray(j3, float)
    m1 = -(m2 + m3)
    low, high = np.maximum(np.abs(j2 - j3), abs(m1)), j2 + j3
    size = int(high.max(initial=0)) + 2
    real = (j2 >= abs(m2)) & (j3 >= abs(m3)) & (low <= high)

    def a(j):
        return np.sqrt(np.maximum((j * j - (j2 - j3) ** 2) * ((j2 + j3 + 1) ** 2 - j * j) * (j * j - m1 * m1), 0.0))

    def b(j):
        return -(2 * j + 1) * ((j2 * (j2 + 1) - j3 * (j3 + 1)) * m1 - j * (j + 1) * (m3 - m2))

    up, down = np.zeros((len(j2), size + 1)), np.zeros((len(j2), size + 1))
    for j in range(size - 1):
        up[:, j] = np.where(low == j, 1.0, up[:, j])
        active = (j >= low) & (j < high) & (j > 0)
        below = up[:, j - 1] if j else 0.0
        new = -(b(j) * up[:, j] + (j + 1) * a(j) * below) / np.where(active, j * a(j + 1), 1.0)
        up[:, j + 1] = np.where(active, new, up[:, j + 1])
        big = np.abs(up[:, j + 1]) > _BIG
        up[big] /= _BIG
    for j in range(size - 1, 0, -1):
        down[:, j] = np.where(high == j, 1.0, down[:, j])
        active = (j <= high) & (j > low)
        new = -(b(j) * down[:, j] + j * a(j + 1) * down[:, j + 1]) / np.where(active, (j + 1) * a(j), 1.0)
        down[:, j - 1] = np.where(active, new, down[:, j - 1])
        big = np.abs(down[:, j - 1]) > _BIG
        down[big] /= _BIG
    down[:, 0] = np.where(high == 0, 1.0, down[:, 0])
    # The turning point: where the upward values first shrink; none if they
    # can't start, which is so where j = 0 belongs to the family.
    place = np.arange(size)
    shrinks = (np.abs(up[:, 1:]) < np.abs(up[:, :-1])) & (place >= low[:, None])
    turn = np.where(low == 0, 0, np.where(shrinks.any(axis=1), shrinks.argmax(axis=1), low)).astype(int)
    rows = np.arange(len(j2))
    near = [np.clip(turn + k, 0, size) for k in (-1, 0, 1)]
    f, g = np.array([up[rows, k] for k in near]), np.array([down[rows, k] for k in near])
    inside = np.array([(k >= low) & (k <= high) for k in near])
    f, g = f * inside, g * inside
    square = (g * g).sum(axis=0)
    share = np.where(square > 0, (f * g).sum(axis=0) / np.where(square > 0, square, 1.0), 1.0)
    share = np.where(low == 0, 1.0, share)
    w = np.where((np.arange(size + 1) < turn[:, None]) & (low > 0)[:, None], up, down * share[:, None])
    w = w * ((np.arange(size + 1) >= low[:, None]) & (np.arange(size + 1) <= high[:, None]))
    total = ((2 * np.arange(size + 1) + 1) * w * w).sum(axis=1)
    last = w[rows, np.clip(high, 0, size).astype(int)]
    sign = np.where((j2 - j3 - m1).astype(int) % 2 == 0, 1.0, -1.0) * np.sign(last)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = w * (sign / np.sqrt(total))[:, None]
    return np.where(real[:, None], np.nan_to_num(w), 0.0)[:, :size]


def order_products(m1: int, m2: int, l1: np.ndarray, l2: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For orders m1, m2 >= 0 and degrees l1[n], l2[n]: the coefficients of
    P(l1, m1) P(l2, m2) in the functions of order m1 + m2, and of |m1 - m2|:
    two times an order and an array [n, l]."""
    norm = lambda m: 1.0 if m == 0 else math.sqrt(2.0)
    plain = wigner_families(l1, l2, 0, 0)
    scale = np.sqrt((2 * l1 + 1.0) * (2 * l2 + 1.0))[:, None] * np.sqrt(2 * np.arange(plain.shape[1]) + 1.0)
    out = []
    for a, b in ((m1, m2), (m1, -m2)):
        order, w = abs(a + b), wigner_families(l1, l2, a, b)
        # Signs of the complex functions with and without the phase of Condon and Shortley.
        sign = (-1) ** (m1 + m2) if b >= 0 else (-1) ** (m1 if a + b >= 0 else m2)
        out.append((order, norm(m1) * norm(m2) / norm(order) * sign * scale * plain * w))
    return out


#: (q1, q2) -> q of the result, and the factors of the sum and of the difference of orders.
_TRIG = {(0, 0): (0, 0.5, 0.5), (1, 1): (0, -0.5, 0.5), (1, 0): (1, 0.5, 0.5), (0, 1): (1, 0.5, -0.5)}


def _pair_cells(m1: int, m2: int, lmax1: int, lmax2: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, int, np.ndarray]]:
    """l1, l2, q1, q2, (order and kind as m * 2 + q), coefficients [n, l]."""
    l1, l2 = (x.ravel() for x in np.meshgrid(np.arange(m1, lmax1 + 1), np.arange(m2, lmax2 + 1), indexing="ij"))
    products = order_products(m1, m2, l1, l2)
    for (q1, q2), (q, plus, minus) in _TRIG.items():
        if (q1 and not m1) or (q2 and not m2):
            continue
        for (order, w), by in zip(products, (plus, minus), strict=True):
            if q and m1 < m2 and by is minus and w is products[1][1]:
                by = -by  # sin(m1 - m2) = -sin(m2 - m1)
            if not (q and not order):
                yield l1, l2, q1, q2, order * 2 + q, w * by


def gaunt(spark: SparkSession, lmax1: int, lmax2: int) -> DataFrame:
    """l1, m1, q1, l2, m2, q2, l, m, q, value: Y1 Y2 = sum of value Y over all
    4-pi-normalised real functions; zeros are left out."""
    names = ["l1", "m1", "q1", "l2", "m2", "q2", "l", "m", "q", "value"]

    def run(batches):
        for batch in batches:
            for m1, m2 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for l1, l2, q1, q2, mq, w in _pair_cells(m1, m2, lmax1, lmax2):
                    n, l = np.nonzero(np.abs(w) > 1e-14)  # noqa: E741
                    if len(n):
                        cols = [l1[n], np.full(len(n), m1), np.full(len(n), q1), l2[n], np.full(len(n), m2), np.full(len(n), q2), l, np.full(len(n), mq // 2), np.full(len(n), mq % 2)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(w[n, l])], names=names)

    got = _order_pairs(spark, lmax1, lmax2).mapInArrow(run, ", ".join(f"{c} int" for c in names[:-1]) + ", value double")
    return got.groupBy(*names[:-1]).agg(F.sum("value").alias("value"))


def _order_pairs(spark: SparkSession, lmax1: int, lmax2: int) -> DataFrame:
    pairs = spark.range(lmax1 + 1).select(F.col("id").alias("m1"), F.explode(F.sequence(F.lit(0), F.lit(lmax2))).alias("m2"))
    return pairs.repartition(min((lmax1 + 1) * (lmax2 + 1), 4 * spark.sparkContext.defaultParallelism), "m1", "m2")


def multiplier(field: DataFrame, lmax_field: int, lmax_in: int, lmax_out: int | None = None) -> DataFrame:
    """Cells (row_key, col_key, value) of the matrix that multiplies a field of
    degrees to lmax_in by `field` (l, m, c, s), degrees to lmax_out of the result.

    Each task sums over the degrees of `field` for its pair of orders, so the
    shuffle holds cells of the result, not triples."""
    spark = field.sparkSession
    held = spark.sparkContext.broadcast(_spectrum(field, lmax_field))
    top = lmax_in + lmax_field if lmax_out is None else lmax_out

    def run(batches):
        for batch in batches:
            f = held.value
            for m1, m2 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for l1, l2, q1, q2, mq, w in _pair_cells(m1, m2, lmax_in, lmax_field):
                    by = f[q2][l2, m2]
                    if not by.any():
                        continue
                    total = np.zeros((lmax_in + 1, w.shape[1]))
                    np.add.at(total, l1, w * by[:, None])
                    a, l = np.nonzero(total[:, : top + 1])  # noqa: E741
                    if len(a):
                        one = lambda x: pa.array(np.full(len(a), x), pa.int32())  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), one(mq // 2), one(mq % 2), pa.array(a, pa.int32()), one(m1), one(q1), pa.array(total[a, l])], names=["l", "m", "q", "l1", "m1", "q1", "value"])

    cells = _order_pairs(spark, lmax_in, lmax_field).mapInArrow(run, "l int, m int, q int, l1 int, m1 int, q1 int, value double")
    summed = cells.groupBy("l", "m", "q", "l1", "m1", "q1").agg(F.sum("value").alias("value")).where("value <> 0")
    return summed.select(coefficient_key(F.col("l"), F.col("m"), F.col("q")).alias("row_key"), coefficient_key(F.col("l1"), F.col("m1"), F.col("q1")).alias("col_key"), "value")
