"""Whitening of embeddings from exact integer sums.

Entries c become whole numbers floor(64 c) + 1000000.  Their sums and
cross-products are gathered without rounding: each task subtracts the shift,
multiplies blocks of rows whose products stay below 2**53, and carries the
results into limbs of 20 bits; Spark adds the limbs of all tasks; the driver
puts the limbs together as Python integers, forms n X'X - S S' exactly and only
then rounds it, once, for eigh.  What reaches the driver is one matrix of the
vectors' dimension, whatever the number of rows.

Defined results: a vector that is null, empty or holds null or non-finite
entries is dropped; so is one whose length isn't the most frequent (of equally
frequent lengths the smaller counts).  Entries beyond 2**62 / 64 count as that.
Null, repeated or tied ids are rows like others.  A component whose variance
is zero to double precision (relative 1e-16 a dimension) isn't returned, so a
table of one distinct vector, like an empty one, gives no rows.  Other columns
are ignored, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

SCALE, SHIFT = 64, 1_000_000
LIMB = 20
#: Rows of a block: products of two limbs, added over a block, are below 2**53.
BLOCK_ROWS = 1 << 12
MAX_DIMENSION = 2048
_FAR = 2.0**62


class Scatter(NamedTuple):
    """Exact sums: n, the sum of y and n Y'Y - S S' for y = x - SHIFT."""

    n: int
    sums: list[int]
    scatter: np.ndarray


class Whitening(NamedTuple):
    """Unit eigenvectors (one a row) and eigenvalues of the covariance, falling."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a list column: for each length the usable rows and their y as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    parent = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    fine = length > 0
    fine[parent[~np.isfinite(flat)]] = False
    for d in np.unique(length[fine]):
        rows = np.flatnonzero(fine & (length == d))
        keep = np.zeros(len(length), bool)
        keep[rows] = True
        with np.errstate(over="ignore"):
            y = np.floor(SCALE * flat[keep[parent]])
        yield rows, np.clip(y, -_FAR, _FAR).reshape(-1, int(d))


class Sums:
    """Cross-products of whole numbers as limbs: value = sum of limb << 20 w."""

    def __init__(self, d: int):
        self.limbs: dict[int, np.ndarray] = {}
        self.d = d

    def add(self, y: np.ndarray) -> None:
        """Add y'y for the rows of y with a column of ones behind them."""
        whole = np.concatenate([y.astype(np.int64), np.ones((len(y), 1), np.int64)], axis=1)
        for at in range(0, len(whole), BLOCK_ROWS):
            rest, parts = whole[at : at + BLOCK_ROWS], []
            while True:
                if np.abs(rest).max(initial=0) <= 1 << LIMB:
                    parts.append(rest.astype(float))
                    break
                parts.append((rest & ((1 << LIMB) - 1)).astype(float))
                rest = rest >> LIMB
            for a, left in enumerate(parts):
                for b, right in enumerate(parts):
                    self._put(a + b, (left.T @ right).astype(np.int64))
            self._carry()

    def _put(self, w: int, more: np.ndarray) -> None:
        self.limbs[w] = self.limbs[w] + more if w in self.limbs else more

    def _carry(self) -> None:
        w = 0
        while w <= max(self.limbs):
            if w in self.limbs:
                up = np.where(np.abs(self.limbs[w]) >= 1 << (2 * LIMB), self.limbs[w] >> LIMB, 0)
                if up.any():
                    self.limbs[w] = self.limbs[w] - (up << LIMB)
                    self._put(w + 1, up)
            w += 1

    def rows(self) -> pa.RecordBatch:
        i, j = np.triu_indices(self.d + 1)
        some = [(w, x[i, j]) for w, x in sorted(self.limbs.items())]
        n = len(i)
        cols = [np.full(n * len(some), self.d), np.tile(i, len(some)), np.tile(j, len(some)), np.repeat([w for w, _ in some], n), np.concatenate([x for _, x in some])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["d", "i", "j", "w", "part"])
        return batch.filter(pc.not_equal(batch.column("part"), 0))


def scatter(table: DataFrame, column: str = "embedding") -> Scatter | None:
    """Exact sums over all rows of the most frequent length; None without rows."""

    def run(batches):
        sums: dict[int, Sums] = {}
        for batch in batches:
            for rows, y in vectors(batch.column(0)):
                d = y.shape[1]
                if d > MAX_DIMENSION:
                    raise ValueError(f"vectors of more than {MAX_DIMENSION} entries")
                sums.setdefault(d, Sums(d)).add(y)
        yield from (s.rows() for s in sums.values())

    limbs = mapped(table.select(column), run, "d int, i int, j int, w int, part long").groupBy("d", "i", "j", "w").agg(F.sum("part").alias("part"))
    found: dict[int, np.ndarray] = {}
    for r in limbs.collect():  # limbs of one matrix for each length
        m = found.setdefault(r["d"], np.zeros((r["d"] + 1, r["d"] + 1), object))
        m[r["i"], r["j"]] += r["part"] << (LIMB * r["w"])
    if not found:
        return None
    d = max(found, key=lambda k: (found[k][k, k], -k))
    m = found[d]
    n, s = m[d, d], [m[i, d] for i in range(d)]
    out = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = n * m[i, j] - s[i] * s[j]
    return Scatter(n, s, out)


def decompose(sums: Scatter, most: int = 32) -> Whitening:
    """Leading components.  Each eigenvalue is v'Av / v'v of the exact matrix A
    and its computed vector v, so that small ones keep their relative accuracy."""
    a, n = sums.scatter, sums.n
    d = len(a)
    square = n * n
    cov = np.array([[a[i, j] / square for j in range(d)] for i in range(d)], float)  # int / int rounds once
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1].T[:most]
    v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    values = []
    for row in v:
        whole = np.array([int(x) for x in np.rint(row * 2.0**52)], object)
        values.append(int(whole @ (a @ whole)) / (square * int(whole @ whole)))
    order = sorted(range(len(v)), key=lambda k: -values[k])
    v, e = v[order], np.array([values[k] for k in order])
    real = e > (e[0] if len(e) else 0.0) * d * 1e-16
    return Whitening(n, sums.sums, v[real], e[real], sum(a[i, i] for i in range(d)) / square)


def _centred(w: Whitening, y: np.ndarray) -> np.ndarray:
    """n y - S as whole numbers: int64, or Python's where they may not fit."""
    reach = max([abs(s) for s in w.sums], default=0) + w.n * int(np.abs(y).max(initial=0))
    if reach < 1 << 62:
        return w.n * y.astype(np.int64) - np.array(w.sums, np.int64)
    return w.n * y.astype(np.int64).astype(object) - np.array(w.sums, object)


def _project(w: Whitening, centred: np.ndarray) -> np.ndarray:
    return (centred / w.n).astype(float) @ w.components.T / np.sqrt(w.values)


def _squares(centred: np.ndarray) -> list[int]:
    if centred.dtype != object and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    whole = centred.astype(object)
    return (whole * whole).sum(axis=1).tolist()


def identity_error(table: DataFrame, w: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the
    identity, from a pass over all rows."""
    held, d, k = table.sparkSession.sparkContext.broadcast(w), len(w.sums), len(w.values)

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, y in vectors(batch.column(0)):
                if y.shape[1] == d:
                    z = np.concatenate([_project(held.value, _centred(held.value, y)), np.ones((len(y), 1))], axis=1)
                    total += z.T @ z
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    sums = np.zeros((k + 1, k + 1))
    for r in mapped(table.select(column), run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # one small matrix
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["value"]
    mean = sums[:k, k] / w.n
    return float(np.abs(sums[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(table: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = 32) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error and
    deviation_exact, for each usable row and component.

    deviation is the sum of (n x - S)**2 over the dimensions; null where it
    passes a long, deviation_exact then still has its digits."""
    kind = table.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    rows = table.select(key, column)
    sums = scatter(rows, column)
    if sums is None:
        return table.sparkSession.createDataFrame([], out)
    w = decompose(sums, most)
    k, d = len(w.values), len(w.sums)
    if not k:
        return table.sparkSession.createDataFrame([], out)
    error = identity_error(rows, w, column)
    held = table.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            for at, y in vectors(batch.column(1)):
                if y.shape[1] != d:
                    continue
                w = held.value
                for lo in range(0, len(y), BLOCK_ROWS):
                    part = _centred(w, y[lo : lo + BLOCK_ROWS])
                    z, sq, n = _project(w, part), _squares(part), len(part)
                    where = pa.array(np.repeat(at[lo : lo + BLOCK_ROWS], k))
                    exact = pa.array([str(x) for x in sq])
                    each = pa.array(np.repeat(np.arange(n), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(where),
                            pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                            pa.array(np.full(n * k, w.n), pa.int64()),
                            pa.array([x if x < 1 << 63 else None for x in sq], pa.int64()).take(each),
                            pa.array(z.ravel()),
                            pa.array(np.tile(w.values / w.trace, n)),
                            pa.array(np.full(n * k, error)),
                            exact.take(each),
                        ],
                        names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                    )

    return mapped(rows, run, out)
