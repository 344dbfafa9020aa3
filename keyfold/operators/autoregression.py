"""Autoregressive noise of series: Yule-Walker models and fits weighted by them.

A model is one small row a series, made of sums (autocovariances) and a
Levinson recursion.  The weighted fit whitens a series by the Cholesky factor
of its banded Toeplitz covariance.  That recursion goes along time, so each
series streams through one task in order of time; a task holds the last `order`
rows and the sums of the normal equations, never a series.

Defined results: rows with null time or value don't count; a series without
more rows than the order, or whose covariances aren't positive definite, has a
null model; a series without a model isn't fitted; ties in time follow the
value; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import normals

#: Rounds and tolerance of the autocorrelation's fixed point, and the least
#: ratio of the diagonal of the covariance to its first neighbour.
ROUNDS, TOLERANCE, LEAST_RATIO = 20, 1e-4, 2.1


def autocovariances(df: DataFrame, by: str, t: str, y: str, order: int) -> DataFrame:
    """by, n, gamma (lags 0 to order): sums of products of deviations over n - 1."""
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull())
    mean = rows.groupBy(by).agg(F.avg(y).alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(t, y)
    d = rows.join(mean, by).withColumn("d", F.col(y) - F.col("mean"))
    lagged = d.select(by, "n", "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, order + 1)))
    sums = [F.sum(F.col("d") * F.col(f"d{k}" if k else "d")) for k in range(order + 1)]
    return lagged.groupBy(by).agg(F.max("n").alias("n"), F.array(*(F.try_divide(s, F.max("n") - 1) for s in sums)).alias("gamma"))


def levinson(gamma: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Coefficients and innovation variance of the Toeplitz system of gamma;
    None if it isn't positive definite."""
    phi, sig2 = np.zeros(0), float(gamma[0])
    for k in range(1, len(gamma)):
        if not sig2 > 0:
            return None
        r = (gamma[k] - phi @ gamma[k - 1 : 0 : -1]) / sig2
        phi = np.append(phi - r * phi[::-1], r)
        sig2 *= 1 - r * r
    return (phi, sig2) if sig2 > 0 else None


def correlation(phi: np.ndarray) -> np.ndarray:
    """Autocorrelations at lags 0 to the order, by their fixed point."""
    p, rho = len(phi), np.zeros(len(phi) + 1)
    rho[0] = 1.0
    lags = np.abs(np.subtract.outer(np.arange(1, p + 1), np.arange(1, p + 1)))
    for _ in range(ROUNDS):
        new = np.append(1.0, rho[lags] @ phi)
        done = np.abs(new - rho).max() <= TOLERANCE
        rho = new
        if done:
            break
    return rho


def model(covariances: DataFrame, by: str) -> DataFrame:
    """by, n, parameters, sig2, band: the banded covariance at lags 0 to order,
    its diagonal raised where it is too weak against its neighbour."""
    kind = covariances.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, n long, parameters array<double>, sig2 double, band array<double>"

    def run(batches):
        for batch in batches:
            out = []
            for gamma in batch.column("gamma").to_pylist():
                got = None if any(g is None for g in gamma) else levinson(np.array(gamma))
                if got is None:
                    out.append((None, None, None))
                    continue
                phi, sig2 = got
                rho = correlation(phi)
                free = 1 - phi @ rho[1:]
                band = sig2 / free * rho if free > 0 else np.full(len(rho), np.nan)
                if len(band) > 1 and abs(band[0]) <= LEAST_RATIO * abs(band[1]):
                    band[0] = LEAST_RATIO * abs(band[1])
                out.append((phi.tolist(), sig2, band.tolist() if np.isfinite(band).all() else None))
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("n"), pa.array([o[0] for o in out], lists), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], lists)], names=[by, "n", "parameters", "sig2", "band"])

    return covariances.select(by, "n", "gamma").mapInArrow(run, schema)


class _Factor:
    """Rows of the Cholesky factor of a banded Toeplitz matrix, and what they
    make of the columns that stream by."""

    def __init__(self, band: list[float], width: int):
        self.band, self.p = np.array(band), len(band) - 1
        self.rows: list[np.ndarray] = []  # the last p rows: entries at lags p..0
        self.past = np.zeros((0, width))

    def next(self, x: np.ndarray) -> np.ndarray | None:
        """The whitened row; None if the matrix isn't positive definite."""
        p, row = self.p, np.zeros(self.p + 1)
        have = len(self.rows)
        for k in range(min(p, have), 0, -1):  # column t - k
            other = self.rows[have - k]
            # sum over columns left of t - k, which both rows have
            m = p - k
            dot = row[p - k - m : p - k] @ other[p - m : p] if m else 0.0
            row[p - k] = (self.band[k] - dot) / other[p]
        rest = self.band[0] - row[:p] @ row[:p]
        if not rest > 0:
            return None
        row[p] = np.sqrt(rest)
        z = (x - row[p - len(self.past) : p] @ self.past) / row[p] if len(self.past) else x / row[p]
        self.rows = (self.rows + [row])[-p:] if p else []
        self.past = np.vstack([self.past, z])[-p:] if p else self.past
        return z


def whitened_fit(df: DataFrame, by: str, t: str, y: str, terms: dict[str, Column], models: DataFrame) -> DataFrame:
    """sys, name, x, sigma, nobs, ltpl, sigma0 of the fit of `terms` with the
    inverse of each series' banded covariance as weight."""
    names, kind = list(terms), df.schema[by].dataType.simpleString()
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(F.col(by).alias("sys"), F.col(t).alias("t"), F.col(y).cast("double").alias("y"), *(c.cast("double").alias(f"x_{n}") for n, c in terms.items()))
    joined = rows.join(models.where("band is not null").select(F.col(by).alias("sys"), "band"), "sys").repartition("sys").sortWithinPartitions("sys", "t", "y")
    sums = [f"n_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]
    schema = ", ".join([f"sys {kind}", "nobs long", "ltpl double", *(f"b_{a} double" for a in names), *(f"{s} double" for s in sums)])
    i, j = np.triu_indices(len(names))

    def run(batches):
        now, factor, total, n = None, None, None, 0
        out: list[tuple] = []
        first = True

        def done():
            if not first and total is not None:
                k = len(names)
                out.append((now, n, total[k, k], *total[:k, k], *total[i, j]))

        def passed():
            cols = list(zip(*out, strict=True))
            kinds = [None, pa.int64()] + [pa.float64()] * (len(cols) - 2)
            got = pa.RecordBatch.from_arrays([pa.array(c, k or key_type) for c, k in zip(cols, kinds, strict=True)], names=["sys", "nobs", "ltpl", *(f"b_{a}" for a in names), *sums])
            out.clear()
            return got

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("sys").type
            keys, bands = batch.column("sys").to_pylist(), batch.column("band")
            x = np.column_stack([batch.column(f"x_{a}").to_numpy(zero_copy_only=False) for a in names] + [batch.column("y").to_numpy(zero_copy_only=False)])
            for r, key in enumerate(keys):
                if first or key != now:
                    done()
                    now, first, factor, total, n = key, False, _Factor(bands[r].as_py(), x.shape[1]), np.zeros((x.shape[1],) * 2), 0
                if total is not None:
                    z = factor.next(x[r])
                    if z is None:
                        total = None
                    else:
                        total += np.outer(z, z)
                        n += 1
            if len(out) > 1000:
                yield passed()
        done()
        if out:
            yield passed()

    return normals.solve(joined.select("sys", "band", "y", *(f"x_{a}" for a in names)).mapInArrow(run, schema), names)


def two_pass_fit(df: DataFrame, by: str, t: str, y: str, terms: dict[str, Column], order: int) -> tuple[DataFrame, DataFrame]:
    """The fit weighted by the model of the residuals of a plain fit, and those
    models (by, n, parameters, sig2, band)."""
    first = normals.solve(normals.build(df, terms, y, by), list(terms))
    wide = first.groupBy("sys").agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(f"x_{n}") for n in terms))
    fitted = df.join(wide.withColumnRenamed("sys", by), by)
    fit = sum((c * F.col(f"x_{n}") for n, c in terms.items()), F.lit(0.0))
    rest = fitted.select(by, t, (F.col(y) - fit).alias("residual"))
    models = model(autocovariances(rest, by, t, "residual", order), by)
    return whitened_fit(df, by, t, y, terms, models), models
