"""Matrix filters of stacks of spherical-harmonic fields, block by block.

Filter cells (block, row_key, col_key, value): a block-diagonal filter has one
block for each order and kind of coefficient (or for their parities too), a
full one a single block.  Symmetric filters come as upper triangles.
Values (field, key, value[, sigma]) hold any number of fields.

A block is dense work for one task with many right sides: fields are dealt
into buckets, each block meets each bucket once in a cogroup, and a task holds
one block and the coefficients of one bucket's fields in it.

Defined results: a coefficient that a block knows and a field lacks counts as
zero, and comes out; one that no block knows passes through unless `drop`; null
values count as zero and null sigmas too; duplicate coefficients of a field
add; a block that isn't positive definite gives null weights; empty tables
give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectra import MAX_DEGREE

#: The largest block; bounds what a task holds.
MAX_BLOCK = 8192


def coefficient_key(l: Column, m: Column, q: Column) -> Column:  # noqa: E741
    """GCN or GSN (q 0 or 1), degree and order, three columns each."""
    return F.concat(F.when(q == 0, "GCN").otherwise("GSN"), F.lit(" "), F.lpad(l.cast("string"), 3, " "), F.lpad(m.cast("string"), 3, " "))


def key_degree(key: Column) -> Column:
    return F.trim(F.substring(key, 5, 3)).try_cast("int")


def key_order(key: Column) -> Column:
    return F.trim(F.substring(key, 8, 3)).try_cast("int")


def order_block(key: Column, parity: bool = False) -> Column:
    """The block of a coefficient: its kind and order, and with parity whether
    its degree is even."""
    parts = [F.substring(key, 1, 3), F.lpad(key_order(key).cast("string"), 3, "0")]
    return F.concat(*parts, (key_degree(key) % 2).cast("string")) if parity else F.concat(*parts)


def to_values(coeffs: DataFrame, field: str = "field") -> DataFrame:
    """(field, key, value[, sigma]) of (field, l, m, c, s[, sc, ss]); sine
    coefficients of order 0 don't exist."""
    has = "sc" in coeffs.columns
    one = lambda q, v, e: F.struct(coefficient_key(F.col("l"), F.col("m"), F.lit(q)).alias("key"), F.col(v).alias("value"), *([F.col(e).alias("sigma")] if has else []))
    both = F.when(F.col("m") == 0, F.array(one(0, "c", "sc"))).otherwise(F.array(one(0, "c", "sc"), one(1, "s", "ss")))
    return coeffs.select(F.col(field).alias("field"), F.inline(both))


def to_coefficients(values: DataFrame) -> DataFrame:
    """The inverse of to_values."""
    cos = F.col("key").startswith("GCN")
    pick = lambda v, c: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0))
    cols = [pick("value", cos).alias("c"), pick("value", ~cos).alias("s")]
    if "sigma" in values.columns:
        cols += [pick("sigma", cos).alias("sc"), pick("sigma", ~cos).alias("ss")]
    return values.groupBy("field", key_degree(F.col("key")).alias("l"), key_order(F.col("key")).alias("m")).agg(*cols)


def _square(cells: pa.Table, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the dense matrix of a block's cells."""
    rows, cols = (np.array(cells.column(c).to_pylist(), object) for c in ("row_key", "col_key"))
    keys = np.unique(np.concatenate([rows, cols]).astype(str)) if len(rows) else np.zeros(0, str)
    if len(keys) > MAX_BLOCK:
        raise ValueError(f"a block of more than {MAX_BLOCK} coefficients")
    i, j = np.searchsorted(keys, rows.astype(str)), np.searchsorted(keys, cols.astype(str))
    value = np.nan_to_num(cells.column("value").cast(pa.float64()).to_numpy())
    m = np.zeros((len(keys), len(keys)))
    np.add.at(m, (i, j), value)
    if symmetric:
        off = i != j
        np.add.at(m, (j[off], i[off]), value[off])
    return keys, m


def power_law_weights(normals: DataFrame, alpha: float, power: float) -> DataFrame:
    """Filter cells (N + alpha R)^-1 N of each block, R = l^power on the
    diagonal, for normals (block, row_key, col_key, value: upper triangle).

    The degree is read from the keys.  One block a task."""
    schema = "block string, row_key string, col_key string, value double"
    names = ["block", "row_key", "col_key", "value"]

    def one(cells: pa.Table) -> pa.Table:
        keys, n = _square(cells, True)
        r = np.array([alpha * float(k[4:7]) ** power for k in keys])
        try:
            low = np.linalg.cholesky(n + np.diag(r))
            w = np.linalg.solve(low.T, np.linalg.solve(low, n))
        except np.linalg.LinAlgError:
            w = np.full(n.shape, np.nan)
        size = len(keys)
        flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
        return pa.Table.from_arrays([pa.array([cells.column("block")[0].as_py()] * size**2), pa.array(np.repeat(keys, size).tolist()), pa.array(np.tile(keys, size).tolist()), flat], names=names)

    return normals.select(*names).groupBy("block").applyInArrow(one, schema)


def apply(values: DataFrame, cells: DataFrame, symmetric: bool = False, transpose: bool = False, complement: bool = False, reference: DataFrame | None = None, drop: bool = False, buckets: int = 16) -> DataFrame:
    """W x for every field, or W' x, or (I - W) x; sigma = sqrt(sum W^2 sigma^2).

    reference (key, value): is taken off before and put back after.  buckets:
    into how many tasks the fields of one block go at least."""
    has = "sigma" in values.columns
    kind = values.schema["field"].dataType.simpleString()
    data = values.select("field", "key", F.coalesce("value", F.lit(0.0)).cast("double").alias("value"), (F.coalesce("sigma", F.lit(0.0)) if has else F.lit(0.0)).cast("double").alias("sigma"))
    if reference is not None:
        if reference.count() > 2 * (MAX_DEGREE + 1) ** 2:
            raise ValueError("a reference of more than one field")
        less = values.select("field").distinct().crossJoin(F.broadcast(reference.select("key", (-F.col("value")).alias("value"), F.lit(0.0).alias("sigma"))))  # one spectrum
        data = data.unionByName(less)
    data = data.groupBy("field", "key").agg(F.sum("value").alias("value"), F.sqrt(F.sum(F.col("sigma") * F.col("sigma"))).alias("sigma"))
    places = cells.select("block", F.col("row_key").alias("key")).unionByName(cells.select("block", F.col("col_key").alias("key"))).distinct()
    known = data.join(places, "key").withColumn("bucket", F.pmod(F.xxhash64("field"), F.lit(buckets)).cast("int"))
    copies = cells.select(F.col("block").alias("of"), "row_key", "col_key", "value", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("share"))
    out = f"field {kind}, key string, value double, sigma double"

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["field", "key", "value", "sigma"]
        if not left.num_rows or not right.num_rows:
            return left.select(names).slice(0, 0)
        keys, w = _square(right, symmetric)
        w = w.T if transpose else w
        w = np.eye(len(keys)) - w if complement else w
        coded = left.column("field").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        col = coded.indices.to_numpy(zero_copy_only=False)
        null = coded.indices.null_count
        fields = coded.dictionary.to_pylist() + ([None] if null else [])
        col = np.where(np.isnan(col), len(fields) - 1, col).astype(int) if null else col
        row = np.searchsorted(keys, np.array(left.column("key").to_pylist(), str))
        x, e = np.zeros((len(keys), len(fields))), np.zeros((len(keys), len(fields)))
        x[row, col] = left.column("value").to_numpy()
        e[row, col] = left.column("sigma").to_numpy() ** 2
        y, s = w @ x, np.sqrt(w**2 @ e)
        n = len(keys)
        return pa.Table.from_arrays([pa.array([f for f in fields for _ in range(n)], left.schema.field("field").type), pa.array(np.tile(keys, len(fields)).tolist()), pa.array(y.T.ravel()), pa.array(s.T.ravel())], names=names)

    done = known.groupBy("block", "bucket").cogroup(copies.groupBy("of", "share")).applyInArrow(one, out)
    if not drop:
        done = done.unionByName(data.join(places, "key", "left_anti").select("field", "key", "value", "sigma"))
    if reference is not None:
        back = reference.groupBy("key").agg(F.sum("value").alias("back"))
        done = done.join(F.broadcast(back), "key", "left").withColumn("value", F.col("value") + F.coalesce("back", F.lit(0.0)))
    return done.select("field", "key", "value", *(["sigma"] if has else []))


def window_decorrelation(degrees: list[int], width: int, power: int) -> np.ndarray:
    """The matrix that takes from each coefficient of an order and parity what
    a polynomial of this power, fitted to `width` neighbours, says of it.

    At the ends the window is shifted inwards; with fewer coefficients than
    power + 2 nothing is taken away."""
    n = len(degrees)
    out = np.eye(n)
    size = min(width, n)
    if size < power + 2:
        return out
    for k in range(n):
        lo = min(max(k - size // 2, 0), n - size)
        x = np.array(degrees[lo : lo + size], float) - degrees[k]
        a = np.vander(x, power + 1, increasing=True)
        out[k, lo : lo + size] -= np.linalg.pinv(a)[0]
    return out


def decorrelation(lmax: int, from_order: int, width: int, power: int, spark) -> DataFrame:
    """Filter cells of sliding polynomial windows by order and parity, orders
    from_order to lmax.  One (kind, order, parity) is generated a row, in tasks."""
    names = "block string, row_key string, col_key string, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, q, parity in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                degrees = [l for l in range(max(m, 2), lmax + 1) if l % 2 == parity]  # noqa: E741
                if not degrees or (q and not m):
                    continue
                w = window_decorrelation(degrees, width, power)
                keys = [f"G{'CS'[q]}N {l:3d}{m:3d}" for l in degrees]  # noqa: E741
                i, j = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array([f"G{'CS'[q]}N{m:03d}{parity}"] * len(i)), pa.array([keys[a] for a in i]), pa.array([keys[b] for b in j]), pa.array(w[i, j])], names=["block", "row_key", "col_key", "value"])

    orders = spark.range(from_order, lmax + 1).select(F.col("id").alias("m"))
    grid = orders.select("m", F.explode(F.array(F.lit(0), F.lit(1))).alias("q")).select("m", "q", F.explode(F.array(F.lit(0), F.lit(1))).alias("parity"))
    return grid.mapInArrow(run, names)


def gauss_cells(cells: DataFrame, radius: float, earth: float = 6378136.46) -> DataFrame:
    """Cells with each row scaled by the Gaussian weight of its degree."""
    by = F.exp(-(key_degree(F.col("row_key")) ** 2) * F.lit((radius / earth) ** 2 / (4 * math.log(2))))
    return cells.withColumn("value", F.col("value") * by)
