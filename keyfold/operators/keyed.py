"""Algebra of keyed matrices: cells (row_key, col_key, value), zeros left out.

Every operation is a join on keys and a partial aggregation, so a matrix may
have any number of cells; null keys and null values belong to no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), "value")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B, matched on A's column keys and B's row keys."""
    left = a.select("row_key", F.col("col_key").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("row_key").alias("k"), "col_key", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row_key", "col_key").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def matvec(a: DataFrame, v: DataFrame) -> DataFrame:
    """A v for a vector (row_key, value)."""
    right = v.select(F.col("row_key").alias("k"), F.col("value").alias("y"))
    return a.join(right, a["col_key"] == right["k"]).groupBy("row_key").agg(F.sum(F.col("value") * F.col("y")).alias("value"))


def add(a: DataFrame, b: DataFrame, wa: float = 1.0, wb: float = 1.0) -> DataFrame:
    """wa A + wb B over the union of keys."""
    return scale(a, wa).unionByName(scale(b, wb)).groupBy("row_key", "col_key").agg(F.sum("value").alias("value"))


def scale(a: DataFrame, w: float) -> DataFrame:
    return a.select("row_key", "col_key", (F.col("value") * F.lit(w)).alias("value"))


def propagate(a: DataFrame, b: DataFrame) -> DataFrame:
    """B' A B."""
    return matmul(matmul(transpose(b), a), b)


def gram(a: DataFrame) -> DataFrame:
    """The upper triangle of A' A."""
    left = a.select("row_key", F.col("col_key").alias("i"), F.col("value").alias("x"))
    right = a.select("row_key", F.col("col_key").alias("j"), F.col("value").alias("y"))
    both = left.join(right, "row_key").where("i <= j")
    return both.groupBy(F.col("i").alias("row_key"), F.col("j").alias("col_key")).agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("row_key = col_key").select("row_key", "value")


def upper(a: DataFrame) -> DataFrame:
    return a.where("row_key <= col_key")


def mirror(a: DataFrame) -> DataFrame:
    """A full symmetric matrix from its upper triangle."""
    return upper(a).unionByName(transpose(a.where("row_key < col_key")))


def correlation(a: DataFrame) -> DataFrame:
    """c_ij / (s_i s_j); cells of a variance that isn't positive are null."""
    d = diagonal(a)
    i, j = d.select(F.col("row_key"), F.col("value").alias("vi")), d.select(F.col("row_key").alias("col_key"), F.col("value").alias("vj"))
    s = F.when((F.col("vi") > 0) & (F.col("vj") > 0), F.sqrt("vi") * F.sqrt("vj"))
    return a.join(i, "row_key").join(j, "col_key").select("row_key", "col_key", F.when(F.col("row_key") == F.col("col_key"), F.lit(1.0)).otherwise(F.try_divide("value", s)).alias("value"))


def complement(a: DataFrame) -> DataFrame:
    """I - A on A's own cells."""
    one = F.when(F.col("row_key") == F.col("col_key"), 1.0).otherwise(0.0)
    return a.select("row_key", "col_key", (one - F.col("value")).alias("value"))


def norm1(a: DataFrame) -> DataFrame:
    """The greatest sum of absolute values of a column."""
    return a.groupBy("col_key").agg(F.sum(F.abs("value")).alias("s")).agg(F.max("s").alias("value"))


def submatrix(a: DataFrame, rows: tuple, cols: tuple) -> DataFrame:
    return a.where(F.col("row_key").between(*rows) & F.col("col_key").between(*cols))


def stack(*parts: DataFrame) -> DataFrame:
    """Block merge: part n's rows are told apart by block_no."""
    out = None
    for n, p in enumerate(parts):
        p = p.select(F.lit(n).alias("block_no"), "row_key", "col_key", "value")
        out = p if out is None else out.unionByName(p)
    return out


def correlate_keys(a: DataFrame, b: DataFrame, start: int, length: int, how: str = "inner") -> DataFrame:
    """Match two key lists (key) on a part of the keys; both keys are kept."""
    left = a.select(F.col("key").alias("key_a"), F.substring("key", start, length).alias("part"))
    right = b.select(F.col("key").alias("key_b"), F.substring("key", start, length).alias("part"))
    return left.join(right, "part", how)


def height_east_north(x: Column, y: Column, z: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Components along the spherical normal, east and north at lon, lat (degrees)."""
    a, b = F.radians(lon), F.radians(lat)
    up = x * F.cos(b) * F.cos(a) + y * F.cos(b) * F.sin(a) + z * F.sin(b)
    return up, y * F.cos(a) - x * F.sin(a), z * F.cos(b) - x * F.sin(b) * F.cos(a) - y * F.sin(b) * F.sin(a)


def permutation(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """key, ix: each key's place (from 0) in this order.

    Ranges of the order are counted apart and their starts added, so that no
    task sees more than its range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, F.monotonically_increasing_id().alias("at"))
    ranged = ranged.select(key, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("inner"))
    sizes = ranged.groupBy("part").agg((F.max("inner") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "part").select(key, (F.col("start") + F.col("inner")).alias("ix"))


def permuted(rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """rows with their place ix; the order is a column, nothing is moved."""
    return rows.join(places, key)


def strict_match(left: DataFrame, right: DataFrame, key: str, whole_right: bool = True) -> DataFrame:
    """The inner join, but an error if a key of left (or, with whole_right, of
    right) has no partner."""
    if not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"keys of the left side without a partner in {key}")
    if whole_right and not right.join(left, key, "left_anti").isEmpty():
        raise ValueError(f"keys of the right side without a partner in {key}")
    return left.join(right, key)


def not_empty(rows: DataFrame, what: str = "the selection") -> DataFrame:
    """rows, but an error if there are none."""
    if rows.isEmpty():
        raise ValueError(f"{what} is empty")
    return rows


def prefix_lookup(rows: DataFrame, dim: DataFrame, key: str, take: list[str], lengths: list[int], order: list[str]) -> DataFrame:
    """rows with the columns `take` of the row of dim (key, take, order) whose
    key begins alike: by the longest of these prefix lengths that has a match,
    of several the first in order; null where none has."""
    out, base = rows, rows.columns
    for k, n in enumerate(lengths):
        first = dim.groupBy(F.substring(key, 1, n).alias(f"prefix_{k}")).agg(F.min(F.struct(*order, *take)).alias(f"hit_{k}"))
        out = out.join(first, F.substring(F.col(key), 1, n) == F.col(f"prefix_{k}"), "left")
    best = F.coalesce(*(F.col(f"hit_{k}") for k in range(len(lengths))))
    return out.select(*base, *(best[c].alias(c) for c in take))
