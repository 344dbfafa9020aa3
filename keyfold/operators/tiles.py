"""Factorisation of large symmetric systems by tiles of keys.

Cells (row_key, col_key, value: upper triangle) are dealt into square tiles;
right sides (row_key, rhs_no, value) become extra rows below the matrix, so
that one factorisation also does the forward substitution.  Column of tiles
after column of tiles is made from the columns before it: each step is one
group per row of tiles, in which a task holds that row and the pivot's row and
never the matrix.  Every column is written to the shared folder before the
next begins, so a lost executor costs one step.

Defined results: null values and cells that aren't there are zeros, repeated
cells add; a matrix that isn't positive definite gives nulls from the first
pivot on that isn't; no cells give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder
from .keyed import permutation

#: Keys of a tile.
TILE = 512
_TILE = "i int, j int, rows int, cols int, data binary"


class Factor(NamedTuple):
    """tiles of L (lower; i, j, rows, cols, data), the last row of tiles being
    (L^-1 B)'; places (row_key, ix); tiles in a row; keys; keys of a tile;
    right sides."""

    tiles: DataFrame
    places: DataFrame
    count: int
    keys: int
    tile: int
    sides: int


def _array(rows: int, cols: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data).reshape(rows, cols)


def _dense(shape: tuple[int, int], part: pa.Table) -> np.ndarray:
    out = np.zeros(shape)
    np.add.at(out, (part.column("r").to_numpy(), part.column("c").to_numpy()), np.nan_to_num(part.column("value").to_numpy()))
    return out


def pack(cells: DataFrame, rhs: DataFrame | None = None, first: str = "", tile: int = TILE) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Lower tiles of the matrix with right sides below, places, tiles, keys and
    right sides.  first: keys that match come first in the order."""
    keys = cells.select("row_key").unionByName(cells.select(F.col("col_key").alias("row_key")))
    if rhs is not None:
        keys = keys.unionByName(rhs.select("row_key"))
    keys = keys.where("row_key is not null").distinct()
    late = ~F.col("row_key").rlike(first) if first else F.lit(False)
    spark = cells.sparkSession
    path = fresh_folder(spark, "places")
    permutation(keys.select("row_key", late.alias("late")), "row_key", [F.asc("late"), F.asc("row_key")]).write.parquet(path)
    places = spark.read.parquet(path)
    n = places.count()
    sides = 0 if rhs is None else int(rhs.agg(F.max("rhs_no")).first()[0] or 0)
    count = -(-n // tile)
    at = places.select("row_key", "ix")
    both = cells.join(at.withColumnRenamed("ix", "a"), "row_key").join(at.select(F.col("row_key").alias("col_key"), F.col("ix").alias("b")), "col_key")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    value = F.coalesce("value", F.lit(0.0)).cast("double").alias("value")
    lower = both.select(high.alias("row"), low.alias("col"), value)
    entry = lower.select(F.floor(F.col("row") / tile).cast("int").alias("i"), F.floor(F.col("col") / tile).cast("int").alias("j"), (F.col("row") % tile).cast("int").alias("r"), (F.col("col") % tile).cast("int").alias("c"), "value")
    if rhs is not None:
        below = rhs.join(at, "row_key").select(F.lit(count).cast("int").alias("i"), F.floor(F.col("ix") / tile).cast("int").alias("j"), (F.col("rhs_no") - 1).cast("int").alias("r"), (F.col("ix") % tile).cast("int").alias("c"), value)
        entry = entry.unionByName(below)

    def one(part: pa.Table) -> pa.Table:
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        high = sides if i == count else min(tile, n - i * tile)
        wide = min(tile, n - j * tile)
        m = _dense((high, wide), part)
        if i == j:
            m = m + np.tril(m, -1).T
        return _tile_row({"i": i, "j": j}, m)

    path = fresh_folder(spark, "tiles")
    entry.groupBy("i", "j").applyInArrow(one, _TILE).write.parquet(path)
    return spark.read.parquet(path), places, count, n, sides


def _row(table: pa.Table, role: str) -> dict[int, np.ndarray]:
    got = table.filter(pa.compute.equal(table.column("role"), role))
    return {j: _array(r, c, d) for j, r, c, d in zip(*(got.column(k).to_pylist() for k in ("j", "rows", "cols", "data")), strict=True)}


def _column(k: int, count: int, tile: int, n: int, sides: int):
    """A row of tiles' part of column k, from its earlier tiles and the pivot row's."""
    wide = min(tile, n - k * tile)

    def one(part: pa.Table) -> pa.Table:
        i = part.column("target")[0].as_py()
        high = sides if i == count else min(tile, n - i * tile)
        pivot, own = _row(part, "pivot"), _row(part, "own")
        square = _row(part, "diagonal").get(k, np.zeros((wide, wide))) - sum((x @ x.T for x in pivot.values()), np.zeros((wide, wide)))
        try:
            low = np.linalg.cholesky(square)
            if i == k:
                out = low
            else:
                m = _row(part, "matrix").get(k, np.zeros((high, wide))) - sum((own[j] @ x.T for j, x in pivot.items() if j in own), np.zeros((high, wide)))
                out = np.linalg.solve(low, m.T).T
        except np.linalg.LinAlgError:
            out = np.full((high, wide), np.nan)
        return _tile_row({"i": i, "j": k}, out)

    return one


def _tile_row(place: dict[str, int], m: np.ndarray) -> pa.Table:
    cols = {c: pa.array([v], pa.int32()) for c, v in place.items()}
    return pa.table(cols | {"rows": pa.array([m.shape[0]], pa.int32()), "cols": pa.array([m.shape[1]], pa.int32()), "data": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())})


def factor(cells: DataFrame, rhs: DataFrame | None = None, first: str = "", tile: int = TILE) -> Factor:
    """Cholesky factor of the matrix, right sides below it."""
    spark = cells.sparkSession
    tiles, places, count, n, sides = pack(cells, rhs, first, tile)
    below = count + (1 if sides else 0)
    folder = fresh_folder(spark, "factor")
    done = spark.createDataFrame([], _TILE)
    role = lambda df, name, target: df.select(target.alias("target"), F.lit(name).alias("role"), "j", "rows", "cols", "data")
    for k in range(count):
        targets = F.explode(F.sequence(F.lit(k), F.lit(below - 1)))
        column = tiles.where(F.col("j") == k)
        work = role(column.where(F.col("i") > k), "matrix", F.col("i"))
        work = work.unionByName(role(column.where(F.col("i") == k), "diagonal", targets))
        if k:
            work = work.unionByName(role(done.where(F.col("i") > k), "own", F.col("i"))).unionByName(role(done.where(F.col("i") == k), "pivot", targets))
        work.groupBy("target").applyInArrow(_column(k, count, tile, n, sides), _TILE).write.parquet(f"{folder}/column={k:05d}")
        done = spark.read.schema(_TILE).parquet(*(f"{folder}/column={c:05d}" for c in range(k + 1)))
    return Factor(done, places, count, n, tile, sides)


_BLOCK = "j int, rows int, cols int, data binary"


def _step(k: int, up: bool):
    """Block k of a substitution, from the tiles that meet it and the blocks so far."""

    def one(part: pa.Table) -> pa.Table:
        got: dict[str, dict[int, np.ndarray]] = {"tile": {}, "known": {}, "side": {}}
        for role, at, r, c, d in zip(*(part.column(x).to_pylist() for x in ("role", "at", "rows", "cols", "data")), strict=True):
            got[role][at] = _array(r, c, d)
        low, known, y = got["tile"][k], got["known"], got["side"][k]
        for at, m in got["tile"].items():
            if at in known:
                y = y - (m.T if up else m) @ known[at]
        x = np.linalg.solve(low.T if up else low, y) if np.isfinite(low).all() else np.full(y.shape, np.nan)
        return _tile_row({"j": k}, x)

    return one


def _sweep(f: Factor, sides: DataFrame, up: bool) -> DataFrame:
    """Blocks (j, rows, cols, data) of L^-1 or, up, L'^-1 times the blocks of
    sides.  One group a step: the tiles of a row (up: of a column) and the
    blocks found so far, which are as long as the keys but as narrow as sides."""
    spark = f.tiles.sparkSession
    folder, found = fresh_folder(spark, "sweep"), None
    role = lambda df, name, at: df.select(F.lit(name).alias("role"), F.col(at).alias("at"), "rows", "cols", "data")
    for n, k in enumerate(range(f.count - 1, -1, -1) if up else range(f.count)):
        line = (F.col("j") == k) if up else (F.col("i") == k)
        work = role(f.tiles.where(line & (F.col("i") < f.count)), "tile", "i" if up else "j").unionByName(role(sides.where(F.col("j") == k), "side", "j"))
        if found is not None:
            work = work.unionByName(role(found, "known", "j"))
        work.groupBy(F.lit(k).alias("step")).applyInArrow(_step(k, up), _BLOCK).write.parquet(f"{folder}/step={n:05d}")
        found = spark.read.schema(_BLOCK).parquet(*(f"{folder}/step={c:05d}" for c in range(n + 1)))
    return found


def _blocks(rhs: DataFrame, f: Factor) -> tuple[DataFrame, int]:
    """Right sides (row_key, rhs_no, value) as blocks; keys without any are zeros."""
    sides, tile, keys = int(rhs.agg(F.max("rhs_no")).first()[0] or 1), f.tile, f.keys
    every = f.places.select("row_key", "ix", F.lit(1).alias("rhs_no"), F.lit(0.0).alias("value"))
    entry = every.unionByName(rhs.join(f.places, "row_key").select("row_key", "ix", F.col("rhs_no").cast("int").alias("rhs_no"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value")))

    def one(part: pa.Table) -> pa.Table:
        j = part.column("j")[0].as_py()
        m = _dense((min(tile, keys - j * tile), sides), part)
        return _tile_row({"j": j}, m)

    return entry.select(F.floor(F.col("ix") / f.tile).cast("int").alias("j"), (F.col("ix") % f.tile).cast("int").alias("r"), (F.col("rhs_no") - 1).alias("c"), "value").groupBy("j").applyInArrow(one, _BLOCK), sides


def solve(f: Factor, rhs: DataFrame | None = None) -> DataFrame:
    """row_key, rhs_no, value of the solutions for the factor's own right sides
    or for others (row_key, rhs_no, value)."""
    if not f.count:
        return _keyed(None, f)
    if rhs is not None:
        return _keyed(_sweep(f, _sweep(f, _blocks(rhs, f)[0], False), True), f)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j, r, c, d = (batch.column(k).to_pylist() for k in range(4))
            data = [np.ascontiguousarray(_array(a, b, x).T).tobytes() for a, b, x in zip(r, c, d, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(data, pa.binary())], names=["j", "rows", "cols", "data"])

    own = f.tiles.where(F.col("i") == f.count).select("j", "rows", "cols", "data").mapInArrow(turned, _BLOCK)
    return _keyed(_sweep(f, own, True), f)


def _keyed(blocks: DataFrame | None, f: Factor) -> DataFrame:
    if blocks is None:
        return f.places.select("row_key", F.lit(1).alias("rhs_no"), F.lit(0.0).alias("value")).limit(0)
    tile = f.tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, r, c, d in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                flat, start = _array(r, c, d).ravel(), j * tile
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(start, start + r), c), pa.int64()), pa.array(np.tile(np.arange(1, c + 1), r), pa.int32()), pa.array(flat, mask=np.isnan(flat))], names=["ix", "rhs_no", "value"])

    return blocks.mapInArrow(run, "ix long, rhs_no int, value double").join(f.places, "ix").select("row_key", "rhs_no", "value")


def factor_cells(f: Factor) -> DataFrame:
    """row_key, col_key, value of the lower factor (row at or after column)."""
    tile = f.tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, r, c, d in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x, row, col = _array(r, c, d), i * tile, j * tile
                a, b = np.nonzero((np.add.outer(np.arange(row, row + r), -np.arange(col, col + c)) >= 0) & (x != 0))
                value = x[a, b]
                yield pa.RecordBatch.from_arrays([pa.array(a + row, pa.int64()), pa.array(b + col, pa.int64()), pa.array(value, mask=np.isnan(value))], names=["row_ix", "col_ix", "value"])

    flat = f.tiles.where(F.col("i") < f.count).mapInArrow(run, "row_ix long, col_ix long, value double")
    key = lambda name: f.places.select(F.col("ix").alias(f"{name}_ix"), F.col("row_key").alias(f"{name}_key"))
    return flat.join(key("row"), "row_ix").join(key("col"), "col_ix").select("row_key", "col_key", "value")


def norm(cells: DataFrame) -> float:
    """The 1-norm of a symmetric matrix given by its upper triangle."""
    both = cells.select("col_key", "value").unionByName(cells.where("row_key <> col_key").select(F.col("row_key").alias("col_key"), "value"))
    return float(both.groupBy("col_key").agg(F.sum(F.abs("value")).alias("s")).agg(F.max("s")).first()[0] or 0.0)


def condition(cells: DataFrame, tile: int = TILE, rounds: int = 5) -> float:
    """The condition number in the 1-norm, its inverse factor estimated by
    Hager's ascent: a lower bound that is exact in nearly all cases.

    Each round solves one right side, a vector of signs or one unit vector."""
    keys = cells.select("row_key").unionByName(cells.select(F.col("col_key").alias("row_key"))).distinct()
    n = keys.count()
    if not n:
        return float("nan")
    f = factor(cells, None, "", tile)
    side = keys.select("row_key", F.lit(1).alias("rhs_no"), F.lit(1.0 / n).alias("value"))
    best, last = 0.0, None
    for _ in range(rounds):
        x = solve(f, side).select("row_key", "value")
        size = x.agg(F.sum(F.abs("value"))).first()[0]
        if size is None:
            return float("inf")
        if size <= best:
            break
        best = float(size)
        signs = x.select("row_key", F.lit(1).alias("rhs_no"), F.when(F.col("value") < 0, -1.0).otherwise(1.0).alias("value"))
        z = solve(f, signs).orderBy(F.desc(F.abs("value")), "row_key").first()
        if z["row_key"] == last:
            break
        last = z["row_key"]
        side = keys.select("row_key", F.lit(1).alias("rhs_no"), F.when(F.col("row_key") == last, 1.0).otherwise(0.0).alias("value"))
    return norm(cells) * best
