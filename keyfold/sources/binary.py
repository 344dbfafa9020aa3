"""Binary files of keyed matrices, as a Spark data source.

A file holds, one after the other, an index (sizes), metadata, the keys of rows
and columns, vectors, and a matrix of float64 in one of ten storage forms.  The
source has a table for each of these stages (option `stage`: index, meta, keys,
vectors or cells) and reads no byte of the others: the driver reads the index of
each file, and tasks read ranges of its bytes, so that a matrix of any size is
read in parallel.  Both byte orders are read; versions up to 2.5.

`write` makes one such file: the driver writes what grows with the keys, tasks
write disjoint ranges of the matrix at their places, so that a task which runs
twice writes the same bytes.  That needs a file system on which a file can be
written from many places, which the shared folder is; others raise.

Defined results: cells outside the stored blocks don't exist; missing cells are
written as zeros, repeated ones add; null values are zeros; a matrix without
keys has no rows; keys longer than 24 bytes are cut there.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Storage forms and the layout of files.
SYMMETRIC = ("SYMV0___", "SYMV1___", "SYMV2___", "SYMVN___", "TRIVN___")
BLOCKS_SYMMETRIC, BLOCKS_FULL = ("BDSYMV0_", "BDSYMVN_"), ("BDFULLV0", "BDFULLVN")
FULL, RECTANGLE, DIAGONAL = ("FULLSQV0", "FULLSQVN"), ("FULL2DVN",), ("DIAVN___",)
FORMS = SYMMETRIC + BLOCKS_SYMMETRIC + BLOCKS_FULL + FULL + RECTANGLE + DIAGONAL
KEY, LINE, VERSION = 24, 80, 2.5
#: Matrix values that one task reads or writes.
RANGE = 1 << 20
STAGES = {
    "index": "file string, version double, type string, description string, little_endian boolean, rows int, cols int, values long, vectors int, blocks int",
    "meta": "file string, kind string, place int, name string, long_value long, double_value double",
    "keys": "file string, axis int, ix int, key string, block int",
    "vectors": "file string, vec_no int, row_ix int, row_key string, value double",
    "cells": "file string, row_ix int, col_ix int, row_key string, col_key string, value double",
}


def local_path(path: str) -> str:
    """The path of a mounted file system; other schemes raise."""
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"binary matrices are read and written on mounted file systems, not on {u.scheme}")
    return unquote(u.path) if u.scheme else path


def packed_size(form: str, rows: int, cols: int, ends: list[int]) -> int:
    """Stored values of a matrix; ends: the last row of each block."""
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    if form in SYMMETRIC:
        return rows * (rows + 1) // 2
    if form in BLOCKS_SYMMETRIC:
        return sum(s * (s + 1) // 2 for s in sizes)
    if form in BLOCKS_FULL:
        return sum(s * s for s in sizes)
    return rows if form in DIAGONAL else rows * cols


def _triangle(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column (from 0) of places in a packed upper triangle."""
    col = ((np.sqrt(8.0 * at + 1) - 1) / 2).astype(np.int64)
    col -= col * (col + 1) // 2 > at
    col += (col + 1) * (col + 2) // 2 <= at
    return at - col * (col + 1) // 2, col


def places(form: str, rows: int, ends: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column (from 0) of these places of the stored values."""
    if form in SYMMETRIC:
        return _triangle(at)
    if form in DIAGONAL:
        return at, at
    if form in FULL + RECTANGLE:
        return at % rows, at // rows
    size = np.diff([0, *ends])
    number = size * (size + 1) // 2 if form in BLOCKS_SYMMETRIC else size * size
    first = np.concatenate([[0], np.cumsum(number)])
    b = np.searchsorted(first, at, side="right") - 1
    inner, shift = at - first[b], np.concatenate([[0], ends])[b]
    r, c = _triangle(inner) if form in BLOCKS_SYMMETRIC else (inner % size[b], inner // size[b])
    return r + shift, c + shift


@dataclass
class Index:
    """The first segment of a file, and where the others begin."""

    file: str
    order: str
    version: float
    form: str
    description: str
    ints: int
    doubles: int
    rows: int
    cols: int
    values: int
    vectors: int
    readme: int
    blocks: int
    meta_at: int
    keys_at: int
    ends_at: int
    side2_at: int
    vectors_at: int
    cells_at: int
    ends: list[int] = field(default_factory=list)


def read_index(file: str) -> Index:
    """Sizes of a file and, if it has blocks, their ends."""
    with open(file, "rb") as f:
        mark = f.read(2)
        if mark not in (b"BI", b"IB"):
            raise ValueError(f"{file} is no binary matrix")
        o = "<" if mark == b"BI" else ">"
        version = float(f.read(6).decode("latin-1")[2:].strip())
        if version > VERSION:
            raise ValueError(f"{file} has version {version}")
        form, description = f.read(8).decode("latin-1"), f.read(LINE).decode("latin-1").rstrip()
        if form not in FORMS:
            raise ValueError(f"unknown storage form {form}")
        ints, doubles, rows, cols = struct.unpack(o + "4i", f.read(16))
        struct.unpack(o + ("2q" if version > 2.3 else "2i"), f.read(16 if version > 2.3 else 8))
        vectors, readme = {"SYMV1___": 1, "SYMV2___": 2}.get(form, 0), 0
        if version > 2.1:
            vectors, readme = struct.unpack(o + "2i", f.read(8))
        else:
            cols = rows
        blocked = form in BLOCKS_SYMMETRIC + BLOCKS_FULL
        blocks = struct.unpack(o + "i", f.read(4))[0] if blocked else 0
        meta = f.tell()
        keys = meta + LINE * readme + ints * (KEY + (8 if version > 2.4 else 4)) + doubles * (KEY + 8)
        ends_at = keys + KEY * rows
        side2 = ends_at + 4 * blocks
        two = form in BLOCKS_FULL + FULL and version > 2.2 or form in RECTANGLE
        vectors_at = side2 + (KEY * cols if two else 0)
        got = Index(file, o, version, form, description, ints, doubles, rows, cols, 0, vectors, readme, blocks, meta, keys, ends_at, side2 if two else keys, vectors_at, vectors_at + 8 * rows * vectors)
        if blocks:
            f.seek(ends_at)
            got.ends = list(struct.unpack(f"{o}{blocks}i", f.read(4 * blocks)))
        got.values = packed_size(form, rows, cols, got.ends)
        return got


def _keys(f, x: Index, axis: int) -> list[str]:
    f.seek(x.keys_at if axis == 1 else x.side2_at)
    n = x.rows if axis == 1 else x.cols
    raw = f.read(KEY * n)
    return [raw[k : k + KEY].decode("latin-1").rstrip() for k in range(0, len(raw), KEY)]


@dataclass
class Part(InputPartition):
    index: Index
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.stage = options.get("stage", "cells")
        if self.stage not in STAGES:
            raise ValueError(f"no such stage: {self.stage}")
        self.path, self.range = options["path"], int(options.get("values", RANGE))
        self.schema = [f.name for f in schema.fields]

    def partitions(self):
        path = local_path(self.path)
        files = sorted(x for x in (glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(x))
        out = []
        for f in files:
            x = read_index(f)
            n = {"cells": x.values, "vectors": x.rows * x.vectors}.get(self.stage, 1)
            out += [Part(x, k, min(k + self.range, n)) for k in range(0, n, self.range)]
        return out or [Part(None, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        x = part.index
        if x is not None:
            cols = getattr(self, f"_{self.stage}")(x, part)
            n = len(cols[0]) if cols else 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([x.file] * n), *cols], names=self.schema)

    def _index(self, x: Index, _: Part):
        row = [x.version, x.form, x.description, x.order == "<", x.rows, x.cols, x.values, x.vectors, x.blocks]
        kinds = [pa.float64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]

    def _meta(self, x: Index, _: Part):
        wide = x.version > 2.4
        with open(x.file, "rb") as f:
            f.seek(x.meta_at)
            text = lambda n, size: [f.read(size).decode("latin-1").rstrip() for _ in range(n)]
            rows = [("readme", k, t, None, None) for k, t in enumerate(text(x.readme, LINE))]
            names = text(x.ints, KEY)
            rows += [("long", k, n, v, None) for k, (n, v) in enumerate(zip(names, struct.unpack(f"{x.order}{x.ints}{'q' if wide else 'i'}", f.read(x.ints * (8 if wide else 4))), strict=True))]
            names = text(x.doubles, KEY)
            rows += [("double", k, n, None, v) for k, (n, v) in enumerate(zip(names, struct.unpack(f"{x.order}{x.doubles}d", f.read(8 * x.doubles)), strict=True))]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64()]
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]

    def _keys(self, x: Index, _: Part):
        with open(x.file, "rb") as f:
            first, second = _keys(f, x, 1), _keys(f, x, 2)
        block = lambda n: np.searchsorted(x.ends, np.arange(n), side="right") + 1 if x.ends else np.zeros(n, int)
        return [pa.array(np.repeat([1, 2], [len(first), len(second)]), pa.int32()), pa.array(np.concatenate([np.arange(1, len(first) + 1), np.arange(1, len(second) + 1)]), pa.int32()), pa.array(first + second), pa.array(np.concatenate([block(len(first)), block(len(second))]), pa.int32())]

    def _values(self, f, x: Index, start: int, part: Part) -> np.ndarray:
        f.seek(start + 8 * part.first)
        return np.frombuffer(f.read(8 * (part.last - part.first)), x.order + "f8").astype(float)

    def _vectors(self, x: Index, part: Part):
        with open(x.file, "rb") as f:
            names = pa.array(_keys(f, x, 1))
            value = self._values(f, x, x.vectors_at, part)
        at = np.arange(part.first, part.last)
        row = at % x.rows
        return [pa.array(at // x.rows + 1, pa.int32()), pa.array(row + 1, pa.int32()), names.take(pa.array(row)), pa.array(value)]

    def _cells(self, x: Index, part: Part):
        with open(x.file, "rb") as f:
            rows, cols = pa.array(_keys(f, x, 1)), pa.array(_keys(f, x, 2))
            value = self._values(f, x, x.cells_at, part)
        r, c = places(x.form, x.rows, x.ends, np.arange(part.first, part.last))
        return [pa.array(r + 1, pa.int32()), pa.array(c + 1, pa.int32()), rows.take(pa.array(r)), cols.take(pa.array(c)), pa.array(value)]


class BinaryMatrices(DataSource):
    """spark.read.format("keyed_binary").option("stage", ...).load(path): a
    file, a folder or a glob."""

    @classmethod
    def name(cls) -> str:
        return "keyed_binary"

    def schema(self) -> str:
        stage = self.options.get("stage", "cells")
        if stage not in STAGES:
            raise ValueError(f"no such stage: {stage}")
        return STAGES[stage]

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)


def read(spark: SparkSession, path: str, stage: str = "cells", values: int = RANGE) -> DataFrame:
    """A stage of all files at path; values: of the matrix, for each task."""
    spark.dataSource.register(BinaryMatrices)
    return spark.read.format("keyed_binary").option("stage", stage).option("values", str(values)).load(path)


def _text(s: str, size: int) -> bytes:
    return s.encode("latin-1", "replace")[:size].ljust(size)


def write(path: str, cells: DataFrame, form: str, rows: list[str], cols: list[str] | None = None, ends: list[int] | None = None, vectors: DataFrame | None = None, longs: dict[str, int] | None = None, doubles: dict[str, float] | None = None, readme: list[str] | None = None, description: str = "", little_endian: bool = True, values: int = RANGE) -> None:
    """One file of cells (row_ix, col_ix from 1, value) in a storage form.

    rows, cols: keys in order.  ends: the last row of each block.  vectors
    (row_ix, vec_no, value).  Symmetric forms take the upper triangle; of a
    cell below the diagonal, or outside its block or form, nothing is stored."""
    if form not in FORMS:
        raise ValueError(f"unknown storage form {form}")
    target, o = local_path(path), "<" if little_endian else ">"
    n, m, ends = len(rows), len(rows if cols is None else cols), list(ends or [])
    blocked = form in BLOCKS_SYMMETRIC + BLOCKS_FULL
    if blocked and (not ends or ends[-1] != n or sorted(set(ends)) != ends):
        raise ValueError("ends of blocks must rise to the number of rows")
    size, longs, doubles, readme = packed_size(form, n, m, ends), longs or {}, doubles or {}, readme or []
    number = 0 if vectors is None else int(vectors.agg(F.max("vec_no")).first()[0] or 0)
    head = (b"BI" if little_endian else b"IB") + _text(f"NV{VERSION}", 6) + _text(form, 8) + _text(description, LINE)
    head += struct.pack(o + "4i2q2i", len(longs), len(doubles), n, m, size, 1, number, len(readme))
    head += struct.pack(o + "i", len(ends)) if blocked else b""
    head += b"".join(_text(x, LINE) for x in readme) + b"".join(_text(k, KEY) for k in longs) + struct.pack(f"{o}{len(longs)}q", *longs.values())
    head += b"".join(_text(k, KEY) for k in doubles) + struct.pack(f"{o}{len(doubles)}d", *doubles.values()) + b"".join(_text(k, KEY) for k in rows)
    head += struct.pack(f"{o}{len(ends)}i", *ends) if blocked else b""
    if form in BLOCKS_FULL + FULL + RECTANGLE:
        head += b"".join(_text(k, KEY) for k in (rows if cols is None else cols))
    start = len(head) + 8 * n * number
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(target, "wb") as f:
        f.write(head)
        f.truncate(start + 8 * size)
    _put(cells.where("row_ix between 1 and {} and col_ix between 1 and {}".format(n, m)).select(_address(form, n, ends).alias("at"), "value"), target, start, o, values)
    if number:
        _put(vectors.where(f"row_ix between 1 and {n} and vec_no >= 1").select(((F.col("vec_no").cast("long") - 1) * n + F.col("row_ix") - 1).alias("at"), "value"), target, len(head), o, values)


def _address(form: str, rows: int, ends: list[int]):
    """The place of a cell among the stored values; null if it has none."""
    r, c = F.col("row_ix").cast("long") - 1, F.col("col_ix").cast("long") - 1
    if form in SYMMETRIC:
        return F.when(r <= c, r + F.floor(c * (c + 1) / 2))
    if form in DIAGONAL:
        return F.when(r == c, r)
    if form in FULL + RECTANGLE:
        return c * rows + r
    sizes = np.diff([0, *ends]).astype(int).tolist()
    number = [s * (s + 1) // 2 if form in BLOCKS_SYMMETRIC else s * s for s in sizes]
    table = F.array(*(F.struct(F.lit(e).cast("long").alias("end"), F.lit(e - s).cast("long").alias("low"), F.lit(s).cast("long").alias("size"), F.lit(sum(number[:k])).cast("long").alias("first")) for k, (e, s) in enumerate(zip(ends, sizes, strict=True))))
    b = F.get(F.filter(table, lambda t: r < t["end"]), F.lit(0))
    i, j = r - b["low"], c - b["low"]
    inside = (j >= 0) & (j < b["size"])
    if form in BLOCKS_SYMMETRIC:
        return F.when(inside & (i <= j), b["first"] + i + F.floor(j * (j + 1) / 2))
    return F.when(inside, b["first"] + j * b["size"] + i)


def _put(values: DataFrame, target: str, start: int, order: str, many: int) -> None:
    """Write values (at, value) as doubles from byte `start` on, a range a task."""

    def one(part: pa.Table) -> pa.Table:
        k = part.column("range")[0].as_py()
        at = part.column("at").to_numpy() - k * many
        out = np.bincount(at, np.nan_to_num(part.column("value").cast(pa.float64()).to_numpy()), at.max() + 1)
        with open(target, "r+b") as f:
            f.seek(start + 8 * k * many)
            f.write(out.astype(order + "f8").tobytes())
        return pa.table({"range": pa.array([k], pa.int64()), "written": pa.array([len(out)], pa.int64())})

    known = values.where("at is not null").select("at", F.coalesce("value", F.lit(0.0)).alias("value"), F.floor(F.col("at") / many).alias("range"))
    known.groupBy("range").applyInArrow(one, "range long, written long").agg(F.sum("written")).collect()  # one row
