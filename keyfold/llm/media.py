"""Media columns: content-addressed payloads in tar shards.

A payload (the UTF-8 bytes of a text, filled with bytes 255 up to a positive
multiple of 576) is stored losslessly as an 8-bit greyscale PNG of width 576.
Equal payloads of different ids are stored once, rows that repeat an id and a
text each store theirs.  Each writing task packs its images into tar
files in the shared folder, named by their SHA-256; a table of rows holds
digest, shard, offset and length.  Metadata columns are filled by range reads
of an image's first 33 bytes; payloads are read back by range too.

Tar files are named after the task attempt that wrote them, and only the rows
of attempts that ended well are kept: a lost executor leaves at most a file
that no row refers to.

Which copy of a repeated text is stored: the one with the smallest id.  The
digests that occur more than once decide that; they are broadcast up to
BROADCAST_KEYS rows and joined by shuffle beyond.

Defined results: null texts are empty, and an empty payload is 576 bytes 255;
equal texts give equal values, whatever the id; null and repeated ids keep
their rows; texts of any length are stored whole; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, fresh_path, mapped, materialise

WIDTH = 576
HEADER_BYTES = 33
SHARD_BYTES = 64 << 20
LEVEL = 6
BROADCAST_KEYS = 200_000
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled up with bytes 255 to a positive multiple of 576."""
    return text.ljust(max(-(-len(text) // WIDTH), 1) * WIDTH, b"\xff")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """8-bit greyscale, one row of 576 samples after the other, not filtered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from an image's first 33 bytes."""
    if head[:8] != _PNG or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(image: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    width, height, _ = png_header(image[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Size, mean and a 16-bin histogram of the samples, in parts of 65535."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 65535 // len(x)
    return f"{WIDTH}x{len(x) // WIDTH}:{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:" + "".join(f"{b:04x}" for b in bins.tolist())


class _TarWriter:
    """Tar files in a folder, each closed at about SHARD_BYTES."""

    def __init__(self, folder: str, stem: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.stem, self.count, self.file = folder, stem, 0, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """Write a member; gives the shard and the offset of the data."""
        if self.file is None:
            self.name = f"{self.stem}-{self.count:05d}.tar"
            self.fs.create_dir(self.root, recursive=True)
            self.file, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(head)
        self.file.write(data)
        self.file.write(b"\0" * (-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        shard = self.name
        if self.at >= SHARD_BYTES:
            self.close()
        return shard, offset

    def close(self) -> None:
        if self.file is not None:
            self.file.write(b"\0" * 1024)
            self.file.close()
            self.file, self.count = None, self.count + 1


def _write(batches, folder: str, schema: pa.Schema):
    task = TaskContext.get()
    tar = _TarWriter(folder, f"media-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8")
            image = encode_png(payload_of(raw))
            shard, offset = tar.add(f"{key.hex()}.png", image)
            rows.append((key, len(raw), shard, offset, len(image)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)
    tar.close()


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the payloads of all rows to tar files in `folder`.

    Gives the rows (doc_id, digest) and the index (digest, n_bytes, shard,
    offset, length), one row for each distinct payload."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))
    ids = materialise(rows.select("doc_id", "digest"), "media-rows")
    repeated = materialise(ids.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner", F.lit(True).alias("again")), "media-repeated")
    small = repeated.count() <= BROADCAST_KEYS
    marked = rows.join(F.broadcast(repeated) if small else repeated.hint("merge"), "digest", "left")
    owned = marked.where(F.col("again").isNull() | F.col("doc_id").eqNullSafe(F.col("owner")))
    out = "digest binary, n_bytes long, shard string, offset long, length long"
    schema = arrow_schema(out)
    index = materialise(owned.select("digest", "text").transform(mapped, lambda it: _write(it, folder, schema), out), "media-index")
    # A text that occurs twice under its smallest id was written by each of those rows: one place is enough.
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "n_bytes", "length")).alias("at"))
    return ids, first.select("digest", "at.n_bytes", "at.shard", "at.offset", "at.length")


def _dealt(index: DataFrame) -> DataFrame:
    """Index rows by shard, each shard's in the order of the file."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "shard").sortWithinPartitions("shard", "offset")


def _ranges(batches, folder: str, header_only: bool) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    system, root = fs.FileSystem.from_uri(folder)
    name, file = None, None
    for batch in batches:
        got = []
        for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
            if shard != name:
                if file is not None:
                    file.close()
                name, file = shard, system.open_input_file(f"{root}/{shard}")
            got.append(file.read_at(HEADER_BYTES if header_only else length, offset))
        yield batch, got
    if file is not None:
        file.close()


def _headers(batches, folder: str, schema: pa.Schema):
    for batch, got in _ranges(batches, folder, True):
        w, h, b = zip(*map(png_header, got), strict=True) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(b, pa.int32())], schema=schema)


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits, from range reads of headers."""
    out = index.withColumns({c: F.lit(0) for c in ("width", "height", "bits")}).schema
    schema = arrow_schema(out)
    return _dealt(index).transform(mapped, lambda it: _headers(it, folder, schema), out)


def _payloads(batches, folder: str, schema: pa.Schema):
    for batch in batches:
        step = 64  # images in memory at a time
        for a in range(0, batch.num_rows, step):
            for part, images in _ranges([batch.slice(a, step)], folder, False):
                rows = []
                for digest, n, width, height, image in zip(*(part.column(c).to_pylist() for c in ("digest", "n_bytes", "width", "height")), images, strict=True):
                    data = decode_png(image)
                    if len(data) != width * height or hashlib.sha256(data[:n]).digest() != digest:
                        raise ValueError(f"{digest.hex()} was not read back as written")
                    rows.append((digest, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(data), width, height))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Per digest of an index with metadata, what the stored bytes say."""
    out = "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    schema = arrow_schema(out)
    return _dealt(index).transform(mapped, lambda it: _payloads(it, folder, schema), out)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store all payloads in the shared folder, read them back, and give each
    row its digest, sizes, checksums, feature, width and height."""
    folder = fresh_path(docs.sparkSession, "media")
    rows, index = store(docs, folder, doc_id, text)
    facts = materialise(read_back(materialise(with_metadata(index, folder), "media-meta"), folder), "media-facts")
    return rows.join(facts, "digest").select("doc_id", *[c for c in facts.columns if c != "digest"], F.lower(F.hex("digest")).alias("digest"))
