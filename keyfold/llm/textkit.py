"""Vectorised words, word hashes and shingle hashes of a batch of texts.

A batch is cut into chunks of bounded bytes; within a chunk the texts lie in
one byte buffer with a blank between them, and everything is numpy on that
buffer.  A text longer than the bound is a chunk by itself: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHUNK_BYTES = 1 << 18
#: ASCII A-Z to a-z; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n at least.
    Those of a usual chunk are kept; longer tables, for very long texts, aren't."""
    size = max(n, 2 * CHUNK_BYTES)
    if len(_powers[0]) >= size:
        return _powers[0], _powers[1]
    made = []
    for base in (_P, _P_INV):
        full = np.full(size, base, np.uint64)
        full[0] = 1
        made.append(np.multiply.accumulate(full))
    if size == 2 * CHUNK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Some texts in one buffer.

    rows: index in the batch of the first text, and one past the last;
    buf: the bytes; doc_start: where each text begins, then the buffer's end.
    """

    def __init__(self, first: int, texts: list[bytes | memoryview], lower: bool):
        self.first, self.n = first, len(texts)
        joined = b" ".join([*texts, b""])
        self.raw = joined.translate(LOWER) if lower else joined
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.doc_start = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.doc_start[1:])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each text the index of its
        first word (then the number of all words)."""
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = ~IS_SPACE[self.buf]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(starts, self.doc_start)

    def sums(self) -> np.ndarray:
        """What hashes() needs of the buffer, for callers that hash ranges more than once."""
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _power_tables(len(self.buf) + 1)[0][: len(self.buf)], out=sums[1:])
        return sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        down = _power_tables(len(self.buf) + 1)[1]
        sums = self.sums() if sums is None else sums
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Of each byte: 0 white space, 1 letters, digits and all beyond ASCII, 2 the rest.
BYTE_CLASS = np.full(256, 2, np.int8)
BYTE_CLASS[IS_SPACE] = 0
BYTE_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Of each byte, what it adds to a token's shape: capital, small, digit, beyond ASCII, the rest.
SHAPE_BIT = np.zeros(256, np.uint8)
SHAPE_BIT[65:91], SHAPE_BIT[97:123], SHAPE_BIT[48:58], SHAPE_BIT[128:] = 1, 2, 4, 8
SHAPE_BIT[(BYTE_CLASS == 2)] = 16


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, and runs of other signs: starts, ends, and
    each text's first token (then the number of all)."""
    kind = np.zeros(len(chunk.buf) + 1, np.int8)
    kind[:-1] = BYTE_CLASS[chunk.buf]
    change = np.flatnonzero(np.diff(kind, prepend=0))
    starts = change[kind[change] != 0]
    ends = np.append(change, len(chunk.buf))[np.searchsorted(change, starts, side="right")]
    return starts, ends, np.searchsorted(starts, chunk.doc_start)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def views(texts: list[str | None] | pa.Array) -> list[bytes | memoryview]:
    """The bytes of each text, null as empty.  Of an Arrow column, views into
    its buffer: nothing is copied or decoded."""
    if not isinstance(texts, pa.Array):
        return encoded(texts)
    if not len(texts):
        return []
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def text_array(texts: list[bytes | memoryview], valid: list[bool], kind: pa.DataType) -> pa.Array:
    """The inverse of views: an Arrow column of these bytes, null where not valid."""
    edge = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edge[1:])
    got = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edge), pa.py_buffer(b"".join(texts)))
    if not all(valid):
        got = pa.compute.if_else(pa.array(valid), got, pa.scalar(None, pa.large_string()))
    return got.cast(kind)


def chunks(texts: list[str | None] | pa.Array, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts (null counts as empty) in chunks of about `limit` bytes."""
    first, held, size = 0, [], 0
    for k, t in enumerate(views(texts)):
        if held and size + len(t) > limit:
            yield Chunk(first, held, lower)
            first, held, size = k, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield Chunk(first, held, lower)


def shingle_hashes(word_hash: np.ndarray, word_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words that lies in one text, with the word
    index at which each run begins.  A text of fewer words has none."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hash[:n].copy()
    for j in range(1, k):
        h = mix(h * _P + word_hash[j : j + n])
    last = np.repeat(word_at[1:], np.diff(word_at))[:n]
    at = np.flatnonzero(np.arange(n) + k <= last)
    return h[at], at


def set_hashes(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of a chunk, and the text of each.  A text
    of fewer words has one shingle of all its words, an empty one has none."""
    starts, ends, at = chunk.words()
    word = chunk.hashes(starts, ends)
    h, begin = shingle_hashes(word, at, k)
    doc = np.searchsorted(at, begin, side="right") - 1
    count = np.diff(at)
    more_h, more_d = [h], [doc]
    for m in range(1, k):
        few = np.flatnonzero(count == m)
        if len(few):
            x = word[at[few]].copy()
            for j in range(1, m):
                x = mix(x * _P + word[at[few] + j])
            more_h.append(mix(x + np.uint64(m)))
            more_d.append(few)
    return np.concatenate(more_h), np.concatenate(more_d)
