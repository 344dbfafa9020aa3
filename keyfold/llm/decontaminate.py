"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Every run of words as long as a benchmark item is a window; its fingerprint is
the majority of its shingles' hash bits, had for all windows of a text from
running sums.  Fingerprints of items are indexed by eight blocks of eight
bits.  Within `radius` = 23 differing bits some block differs in two bits or
fewer, so looking up each block's neighbourhood of two bits gives every item
within the radius.  Candidates within the radius are verified by the exact
similarity of weighted shingles: the shingles' counts, sum of minima over sum
of maxima, at least `similarity`.

Windows that share no shingle with an item have similarity 0, so only windows
that hold a shingle of an item of their length get a fingerprint; that drops
nothing which could be verified.

A text of fewer shingles than an item is a window by itself, verified without
fingerprints.

Items are broadcast in slices of at most `SLICE_WORDS` words, one pass over
the texts for each slice, so a large benchmark costs time and not memory.

Defined results: words are small ASCII letters' runs without white space; null
and empty texts and items match nothing; an item of fewer words than a shingle
is one shingle, compared with windows of as many words; null item ids are
reported as null; rows equal in id and text are reported once for each row;
texts of any length are searched whole; an empty table of texts or of items
gives no leak; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, mapped
from .textkit import chunks, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
SLICE_WORDS = 200_000
#: All bytes that differ from zero in at most two bits.
_NEAR = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= 2).astype(np.uint8)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class Items:
    """Items of one slice that have the same number of words to a shingle."""

    def __init__(self, k: int, rows: list[tuple[int, int, np.ndarray]]):
        """rows: place in the slice, words, hashes of the shingles."""
        self.k = k
        self.place = np.array([r[0] for r in rows])
        self.words = np.array([r[1] for r in rows])
        self.counts = [Counter(r[2].tolist()) for r in rows]
        self.prints = np.concatenate([_pack((_bits(r[2]).sum(0, dtype=np.int64) * 2 > len(r[2]))[None]) for r in rows])
        pairs = np.unique(np.array([(h, i) for i, c in enumerate(self.counts) for h in c], np.uint64), axis=0)
        self.shingle, self.owner = pairs[:, 0], pairs[:, 1].astype(np.int64)
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        #: For each block and value, the items that have a near value there.
        self.block: list[dict[int, list[int]]] = [{} for _ in range(8)]
        for i, row in enumerate(blocks):
            for b in range(8):
                for v in (_NEAR ^ row[b]).tolist():
                    self.block[b].setdefault(v, []).append(i)

    def candidates(self, prints: np.ndarray, radius: int) -> Iterator[tuple[int, int, int]]:
        """Distance, window, item of all within the radius, by the blocks."""
        for b, values in enumerate(prints.view(np.uint8).reshape(-1, 8).T):
            for v in np.unique(values).tolist():
                near = np.array(self.block[b].get(v, []), np.int64)
                if not len(near):
                    continue
                win = np.flatnonzero(values == v)
                dist = np.bitwise_count(prints[win][:, None] ^ self.prints[near][None, :])
                # A pair is told at its first block that is near.
                apart = (prints[win][:, None] ^ self.prints[near][None, :]).view(np.uint8).reshape(len(win), len(near), 8)
                fresh = ~(np.bitwise_count(apart[:, :, :b]) <= 2).any(axis=2)
                for w, i in np.argwhere((dist <= radius) & fresh).tolist():
                    yield int(dist[w, i]), int(win[w]), int(near[i])

    def search(self, h: np.ndarray, radius: int, least: float) -> Iterator[tuple[int, float, int, int]]:
        """Place, similarity, first word and words of each item found in a
        text, given the hashes of its shingles."""
        if not len(h):
            return
        lo, hi = np.searchsorted(self.shingle, h, "left"), np.searchsorted(self.shingle, h, "right")
        at = np.flatnonzero(hi > lo)
        if not len(at):
            return
        number = hi[at] - lo[at]
        owners = self.owner[np.repeat(lo[at], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)]
        spots = np.repeat(at, number)
        for length in np.unique(self.words[owners]).tolist():
            width = length - self.k + 1
            if len(h) < width:
                own = Counter(h.tolist())
                for i in np.unique(owners[self.words[owners] == length]).tolist():
                    s = similarity(own, self.counts[i])
                    if s >= least:
                        yield int(self.place[i]), s, 0, len(h) + self.k - 1
                continue
            hit = np.unique(spots[self.words[owners] == length])
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(hit - width + 1, 0), 1)
            np.add.at(edge, hit + 1, -1)
            start = np.flatnonzero(np.cumsum(edge)[: len(h) - width + 1])
            found: dict[int, tuple[float, int]] = {}
            for a in range(0, len(start), 4096):
                part = start[a : a + 4096]
                base, top = int(part[0]), int(part[-1]) + width
                if top - base > 4 * (len(part) + width):  # far apart: each window by itself
                    groups = np.split(part, np.flatnonzero(np.diff(part) > width) + 1)
                else:
                    groups = [part]
                for g in groups:
                    base, top = int(g[0]), int(g[-1]) + width
                    sums = np.zeros((top - base + 1, 64), np.int32)
                    np.cumsum(_bits(h[base:top]), axis=0, out=sums[1:], dtype=np.int32)
                    prints = _pack((sums[g - base + width] - sums[g - base]) * 2 > width)
                    near = [(d, int(g[w]), i) for d, w, i in self.candidates(prints, radius) if self.words[i] == length]
                    for _, w, i in sorted(near):
                        if i in found:
                            continue
                        s = similarity(Counter(h[w : w + width].tolist()), self.counts[i])
                        if s >= least:
                            found[i] = s, w
            for i, (s, w) in found.items():
                yield int(self.place[i]), s, w, length


def index(texts: list[str | None], shingle: int = SHINGLE) -> list[Items]:
    """Items by the number of words that make a shingle."""
    by: dict[int, list] = {}
    for c in chunks(texts):
        starts, ends, at = c.words()
        word = c.hashes(starts, ends)
        for d in range(c.n):
            own = word[at[d] : at[d + 1]]
            if len(own):
                k = min(shingle, len(own))
                h, _ = shingle_hashes(own, np.array([0, len(own)]), k)
                by.setdefault(k, []).append((c.first + d, len(own), h))
    return [Items(k, rows) for k, rows in sorted(by.items())]


def search_texts(texts: list[str | None] | pa.Array, groups: list[Items], radius: int = RADIUS, least: float = SIMILARITY) -> Iterator[tuple[int, int, float, int, int]]:
    """Text, item, similarity, first word, words of everything found."""
    for c in chunks(texts):
        starts, ends, at = c.words()
        word = c.hashes(starts, ends)
        for g in groups:
            h, pos = shingle_hashes(word, at, g.k)
            touched = np.unique(np.searchsorted(at, pos[np.isin(h, g.shingle)], side="right") - 1)
            for d in touched.tolist():
                a, b = np.searchsorted(pos, [at[d], at[d + 1]])
                for item, s, w, n in g.search(h[a:b], radius, least):
                    yield c.first + d, item, s, w, n


def _found(batches, held, item_ids: list, radius: int, least: float, schema: pa.Schema):
    groups = held.value
    for batch in batches:
        rows = list(search_texts(batch.column("text"), groups, radius, least))
        own = pa.array([r[0] for r in rows], pa.int64())
        cols = [batch.column("doc_id").take(own), pa.array([item_ids[r[1]] for r in rows], schema.types[1])]
        cols += [pa.array([r[k] for r in rows], schema.types[k]) for k in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays(cols, schema=schema)


def _slices(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in pieces of at most SLICE_WORDS words (or one longer item)."""
    held, words = [], 0
    for r in items.toLocalIterator():
        n = len((r["text"] or "").split())
        if held and words + n > SLICE_WORDS:
            yield held
            held, words = [], 0
        held.append((r["item_id"], r["text"]))
        words += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: each item that a text
    holds, with a window that shows it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(benchmark.dtypes)["item_id"]
    out = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {kind}, similarity double, first_word long, n_words long"
    schema = arrow_schema(out)
    result = None
    for part in _slices(benchmark.select("item_id", "text")):
        held = spark.sparkContext.broadcast(index([t for _, t in part], shingle))
        ids = [i for i, _ in part]
        got = rows.transform(mapped, lambda it, held=held, ids=ids: _found(it, held, ids, radius, similarity, schema), out)
        result = got if result is None else result.unionByName(got)
    return spark.createDataFrame([], out) if result is None else result


def _clean(batches, at: int, held, radius: int, least: float):
    """The rows that hold no item, judged and filtered in one pass."""
    for batch in batches:
        bad = np.zeros(batch.num_rows, bool)
        bad[[r[0] for r in search_texts(pc.struct_field(batch.column("row"), [at]), held.value, radius, least)]] = True
        yield batch.filter(pa.array(~bad))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark.
    Each slice of the items is one more filter over the stream of rows; nothing
    is shuffled."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for part in _slices(benchmark.select("item_id", "text")):
        held = spark.sparkContext.broadcast(index([t for _, t in part], shingle))
        rows = rows.transform(mapped, lambda it, held=held: _clean(it, at, held, radius, similarity), rows.schema)
    return rows.select("row.*")
