"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: one bit per position, set if over half of a text's shingle hashes
(repeats counted) have it set.  Fingerprints are cut into blocks; if two differ
in few bits, some choice of blocks is equal in both.  Each choice is a join
key; only fingerprints that share a key are compared, by Hamming distance.

No group is paired off in full.  A key's fingerprints are distinct, dealt in
tiles of bounded size, and a tile answers with a spanning forest of its links.
A key that spans several tiles is looked at again after the first components
are known: only pairs of different components can still matter, so everything
but the key's largest component is sent to the key's other tiles.  That is
exact for components, whatever the size of a group.

Defined results: null and empty texts have no shingle and fingerprint zero,
linked like any other; a text of fewer words than a shingle is one shingle;
null ids stay as rows and never name a component unless all its ids are null;
repeated rows share their component; texts of any length count whole; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_schema, mapped, materialise
from .textkit import chunks, mix

#: Fingerprints of one key that are compared in one piece.
TILE = 2048
#: Hot keys up to this number (32 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000


def _shingles(chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every k-word shingle of the chunk, words joined by
    single blanks, and each text's first index in them (then their number)."""
    starts, ends, at = chunk.words()
    words = [chunk.raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    joined = b" ".join(words)
    length = ends - starts
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(length + 1, out=begin[1:])
    count = np.diff(at)
    number = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    first = np.zeros(chunk.n + 1, np.int64)
    np.cumsum(number, out=first[1:])
    head = np.repeat(at[:-1] - first[:-1], number) + np.arange(first[-1])
    tail = np.minimum(head + k, np.repeat(at[1:], number))
    cut = map(slice, begin[head].tolist(), (begin[tail] - 1).tolist())
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(42)), np.uint64, int(first[-1]))
    return h, first


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes, as unsigned 64-bit."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    total = np.zeros((len(full), 64), np.int64)
    step = 1 << 16
    edge = first[full]
    for a in range(0, len(h), step):
        bits = np.unpackbits(h[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(edge, [a, a + step], side="left")
        if lo == len(edge) or edge[lo] > a:
            lo -= 1
        cut = np.maximum(edge[lo:hi] - a, 0)
        total[lo:hi] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    bit = total * 2 > np.diff(first)[full][:, None]
    out[full] = np.packbits(bit, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64).ravel()
    return out


def _fingerprints(batches, text: str, words: int, wide: bool, schema: pa.Schema):
    for batch in batches:
        hi, lo = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        for c in chunks(batch.column(text)):
            h, first = _shingles(c, words)
            hi[c.first : c.first + c.n] = majority(h, first)
            if wide:
                lo[c.first : c.first + c.n] = majority(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        kept = [batch.column(k) for k in schema.names[:-2]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], schema=schema)


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, bits: int = 64, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text, if not given) with fp_hi, fp_lo.

    bits: 64, or 128 (fp_lo then holds 64 more bits from a second hash)."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    need = list(dict.fromkeys([*keep, text]))
    out = df.select(*keep).withColumns({"fp_hi": F.lit(0).cast("long"), "fp_lo": F.lit(0).cast("long")}).schema
    schema = arrow_schema(out)
    return df.select(*need).transform(mapped, lambda it: _fingerprints(it, text, words, bits == 128, schema), out)


def _block_keys(bits: int, blocks: int, pick: int):
    """An array of keys for fp_hi and fp_lo: every choice of `pick` blocks of
    each 64-bit half, with the choice's number above the blocks' bits."""
    width = 64 // blocks
    keys = []
    for half in ("fp_hi", "fp_lo")[: bits // 64]:
        for chosen in combinations(range(blocks), pick):
            key = F.lit(len(keys)).cast("long")
            for b in chosen:
                part = F.shiftrightunsigned(F.col(half), b * width).bitwiseAND(F.lit((1 << width) - 1))
                key = F.shiftleft(key, width).bitwiseOR(part)
            keys.append(key)
    return F.array(*keys)


def _forest(hi: np.ndarray, lo: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one tile's fingerprints."""
    n, edges = len(hi), []
    left = np.arange(n)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count(hi[left] ^ hi[u]).astype(np.int64) + np.bitwise_count(lo[left] ^ lo[u]) <= radius
            if near.any():
                found = left[near]
                edges += [(u, v) for v in found.tolist()]
                front += found.tolist()
                left = left[~near]
    return edges


def _runs(batches, names: list[str], by: int = 2):
    """The rows of a partition sorted by key, a run of equal keys (the first
    `by` columns) at a time: many short runs together, never half a run."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:by]], axis=0)) + 1
        if len(change):
            yield [c[: change[-1]] for c in cols]
            held = [c[change[-1] :] for c in cols]
        else:
            held = cols
    if held is not None and len(held[0]):
        yield held


def tile_links(key: np.ndarray, tile: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by key and tile) that are linked: of a short run of one
    key and tile all links, of a long one a spanning forest."""
    edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
    size = np.diff(edge)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Short runs: all rows against the row k further down, for each k at once.
    last = np.repeat(edge[1:], size)
    at = np.flatnonzero(np.repeat(size <= 32, size))
    for k in range(1, 32):
        at = at[at + k < last[at]]
        if not len(at):
            break
        near = np.bitwise_count(hi[at] ^ hi[at + k]).astype(np.int64) + np.bitwise_count(lo[at] ^ lo[at + k]) <= radius
        a.append(at[near])
        b.append(at[near] + k)
    for g in np.flatnonzero(size > 32).tolist():
        s = slice(edge[g], edge[g + 1])
        pairs = np.array(_forest(hi[s], lo[s], radius), np.int64).reshape(-1, 2) + edge[g]
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _link_tiles(batches, radius: int, give: list[str], schema: pa.Schema):
    """The columns `give` of both ends of each link."""
    for key, tile, hi, lo, *more in _runs(batches, ["key", "tile", "fp_hi", "fp_lo", *give]):
        a, b = tile_links(key, tile, hi.view(np.uint64), lo.view(np.uint64), radius)
        yield pa.RecordBatch.from_arrays([pa.array(x[end]) for end in (a, b) for x in more], schema=schema)


def _probe_tiles(batches, radius: int, schema: pa.Schema):
    """Links of probes (members of lesser components) with a tile's own rows."""
    for key, tile, hi, lo, probe in _runs(batches, ["key", "tile", "fp_hi", "fp_lo", "probe"]):
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
        a, b = [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = s + np.flatnonzero(probe[s:e] == 0)
            for u in (s + np.flatnonzero(probe[s:e] == 1)).tolist():
                near = own[np.bitwise_count(hi[own] ^ hi[u]).astype(np.int64) + np.bitwise_count(lo[own] ^ lo[u]) <= radius]
                a.append(np.full(len(near), u))
                b.append(near)
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (hi[a], lo[a], hi[b], lo[b])], schema=schema)


def _node(hi: str, lo: str, wide: bool):
    one = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(one(hi), one(lo)) if wide else one(hi)


def tiled_keys(fps: DataFrame, blocks: int, pick: int, bits: int, tile: int) -> tuple[DataFrame, DataFrame, int]:
    """The fingerprints by key, tile of the key and number of its tiles; the
    keys of several tiles; their number."""
    spare = [c for c in fps.columns if c not in ("fp_hi", "fp_lo")]
    keyed = fps.select("fp_hi", "fp_lo", *spare, F.explode(_block_keys(bits, blocks, pick)).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > tile)
    hot = materialise(hot.select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("tiles")), "hot")
    n_hot = hot.count()
    tiled = keyed.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left")
    spread = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp_hi", "fp_lo"), F.col("tiles"))).cast("int")
    return tiled.select("key", spread.alias("tile"), "tiles", "fp_hi", "fp_lo", *spare), hot, n_hot


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows of one key and tile together."""
    return df.repartition(*by).sortWithinPartitions(*by)


def fingerprint_components(fps: DataFrame, radius: int, blocks: int, pick: int, bits: int = 64, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp_hi, fp_lo) to (node, comp): node is the
    fingerprint in hex, comp the least node it is linked to.  Only
    fingerprints that are linked to another appear.

    Links up to blocks - pick bits are all found; farther ones, up to
    `radius`, as far as two fingerprints agree on some choice of blocks."""
    wide = bits == 128
    tiled, hot, n_hot = tiled_keys(fps, blocks, pick, bits, tile)
    small = n_hot <= BROADCAST_KEYS
    pair = "ah long, al long, bh long, bl long"
    schema = arrow_schema(pair)
    links = dealt(tiled.drop("tiles"), "key", "tile").transform(mapped, lambda it: _link_tiles(it, radius, ["fp_hi", "fp_lo"], schema), pair)
    hexed = lambda df: df.select(_node("ah", "al", wide).alias("a"), _node("bh", "bl", wide).alias("b")).distinct()
    edges = materialise(hexed(links), "links")
    found = components(edges)
    if not n_hot:
        return found
    # Keys of several tiles: what isn't in the key's largest component meets the other tiles.
    found = materialise(found, "round1")
    members = tiled.where("tiles is not null").withColumn("node", _node("fp_hi", "fp_lo", wide))
    members = members.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = materialise(members.select("key", "tile", "tiles", "fp_hi", "fp_lo", "comp"), "members")
    per = members.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps"))
    open_keys = per.where("comps > 1")
    rest = members.join(F.broadcast(open_keys) if small else open_keys, "key")
    probes = rest.where("comp <> largest").withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    both = rest.select("key", "tile", "fp_hi", "fp_lo", F.lit(0).alias("probe")).unionByName(probes.select("key", "tile", "fp_hi", "fp_lo", F.lit(1).alias("probe")))
    more = dealt(both, "key", "tile").transform(mapped, lambda it: _probe_tiles(it, radius, schema), pair)
    return components(materialise(edges.unionByName(hexed(more)), "links"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, bits: int = 64, radius: int = 2, blocks: int = 4, pick: int = 2, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    component_id: the smallest id of all rows that can be reached by links,
    the row itself included.  With the defaults (64 bits, radius 2, two of
    four blocks) every link is found."""
    wide = bits == 128
    rows = materialise(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words, bits), "fp")
    distinct = materialise(rows.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("least")), "distinct")
    linked = fingerprint_components(distinct, radius, blocks, pick, bits, tile)
    nodes = distinct.withColumn("node", _node("fp_hi", "fp_lo", wide)).join(linked, "node", "left")
    nodes = nodes.select("node", "least", F.coalesce("comp", "node").alias("comp"))
    alone = nodes.join(nodes.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    return rows.withColumn("node", _node("fp_hi", "fp_lo", wide)).join(alone, "node").select("doc_id", F.col("node").alias("fingerprint"), "component_id")
