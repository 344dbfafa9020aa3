"""Near copies: texts whose sets of word shingles have a Jaccard similarity of
0.8 at least; one row of each group of them stays.

First come the SimHash proposals: 64-bit fingerprints that share two of four
blocks and differ in at most `radius` bits.  Each proposal is checked on the
shingles themselves.  SimHash alone can't find every pair at 0.8 (such pairs
differ in some ten bits), so what it leaves is searched by prefixes: in an
order of shingles that all texts share (frequent ones last, then by hash),
similar sets share shingles near the beginning.

How long a prefix: two sets of x and y shingles at 0.8 at least share ceil(0.8 x)
and ceil(0.8 y) at least.  Of the shared ones, the k-th in the order then has at
most x - ceil(0.8 x) others of its set before it that aren't shared, so it is
among the first x - ceil(0.8 x) + k of the one set and likewise of the other.
Prefixes are that long for k = `NEED` (or all that must be shared, if fewer).  Of
two prefixes of p and q keys, one ends first; if c of its keys are in the other,
p - c (or q - c) shingles of its set are surely not shared, so near copies have
c >= 4 (x + y) / 9 - max(x - p, y - q).  Only such pairs are looked at.  No pair
is left to chance, and none depends on which shingles come last.

No group is paired off in full.  A key of up to 32 rows gives its pairs; in a
larger one, all rows meet one row of the key's largest component, and once the
new components are known, rows outside the largest meet the others and only true
links come out.  Keys with more rows than a tile are split over tiles.

Defined results: null and texts without words are equal to each other; a text
of fewer words than a shingle is one shingle; equal word sequences count as
copies unseen; the row with the smallest id stays (rows without ids after
them; of several rows with that id, any); all columns stay, whatever their
names; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_schema, mapped, materialise
from .simhash import BROADCAST_KEYS, TILE, _link_tiles, _runs, dealt, majority, tiled_keys
from .textkit import LOWER, chunks, set_hashes, views

#: Shingles that come last in the order, the most frequent ones.
ORDER_TERMS = 50_000
#: Hashes that are counted together.
PIECE = 1 << 21
#: Shingles of lesser hashes are counted one and all; others only where a piece has them in over three texts, as they seldom come into a prefix.
LOW = np.uint64(1 << 63)
#: Keys of their prefixes that a pair must share at least.
NEED = 4
SHORT = 32


def _shingle_counts(batches, words: int, schema: pa.Schema):
    """Shingles of low hashes, or that are in over three of the texts of a piece, and in how many."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        told = (n > 3) | (h < LOW)
        return pa.RecordBatch.from_arrays([pa.array(h[told].view(np.int64)), pa.array(n[told])], schema=schema)

    held, size = [], 0
    for batch in batches:
        for c in chunks(batch.column("text")):
            h, doc = set_hashes(c, words)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            held.append(h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]])
            size += len(held[-1])
            if size > PIECE:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER_TERMS most frequent shingles (sorted) and in how many of all
    texts they are (from LOW on, pieces where one is in three texts at most
    don't add to it).  They bear on speed, not on the result."""
    count = "key long, n long"
    schema = arrow_schema(count)
    counts = texts.select("text").transform(mapped, lambda it: _shingle_counts(it, words, schema), count).groupBy("key").agg(F.sum("n").alias("n")).where("n > 3")
    top = materialise(counts, "counts", lean=True).orderBy(F.desc("n"), "key").limit(ORDER_TERMS).toArrow()
    terms, ranks = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(terms)
    return terms[order], ranks[order]


def prefix_sizes(size: np.ndarray) -> np.ndarray:
    """The shingles of the prefix of sets with so many shingles."""
    shared = (4 * size + 4) // 5
    return size - shared + np.minimum(shared, NEED)


def required(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The common keys of their prefixes that two sets of so many shingles must have."""
    return (4 * (x + y) + 8) // 9 - np.maximum(x - prefix_sizes(x), y - prefix_sizes(y))


def _marked(batches, at: int, words: int, terms: np.ndarray, ranks: np.ndarray, schema: pa.Schema):
    """Adds to each row the fingerprint, a 128-bit mark of its words, the
    number of its shingles, and the prefix."""
    for batch in batches:
        n = batch.num_rows
        mark, fp = np.zeros((2, n), np.uint64), np.zeros(n, np.uint64)
        sizes = np.zeros(n, np.int32)
        keys, taken = [np.zeros(0, np.uint64)], np.zeros(n + 1, np.int32)
        for c in chunks(pc.struct_field(batch.column("row"), [at])):
            own = slice(c.first, c.first + c.n)
            edge = c.doc_start.tolist()
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True), c.first):
                mark[:, k] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(c.raw[a:b].split())), np.uint64)
            h, doc = set_hashes(c, words)
            rank = np.zeros(len(h), np.int64)
            if len(terms):
                spot = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                rank = np.where(terms[spot] == h, ranks[spot], 0)
            order = np.lexsort((h, rank, doc))
            h, doc = h[order], doc[order]
            fp[own] = majority(h, np.searchsorted(doc, np.arange(c.n + 1)))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            size = np.bincount(doc, minlength=c.n)
            take, sizes[own] = prefix_sizes(size), size
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            keys.append(h[pos < take[doc]])
            taken[c.first + 1 : c.first + c.n + 1] = take
        prefix = pa.ListArray.from_arrays(pa.array(np.cumsum(taken, dtype=np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
        cols = [pa.array(x) for x in (fp.view(np.int64), mark[0].view(np.int64), mark[1].view(np.int64), sizes)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *cols, prefix.cast(schema.types[-1])], schema=schema)


def _same_length(size: np.ndarray, a, b) -> np.ndarray:
    return 5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])


def _meet(batches, schema: pa.Schema):
    """Of rows sorted by key and tile: pairs that share a key (kind 0: x, y),
    and the rows of keys that aren't yet paired off (kind 1: key, row)."""
    for key, tile, tiles, at, comp, size in _runs(batches, ["key", "tile", "tiles", "at", "comp", "size"]):
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), True])
        run = np.diff(edge)
        a, b, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        last = np.repeat(edge[1:], run)
        near = np.flatnonzero(np.repeat((run <= SHORT) & (tiles[edge[:-1]] == 1), run))
        for k in range(1, SHORT):
            near = near[near + k < last[near]]
            if not len(near):
                break
            hit = near[(comp[near] != comp[near + k]) & _same_length(size, near, near + k)]
            a.append(hit)
            b.append(hit + k)
        for g in np.flatnonzero((run > SHORT) | (tiles[edge[:-1]] > 1)).tolist():
            own = np.arange(edge[g], edge[g + 1])
            names, which, count = np.unique(comp[own], return_inverse=True, return_counts=True)
            if len(names) == 1 and tiles[own[0]] == 1:
                continue
            largest = own[which == np.argmax(count)]
            hub = largest[np.argmin(at[largest])]
            hit = own[which != np.argmax(count)]
            hit = hit[_same_length(size, hit, hub)]
            a.append(np.full(len(hit), hub))
            b.append(hit)
            members.append(own)
        a, b, m = np.concatenate(a), np.concatenate(b), np.concatenate(members)
        none = np.zeros(len(a), np.int32)
        x, y = np.minimum(at[a], at[b]), np.maximum(at[a], at[b])
        cols = [np.r_[none, none[:0] + 1, np.ones(len(m), np.int32)], np.r_[x, key[m]], np.r_[y, at[m]], np.r_[none, size[m]], np.r_[required(size[a], size[b]), 0 * size[m]], np.r_[none, tile[m]], np.r_[none, tiles[m]]]
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(t.to_pandas_dtype())) for v, t in zip(cols, schema.types, strict=True)], schema=schema)


def _counter(lists: list[np.ndarray]):
    """A function that tells how many of some keys each of the lists holds."""
    flat = np.concatenate([np.zeros(0, np.int64), *lists])
    order = np.argsort(flat)
    flat, owner = flat[order], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]

    def count(keys: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(flat, keys).tolist(), np.searchsorted(flat, keys, side="right").tolist()
        return np.bincount(np.concatenate([owner[:0], *(owner[i:j] for i, j in zip(low, high, strict=True))]), minlength=len(lists))

    return count


def _hits(batches, more: list[str]):
    """Runs of rows sorted by key, tile and part, and of each the probes (rows
    outside a key's largest component) with the rows of the tile that they may
    be near copies of by their prefixes: (at, great, more columns, [(probe,
    rows)] of each key).  A pair is looked at under the least of the large keys it shares."""
    names = ["key", "tile", "part", "at", "comp", "size", "great", "probe", "large", "prefix", *more]
    for key, tile, part, at, comp, size, great, probe, large, prefix, *rest in _runs(batches, names, by=3):
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (part[1:] != part[:-1]), True])
        groups = []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = s + np.flatnonzero(probe[s:e] == 0)
            in_prefix, in_large = _counter([prefix[k] for k in own]), _counter([large[k] for k in own])
            found = []
            for u in (s + np.flatnonzero(probe[s:e] == 1)).tolist():
                common, before = in_prefix(prefix[u]), in_large(large[u][large[u] < key[s]])
                hit = (comp[own] != comp[u]) & (common >= required(size[own], size[u])) & (before == 0)
                hit = own[hit & _same_length(size, own, u) & ((great[own] == 1) | (at[own] > at[u]))]
                if len(hit):
                    found.append((u, hit))
            groups.append(found)
        yield at, great, rest, groups


def _active(batches, schema: pa.Schema):
    """The rows that any pair of _hits holds."""
    for at, _, _, groups in _hits(batches, []):
        rows = [np.zeros(0, np.int64), *(at[np.r_[u, hit]] for found in groups for u, hit in found)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(rows)))], schema=schema)


def _probe(batches, words: int, schema: pa.Schema):
    """The links among the pairs of _hits, checked on the shingles; of the largest component, one link is enough."""
    for at, great, (text,), groups in _hits(batches, ["text"]):
        a, b = [], []
        for found in groups:
            number: dict = {}
            known: dict[int, set] = {}

            def shingles(k: int, number=number, known=known, text=text) -> set:
                if k not in known:
                    known[k] = {number.setdefault(x, len(number)) for x in _shingle_set(text[k].encode("utf-8", "surrogatepass") if text[k] else b"", words)}
                return known[k]

            for u, hit in found:
                joined = False
                for v in hit[np.argsort(-great[hit], kind="stable")].tolist():
                    if great[v] and joined:
                        continue
                    x, y = shingles(u), shingles(v)
                    if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                        joined = joined or bool(great[v])
                        a.append(min(at[u], at[v]))
                        b.append(max(at[u], at[v]))
                known.pop(u, None)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def _shingle_set(text, words: int) -> set:
    w = bytes(text).translate(LOWER).split()
    return set(zip(*[w[j:] for j in range(words)], strict=False)) if len(w) >= words else {tuple(w)} if w else set()


def _alike(batches, words: int, schema: pa.Schema):
    """The pairs of texts whose sets of shingles are alike by 0.8 at least; the shingles are compared themselves."""
    for batch in batches:
        good, before, x = np.zeros(batch.num_rows, bool), None, set()
        for k, (a, s, t) in enumerate(zip(batch.column("a").to_pylist(), views(batch.column("text_a")), views(batch.column("text_b")), strict=True)):
            if a != before:
                before, x = a, _shingle_set(s, words)
            y = _shingle_set(t, words)
            good[k] = 9 * len(x & y) >= 4 * (len(x) + len(y))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in schema.names], schema=schema)


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of rows whose texts are near copies."""
    pairs = materialise(pairs.select("a", "b").where("a <> b").distinct(), "pairs")
    need = pairs.select(F.col("a").alias("at")).unionByName(pairs.select(F.col("b").alias("at"))).distinct()
    own = materialise(texts.join(F.broadcast(need) if need.count() <= BROADCAST_KEYS else need, "at", "left_semi"), "texts", lean=True)
    side = lambda k: own.select(F.col("at").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    out = "a long, b long"
    schema = arrow_schema(out)
    return materialise(both.transform(mapped, lambda it: _alike(it, words, schema), out), "alike", lean=True)


def near_copies(nodes: DataFrame, texts: DataFrame, words: int, radius: int, tile: int) -> DataFrame:
    """(node, comp) of all nodes (at, fp_hi, size, prefix) that have a
    near copy among them; texts has at, text of the nodes at least."""
    # Proposals of the fingerprints: equal ones, and the links of their least rows.
    hubs = materialise(nodes.groupBy("fp_hi").agg(F.min("at").alias("hub")), "hubs")
    equal = nodes.join(hubs, "fp_hi").select(F.col("hub").alias("a"), F.col("at").alias("b"))
    tiled, _, _ = tiled_keys(hubs.withColumn("fp_lo", F.lit(0).cast("long")), 4, 2, 64, tile)
    ends = "a long, b long"
    end_schema = arrow_schema(ends)
    near = dealt(tiled.drop("tiles"), "key", "tile").transform(mapped, lambda it: _link_tiles(it, radius, ["hub"], end_schema), ends)
    first = _verified(equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), texts, words)
    found = materialise(components(first), "round1")
    # Everything else: pairs of different components that share keys of their prefixes.
    keyed = nodes.join(found.withColumnRenamed("node", "at"), "at", "left")
    keyed = keyed.select(F.explode("prefix").alias("key"), "at", F.coalesce("comp", "at").alias("comp"), "size")
    hot = keyed.groupBy("key").count().where(F.col("count") > tile)
    hot = materialise(hot.select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("tiles")), "hot", lean=True)
    keyed = keyed.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    keyed = keyed.withColumn("tile", F.pmod(F.xxhash64("at"), F.col("tiles")).cast("int"))
    out = "kind int, x long, y long, size int, need int, tile int, tiles int"
    schema = arrow_schema(out)
    met = materialise(dealt(keyed, "key", "tile").transform(mapped, lambda it: _meet(it, schema), out), "met", lean=True)
    counted = met.where("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    second = _verified(counted.where("n >= need"), texts, words)
    edges = first.unionByName(second)
    members = met.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("at"), "size", "tile", "tiles")
    if members.isEmpty():
        return components(edges)
    found = materialise(components(edges), "round2")
    members = members.join(found.withColumnRenamed("node", "at"), "at", "left").withColumn("comp", F.coalesce("comp", "at"))
    members = materialise(members, "members")
    per = members.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps"))
    rest = members.join(per.where("comps > 1").select("key", "largest"), "key").withColumn("great", (F.col("comp") == F.col("largest")).cast("int"))
    rest = materialise(rest.drop("largest"), "rest", lean=True)
    large = rest.groupBy("at").agg(F.collect_list("key").alias("large"))
    rest = rest.join(large, "at").join(nodes.select("at", "prefix"), "at")
    every = F.explode(F.expr("sequence(0, tiles - 1)"))

    def tiles(rest: DataFrame, *more: str) -> DataFrame:
        cols = ["at", "comp", "size", "great", "large", "prefix", *more]
        own = rest.select("key", "tile", every.alias("part"), *cols, F.lit(0).alias("probe"))
        probes = rest.where("great = 0").withColumn("part", F.pmod(F.xxhash64("at", F.lit(1)), F.col("tiles")).cast("int"))
        return dealt(own.unionByName(probes.select("key", every.alias("tile"), "part", *cols, F.lit(1).alias("probe"))), "key", "tile", "part")

    # Texts are only dealt of rows that have a partner by their prefixes.
    one = "at long"
    one_schema = arrow_schema(one)
    active = materialise(tiles(rest).transform(mapped, lambda it: _active(it, one_schema), one).distinct(), "active", lean=True)
    rest = rest.join(active, "at", "left_semi").join(texts, "at")
    third = tiles(rest, "text").transform(mapped, lambda it: _probe(it, words, end_schema), ends)
    return components(edges.unionByName(materialise(third, "third", lean=True)))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, radius: int = 12, tile: int = TILE) -> DataFrame:
    """The rows of df, all columns, but one of each group of near copies.

    A group is what links connect.  radius says which pairs the fingerprints
    propose before the rest is searched; it bears on speed, not on the result."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    terms, ranks = frequent_shingles(df.select(F.col(text).alias("text")), words)
    marks = {c: F.lit(0).cast("long") for c in ("fp_hi", "mark_hi", "mark_lo")} | {"size": F.lit(0)}
    out = packed.withColumns(marks | {"prefix": F.array(F.lit(0).cast("long"))}).schema
    schema = arrow_schema(out)
    at = df.columns.index(text)
    rows = packed.transform(mapped, lambda it: _marked(it, at, words, terms, ranks, schema), out)
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    ids = rows.select("at", F.col(f"row.`{doc_id}`").alias("id"), "mark_hi", "mark_lo")
    least = lambda: (F.coalesce(F.min_by("at", "id"), F.min("at")).alias("at"), F.min("id").alias("id"))
    best = ids.groupBy("mark_hi", "mark_lo").agg(*least()).select("at", "id")
    nodes = materialise(rows.select("at", "fp_hi", "size", "prefix").join(best, "at"), "nodes", lean=True)
    linked = near_copies(nodes.drop("id"), rows.select("at", F.col(f"row.`{text}`").alias("text")), words, radius, tile)
    named = nodes.select("at", "id").join(linked.withColumnRenamed("node", "at"), "at", "left")
    kept = named.groupBy(F.coalesce("comp", "at").alias("comp")).agg(*least()).select("at")
    gone = materialise(rows.select("at").join(kept, "at", "left_anti"), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "at", "left_anti").select("row.*")
