"""Language-model scores by deleted interpolation.

The probability of a token after its context is a mixture of maximum-likelihood
estimates of orders 3, 2 and 1 and of the uniform distribution.  The weights
depend on how frequent the context is: contexts of two words and of one fall
into buckets by the powers of two of their counts, and each pair of buckets has
weights of its own.  They are learnt by expectation-maximisation on documents
that were kept out of the counts (`deleted`); the counts of all training
documents then take the place of those without them.

How it runs.  Documents are dealt into blocks of about `BLOCK_BYTES` of text by
a hash, so that no id, source or group of copies gathers.  A block sends each
of its distinct n-grams once, with how often it holds it, as sorted 64-bit
hashes cut by their leading bits into parts; a part adds the blocks' counts and
sends each block the sums for what it asked, in the same order.  A frequent
n-gram so travels once a block, and every n-gram of the table is counted: no
vocabulary is cut.  One order goes at a time, so that the shuffle holds one.
The number of parts follows the bytes of text, and so do the rows of the
shuffle, whose cells never hold less than one n-gram.

Defined results: a null text counts as empty, which is one end token; a null id
is training data and not held out; equal rows are each counted and scored; texts
of any length stay whole (a block is at least one text); without training data
every estimate is uniform and the base score is zero; without deleted documents
the weights are equal; an empty table gives an empty table; other columns are
ignored.  n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, dropped, mapped, materialise, trim
from .textkit import _P, chunks, mix

ORDER = 3
BLOCK_BYTES = 6 << 20
#: Tokens whose estimates are held at once, and distinct estimates of a row.
WINDOW, SLICE = 1 << 16, 1 << 15
#: Roles of a block: counted; deleted from the counts while weights are learnt; not learnt from.
COUNTED, DELETED, OUTSIDE = 0, 1, 2
_BEGIN, _END = (mix(np.array([x], np.uint64))[0] for x in (0xB0, 0xE0))
BUCKETS = 64


class Layout(NamedTuple):
    """Blocks of each role, and parts of the hashes."""

    blocks: tuple[int, int, int]
    parts: int


def layout(docs: DataFrame, text: str = "text") -> Layout:
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    return Layout((n, math.ceil(n / 5), math.ceil(n / 5)), n)


def dealt(docs: DataFrame, role: Column, plan: Layout, key: str, text: str) -> DataFrame:
    """doc, text, role and block of each document; blocks of a role follow those of the one before."""
    first = [0, plan.blocks[0], plan.blocks[0] + plan.blocks[1]]
    spread = F.xxhash64(key, text)
    place = F.lit(0)
    for r in (COUNTED, DELETED, OUTSIDE):
        place = F.when(role == r, first[r] + F.pmod(spread, F.lit(plan.blocks[r]))).otherwise(place)
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), role.cast("int").alias("role"), place.cast("int").alias("block"))


def padded(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each after `order` begin marks and before an
    end, and where each text begins (then the number of all)."""
    tokens, counts = [], []
    for c in chunks(texts):
        starts, ends, at = c.words()
        number = np.diff(at)
        width = number + order + 1
        edge = np.concatenate([[0], np.cumsum(width)])
        out = np.full(edge[-1], _BEGIN, np.uint64)
        out[np.arange(len(starts)) + np.repeat(edge[:-1] + order - at[:-1], number)] = c.hashes(starts, ends)
        out[edge[1:] - 1] = _END
        tokens.append(out)
        counts.append(width)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def grams(tokens: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each token but the first order - 1."""
    h = tokens.copy()
    for k in range(1, order):
        h = mix(h[:-1] * _P + tokens[k:])
    return h


def own_grams(tokens: np.ndarray, edge: np.ndarray, order: int, most: int) -> np.ndarray:
    """n-grams that end at each text's last begin mark or at a token of it."""
    use = np.ones(len(tokens), bool)
    if len(edge) > 1:
        use[(edge[:-1, None] + np.arange(most - 1)).ravel()] = False
    return grams(tokens, order)[use[order - 1 :]]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: planes of zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _short(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(x.max(initial=0))
    return bytes([kind.itemsize]) + _planes(x.astype(kind))


def _long(data: bytes) -> np.ndarray:
    return _numbers(memoryview(data)[1:], np.dtype(f"u{data[0]}"))


def _ask(order: int, most: int, parts: int):
    """Of a block's documents: for each part its distinct n-grams and their counts."""
    schema = arrow_schema(_ASKED)
    # Part p has the hashes from p * width on.
    width = (1 << 64) // parts + 1

    def one(block: pa.Table) -> pa.Table:
        text = block.column("text").combine_chunks()
        tokens, edge = padded(text, most)
        found, count = np.unique(own_grams(tokens, edge, order, most), return_counts=True)
        cut = np.searchsorted(found, np.array([min(p * width, (1 << 64) - 1) for p in range(parts)], np.uint64))
        cut = np.append(cut, len(found))
        rows = []
        for p in np.flatnonzero(np.diff(cut)):
            h, c = found[cut[p] : cut[p + 1]], count[cut[p] : cut[p + 1]]
            rows.append({"part": int(p), "block": block.column("block")[0].as_py(), "role": block.column("role")[0].as_py(), "hashes": _planes(np.diff(h, prepend=np.uint64(0))), "counts": _planes(c.astype(np.uint32))})
        del tokens, found, count
        trim()
        return pa.Table.from_pylist(rows, schema=schema)

    return one


_ASKED = "part int, block int, role int, hashes binary, counts binary"
_TOLD = "block int, part int, role int, total binary, kept binary, distinct long, number long, kept_number long"


def _tell():
    """Of a part's requests: the sums for each block, and once how many n-grams
    are known and how often they occur."""
    schema = arrow_schema(_TOLD)

    def one(part: pa.Table) -> pa.Table:
        rows = [part.column(c).to_pylist() for c in ("block", "role", "part")]
        hashes = [np.cumsum(_numbers(x.as_py(), np.uint64), dtype=np.uint64) for x in part.column("hashes")]
        counts = [_numbers(x.as_py(), np.uint32) for x in part.column("counts")]
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        role = np.repeat(rows[1], [len(h) for h in hashes])
        every = np.concatenate(counts).astype(float)
        kept = np.bincount(at, every * (role == COUNTED), len(known)).astype(np.uint64)
        total = kept + np.bincount(at, every * (role == DELETED), len(known)).astype(np.uint64)
        words = (total > 0) & (known != _BEGIN)
        out, lo = [], 0
        for k, (block, r, p) in enumerate(zip(*rows, strict=True)):
            where = at[lo : lo + len(hashes[k])]
            lo += len(where)
            out.append({"block": block, "part": p, "role": r, "total": _short(total[where]), "kept": _short(kept[where]) if r == DELETED else None})
            if not k:
                out[-1] |= {"distinct": int(words.sum()), "number": int(total[words].sum()), "kept_number": int(kept[words].sum())}
        trim()
        return pa.Table.from_pylist(out, schema=schema)

    return one


class Counts(NamedTuple):
    """told: the replies of each order; tokens, kept_tokens and vocabulary: of the
    training texts, of those not deleted, and distinct ones; ends included."""

    told: list[DataFrame]
    tokens: int
    kept_tokens: int
    vocabulary: int


def count(rows: DataFrame, plan: Layout, order: int = ORDER) -> Counts:
    told = []
    for k in range(1, order + 1):
        asked = rows.groupBy("block").applyInArrow(_ask(k, order, plan.parts), _ASKED)
        told.append(materialise(asked.groupBy("part").applyInArrow(_tell(), _TOLD), f"grams-{k}", lean=True))
    n = told[0].agg(F.sum("number").alias("n"), F.sum("kept_number").alias("kept"), F.sum("distinct").alias("v")).first()
    return Counts(told, n["n"] or 0, n["kept"] or 0, n["v"] or 0)


class Estimates(NamedTuple):
    """Of each token: its text, its count, and bucket and estimates of orders
    `order` to 0, one a column."""

    text: np.ndarray
    count: np.ndarray
    bucket: np.ndarray
    p: np.ndarray


def _log2(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.frexp(x)[1], 0)


def estimates(texts: pa.Array, replies: dict[int, list[bytes]], order: int, tokens: int, vocabulary: int) -> Iterator[Estimates]:
    """Some texts at a time.  replies: for each order the sums of the block's
    distinct n-grams, part by part."""
    seq, edge = padded(texts, order)
    sums = {k: (np.unique(own_grams(seq, edge, k, order)), np.concatenate([_long(x) for x in replies[k]])) for k in replies}
    lo, texts_ = 0, len(edge) - 1
    while lo < texts_:
        hi = max(int(np.searchsorted(edge, edge[lo] + WINDOW, side="right")) - 1, lo + 1)
        yield _estimates(seq[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo], lo, sums, order, tokens, vocabulary)
        lo = hi


def _estimates(seq: np.ndarray, edge: np.ndarray, shift: int, sums: dict, order: int, tokens: int, vocabulary: int) -> Estimates:
    number = np.diff(edge) - (order - 1)  # the last begin mark and all tokens
    doc = np.repeat(np.arange(len(number)), number)
    inner = np.ones(len(doc), bool)  # all but the last begin mark
    inner[np.cumsum(number) - number] = False
    before = np.flatnonzero(inner) - 1
    p = np.zeros((len(before), order + 1))
    bucket, first, above = np.zeros(len(p), np.int64), None, None
    for k in range(1, order + 1):
        found, count = sums[k]
        c = count[np.searchsorted(found, own_grams(seq, edge, k, order))].astype(float)
        own = c[inner]
        if k == 1:
            first, context = own, np.full(len(own), float(tokens))
        else:
            context = above
            if k >= order - 1:
                bucket = bucket + _log2(context).astype(np.int64) * BUCKETS ** (k - max(2, order - 1))
        p[:, order - k] = np.divide(own, context, out=np.zeros_like(own), where=context > 0)
        above = c[before]  # the same order, one token earlier
    p[:, order] = 1.0 / (vocabulary + 1)
    return Estimates(doc[inner] + shift, first, bucket, p)


def _with_replies(rows: DataFrame, replies: list[DataFrame], column: str):
    """Documents and replies of a block side by side, for cogrouping."""
    told = None
    for k, t in enumerate(replies, 1):
        t = t.select("block", "part", F.lit(k).alias("order"), F.col(column).alias("sums"))
        told = t if told is None else told.unionByName(t)
    return rows.groupBy("block").cogroup(told.groupBy("block"))


def _replies(told: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for r in sorted(told.select(["order", "part", "sums"]).to_pylist(), key=lambda r: (r["order"], r["part"])):
        out.setdefault(r["order"], []).append(r["sums"])
    return out


_SEEN = "buckets binary, estimates binary, times binary"


def _merged(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (told apart by 64-bit hashes) and their times."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * _P + np.ascontiguousarray(rows[:, k]).view(np.uint64))
    _, first, at = np.unique(h, return_index=True, return_inverse=True)
    return rows[first], np.bincount(at, times)


def _distinct(order: int, tokens: int, vocabulary: int):
    """Of a deleted block: its distinct (bucket, estimates), and how often each occurs."""
    schema = arrow_schema(_SEEN)

    def one(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        rows, times = [], []
        for e in estimates(docs.column("text").combine_chunks(), _replies(told), order, tokens, vocabulary):
            some, t = _merged(np.concatenate([e.bucket[:, None].astype(float), e.p[:, :order]], axis=1), np.ones(len(e.bucket)))
            rows.append(some)
            times.append(t)
        rows, times = _merged(np.concatenate(rows), np.concatenate(times))
        out = [{"buckets": rows[k : k + SLICE, 0].astype(np.int64).tobytes(), "estimates": np.ascontiguousarray(rows[k : k + SLICE, 1:]).tobytes(), "times": times[k : k + SLICE].astype(np.int64).tobytes()} for k in range(0, len(rows), SLICE)]
        del rows, times
        trim()
        return pa.Table.from_pylist(out, schema=schema)

    return one


def learn(rows: DataFrame, counts: Counts, order: int = ORDER, rounds: int = 12, prior: float = 1.0) -> tuple[np.ndarray, list[float]]:
    """Weights (bucket, order + 1), and the deleted texts' mean log10
    likelihood before each round.

    Each round is one pass over the deleted texts' distinct estimates and sums
    of a fixed number of buckets.  Every bucket starts, and is held, at `prior`
    tokens' worth of equal weights; a weight of unseen contexts falls by itself."""
    deleted = F.col("role") == DELETED
    seen = _with_replies(rows.where(deleted), [t.where(deleted) for t in counts.told], "kept")
    seen = materialise(seen.applyInArrow(_distinct(order, counts.kept_tokens, counts.vocabulary), _SEEN), "deleted", lean=True)
    size = BUCKETS ** min(order - 1, 2)
    weights = np.full((size, order + 1), 1.0 / (order + 1))
    least, history = 1.0 / (counts.vocabulary + 1), []
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros((size, order + 2)), 0.0
            for batch in batches:
                for b, e, t in zip(*(batch.column(k) for k in range(3)), strict=True):  # SLICE estimates each
                    bucket, times = np.frombuffer(b.as_py(), np.int64), np.frombuffer(t.as_py(), np.int64)
                    p = np.frombuffer(e.as_py(), float).reshape(-1, order)
                    share = held.value[bucket] * np.concatenate([p, np.full((len(p), 1), least)], axis=1)
                    whole = share.sum(axis=1)
                    likelihood += float(times @ np.log10(whole))
                    share *= (times / whole)[:, None]
                    for k in range(order + 1):
                        total[:, k] += np.bincount(bucket, share[:, k], size)
                    total[:, order + 1] += np.bincount(bucket, times, size)
            used = np.flatnonzero(total[:, order + 1])
            cells = [(int(b), k, float(total[b, k])) for b in used for k in range(order + 2)] + [(-1, 0, likelihood)]
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in cells], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["bucket", "term", "value"])

        got = mapped(seen.select("buckets", "estimates", "times"), expect, "bucket int, term int, value double").groupBy("bucket", "term").agg(F.sum("value").alias("value")).collect()  # buckets x terms
        total, likelihood = np.zeros((size, order + 2)), 0.0
        for r in got:
            if r["bucket"] < 0:
                likelihood = r["value"]
            else:
                total[r["bucket"], r["term"]] = r["value"]
        n = total[:, order + 1 :]
        weights = (total[:, : order + 1] + prior / (order + 1)) / (n + prior)
        history.append(likelihood / max(float(n.sum()), 1.0))
        held.unpersist()
    dropped(seen)
    return weights, history


_SCORED = "doc {kind}, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, tokens: int, vocabulary: int, held, kind: str):
    schema = arrow_schema(_SCORED.format(kind=kind))

    def one(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        total = np.zeros((4, docs.num_rows))
        for e in estimates(docs.column("text").combine_chunks(), _replies(told), order, tokens, vocabulary):
            logs = np.log10((e.p * held.value[e.bucket]).sum(axis=1))
            base = np.log10((e.count + 1) / (tokens + vocabulary + 1))
            for k, x in enumerate((np.ones(len(base)), e.count > 0, base, logs)):
                total[k] += np.bincount(e.text, x, docs.num_rows)
        trim()
        return pa.Table.from_arrays([docs.column("doc").combine_chunks(), *(pa.array(x.astype(np.int64)) for x in total[:2]), *(pa.array(x) for x in total[2:])], schema=schema)

    return one


def score(docs: DataFrame, held_out: Column, deleted: Column, order: int = ORDER, key: str = "doc_id", text: str = "text", rounds: int = 12) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each
    document.  Rows that are held_out teach nothing; those that are deleted
    teach the weights first and are counted then."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    kind = docs.schema[key].dataType.simpleString()
    plan = layout(docs, text)
    role = F.when(F.coalesce(held_out, F.lit(False)), OUTSIDE).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(COUNTED)
    rows = dealt(docs, role, plan, key, text)
    counts = count(rows, plan, order)
    weights, _ = learn(rows, counts, order, rounds)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    got = _with_replies(rows, counts.told, "total").applyInArrow(_score(order, counts.tokens, counts.vocabulary, held, kind), _SCORED.format(kind=kind))
    renamed = got.withColumnRenamed("doc", key)
    return renamed.select(key, F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
