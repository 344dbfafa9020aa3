"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Features of a text are counts of hashed n-grams: one and two tokens (lower
case), and one to three token shapes (which kinds of signs a token holds,
whether it repeats the token before).  Counts are divided by the number of
tokens, so a score is a sparse dot product that doesn't depend on length.

Training reads at most `sample_rows` labelled rows, chosen by a hash of the
id; only their feature counts reach the driver.  Scoring streams the whole
table past the weights, whose size is fixed by `dims`.

Defined results: null and empty texts have no features and get the score of
the intercept; rows with null labels teach nothing; of several labels for one
id the largest holds; with no labels at all every score is 0.5; null ids are
scored and count as not held out; texts of any length are scored whole; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, mapped, trim
from .textkit import SHAPE_BIT, chunks, mix, tokens, views

DIMS = 1 << 18
#: Shares of tokens are small numbers; this makes steps of usual size.
SCALE = 20.0


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the FTRL-proximal updates."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 3


def features(texts: list[str | None], dims: int = DIMS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: first text, number of texts, the text of each feature
    occurrence, the feature, and the tokens of each text."""
    for c in chunks(texts, lower=False):
        starts, ends, at = tokens(c)
        number = np.diff(at)
        if not len(starts):
            yield c.first, c.n, np.zeros(0, np.int64), np.zeros(0, np.int64), number
            continue
        doc = np.repeat(np.arange(c.n), number)
        bits = SHAPE_BIT[c.buf]
        shape = np.bitwise_or.reduceat(bits, starts).astype(np.uint64)
        capital = (bits[starts] == 1).astype(np.uint64)
        low = c.buf.copy()
        capitals = (low >= 65) & (low <= 90)
        low[capitals] += 32
        c.buf = low
        word = c.hashes(starts, ends)
        again = np.zeros(len(word), np.uint64)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        shape = mix(shape + (capital << np.uint64(5)) + (again << np.uint64(6)) + np.uint64(1 << 20))
        feats, owners = [word, shape], [doc, doc]
        for base, most in ((word, 2), (shape, 3)):
            h = base
            for n in range(2, most + 1):
                h = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + base[n - 1 :])
                same = doc[: len(h)] == doc[n - 1 :]
                feats.append(h[same])
                owners.append(doc[: len(h)][same])
        yield c.first, c.n, np.concatenate(owners), (np.concatenate(feats) % np.uint64(dims)).astype(np.int64), number


def _counts(batches, dims: int, schema: pa.Schema):
    for batch in batches:
        labels = batch.column("label").to_pylist()
        rows: list[tuple] = []
        for first, n, owner, feat, number in features(batch.column("text"), dims):
            key, count = np.unique(owner * dims + feat, return_counts=True)
            cut = np.searchsorted(key, np.arange(n + 1) * dims)
            for k in range(n):
                own = slice(cut[k], cut[k + 1])
                share = (count[own] * (SCALE / max(int(number[k]), 1))).astype(np.float32)
                rows.append((labels[first + k], (key[own] % dims).astype(np.int32).tobytes(), share.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def fit_ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], dims: int = DIMS, how: Ftrl = Ftrl()) -> np.ndarray:
    """Weights of `dims` features and, last, of the intercept.  The examples
    are taken in the order given, `epochs` times."""
    z, n, w = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    for _ in range(how.epochs):
        for y, feat, x in examples:
            feat, x = np.append(feat, dims), np.append(x, 1.0)
            zi, ni = z[feat], n[feat]
            shrink = np.sign(zi) * how.l1 - zi
            wi = np.where(np.abs(zi) <= how.l1, 0.0, shrink / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / how.alpha
            z[feat] = zi + g - sigma * wi
            n[feat] = ni + g * g
    kept = np.abs(z) > how.l1
    w[kept] = (np.sign(z[kept]) * how.l1 - z[kept]) / ((how.beta + np.sqrt(n[kept])) / how.alpha + how.l2)
    return w.astype(np.float32)


def sampled_labels(labels: DataFrame, label: str, train: Column, sample_rows: int) -> DataFrame:
    """At most sample_rows ids of rows that may teach, with their label; which
    ones depends on the ids alone."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(train)
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_rows)


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, sample_rows: int = 8000, dims: int = DIMS, how: Ftrl = Ftrl()) -> np.ndarray:
    """Fit on labelled rows for which train_rows holds.  At most sample_rows
    ids are used, so their broadcast and what reaches the driver are bounded."""
    chosen = sampled_labels(labels, label, train_rows, sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    out = "label int, feat binary, share binary"
    schema = arrow_schema(out)
    examples = []
    for b in rows.transform(mapped, lambda it: _counts(it, dims, schema), out).toArrow().to_batches():
        examples += [(y, np.frombuffer(f, np.int32), np.frombuffer(x, np.float32)) for y, f, x in zip(b.column(0).to_pylist(), views(b.column(1)), views(b.column(2)), strict=True)]
    examples.sort(key=lambda e: (int(e[1].sum(dtype=np.int64)) * 2654435761 % 4294967291, e[0], xxhash.xxh3_128_digest(e[1])))  # some fixed mixed order
    weights = fit_ftrl(examples, dims, how)
    examples.clear()
    trim()
    return weights


def _scores(batches, weights: np.ndarray, text: str, schema: pa.Schema):
    dims = len(weights) - 1
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for first, n, owner, feat, number in features(batch.column(text), dims):
            dot = np.bincount(owner, weights=weights[feat], minlength=n)
            out[first : first + n] = dot * SCALE / np.maximum(number, 1)
        p = 1 / (1 + np.exp(-np.clip(out + weights[dims], -35, 35)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(p)], schema=schema)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of docs with one more column, the probability of label 1."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")
    held = docs.sparkSession.sparkContext.broadcast(weights)
    out = docs.withColumn(name, F.lit(0.0).cast("double")).schema
    schema = arrow_schema(out)
    return docs.transform(mapped, lambda it: _scores(it, held.value, text, schema), out)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder (null ids: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
