"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max
inverted index, distance-weighted votes, calibrated scores, evidence.

Examples are at most `sample_rows` labelled rows, chosen by a hash of the id.
Terms are lower-case words and their first four and five bytes.  Of the terms of the
examples, those count whose presence differs most between the labels (a
chi-squared statistic), so that the cosine compares what the label is about
and not what a text happens to be about.  Both bounds fix the size of what is
broadcast; every row of the table is scored, over its whole text.

The index holds, per term, postings sorted by example and cut into blocks,
with the largest weight of each term in each block.  A query looks at blocks
in the order of their upper bounds and stops when the next bound is below the
k-th best cosine found: the k nearest are exact, ties going to the smaller id.

The vote is the share of squared cosines that belongs to label 1, drawn
towards the share among all examples.  A logistic curve fitted on the
examples, each asked without itself, turns votes into probabilities.

Defined results: null and empty texts, and texts without any term of the
index, get the (smoothed) share of label 1 among the examples without any;
null labels teach nothing, of several labels for one id the largest holds;
with no labels at all scores are 0.5; null ids are scored and count as not
held out; texts of any length are scored whole; an empty table gives an empty
table; other columns are ignored, those named like the result's are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sampled_labels
from .shared import arrow_schema, mapped, materialise, refuse
from .textkit import chunks, tokens

SAMPLE_ROWS = 12_000
MAX_TERMS = 4096
MIN_CHI2 = 12.0
MIN_ROWS = 4
NEIGHBOURS = 15
BLOCK = 64
#: Queries that are answered together; bounds the memory of a round.
QUERIES = 256
PREFIXES = (4, 5)


def terms(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each chunk: first text, number of texts, the text of each term
    occurrence and the term's hash."""
    for c in chunks(texts):
        starts, ends, at = tokens(c)
        doc = np.repeat(np.arange(c.n), np.diff(at))
        if not len(starts):
            yield c.first, c.n, doc, np.zeros(0, np.uint64)
            continue
        word = c.hashes(starts, ends)
        docs, found = [doc], [word]
        for k in PREFIXES:
            long = ends - starts > k
            docs.append(doc[long])
            found.append(c.hashes(starts[long], starts[long] + k) ^ np.uint64(0x5DEECE66D * k))
        yield c.first, c.n, np.concatenate(docs), np.concatenate(found)


def _term_counts(batches, schema: pa.Schema):
    """Partial counts: per term, the rows of label 0 and of label 1 with it."""
    for batch in batches:
        label = np.array(batch.column("label").to_pylist(), np.int64)
        for first, n, doc, term in terms(batch.column("text").to_pylist()):
            order = np.lexsort((doc, term))
            term, doc = term[order], doc[order]
            once = np.ones(len(term), bool)
            once[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
            term, y = term[once], label[first : first + n][doc[once]]
            edge = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            with_1 = np.add.reduceat(y, edge) if len(edge) else edge
            rows = np.diff(np.append(edge, len(term)))
            yield pa.RecordBatch.from_arrays([pa.array(term[edge].view(np.int64)), pa.array(rows - with_1), pa.array(with_1)], schema=schema)


def _vectors(batches, wanted: np.ndarray, schema: pa.Schema):
    for batch in batches:
        ids, label = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
        for first, n, doc, term in terms(batch.column("text").to_pylist()):
            rows = [(ids[first + k], label[first + k], t.tolist(), f.tolist()) for k, (t, f) in enumerate(_frequencies(n, doc, term, wanted))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _frequencies(n: int, doc: np.ndarray, term: np.ndarray, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its terms among `wanted` (their places) and how often."""
    if not len(wanted):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    place = np.searchsorted(wanted, term)
    place[place == len(wanted)] = 0
    hit = wanted[place] == term
    key, count = np.unique(doc[hit] * len(wanted) + place[hit], return_counts=True)
    cut = np.searchsorted(key, np.arange(n + 1) * len(wanted))
    key = key % len(wanted)
    return [(key[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]]) for k in range(n)]


class BlockMaxIndex:
    """Unit vectors of the examples, by term, in blocks of examples."""

    def __init__(self, wanted: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]]):
        """rows: id, label, places of terms in `wanted`, their frequencies."""
        self.wanted, n = wanted, len(rows)
        in_rows = np.bincount(np.concatenate([np.array(r[2], np.int64) for r in rows]) if rows else np.zeros(0, np.int64), minlength=len(wanted))
        self.idf = np.log((1 + n) / (1 + in_rows)) + 1
        empty = [r[1] for r in rows if not r[2]]
        self.share = (sum(r[1] for r in rows) + 0.5) / (n + 1)
        self.empty_share = (sum(empty) + self.share) / (len(empty) + 1)
        # Examples alike lie together, so that few blocks have high bounds.
        rows = sorted((r for r in rows if r[2]), key=lambda r: (max(r[2], key=lambda t: (self.idf[t], t)), r[2], r[0]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.float64)
        self.blocks = -(-len(rows) // BLOCK)
        owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        term = np.array([t for r in rows for t in r[2]], np.int64)
        weight = np.concatenate([self.vector(np.array(r[2]), np.array(r[3])) for r in rows]) if rows else np.zeros(0)
        self.rows = [(term[a:b], weight[a:b]) for a, b in zip(*self._cuts(owner, len(rows)), strict=True)]
        order = np.lexsort((owner, term))
        self.owner, self.weight = owner[order], weight[order]
        cell = term[order] * max(self.blocks, 1) + self.owner // BLOCK
        self.cut = np.searchsorted(cell, np.arange(len(wanted) * max(self.blocks, 1) + 1))
        self.most = np.zeros((len(wanted), self.blocks))
        np.maximum.at(self.most.reshape(-1), cell, self.weight)
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.curve = (0.0, 1.0)

    @staticmethod
    def _cuts(owner: np.ndarray, n: int) -> tuple[list[int], list[int]]:
        at = np.searchsorted(owner, np.arange(n + 1)).tolist()
        return at[:-1], at[1:]

    def vector(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[place]
        return w / math.sqrt(float(w @ w))

    def nearest(self, place: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosines above 0, and the cosines."""
        return next(self.nearest_of([(place, weight)], k, np.array([without])))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a block, and their weights in its examples."""
        if b not in self.opened:
            has = np.flatnonzero(self.most[:, b] > 0)
            a, e = self.cut[has * self.blocks + b], self.cut[has * self.blocks + b + 1]
            row = np.repeat(np.arange(len(has)), e - a)
            at = np.arange(len(row)) - np.repeat(np.cumsum(e - a) - (e - a), e - a) + np.repeat(a, e - a)
            weights = np.zeros((len(has), BLOCK))
            weights[row, self.owner[at] - b * BLOCK] = self.weight[at]
            self.opened[b] = has, weights
        return self.opened[b]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of many queries.  In each round a query asks for its next
        blocks, in the order of their bounds, and a block serves all queries
        that ask for it in one product; a query ends as nearest() says."""
        for lo in range(0, len(queries), QUERIES):
            part = queries[lo : lo + QUERIES]
            yield from self._nearest_part(part, k, np.full(len(part), -1) if without is None else without[lo : lo + QUERIES])

    def _nearest_part(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(queries)
        dense = np.zeros((n, len(self.wanted)))
        for q, (place, weight) in enumerate(queries):
            dense[q, place] = weight
        bound = dense @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, axis=1)
        query, found, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        worst, at, step = np.zeros(n), 0, 4
        while at < self.blocks:
            # Products may differ in the last digits, so a bound must be clearly below.
            ask_q, ask_r = np.nonzero((ranked[:, at : at + step] > 0) & (ranked[:, at : at + step] >= worst[:, None] - 1e-11))
            if not len(ask_q):
                break
            ask_b = order[ask_q, at + ask_r]
            by_block = np.argsort(ask_b, kind="stable")
            ask_q, ask_b = ask_q[by_block], ask_b[by_block]
            edges = np.r_[np.flatnonzero(np.r_[True, ask_b[1:] != ask_b[:-1]]), len(ask_b)]
            all_q, all_e, all_v = [query], [found], [value]
            for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                b, who = int(ask_b[a]), ask_q[a:e]
                has, weights = self.block(b)
                sums = np.round(dense[np.ix_(who, has)] @ weights, 12)
                j, i = np.nonzero((sums > 0) & (sums >= worst[who][:, None]))
                ok = b * BLOCK + i != without[who[j]]
                all_q.append(who[j[ok]])
                all_e.append(b * BLOCK + i[ok])
                all_v.append(sums[j[ok], i[ok]])
            query, found, value = np.concatenate(all_q), np.concatenate(all_e), np.concatenate(all_v)
            best = np.lexsort((self.ids[found], -value, query))
            query, found, value = query[best], found[best], value[best]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            query, found, value, rank = (x[rank < k] for x in (query, found, value, rank))
            worst[query[rank == k - 1]] = value[rank == k - 1]
            at, step = at + step, min(step * 2, 32)
        cut = np.searchsorted(query, np.arange(n + 1))
        return [(found[cut[q] : cut[q + 1]], value[cut[q] : cut[q + 1]]) for q in range(n)]

    def vote(self, found: np.ndarray, value: np.ndarray) -> float:
        w = value * value
        return float((w @ self.labels[found] + 0.1 * self.share) / (w.sum() + 0.1)) if len(found) else self.share

    def calibrate(self, k: int) -> None:
        """Fit the logistic curve by Newton steps on the examples' votes."""
        if not len(self.rows) or self.labels.min() == self.labels.max():
            return
        votes = np.array([self.vote(*near) for near in self.nearest_of(self.rows, k, np.arange(len(self.rows)))])
        x = np.stack([np.ones(len(votes)), np.log(votes / (1 - votes))], 1)
        beta = np.array([0.0, 1.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (self.labels - p) - 0.1 * (beta - [0.0, 1.0])
            beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        self.curve = float(beta[0]), float(beta[1])

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[float, list[int], list[float]]]:
        """Of each text (places of its terms, their frequencies): probability
        of label 1, ids of the nearest examples, their cosines."""
        near = self.nearest_of([(place, self.vector(place, count)) for place, count in texts if len(place)], k)
        a, b = self.curve
        for place, _ in texts:
            if not len(place):
                yield self.empty_share, [], []
                continue
            found, value = next(near)
            v = self.vote(found, value)
            yield 1 / (1 + math.exp(-min(max(a + b * math.log(v / (1 - v)), -30), 30))), self.ids[found].tolist(), value.tolist()


def build_index(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, sample_rows: int = SAMPLE_ROWS, k: int = NEIGHBOURS) -> BlockMaxIndex:
    """Index at most sample_rows labelled rows for which train_rows holds."""
    chosen = sampled_labels(labels, label, train_rows, sample_rows)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "examples")
    out = "term long, n0 long, n1 long"
    schema = arrow_schema(out)
    counts = rows.select("text", "label").transform(mapped, lambda it: _term_counts(it, schema), out)
    counts = counts.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_ROWS)
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(total.get(0, 0)), float(sum(total.values()) - total.get(0, 0))
    n = n0 + n1
    if n0 and n1:
        a, b = F.col("n1"), F.col("n0")
        chi = n * F.pow(a * n0 - b * n1, F.lit(2)) / ((a + b) * (n - a - b + 1e-9) * n0 * n1)
        best = counts.withColumn("chi", chi).where(F.col("chi") >= MIN_CHI2).orderBy(F.desc("chi"), "term").limit(MAX_TERMS)
        wanted = np.sort(np.array([r["term"] for r in best.select("term").collect()], np.int64).view(np.uint64))
    else:
        wanted = np.zeros(0, np.uint64)
    out = "doc_id long, label int, place array<long>, count array<long>"
    schema = arrow_schema(out)
    got = rows.transform(mapped, lambda it: _vectors(it, wanted, schema), out).toArrow().to_pylist()
    index = BlockMaxIndex(wanted, sorted((r["doc_id"], r["label"], r["place"], r["count"]) for r in got))
    if not got:
        index.share = index.empty_share = 0.5
    index.calibrate(k)
    index.rows, index.opened = [], {}  # need not be broadcast
    return index


def _scores(batches, index: BlockMaxIndex, k: int, evidence: int, text: str, schema: pa.Schema):
    for batch in batches:
        out = []
        for _, n, doc, term in terms(batch.column(text).to_pylist()):
            for p, ids, cosines in index.scores(_frequencies(n, doc, term, index.wanted), k):
                out.append((p, [{"doc_id": i, "cosine": c} for i, c in zip(ids[:evidence], cosines, strict=False)]))
        kept = [batch.column(c) for c in schema.names[:-2]]
        score, near = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array(near, schema.types[-1])], schema=schema)


def score(docs: DataFrame, index: BlockMaxIndex, text: str = "text", k: int = NEIGHBOURS, evidence: int = 3) -> DataFrame:
    """The columns of docs but the text, the score, and as evidence the
    nearest examples with their cosines."""
    keep = [c for c in docs.columns if c != text]
    refuse(keep, "score", "evidence")
    held = docs.sparkSession.sparkContext.broadcast(index)
    out = docs.select(*keep).withColumns({"score": F.lit(0.0), "evidence": F.array(F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("cosine")))}).schema
    schema = arrow_schema(out)
    return docs.transform(mapped, lambda it: _scores(it, held.value, k, evidence, text, schema), out)
