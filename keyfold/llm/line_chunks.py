"""Line dedup: content-defined chunks of lines that repeat are removed.

A text is cut into lines: after each line break, and after a full stop,
exclamation or question mark that a blank follows (prose without line breaks
has lines too).  A rolling hash over the hashes of the last two lines tells
whether a chunk ends there, so chunks depend on their own lines only and an
insertion moves no boundary but its neighbours'.  Chunks that occur twice or
more anywhere are found by hash, then grouped by their bytes: equal hashes of
different bytes never count as one.

Repeated chunks are anchors.  The lines beside a run of them (two chunks
before it, where the boundaries of a passage may still depend on the line
before the passage, and one behind) are compared too, line by line: those with
one hash of all text from the line to the anchor's other end are grouped by the
bytes of the line.

Of each repeated chunk the first occurrence stays (smallest id, null ids last,
then the smallest position).  A chunk counts in a text only as part of a run
of repeated chunks with at least `min_lines` lines and `min_words` words, so a
short line that is merely frequent stays; lines beside an anchor count in its
run.  A passage without a whole chunk between its own boundaries isn't found.

Defined results: null texts stay null, empty ones empty; rows equal in id and
text count as one document (all keep their first occurrence, and lose the
rest); other columns stay as they are, those named like the result's are an
error; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, dropped, mapped, materialise, refuse, unused
from .textkit import chunks, mix, text_array, views

MIN_LINES = 2
MIN_WORDS = 10
#: A hash is hot above this part of all occurrences.
HOT = 1000
_MARKS = np.zeros(256, bool)
_MARKS[[33, 46, 63]] = True


def cut_lines(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines of a batch chunk, and each text's first
    line (then their number).  The lines of a text cover it, separators too."""
    buf = c.buf
    ends = buf == 10
    ends[1:] |= (buf[1:] == 32) & _MARKS[buf[:-1]]
    last = c.doc_start[1:] - 1  # the blank put behind each text
    ends[last] = False
    stop = np.flatnonzero(ends) + 1
    edges = np.union1d(stop, last)
    start = np.r_[0, edges[:-1]]
    behind = np.isin(start, last)
    start = start + behind  # a text begins behind the blank of the one before
    full = start < edges
    start, edges = start[full], edges[full]
    return start, edges, np.searchsorted(start, c.doc_start)


def bare_ends(c, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ends b of ranges that begin at a, without closing white space, so
    that a passage is the same at the end of a text as in its middle."""
    bare = b.copy()
    for _ in range(4):
        bare -= (bare > a) & np.isin(c.buf[np.maximum(bare - 1, 0)], (10, 13, 32))
    return bare


def cut_chunks(c, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each chunk: its text, start and end in the buffer, hash, lines, words,
    first line, and that line's place in its text; of each line: start, end, words."""
    start, end, at = cut_lines(c)
    n = len(start)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64), e, e, e, e, e, e, e
    line = c.hashes(start, end, sums)
    before = np.r_[np.uint64(0), line[:-1]]
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    before[first] = 0
    closes = mix(before * np.uint64(0x9E3779B97F4A7C15) + line) % np.uint64(3) != 0
    closes[np.r_[first[1:], True]] = True
    tail = np.flatnonzero(closes)
    head = np.r_[0, tail[:-1] + 1]
    word_starts, _, _ = c.words()
    own_words = np.searchsorted(word_starts, end) - np.searchsorted(word_starts, start)
    a, b = start[head], end[tail]
    words = np.add.reduceat(own_words, head)
    doc = np.searchsorted(at, head, side="right") - 1
    return doc, a, b, c.hashes(a, bare_ends(c, a, b), sums), tail - head + 1, words, head, head - at[doc], start, end, own_words


def beside(doc: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks beside runs of repeated ones, and the anchor of each: the first
    chunk of a run for the two before it, the last one for that behind it."""
    n, chunk, anchor = len(doc), [], []
    for step in (1, 2, -1):
        k = np.flatnonzero(~again)
        k = k[(k + step >= 0) & (k + step < n)]
        k = k[(doc[k] == doc[k + step]) & again[k + step]]
        if step == 2:
            k = k[~again[k + 1]]
        chunk.append(k)
        anchor.append(k + step)
    return np.concatenate(chunk), np.concatenate(anchor)


def _hash_counts(batches, schema: pa.Schema):
    """Each text's distinct chunk hashes and how often it has them, by its mark."""
    for batch in batches:
        marks = batch.column("line_mark")
        for c in chunks(batch.column("line_text"), lower=False):
            doc, _, _, h, *_ = cut_chunks(c, c.sums())
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)])
            often = np.diff(np.r_[first, len(h)])
            yield pa.RecordBatch.from_arrays([marks.take(pa.array(doc[first] + c.first)), pa.array(h[first].view(np.int64)), pa.array(often)], schema=schema)


def _occurrences(batches, hot: np.ndarray, min_lines: int, min_words: int, schema: pa.Schema):
    """The chunks of repeated hashes that lie in a long enough run of them."""
    for batch in batches:
        ids, marks, told = batch.column("line_id"), batch.column("line_mark"), batch.column("hashes")
        row, own_hash = pc.list_parent_indices(told).to_numpy(), pc.list_flatten(told).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for c in chunks(batch.column("line_text"), lower=False):
            sums = c.sums()
            doc, a, b, h, lines, words, head, seq, start, end, line_words = cut_chunks(c, sums)
            again = np.isin(h, hot)
            # Told hashes hold for their own text only: text and hash are looked up as one number.
            part = slice(edges[c.first], edges[c.first + c.n])
            again |= np.isin(mix(h ^ mix(doc.astype(np.uint64))), mix(own_hash[part] ^ mix((row[part] - c.first).astype(np.uint64))))
            near, anchor = beside(doc, again)
            within = again.copy()
            within[near] = True
            opens = np.r_[True, (doc[1:] != doc[:-1]) | (within[1:] != within[:-1])][: len(doc)]
            run = np.cumsum(opens) - 1
            enough = (np.bincount(run, lines) >= min_lines) & (np.bincount(run, words) >= min_words) if len(run) else np.zeros(0, bool)
            whole = np.flatnonzero(again & enough[run])
            near, anchor = near[enough[run[near]]], anchor[enough[run[near]]]
            # Each line beside an anchor, and the text from it to the anchor's other end (for its hash).
            many = lines[near]
            line = np.repeat(head[near] - np.cumsum(many) + many, many) + np.arange(many.sum())
            near, anchor = np.repeat(near, many), np.repeat(anchor, many)
            before = near < anchor
            lo, hi = np.where(before, start[line], a[anchor]), np.where(before, b[anchor], end[line])
            side = np.where(before, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
            own = np.r_[doc[whole], doc[near]]
            place, stop = np.r_[a[whole], start[line]], np.r_[b[whole], end[line]]
            raw = [c.raw[x:y].rstrip(b" \r\n") for x, y in zip(place.tolist(), stop.tolist(), strict=True)]
            hashes = np.r_[h[whole], c.hashes(lo, bare_ends(c, lo, hi), sums) ^ side]
            numbers = (np.r_[seq[whole], seq[near] + line - head[near]], place - c.doc_start[own], stop - place, np.r_[lines[whole], np.ones(len(line), np.int64)], np.r_[words[whole], line_words[line]], hashes.view(np.int64))
            own = pa.array(own + c.first)
            yield pa.RecordBatch.from_arrays([ids.take(own), marks.take(own), *map(pa.array, numbers), pa.array(raw, pa.binary())], schema=schema)


def repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """line_id, line_mark (hash of id and text), seq (first line), place, size (bytes), lines, words
    and is_first of each occurrence of a repeated chunk.

    A hash with over 1/HOT of all occurrences is hot: there are fewer than HOT
    of them, so they are broadcast and their rows never meet in one task.
    Marks that collide do no harm here: a mark only brings a text hashes that
    are repeated anyway.  Byte ranges go back to a text by its id and mark."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).alias("line_id"), F.xxhash64(doc_id, text).alias("line_mark"), F.col(text).alias("line_text"))
    counted = "line_mark long, hash long, n long"
    schema = arrow_schema(counted)
    asked = materialise(keyed.select("line_mark", "line_text").transform(mapped, lambda it: _hash_counts(it, schema), counted), "asked")
    hashes = materialise(asked.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1"), "hashes", lean=True)
    total = hashes.agg(F.sum("n")).first()[0] or 0
    often = hashes.where(F.col("n") > total / HOT).select("hash").collect()
    hot = np.array([r["hash"] for r in often], np.int64).view(np.uint64)
    told = asked.select("line_mark", "hash").join(F.broadcast(spark.createDataFrame(often, "hash long")), "hash", "left_anti")
    told = told.join(hashes.where(F.col("n") <= total / HOT).select("hash"), "hash", "left_semi")
    told = told.groupBy("line_mark").agg(F.collect_set("hash").alias("hashes"))

    out = f"line_id {dict(docs.dtypes)[doc_id]}, line_mark long, seq long, place long, size long, lines long, words long, hash long, bytes binary"
    wide = arrow_schema(out)
    with_hashes = keyed.join(told, "line_mark", "left").select("line_id", "line_mark", "line_text", "hashes")
    occ = with_hashes.transform(mapped, lambda it: _occurrences(it, hot, min_lines, min_words, wide), out)
    occ = materialise(occ.withColumn("second", F.xxhash64("bytes", F.lit(5))), "occurrences", lean=True)
    dropped(asked, hashes)

    # Byte comparison: groups are formed by the bytes, partial groups first.
    order = F.struct(F.col("line_id").isNull().alias("no_id"), "line_id", "line_mark", "place")
    same = occ.groupBy("hash", "second", "bytes").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    # Should both hashes ever agree on different bytes, those chunks stay.
    same = same.groupBy("hash", "second").agg(F.count("*").alias("kinds"), F.max("n").alias("n"), F.min("first").alias("first"))
    same = materialise(same.where("n > 1 and kinds = 1"), "same", lean=True)
    size = same.agg(F.sum("n")).first()[0] or 0
    light = occ.select("line_id", "line_mark", "seq", "place", "size", "lines", "words", "hash", "second")
    often = spark.createDataFrame(same.where(F.col("n") > size / HOT).select("hash", "second", "first").collect(), same.select("hash", "second", "first").schema)
    busy = light.join(F.broadcast(often), ["hash", "second"])
    rare = light.join(F.broadcast(often.select("hash", "second")), ["hash", "second"], "left_anti").join(same.where(F.col("n") <= size / HOT).select("hash", "second", "first"), ["hash", "second"])
    return busy.unionByName(rare).select("line_id", "line_mark", "seq", "place", "size", "lines", "words", (order == F.col("first")).alias("is_first"))


def in_long_runs(row: np.ndarray, seq: np.ndarray, lines: np.ndarray, words: np.ndarray, min_lines: int, min_words: int) -> np.ndarray:
    """Of occurrences sorted by row and seq (their first line), those in a
    long enough run of adjacent ones."""
    if not len(row):
        return np.zeros(0, bool)
    run = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (seq[1:] != seq[:-1] + lines[:-1])]) - 1
    return ((np.bincount(run, lines) >= min_lines) & (np.bincount(run, words) >= min_words))[run]


def _remove(batches, min_lines: int, min_words: int, schema: pa.Schema):
    for batch in batches:
        texts, spans = batch.column("line_text"), batch.column("spans")
        row, flat = pc.list_parent_indices(spans).to_numpy(), pc.list_flatten(spans)
        part = {k: pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in ("seq", "place", "size", "lines", "words", "is_first")}
        order = np.lexsort((part["is_first"], part["seq"], row))
        # A line between two anchors counts once, as repeated if it is for either.
        once = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(part["seq"][order]) != 0)][: len(order)]
        order = order[once]
        row, part = row[order], {k: v[order] for k, v in part.items()}
        chosen = in_long_runs(row, part["seq"], part["lines"], part["words"], min_lines, min_words)
        again = np.bincount(row[chosen], part["size"][chosen], minlength=batch.num_rows).astype(np.int64)
        drop = chosen & ~part["is_first"].astype(bool)
        row, place, size = row[drop], part["place"][drop], part["size"][drop]
        out, at = views(texts), np.searchsorted(row, np.arange(batch.num_rows + 1))
        for k in np.unique(row).tolist():
            raw, end, parts = out[k], 0, []
            for a, n in zip(place[at[k] : at[k + 1]].tolist(), size[at[k] : at[k + 1]].tolist(), strict=True):
                parts.append(raw[end:a])
                end = a + n
            out[k] = b"".join([*parts, raw[end:]])
        gone = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(place, pa.int64()), pa.array(size, pa.int64())], ["place", "size"]))
        kept = [batch.column(c) for c in schema.names[:-3]]
        yield pa.RecordBatch.from_arrays([*kept, text_array(out, texts.is_valid().to_pylist(), schema.types[-3]), pa.array(again), gone.cast(schema.types[-1])], schema=schema)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with the columns line_text (the text without repeats),
    repeated_bytes (in runs of repeated chunks, kept or not) and removed (the
    byte ranges taken out)."""
    refuse(docs.columns, "line_text", "spans", "repeated_bytes", "removed")
    found = repeated_chunks(docs, text, doc_id, min_lines, min_words)
    spans = found.groupBy("line_id", "line_mark").agg(F.collect_set(F.struct("seq", "place", "size", "lines", "words", "is_first")).alias("spans"))
    mark = unused("line_mark", docs.columns)
    left = docs.withColumn(mark, F.xxhash64(doc_id, text))
    same = (F.col(f"d.{mark}") == F.col("s.line_mark")) & F.col(f"d.`{doc_id}`").eqNullSafe(F.col("s.line_id"))
    both = left.alias("d").join(spans.alias("s"), same, "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col(f"d.`{text}`").alias("line_text"), "s.spans")
    out = docs.withColumns({"line_text": F.col(text), "repeated_bytes": F.lit(0).cast("long"), "removed": F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("size")))}).schema
    schema = arrow_schema(out)
    return both.transform(mapped, lambda it: _remove(it, min_lines, min_words, schema), out)
