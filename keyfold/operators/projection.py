"""Printing columns of a keyed system, and edits of its metadata.

A system has keys (ix, key) of its rows, vectors (row_ix, vec_no, value) and
cells (row_ix, col_ix, value).  A projection is a comma list of column texts:
s (key), i (place), vN (vector N), d (diagonal), r (its root), cN (column N),
m (the row's stored values in order of columns), or arithmetic of v, d, r, c
and numbers, executed from left to right.

Only the vectors and cells that a projection names are read; they meet in one
aggregation by row.  Defined results: a cell or a vector's value that isn't
there is 0 (in m it is left out), a root of a negative and x / 0 are null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calculate

_TERM = re.compile(r"[sim]|[vc]\d+|[dr]")


def project(keys: DataFrame, vectors: DataFrame | None, cells: DataFrame, text: str, transposed: bool = False) -> DataFrame:
    """ix and a column named by each text of the list.  transposed: rows are
    the matrix's columns (keys are theirs), and vectors can't be had."""
    columns = [c.strip() for c in text.split(",")]
    names = [x for c in columns for x in re.findall(r"[A-Za-z]\d*", re.sub(r"\d+\.?\d*[eE][-+]?\d+", "", c))]
    for x in names:
        if not _TERM.fullmatch(x) or (transposed and x[0] == "v"):
            raise ValueError(f"no such column: {x}")
    wanted = sorted(set(names))
    number = lambda kind: [int(x[1:]) for x in wanted if x[0] == kind]
    row, col = ("col_ix", "row_ix") if transposed else ("row_ix", "col_ix")
    entries = cells.select(F.col(row).cast("long").alias("ix"), F.lit(None).cast("int").alias("vec_no"), F.col(col).cast("long").alias("place"), "value")
    if "m" not in wanted:
        need = F.lit(False)
        if {"d", "r"} & set(wanted):
            need = need | (F.col("ix") == F.col("place"))
        if number("c"):
            need = need | F.col("place").isin(number("c"))
        entries = entries.where(need)
    if number("v"):
        if vectors is None:
            raise ValueError("the system has no vectors")
        more = vectors.where(F.col("vec_no").isin(number("v")))
        entries = entries.unionByName(more.select(F.col("row_ix").cast("long").alias("ix"), F.col("vec_no").cast("int").alias("vec_no"), F.lit(None).cast("long").alias("place"), "value"))
    pick = lambda cond: F.sum(F.when(cond, F.col("value")))
    sums = {"d": pick(F.col("place") == F.col("ix")), **{f"v{n}": pick(F.col("vec_no") == n) for n in number("v")}, **{f"c{n}": pick(F.col("place") == n) for n in number("c")}}
    stored = F.transform(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value")))), lambda x: x["value"])
    got = entries.groupBy("ix").agg(*(v.alias(f"at_{k}") for k, v in sums.items()), *([stored.alias("at_m")] if "m" in wanted else []))
    rows = keys.select(F.col("ix").cast("long").alias("ix"), "key").join(got, "ix", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    values: dict[str, Column] = {k: zero(f"at_{k}") for k in sums}
    values["r"] = F.when(values["d"] >= 0, F.sqrt(values["d"]))
    plain = {"s": F.col("key"), "i": F.col("ix"), **({"m": F.coalesce("at_m", F.array().cast("array<double>"))} if "m" in wanted else {})}
    return rows.select("ix", *((plain[c] if c in plain else calculate(c, values)).alias(c) for c in columns if c != "i"), *([F.col("ix").alias("i")] if "i" in columns else []))


def vectors_to_matrix(keys: DataFrame, vectors: DataFrame, tags: list[str]) -> DataFrame:
    """row_key, col_key, value: vectors as columns of a matrix; tags name them
    in order, beyond them VEC and the number does."""
    named = F.coalesce(F.get(F.array(*map(F.lit, tags)), F.col("vec_no") - 1) if tags else F.lit(None), F.concat(F.lit("VEC"), F.col("vec_no").cast("string")))
    return vectors.join(keys.select(F.col("ix").alias("row_ix"), F.col("key").alias("row_key")), "row_ix").select("row_key", named.alias("col_key"), "value")


def edit_metadata(meta: DataFrame, longs: dict[str, int] | None = None, doubles: dict[str, float] | None = None, drop: list[str] | None = None, lines: list[str] | None = None) -> DataFrame:
    """meta (file, kind, place, name, long_value, double_value) of every file
    with entries set or added, entries taken out, and lines added to the readme."""
    spark = meta.sparkSession
    new = [("long", k, v, None) for k, v in (longs or {}).items()] + [("double", k, None, float(v)) for k, v in (doubles or {}).items()] + [("readme", k, None, None) for k in lines or []]
    table = spark.createDataFrame([(k, n, *r) for n, (k, *r) in enumerate(new)], "kind string, n int, name string, long_value long, double_value double")
    gone = [*(longs or {}), *(doubles or {}), *(drop or [])]
    kept = meta.where(~(F.col("kind").isin("long", "double") & F.col("name").isin(gone))) if gone else meta
    last = kept.groupBy("file", "kind").agg((F.max("place") + 1).alias("next"))
    every = meta.select("file").distinct().crossJoin(F.broadcast(table))  # some rows a file
    added = every.join(last, ["file", "kind"], "left").select("file", "kind", (F.coalesce("next", F.lit(0)) + F.col("n")).cast("int").alias("place"), "name", "long_value", "double_value")
    return kept.select(added.columns).unionByName(added)
