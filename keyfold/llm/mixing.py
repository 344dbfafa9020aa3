"""Mixing sources to target weights by entropy balancing.

The rates r of the documents minimise the sum of r ln r - r + 1 (the distance
from taking every document once) under 0 <= r <= cap and, for each source,
sum(r * size) = target.  The dual has one unknown per source and is convex;
its solution is an exponential tilt, r = min(cap, exp(lambda * size / mean)).
Newton's method finds lambda: each iteration aggregates the tilted tokens and
their derivative over a table of (source, size, number of documents), which
is distributed, partially aggregated and much smaller than the documents.
Steps that leave the bracket known so far are replaced by bisection.

Rates become whole copies by carrying what is left over: within a piece of a
source (bounded, cut by a hash of the id) documents go from long to short,
and each gets the lower or upper whole number next to its rate, whichever
keeps the piece's words closest to its tilted words; short documents come
last, so little is left.  Pieces are independent tasks: a hot source is just
more pieces.

Defined results: null texts have size 0 and are taken zero words; null is a
source of its own, last in order; repeated rows are documents each; an empty
table gives an empty result; a source of only empty texts has target 0; a
target at the cap takes every document `cap` times exactly; other columns of
the input are kept by `mix_documents` and ignored by `mix`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, unused

CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are rounded in one piece.
PIECE = 4000
MAX_ITERATIONS = 80


def words_of(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """From (source, size): source, source_size, target.

    Weights 1, 2, 3, repeating, in the order of code points, null last.  A
    target stops at cap times the source's size; the excess is shared anew by
    weight.  That level has a closed form: with the sources sorted by
    size/weight, the first that isn't capped fixes it.  The windows run over
    one row per source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    everyone = Window.partitionBy()
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    by = by.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    total, weights = F.sum(F.col("source_size").cast("double")).over(everyone), F.sum("weight").over(everyone)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", (total - left) / (weights - used))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everyone)["level"]
    return by.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).select("source", "source_size", "target")


def solve_tilts(sized: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-9) -> DataFrame:
    """source, tilt: the lambda of each source, by distributed Newton steps.

    Rates at the cap (target = cap * size) have an infinite tilt, rates at
    zero (target 0) a negative infinite one."""
    table = materialise(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    per = table.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum("n").alias("docs"))
    state = targets.alias("t").join(per.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")))
    state = state.select("t.source", "target", (F.col("tokens") / F.col("docs")).alias("mean"), F.col("tokens").cast("double").alias("tokens"))
    inf = float("inf")
    state = state.withColumns({"tilt": F.lit(0.0), "low": F.lit(-inf), "high": F.lit(inf), "done": F.col("target") >= F.col("tokens") * cap * (1 - 1e-12)})
    state = state.withColumn("tilt", F.when(F.col("done"), F.lit(inf)).otherwise(F.lit(0.0)))
    state = materialise(state, "tilt")
    for _ in range(MAX_ITERATIONS):
        if state.where("not done").isEmpty():
            break
        open_ = state.where("not done").alias("s")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.log(F.lit(float(cap)))))
        free = F.col("tilt") * x < F.log(F.lit(float(cap)))
        sums = (
            table.alias("d").join(open_, F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("s.source", (F.col("n") * F.col("size") * rate).alias("f"), (F.col("n") * F.col("size") * rate * F.when(free, x).otherwise(0.0)).alias("g"))
            .groupBy("source").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
        )
        s = state.alias("s").join(sums.alias("u"), F.col("s.source").eqNullSafe(F.col("u.source")), "left")
        gap = F.col("f") - F.col("target")
        low = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(gap, F.col("g"))
        middle = F.when(F.col("lo2") == -inf, F.least(F.col("tilt") * 2, F.lit(-1.0))).when(F.col("hi2") == inf, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        s = s.select("s.source", "target", "mean", "tokens", "tilt", "done", F.when(F.col("done"), F.col("low")).otherwise(low).alias("lo2"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("hi2"), gap.alias("gap"), step.alias("step"))
        inside = (F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")) & F.col("step").isNotNull()
        done = F.col("done") | (F.abs("gap") <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("hi2") - F.col("lo2") < 1e-14 * F.greatest(F.abs("hi2"), F.lit(1.0))) | (F.col("hi2") < -700)
        s = s.select("source", "target", "mean", "tokens", F.when(done, F.col("tilt")).when(inside, F.col("step")).otherwise(middle).alias("tilt"), F.col("lo2").alias("low"), F.col("hi2").alias("high"), done.alias("done"))
        state = materialise(s, "tilt")
    else:
        raise RuntimeError("the tilts did not settle")
    return state.select("source", "tilt", "mean")


def _round_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of one piece, the longest document first."""
    pdf = pdf.sort_values(["size", "doc_id", "mix_row"], ascending=[False, True, True], na_position="last", kind="stable")
    size, rate = pdf["size"].to_numpy(np.float64), pdf["rate"].to_numpy(np.float64)
    low = np.floor(rate + 1e-9)
    high = np.where(rate - low > 1e-9, low + 1, low)
    copies, owed = np.empty(len(size), np.int64), 0.0
    for i in range(len(size)):
        owed += rate[i] * size[i]
        n = low[i] if owed - low[i] * size[i] < high[i] * size[i] - owed else high[i]
        copies[i] = n
        owed -= n * size[i]
    return pdf.assign(copies=copies).drop(columns=["rate", "piece", "mix_key"])


def copies(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, mix_row, source, size, source_size, target, copies of each row
    of docs (doc_id, source, size, mix_row).  docs must be a stored table."""
    targets = materialise(source_targets(docs, cap), "targets")
    tilts = solve_tilts(docs, targets, cap)
    per = docs.groupBy("source").agg(F.count("*").alias("source_docs"))
    facts = targets.alias("t").join(per.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source"))).join(tilts.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    facts = facts.select(F.col("t.source").alias("source_"), "source_size", "target", "source_docs", "tilt", "mean")
    x = F.col("size") / F.col("mean")
    exponent = F.least(F.col("tilt") * x, F.log(F.lit(float(cap))))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), 0.0).otherwise(F.least(F.exp(exponent), F.lit(float(cap))))
    pieces = F.ceil(F.col("source_docs") / PIECE).cast("long")
    rows = docs.join(facts, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.select("doc_id", "mix_row", "source", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", F.lit(11)), pieces).alias("piece"))
    rows = rows.withColumn("mix_key", F.coalesce(F.col("source"), F.lit("\u0000null")))
    out = rows.drop("rate", "piece", "mix_key").withColumn("copies", F.lit(0).cast("long")).schema
    return rows.groupBy("mix_key", "piece").applyInPandas(_round_piece, out)


def _sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"), F.xxhash64(F.col(text), F.lit(3)).alias("mix_row"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), source, copies."""
    sized = materialise(_sized(docs, doc_id, source, text), "sized")
    got = copies(sized, cap)
    return got.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def mix_documents(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to cap times)."""
    at, n, one = (unused(c, docs.columns) for c in ("mix_row", "copies", "copy"))
    whole = materialise(docs.withColumn(at, F.monotonically_increasing_id()), "mixrows")
    sized = materialise(whole.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.col(at).alias("mix_row")), "sized")
    taken = copies(sized, cap).where("copies > 0").select(F.col("mix_row").alias(at), F.col("copies").alias(n))
    again = whole.join(taken, at).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return again.select(*docs.columns)
