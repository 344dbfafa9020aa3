"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
is a partial aggregation and a join on the edge table, whose rows never grow.
Each round is written to the shared folder; nothing is gathered on the driver
but the number of edges and a checksum that tells when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of one sortable type to (node, comp): comp is the least
    node that can be reached.  Nodes without an edge do not appear; null ends
    and loops are left out; no edges give an empty table."""
    e = edges.select("a", "b").where("a <> b").distinct()
    seen = None
    for _ in range(MAX_ROUNDS):
        e = materialise(_small_star(_large_star(e)), "cc")
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen or sign[0] == 0:
            break
        seen = tuple(sign)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
