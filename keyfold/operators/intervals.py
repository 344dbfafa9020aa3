"""Which interval of a station holds a time, and positions carried to it.

Intervals are cut into bins of time and joined with the points of their bin, so
that a point meets the intervals near it and no others; an interval is only
copied to bins that its station's points have, so an open end costs no more.

Defined results: an interval holds what is strictly between its ends; a null
start or end is open; of several that hold a point the first (least rank)
counts; a point that none holds has nulls; null times and stations are held by
none; equal points each have a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holding(points: DataFrame, intervals: DataFrame, by: str, t: str, take: list[str], width: float) -> DataFrame:
    """points and the columns `take` of intervals (by, start, end, rank, ...)
    of the first interval that holds each; width: of a bin."""
    bin_ = lambda c: F.floor(c / width)
    asked = points.where(F.col(t).isNotNull()).select(by, F.col(t).cast("double").alias("t")).distinct().withColumn("bin", bin_(F.col("t")))
    span = asked.groupBy(by).agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    near = intervals.join(span, by)
    first, last = F.greatest(F.coalesce(bin_(F.col("start")), F.col("low")), F.col("low")), F.least(F.coalesce(bin_(F.col("end")), F.col("high")), F.col("high"))
    spread = near.where(first <= last).withColumn("bin", F.explode(F.sequence(first, last)))
    # Bins without points take part in no join.
    spread = spread.join(asked.select(by, "bin").distinct(), [by, "bin"], "left_semi")
    inside = (F.coalesce(F.col("start") < F.col("t"), F.lit(True))) & (F.coalesce(F.col("t") < F.col("end"), F.lit(True)))
    hit = asked.join(spread.select(by, "bin", "start", "end", "rank", *take), [by, "bin"]).where(inside)
    best = hit.groupBy(by, "t").agg(F.min(F.struct("rank", *take)).alias("best")).withColumnRenamed("t", "at")
    got = points.join(best.withColumnRenamed(by, "of"), (F.col(by) == F.col("of")) & (F.col(t).cast("double") == F.col("at")), "left")
    return got.select(*points.columns, *(F.col(f"best.{c}").alias(c) for c in take))


def solution_at(points: DataFrame, table: DataFrame, by: str, t: str, now: float, least: float = 0.0, width: float = 52.0) -> DataFrame:
    """points with `solution` of a discontinuity table (by, solution, start,
    end, kind, rank).  Rows of kind V (velocities) don't count, an open end is
    `now`, and intervals shorter than `least` don't count."""
    rows = table.where(F.coalesce(F.col("kind") != "V", F.lit(True))).withColumn("end", F.coalesce("end", F.lit(float(now))))
    rows = rows.where(F.coalesce(F.col("end") - F.col("start") >= least, F.lit(True)))
    return holding(points, rows, by, t, ["solution"], width)


ANY = "----"


def reference_positions(points: DataFrame, cumulative: DataFrame, by: str, t: str) -> DataFrame:
    """points (by, component, solution, t, ...) with `reference` = pos + vel (t
    - epoch) of cumulative (by, solution, kind STA or VEL, component, value,
    epoch), and `used`, the solution it came from.

    A solution counts if it has all six components; where a point's own doesn't,
    the one named ---- steps in."""
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    whole = cumulative.where(F.col("kind").isin("STA", "VEL") & F.col("component").isin("X", "Y", "Z")).groupBy(by, "solution").agg(F.count_distinct("kind", "component").alias("parts")).where("parts = 6")
    rows = cumulative.join(whole.select(by, "solution"), [by, "solution"], "left_semi").groupBy(by, "solution", "component").agg(pick("STA").alias("pos"), pick("VEL").alias("vel"), F.max("epoch").alias("epoch"))

    def side(name: str, cond: Column | None = None) -> DataFrame:
        got = rows if cond is None else rows.where(cond)
        return got.select(F.col(by).alias(f"{name}_by"), F.col("solution").alias(f"{name}_solution"), F.col("component").alias(f"{name}_component"), F.struct("pos", "vel", "epoch", "solution").alias(name))

    own, other = side("own"), side("other", F.col("solution") == ANY)
    got = points.join(own, (F.col(by) == F.col("own_by")) & (F.col("solution") == F.col("own_solution")) & (F.col("component") == F.col("own_component")), "left")
    got = got.join(other, (F.col(by) == F.col("other_by")) & (F.col("component") == F.col("other_component")), "left")
    best = F.coalesce(F.col("own"), F.col("other"))
    return got.select(*points.columns, (best["pos"] + best["vel"] * (F.col(t) - best["epoch"])).alias("reference"), best["solution"].alias("used"))
