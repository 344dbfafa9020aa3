"""Queries on functionals of the field made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import functionals as K
from .registry import query
from .spectra import _FIELD, field

_LOVE = "lv AS (SELECT n, -0.1 * n AS h, 0.02 * n AS q, -0.3 / (n + 1) AS k FROM (SELECT unnest(range(6)) AS n))"


def love(spark):
    n = F.col("id")
    return spark.range(6).select(n.alias("n"), (-0.1 * n).alias("h"), (0.02 * n).alias("l"), (-0.3 / (n + 1)).alias("k"))


@query("h1_water_height", f"WITH {_FIELD}, {_LOVE} SELECT l, m, round(sum(c * {K.WATER!r} * (2 * l + 1) / (1 + k)) / 1e10, 6) AS c, round(sum(s * {K.WATER!r} * (2 * l + 1) / (1 + k)) / 1e10, 6) AS s FROM f JOIN lv ON l = n GROUP BY l, m")
def h1(spark, d):
    got = K.scale(field(spark, d), "water", love(spark))
    return got.groupBy("l", "m").agg(F.round(F.sum("c") / 1e10, 6).alias("c"), F.round(F.sum("s") / 1e10, 6).alias("s"))


@query("j12_degree_scaling", f"WITH {_FIELD}, {_LOVE} SELECT l, m, round(sum(c / CASE WHEN l = 0 THEN {K.WATER / K.OCEAN!r} ELSE {K.RADIUS!r} * (1 + k - h) END) * 1e3, 6) AS c FROM f JOIN lv ON l = n GROUP BY l, m")
def j12(spark, d):
    got = K.scale(field(spark, d), "sea_level", love(spark), inverse=True)
    return got.groupBy("l", "m").agg(F.round(F.sum("c") * 1e3, 6).alias("c"))


@query("h8_restore_rates", f"WITH {_FIELD} SELECT l, m, count(*) AS n, round(sum(c + CASE WHEN l = 2 AND m < 2 THEN 5 * (l + m) ELSE 0 END), 4) AS c FROM f GROUP BY l, m")
def h8(spark, d):
    rates = spark.createDataFrame([(2, 0, 2.0, 0.0), (2, 1, 3.0, 0.0)], "l int, m int, c double, s double")
    got = K.add_rates(field(spark, d).withColumn("t", F.lit(2005.0)), rates)
    return got.groupBy("l", "m").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("c"))


@query("h6_replace_c20", f"WITH {_FIELD} SELECT l, m, round(sum(CASE WHEN l = 2 AND m = 0 THEN 3.5 ELSE c END), 4) AS c FROM f GROUP BY l, m")
def h6(spark, d):
    series = spark.createDataFrame([(1.0, 9.0), (2.0, 3.0), (3.0, 4.0), (9.0, 1.0)], "t double, c20 double")
    got = K.replace_c20(field(spark, d).withColumns({"stime": F.lit(2.0), "etime": F.lit(4.0)}), series)
    return got.groupBy("l", "m").agg(F.round(F.sum("c"), 4).alias("c"))
