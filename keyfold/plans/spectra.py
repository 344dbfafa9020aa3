"""Spherical-harmonic and local-frame queries that SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyed, spectra
from .matrices import rounded
from .registry import query, table
from .relations import _ST, stations

_FIELD = "f AS (SELECT CAST(p_size % 6 AS INTEGER) AS l, CAST(p_partkey % 3 AS INTEGER) AS m, p_retailprice AS c, p_retailprice / 7 AS s FROM part)"


def field(spark, d):
    """Coefficients made of parts: degrees to 5, orders to 2."""
    price = F.col("p_retailprice")
    return table(spark, d, "part").select((F.col("p_size") % 6).cast("int").alias("l"), (F.col("p_partkey") % 3).cast("int").alias("m"), price.alias("c"), (price / 7).alias("s"))


@query(
    "h15_synthesis",
    f"""WITH {_ST}, {_FIELD}, k AS (SELECT l, m, sum(c) AS c, sum(s) AS s FROM f WHERE l <= 2 AND m <= l GROUP BY l, m),
p AS (SELECT c_custkey, radians(lon) AS x, sin(radians(lat)) AS t, cos(radians(lat)) AS u FROM st),
b AS (SELECT c_custkey, l, m, c, s, x, CASE WHEN l = 0 THEN 1 WHEN l = 1 AND m = 0 THEN sqrt(3) * t WHEN l = 1 THEN sqrt(3) * u
 WHEN m = 0 THEN sqrt(5) * (1.5 * t * t - 0.5) WHEN m = 1 THEN sqrt(15) * t * u ELSE sqrt(15) / 2 * u * u END AS q FROM p CROSS JOIN k)
SELECT c_custkey, round(sum(q * (c * cos(m * x) + s * sin(m * x))) / 1e4, 5) AS value FROM b GROUP BY c_custkey""",
)
def h15(spark, d):
    got = spectra.synthesise(stations(spark, d).select("c_custkey", "lon", "lat"), field(spark, d), 2)
    return got.select("c_custkey", F.round(F.col("value") / 1e4, 5).alias("value"))


@query("h5_add_fields", f"WITH {_FIELD} SELECT l, m, round(sum(c) - 0.5 * sum(CASE WHEN l < 3 THEN c ELSE 0 END), 4) AS c, round(sum(s) - 0.5 * sum(CASE WHEN l < 3 THEN s ELSE 0 END), 4) AS s FROM f GROUP BY l, m")
def h5(spark, d):
    f = field(spark, d)
    return spectra.add_fields([(1.0, f), (-0.5, f.where("l < 3"))]).select("l", "m", F.round("c", 4).alias("c"), F.round("s", 4).alias("s"))


@query("h9_permanent_tide", f"WITH {_FIELD} SELECT l, m, count(*) AS n, round(sum(CASE WHEN l = 2 AND m = 0 THEN c + 1e9 * -0.31460 * 0.30190 / (6378136.46 * sqrt(4 * pi())) ELSE c END), 4) AS c FROM f GROUP BY l, m")
def h9(spark, d):
    got = spectra.permanent_tide(field(spark, d).withColumn("c", F.col("c") / 1e9)).withColumn("c", F.col("c") * 1e9)
    return got.groupBy("l", "m").agg(F.count("*").alias("n"), F.round(F.sum("c"), 4).alias("c"))


@query("h13_frame_change", "SELECT p_partkey AS n, round(-1.29 - (-1.29 + 2 * -0.887 * p_size) / 3 * (p_partkey = 1)::INT, 8) AS h, round(-0.887 * p_size - (-1.29 + 2 * -0.887 * p_size) / 3 * (p_partkey = 1)::INT, 8) AS l, round(-1.0 - (-1.29 + 2 * -0.887 * p_size) / 3 * (p_partkey = 1)::INT, 8) AS k FROM part")
def h13(spark, d):
    love = table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.lit(-1.29).alias("h"), (F.lit(-0.887) * F.col("p_size")).alias("l"), F.lit(-1.0).alias("k"))
    return spectra.degree_one_frame(love, "CF").select("n", *[F.round(c, 8).alias(c) for c in ("h", "l", "k")])


@query("g11_height_east_north", f"WITH {_ST}, r AS (SELECT *, radians(lon) AS x, radians(lat) AS y, c_acctbal AS a, c_acctbal / 2 AS b, h AS c FROM st) SELECT c_custkey, round(a * cos(y) * cos(x) + b * cos(y) * sin(x) + c * sin(y), 5) AS up, round(b * cos(x) - a * sin(x), 5) AS east, round(c * cos(y) - a * sin(y) * cos(x) - b * sin(y) * sin(x), 5) AS north FROM r")
def g11(spark, d):
    st = stations(spark, d)
    up, east, north = keyed.height_east_north(F.col("c_acctbal"), F.col("c_acctbal") / 2, F.col("h"), F.col("lon"), F.col("lat"))
    return st.select("c_custkey", F.round(up, 5).alias("up"), F.round(east, 5).alias("east"), F.round(north, 5).alias("north"))


@query("n5_permute", "SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS BIGINT) AS ix, s_suppkey, s_acctbal FROM supplier")
def n5(spark, d):
    s = table(spark, d, "supplier")
    order = s.select("s_suppkey", "s_acctbal")
    return rounded(keyed.permuted(s.select("s_suppkey", "s_acctbal"), keyed.permutation(order, "s_suppkey", [F.desc("s_acctbal"), F.asc("s_suppkey")]), "s_suppkey").select("ix", "s_suppkey", "s_acctbal"))


@query("n7_strict_match", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def n7(spark, d):
    n = table(spark, d, "nation")
    return keyed.strict_match(n, table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", whole_right=False).select("n_nationkey", "n_name", "r_name")
