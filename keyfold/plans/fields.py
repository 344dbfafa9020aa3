"""Queries on filters, grids and derivatives of spherical-harmonic fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import couplings, filters, grids, isotropic, rotations, spectra
from .registry import query, table
from .relations import _ST, stations
from .spectra import _FIELD, field

_SEG = "cu AS (SELECT c_nationkey AS m, c_mktsegment AS field, c_acctbal / 1e4 AS x, c_custkey AS k FROM customer)"
_KEY = "printf('GCN %3d%3d', m + {0}, m)"
_W = """n AS (SELECT m, count(*)::DOUBLE AS n0, sum(x) AS n1, sum(x * x) AS n2 FROM cu GROUP BY 1),
v AS (SELECT *, n0 + 0.5 * (m + 2) * (m + 2) AS a, n2 + 0.5 * (m + 3) * (m + 3) AS d FROM n),
w AS (SELECT m, (d * n0 - n1 * n1) / (a * d - n1 * n1) AS w00, (d * n1 - n1 * n2) / (a * d - n1 * n1) AS w01, (a * n1 - n1 * n0) / (a * d - n1 * n1) AS w10, (a * n2 - n1 * n1) / (a * d - n1 * n1) AS w11 FROM v)"""


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("m"), F.col("c_mktsegment").alias("field"), (F.col("c_acctbal") / 1e4).alias("x"), F.col("c_custkey").alias("k"))


def block_normals(spark, d):
    """A block of two coefficients for each nation: degrees m + 2 and m + 3."""
    sums = _customers(spark, d).groupBy("m").agg(F.count("*").cast("double").alias("n0"), F.sum("x").alias("n1"), F.sum(F.col("x") * F.col("x")).alias("n2"))
    key = [filters.coefficient_key(F.col("m") + j, F.col("m"), F.lit(0)) for j in (2, 3)]
    cell = lambda i, j, v: F.struct(key[i].alias("row_key"), key[j].alias("col_key"), F.col(v).alias("value"))
    cells = sums.select(F.inline(F.array(cell(0, 0, "n0"), cell(0, 1, "n1"), cell(1, 1, "n2"))))
    return cells.select(filters.order_block(F.col("row_key")).alias("block"), "row_key", "col_key", "value")


def _cells(name: str, i: int, j: int) -> str:
    return f"SELECT {_KEY.format(i + 2)} AS row_key, {_KEY.format(j + 2)} AS col_key, round({name}, 6) AS value FROM w"


@query("h19_power_law_weights", f"WITH {_SEG}, {_W} " + " UNION ALL ".join(_cells(f"w{i}{j}", i, j) for i in (0, 1) for j in (0, 1)))
def h19(spark, d):
    got = filters.power_law_weights(block_normals(spark, d), 0.5, 2.0)
    return got.select("row_key", "col_key", F.round("value", 6).alias("value"))


_VAL = "f AS (SELECT m, field, avg(x) AS y0, avg(k) / 1e3 AS y1, 1.0 / count(*) AS s FROM cu GROUP BY 1, 2)"
_FILTERED = [("y0 - (w00 * y0 + w01 * y1)", "sqrt((1 - w00) * (1 - w00) * s * s + w01 * w01 * 4 * s * s)"), ("y1 - (w10 * y0 + w11 * y1)", "sqrt(w10 * w10 * s * s + (1 - w11) * (1 - w11) * 4 * s * s)")]


@query("h18_filter_fields", f"WITH {_SEG}, {_W}, {_VAL} " + " UNION ALL ".join(f"SELECT field, {_KEY.format(j + 2)} AS key, round({v}, 6) AS value, round({e}, 6) AS sigma FROM f JOIN w USING (m)" for j, (v, e) in enumerate(_FILTERED)))
def h18(spark, d):
    """The complement of the block filter, on one field for each segment, with errors."""
    sums = _customers(spark, d).groupBy("m", "field").agg(F.avg("x").alias("y0"), (F.avg("k") / 1e3).alias("y1"), (1 / F.count("*")).alias("s"))
    key = [filters.coefficient_key(F.col("m") + j, F.col("m"), F.lit(0)).alias("key") for j in (2, 3)]
    values = sums.select("field", F.inline(F.array(F.struct(key[0], F.col("y0").alias("value"), F.col("s").alias("sigma")), F.struct(key[1], F.col("y1").alias("value"), (2 * F.col("s")).alias("sigma")))))
    got = filters.apply(values, filters.power_law_weights(block_normals(spark, d), 0.5, 2.0), complement=True)
    return got.select("field", "key", F.round("value", 6).alias("value"), F.round("sigma", 6).alias("sigma"))


@query(
    "h20_decorrelation",
    f"""WITH {_SEG}, o AS (SELECT field, m, avg(x) AS y FROM cu GROUP BY 1, 2), g AS (SELECT s.field, CAST(4 + 2 * k.k AS INTEGER) AS l, k.k, coalesce(o.y, 0) AS y
FROM (SELECT DISTINCT field FROM cu) s CROSS JOIN (SELECT unnest(range(9)) AS k) k LEFT JOIN o ON o.field = s.field AND o.m = k.k),
r AS (SELECT *, lag(y) OVER q AS a, lead(y) OVER q AS b, lag(y, 2) OVER q AS a2, lead(y, 2) OVER q AS b2 FROM g WINDOW q AS (PARTITION BY field ORDER BY k))
SELECT field, printf('GCN %3d%3d', l, 3) AS key, round(CASE WHEN k = 0 THEN y / 6 - b / 3 + b2 / 6 WHEN k = 8 THEN y / 6 - a / 3 + a2 / 6 ELSE (2 * y - a - b) / 3 END, 6) AS value FROM r""",
)
def h20(spark, d):
    """Straight lines through three neighbours of one parity, taken from the
    coefficients of order 3."""
    cu = _customers(spark, d)
    y = cu.groupBy("field", "m").agg(F.avg("x").alias("y"))
    spine = cu.select("field").distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(8))))
    values = spine.join(y, ["field", "m"], "left").select("field", filters.coefficient_key(4 + 2 * F.col("m"), F.lit(3), F.lit(0)).alias("key"), F.coalesce("y", F.lit(0.0)).alias("value"))
    cells = filters.decorrelation(20, 3, 3, 1, spark).where("block = 'GCN0030'")
    return filters.apply(values, cells).select("field", "key", F.round("value", 6).alias("value"))


_NODE = "nd AS (SELECT event_type, CAST(event_id % 36 * 10 + 5 AS DOUBLE) AS lon, CAST(event_id // 36 % 18 * 10 - 85 AS DOUBLE) AS lat, avg(value) AS value FROM events GROUP BY 1, 2, 3)"


def nodes(spark, d):
    """A grid of ten degrees for each type of event: means of what falls on a node."""
    e = table(spark, d, "events")
    lon, lat = (F.col("event_id") % 36 * 10 + 5).cast("double"), (F.floor(F.col("event_id") / 36) % 18 * 10 - 85).cast("double")
    return e.groupBy("event_type", lon.alias("lon"), lat.alias("lat")).agg(F.avg("value").alias("value"))


@query(
    "h17_grid_check",
    f"""WITH {_NODE}, s AS (SELECT event_type, count(*) AS cells, count(DISTINCT lon) AS nlon, count(DISTINCT lat) AS nlat, min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, max(lat) AS lat1 FROM nd GROUP BY 1),
t AS (SELECT *, (lat1 - lat0) / (nlat - 1) AS step, (lon1 - lon0) / (nlon - 1) AS step2 FROM s)
SELECT event_type, nlon, nlat, round(step, 6) AS step, abs(step - step2) < 1e-4 AS equidistant, 360 - (lon1 - lon0) < step * 1.00001 AS global_lon, 180 - (lat1 - lat0) < step * 1.00001 AS global_lat, cells = nlon * nlat AS complete, CASE WHEN abs(lon0 - step / 2) < 1e-4 THEN 'pixel' END AS registration FROM t""",
)
def h17(spark, d):
    got = grids.inspect(nodes(spark, d), ["event_type"])
    return got.select("event_type", "nlon", "nlat", F.round("step", 6).alias("step"), "equidistant", "global_lon", "global_lat", "complete", "registration")


_LM = "(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)"
_P = "CASE WHEN l = 0 THEN 1 WHEN l = 1 AND m = 0 THEN sqrt(3) * t WHEN l = 1 THEN sqrt(3) * u WHEN m = 0 THEN sqrt(5) * (1.5 * t * t - 0.5) WHEN m = 1 THEN sqrt(15) * t * u ELSE sqrt(15) / 2 * u * u END"
_DP = "CASE WHEN l = 0 THEN 0 WHEN l = 1 AND m = 0 THEN sqrt(3) * u WHEN l = 1 THEN -sqrt(3) * t WHEN m = 0 THEN sqrt(5) * 3 * t * u WHEN m = 1 THEN sqrt(15) * (u * u - t * t) ELSE -sqrt(15) * u * t END"


@query(
    "h16_analyse_rings",
    f"""WITH {_NODE}, p AS (SELECT event_type, value, radians(lon) AS x, sin(radians(lat)) AS t, cos(radians(lat)) AS u, (sin(radians(lat + 5)) - sin(radians(lat - 5))) * radians(10) / (4 * pi()) AS w FROM nd), k(l, m) AS (VALUES {_LM})
SELECT event_type, CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m, round(sum(w * value * {_P} * cos(m * x)), 6) AS c, round(sum(w * value * {_P} * sin(m * x)), 6) + 0.0 AS s FROM p CROSS JOIN k GROUP BY 1, 2, 3""",
)
def h16(spark, d):
    got = grids.analyse_rings(nodes(spark, d), 2, 10.0, ["event_type"], "area")
    return got.select("event_type", "l", "m", F.round("c", 6).alias("c"), (F.round("s", 6) + 0.0).alias("s"))


@query(
    "h14_synthesis_degree2",
    f"""WITH {_ST}, {_FIELD}, k AS (SELECT l, m, sum(c) AS c, sum(s) AS s, sqrt(sum(c * c)) AS e, sqrt(sum(s * s)) AS f FROM f WHERE l <= 2 AND m <= l GROUP BY l, m),
p AS (SELECT c_custkey, radians(lon) AS x, sin(radians(lat)) AS t, cos(radians(lat)) AS u FROM st), b AS (SELECT *, {_P} AS p, {_DP} AS q FROM p CROSS JOIN k)
SELECT c_custkey, round(sum(p * (c * cos(m * x) + s * sin(m * x))) / 1e4, 5) AS value, round(sum(p / u * m * (s * cos(m * x) - c * sin(m * x))) / 1e4, 5) + 0.0 AS east, round(sum(q * (c * cos(m * x) + s * sin(m * x))) / 1e4, 5) AS north,
round(sqrt(sum(p * p * (e * e * cos(m * x) * cos(m * x) + f * f * sin(m * x) * sin(m * x)))) / 1e4, 5) AS error FROM b GROUP BY c_custkey""",
)
def h14(spark, d):
    """Value, derivatives and error of the field of parts at the stations."""
    got = stations(spark, d).select("c_custkey", "lon", "lat")
    for what in ("value", "east", "north", "error"):
        got = spectra.synthesise(got, field(spark, d), 2, value=what, what=what)
    return got.select("c_custkey", *((F.round(F.col(w) / 1e4, 5) + 0.0).alias(w) for w in ("value", "east", "north", "error")))


_SMALL = "fc AS (SELECT CAST(p_size % 2 AS INTEGER) AS l, CAST(p_partkey % 3 % 2 AS INTEGER) AS m, sum(p_retailprice) / 1e5 AS c, sum(p_retailprice) / 7e5 AS s FROM part WHERE p_partkey % 3 % 2 <= p_size % 2 GROUP BY 1, 2)"


def small_field(spark, d):
    """A field of degree 1 made of parts."""
    price = F.col("p_retailprice")
    p = table(spark, d, "part").select((F.col("p_size") % 2).cast("int").alias("l"), (F.col("p_partkey") % 3 % 2).cast("int").alias("m"), (price / 1e5).alias("c"), (price / 7e5).alias("s"))
    return p.where("m <= l").groupBy("l", "m").agg(F.sum("c").alias("c"), F.when(F.col("m") > 0, F.sum("s")).otherwise(0.0).alias("s"))


@query(
    "h23_field_product",
    f"""WITH {_ST}, {_SMALL}, p AS (SELECT c_custkey, radians(lon) AS x, sin(radians(lat)) AS t, cos(radians(lat)) AS u FROM st),
v AS (SELECT c_custkey, sum({_P} * (c * cos(m * x) + s * sin(m * x))) AS v FROM p CROSS JOIN fc GROUP BY 1) SELECT c_custkey, round(v * v, 5) AS value FROM v""",
)
def h23(spark, d):
    """The square of a field: its multiplier applied to itself, at the stations."""
    f = small_field(spark, d)
    values = filters.to_values(f.withColumn("field", F.lit("f")))
    cells = couplings.multiplier(f, 1, 1)
    right = values.select(F.col("key").alias("col_key"), F.col("value").alias("x"))
    product = cells.join(right, "col_key").groupBy(F.lit("f").alias("field"), F.col("row_key").alias("key")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))
    got = spectra.synthesise(stations(spark, d).select("c_custkey", "lon", "lat"), filters.to_coefficients(product), 2)
    return got.select("c_custkey", F.round("value", 5).alias("value"))


@query(
    "h24_triple_sums",
    f"WITH {_SMALL} SELECT round(sum(c * c + CASE WHEN m > 0 THEN s * s ELSE 0 END), 6) AS mean_square FROM fc",
)
def h24(spark, d):
    """The mean of a field's square, from the couplings of degree 0."""
    f = filters.to_values(small_field(spark, d).withColumn("field", F.lit("f"))).select("key", "value")
    g = couplings.gaunt(spark, 1, 1).where("l = 0")
    left = g.select(filters.coefficient_key(F.col("l1"), F.col("m1"), F.col("q1")).alias("key"), filters.coefficient_key(F.col("l2"), F.col("m2"), F.col("q2")).alias("other"), F.col("value").alias("g"))
    both = left.join(f, "key").join(f.select(F.col("key").alias("other"), F.col("value").alias("y")), "other")
    return both.agg(F.round(F.sum(F.col("g") * F.col("value") * F.col("y")), 6).alias("mean_square"))


_A, _B, _C = 0.4, 1.1, -0.7


@query(
    "h11_rotation",
    f"""WITH {_ST}, {_FIELD}, k AS (SELECT l, m, sum(c) AS c, sum(s) AS s FROM f WHERE l <= 2 AND m <= l GROUP BY l, m),
a AS (SELECT c_custkey, cos(radians(lat)) * cos(radians(lon) + {_C}) AS x, cos(radians(lat)) * sin(radians(lon) + {_C}) AS y, sin(radians(lat)) AS z FROM st),
b AS (SELECT c_custkey, x * cos({_B}) + z * sin({_B}) AS x, y, z * cos({_B}) - x * sin({_B}) AS z FROM a),
p AS (SELECT c_custkey, atan2(y, x) + {_A} AS x, z AS t, sqrt(greatest(1 - z * z, 0)) AS u FROM b)
SELECT c_custkey, round(sum({_P} * (c * cos(m * x) + s * sin(m * x))) / 1e4, 5) AS value FROM p CROSS JOIN k GROUP BY 1""",
)
def h11(spark, d):
    """The turned field of parts at the stations: the field at turned stations."""
    got = rotations.rotate(field(spark, d).withColumn("field", F.lit("f")).where("l <= 2"), _A, _B, _C)
    at = spectra.synthesise(stations(spark, d).select("c_custkey", "lon", "lat"), got, 2)
    return at.select("c_custkey", F.round(F.col("value") / 1e4, 5).alias("value"))


_TH = "th AS (SELECT c_custkey, CAST(1 + c_custkey * 37 % 178 AS DOUBLE) AS theta FROM customer), lv AS (SELECT CAST(p_size % 4 AS INTEGER) AS l, sum(p_retailprice) / 1e5 AS a FROM part GROUP BY 1)"


@query(
    "h30_isotropic_series",
    f"""WITH {_TH}, q AS (SELECT c_custkey, radians(theta) AS x, cos(radians(theta)) AS t FROM th), r AS (SELECT c_custkey, x, l, a - 2 - CASE WHEN l > 0 THEN 0.5 / l ELSE 0 END AS a,
CASE l WHEN 0 THEN 1 WHEN 1 THEN t WHEN 2 THEN (3 * t * t - 1) / 2 ELSE (5 * t * t * t - 3 * t) / 2 END AS p, -sin(x) * CASE l WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 * t ELSE (15 * t * t - 3) / 2 END AS dp FROM q CROSS JOIN lv)
SELECT c_custkey, round(sum(a * p) + 2 / (2 * sin(any_value(x) / 2)) - 0.5 * ln(sin(any_value(x) / 2) * (1 + sin(any_value(x) / 2))), 5) AS value,
round(sum(a * dp) - 2 * cos(any_value(x) / 2) / (4 * pow(sin(any_value(x) / 2), 2)) - 0.5 * cos(any_value(x) / 2) / 2 * (1 / sin(any_value(x) / 2) + 1 / (1 + sin(any_value(x) / 2))), 5) AS slope FROM r GROUP BY 1""",
)
def h30(spark, d):
    """A series whose coefficients tend to 2 + 0.5 / l, and its derivative."""
    points = table(spark, d, "customer").select("c_custkey", (1 + F.col("c_custkey") * 37 % 178).cast("double").alias("theta"))
    a = table(spark, d, "part").groupBy((F.col("p_size") % 4).cast("int").alias("l")).agg((F.sum("p_retailprice") / 1e5).alias("a"))
    got = isotropic.evaluate(points, a, constant=2.0, inverse=0.5)
    got = isotropic.evaluate(got, a, value="slope", derivative=True, constant=2.0, inverse=0.5)
    return got.select("c_custkey", F.round("value", 5).alias("value"), F.round("slope", 5).alias("slope"))
