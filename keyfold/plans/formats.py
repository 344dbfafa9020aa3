"""Queries that write given tables in a file format and read them back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import projection, series
from ..sources import binary, files, gravity, sinex
from ..sources.shared import fresh_folder
from .registry import query, table
from .relations import stations

_HEAD = {"created": "26:001:00000", "start": "26:001:00000", "end": "26:002:00000", "parameters": 0}


def _parameters(spark, d):
    """Suppliers as station coordinates."""
    ix = F.col("s_suppkey").cast("int")
    fixed = {"type": "STAX", "point": "A", "solution": "1", "epoch": "26:001:43200", "unit": "m", "constraint": "2"}
    return table(spark, d, "supplier").select(ix.alias("ix"), F.format_string("S%03d", F.col("s_suppkey") % 1000).alias("site"), *(F.lit(v).alias(k) for k, v in fixed.items()), F.col("s_acctbal").alias("value"), (F.col("s_nationkey") + 0.5).alias("sigma"))


@query("s7_sinex_estimates", "SELECT CAST(s_suppkey AS INTEGER) AS ix, 'STAX' AS type, printf('S%03d', s_suppkey % 1000) AS site, '26:001:43200' AS epoch, round(s_acctbal, 6) AS value, round((s_nationkey + 0.5)::DOUBLE, 4) AS sigma FROM supplier")
def s7(spark, d):
    path = fresh_folder(spark, "sinex")
    sinex.write(spark, path, _HEAD, [(sinex.ESTIMATE, sinex.estimate_lines(_parameters(spark, d)))])
    got = sinex.estimates(sinex.lines(spark, path))
    return got.select("ix", "type", "site", "epoch", F.round("value", 6).alias("value"), F.round("sigma", 4).alias("sigma"))


@query("s8_sinex_selection", "SELECT CAST(s_suppkey AS INTEGER) AS ix, round(s_acctbal, 6) AS value FROM supplier WHERE (s_suppkey % 1000 IN (3, 5) OR s_suppkey % 1000 BETWEEN 50 AND 59 OR s_suppkey % 1000 BETWEEN 100 AND 199) AND s_suppkey % 1000 <> 55")
def s8(spark, d):
    """Estimates of some sites, chosen by globs over their keys."""
    path = fresh_folder(spark, "sinex")
    sinex.write(spark, path, _HEAD, [(sinex.ESTIMATE, sinex.estimate_lines(_parameters(spark, d)))])
    got = sinex.estimates(sinex.lines(spark, path), include="STAX   S003*|STAX   S005*|STAX   S05*|STAX   S1*", exclude="*S055*")
    return got.select("ix", F.round("value", 6).alias("value"))


def _nation_matrix(spark, d):
    """How often two nations have customers in one segment."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("c"))
    other = n.select(F.col("n").alias("n2"), "s", F.col("c").alias("c2"))
    return n.join(other, "s").groupBy((F.col("n") + 1).alias("row_ix"), (F.col("n2") + 1).alias("col_ix")).agg(F.sum(F.col("c") * F.col("c2")).cast("double").alias("value"))


@query("s7_sinex_matrix", "WITH n AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS c FROM customer GROUP BY 1, 2), i AS (SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS ix) SELECT a.ix AS row_ix, b.ix AS col_ix, 'L' AS triangle, 'COVA' AS content, coalesce((SELECT sum(x.c * y.c) FROM n x JOIN n y ON x.s = y.s WHERE x.n = a.ix - 1 AND y.n = b.ix - 1), 0)::DOUBLE AS value FROM i a JOIN i b ON a.ix >= b.ix")
def s7m(spark, d):
    """A covariance in many parts of one file: sections go on from part to part."""
    path = fresh_folder(spark, "sinex")
    cells = _nation_matrix(spark, d)
    every = spark.range(1, 26).select(F.col("id").cast("int").alias("row_ix")).withColumn("col_ix", F.explode(F.sequence(F.lit(1), F.col("row_ix"))))
    cells = every.join(cells, ["row_ix", "col_ix"], "left").select("row_ix", "col_ix", F.coalesce("value", F.lit(0.0)).alias("value"))
    sinex.write(spark, path, _HEAD, [(sinex.ESTIMATE, sinex.estimate_lines(_parameters(spark, d))), ("SOLUTION/MATRIX_ESTIMATE L COVA", sinex.matrix_lines(cells))], single=False)
    got = sinex.matrices(sinex.lines(spark, path, folders=True))
    return got.select("row_ix", "col_ix", "triangle", "content", "value")


_PLACE = "CAST(c_custkey * 37 % 360 AS DOUBLE) + (c_custkey % 60) / 60.0 AS lon, CASE WHEN c_custkey * 11 % 160 < 80 THEN -1 ELSE 1 END * (abs(c_custkey * 11 % 160 - 80) + (c_custkey % 7) / 60.0) AS lat, CAST(c_custkey % 500 AS DOUBLE) AS height"


@query("s9_sinex_sites", f"WITH s AS (SELECT c_custkey, {_PLACE} FROM customer) SELECT printf('C%03d', c_custkey % 1000) AS site, 'A' AS point, printf('%-18s', CAST(c_custkey AS VARCHAR))[:1] AS first, round(lon, 6) AS lon, round(lat, 6) AS lat, height FROM s WHERE c_custkey % 1000 // 100 = 1")
def s9(spark, d):
    """The sites block, its lines chosen by a glob."""
    k = F.col("c_custkey")
    size = F.abs(k * 11 % 160 - 80) + (k % 7) / 60
    st = stations(spark, d).select(k.cast("int").alias("ix"), F.format_string("C%03d", k % 1000).alias("site"), F.lit("A").alias("point"), F.lit("00000M000").alias("domes"), k.cast("string").alias("description"), (F.col("lon") + (k % 60) / 60).alias("lon"), F.when(k * 11 % 160 < 80, -size).otherwise(size).alias("lat"), F.col("h").alias("height"))
    path = fresh_folder(spark, "sinex")
    sinex.write(spark, path, _HEAD, [(sinex.SITES, sinex.site_lines(st))])
    chosen = sinex.block(sinex.lines(spark, path), sinex.SITES, " C1*")
    got = sinex.sites(chosen.withColumn("section", F.lit(sinex.SITES)))
    return got.select("site", "point", F.substring("description", 1, 1).alias("first"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "height")


_UNITS = "u AS (SELECT n_nationkey AS n, s, CAST(n_nationkey * 5 + row_number() OVER (PARTITION BY n_nationkey ORDER BY s) AS INTEGER) AS ix FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)), v AS (SELECT u.*, coalesce(c, 0) AS c FROM u LEFT JOIN (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS c FROM customer GROUP BY 1, 2) k USING (n, s))"


def _units(spark, d):
    """(n, s, ix, key, c): customers of a nation and segment; five rows a nation."""
    cu = table(spark, d, "customer")
    names = sorted(r["s"] for r in cu.select(F.col("c_mktsegment").alias("s")).distinct().collect())  # five
    every = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.posexplode(F.array(*map(F.lit, names))).alias("k", "s"))
    sums = cu.groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("c"))
    got = every.join(sums, ["n", "s"], "left").select("n", "s", (F.col("n") * len(names) + F.col("k") + 1).cast("int").alias("ix"), F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    return got, [f"N{n:02d} {s}" for n in range(25) for s in names], len(names)


@query("s1_binary_blocks", f"WITH {_UNITS} SELECT a.ix AS row_ix, b.ix AS col_ix, printf('N%02d ', a.n) || a.s AS row_key, (a.c * b.c)::DOUBLE AS value FROM v a JOIN v b ON a.n = b.n AND a.ix <= b.ix")
def s1(spark, d):
    """A block-diagonal symmetric matrix, big-endian, read in ranges of 50 values."""
    units, keys, five = _units(spark, d)
    other = units.select("n", F.col("ix").alias("col_ix"), F.col("c").alias("c2"))
    cells = units.join(other, "n").select(F.col("ix").alias("row_ix"), "col_ix", (F.col("c") * F.col("c2")).alias("value"))
    path = f"{fresh_folder(spark, 'binary')}/m.bin"
    binary.write(path, cells, "BDSYMVN_", keys, ends=list(range(five, 25 * five + 1, five)), little_endian=False)
    return binary.read(spark, path, values=50).select("row_ix", "col_ix", "row_key", "value")


@query("k1_binary_vectors", f"WITH {_UNITS} SELECT CAST(k AS INTEGER) AS vec_no, ix AS row_ix, printf('N%02d ', n) || s AS row_key, CASE k WHEN 1 THEN c ELSE c * c END::DOUBLE AS value FROM v CROSS JOIN (SELECT unnest(range(1, 3)) AS k)")
def k1(spark, d):
    """Vectors of a file whose matrix isn't read."""
    units, keys, _ = _units(spark, d)
    vectors = units.select(F.col("ix").alias("row_ix"), F.posexplode(F.array(F.col("c"), F.col("c") * F.col("c"))).alias("k", "value")).select("row_ix", (F.col("k") + 1).alias("vec_no"), "value")
    path = f"{fresh_folder(spark, 'binary')}/m.bin"
    binary.write(path, units.select(F.col("ix").alias("row_ix"), F.col("ix").alias("col_ix"), F.col("c").alias("value")), "SYMVN___", keys, vectors=vectors, longs={"Nobs": 7}, doubles={"LtPL": 0.5}, readme=["counts of customers"])
    return binary.read(spark, path, "vectors").select("vec_no", "row_ix", "row_key", "value")


@query("s3_keyed_table", "SELECT printf('SUP %09d', s_suppkey) AS row_key, CAST(k AS INTEGER) AS col_no, round(CASE k WHEN 0 THEN s_acctbal ELSE s_nationkey END, 6) AS value FROM supplier CROSS JOIN (SELECT unnest(range(2)) AS k)")
def s3(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.rpad(F.format_string("SUP %09d", "s_suppkey"), 24, " "), F.format_string(" %22.14E %d", "s_acctbal", "s_nationkey")).alias("line"))
    path = fresh_folder(spark, "keyed")
    rows.write.text(path)
    return files.keyed_table(spark, path).select("row_key", "col_no", F.round("value", 6).alias("value"))


_COEF = "f AS (SELECT CAST(p_partkey % 90 AS INTEGER) AS l, CAST(p_partkey // 90 AS INTEGER) AS m, p_retailprice AS c, p_retailprice / 7 AS s FROM part WHERE p_partkey // 90 <= p_partkey % 90)"


def _coefficients(spark, d):
    price = F.col("p_retailprice")
    rows = table(spark, d, "part").select((F.col("p_partkey") % 90).cast("int").alias("l"), F.floor(F.col("p_partkey") / 90).cast("int").alias("m"), price.alias("c"), (price / 7).alias("s"))
    return rows.where("m <= l")


@query("s4_icgem_coefficients", f"WITH {_COEF} SELECT 'static' AS term, l, m, round(c, 6) AS c, round(s, 6) AS s FROM f")
def s4(spark, d):
    path = fresh_folder(spark, "icgem")
    gravity.write(_coefficients(spark, d), path, "icgem")
    return gravity.read(spark, path, "icgem").select("term", "l", "m", F.round("c", 6).alias("c"), F.round("s", 6).alias("s"))


@query("k2_short_coefficients", f"WITH {_COEF} SELECT l, m, round(c, 6) AS c, round(s, 6) AS s FROM f")
def k2(spark, d):
    path = fresh_folder(spark, "short")
    files.write_coefficients(_coefficients(spark, d), path, "short")
    return files.coefficients(spark, path, "short").select("l", "m", F.round("c", 6).alias("c"), F.round("s", 6).alias("s"))


@query("s5_header_facts", f"WITH {_COEF} SELECT 'short' AS layout, CAST(max(l) AS INTEGER) AS lmax FROM f")
def s5(spark, d):
    """What the header of a file of parts says, sniffed."""
    path = fresh_folder(spark, "short")
    files.write_coefficients(_coefficients(spark, d), path, "short")
    return gravity.describe(spark, path).where("layout = 'short'").select("layout", "lmax")


@query("s11_tide_gauge", "SELECT printf('g%d', o_custkey % 10) AS sid, round(1990 + o_orderkey % 400 / 12.0, 4) AS time, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 10000 END::INTEGER AS mm, CAST(o_orderkey % 31 AS INTEGER) AS missing_days FROM orders")
def s11(spark, d):
    """Monthly heights, a file for each gauge, missing ones as -99999."""
    k = F.col("o_orderkey")
    mm = F.when(k % 13 == 0, -99999).otherwise((F.floor("o_totalprice") % 10000).cast("int"))
    line = F.format_string(" %10.4f;%6d;%2d;%03d", 1990 + k % 400 / 12, mm, (k % 31).cast("int"), F.lit(0))
    path = fresh_folder(spark, "tide")
    rows = table(spark, d, "orders").select(F.concat(F.lit("g"), (F.col("o_custkey") % 10).cast("string")).alias("gauge"), line.alias("value"))
    rows.write.partitionBy("gauge").text(path)
    got = files.tide_monthly(spark, path)
    sid = F.regexp_extract(F.input_file_name(), "gauge=([^/]+)", 1)
    return got.select(sid.alias("sid"), F.round("time", 4).alias("time"), "mm", "missing_days")


_NM = "n AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS c, avg(c_acctbal) AS a FROM customer GROUP BY 1, 2), k AS (SELECT n_nationkey AS n, n_name AS key FROM nation), e AS (SELECT x.n AS i, y.n AS j, sum(x.c * y.c)::DOUBLE AS v FROM n x JOIN n y ON x.s = y.s GROUP BY 1, 2), u AS (SELECT n, sum(c)::DOUBLE AS v1, max(c)::DOUBLE AS v2 FROM n GROUP BY 1)"


@query("j1_projection", f"WITH {_NM} SELECT CAST(k.n + 1 AS BIGINT) AS ix, key AS s, round((coalesce(v1, 0) + coalesce(v2, 0)) / 2, 6) AS mean, round(100 * sqrt(coalesce(d.v, 0)), 6) AS root, round(coalesce(c.v, 0), 6) AS third FROM k LEFT JOIN u ON u.n = k.n LEFT JOIN e d ON d.i = k.n AND d.j = k.n LEFT JOIN e c ON c.i = k.n AND c.j = 2")
def j1p(spark, d):
    """Key, arithmetic of vectors, the diagonal's root and the third column."""
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), "c_mktsegment").agg(F.count("*").cast("double").alias("c"))
    u = counts.groupBy("n").agg(F.sum("c").alias("v1"), F.max("c").alias("v2"))
    vectors = u.select((F.col("n") + 1).alias("row_ix"), F.posexplode(F.array("v1", "v2")).alias("k", "value")).select("row_ix", (F.col("k") + 1).alias("vec_no"), "value")
    keys = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("ix"), F.col("n_name").alias("key"))
    got = projection.project(keys, vectors, _nation_matrix(spark, d), "s,v1+v2/2,100*r,c3")
    return got.select("ix", "s", F.round("v1+v2/2", 6).alias("mean"), F.round("100*r", 6).alias("root"), F.round("c3", 6).alias("third"))


@query("j10_metadata", f"WITH {_UNITS} SELECT * FROM (VALUES ('readme', 0, 'counts of customers', NULL::BIGINT, NULL::DOUBLE), ('readme', 1, 'edited', NULL, NULL), ('long', 0, 'Nobs', 8, NULL), ('double', 0, 'Total', NULL, (SELECT sum(c)::DOUBLE FROM v))) t(kind, place, name, long_value, double_value)")
def j10(spark, d):
    """Metadata of a written file: one entry set, one added, one taken out, a line added."""
    units, keys, _ = _units(spark, d)
    path = f"{fresh_folder(spark, 'binary')}/m.bin"
    total = units.agg(F.sum("c")).first()[0]
    binary.write(path, units.select(F.col("ix").alias("row_ix"), F.col("ix").alias("col_ix"), F.col("c").alias("value")), "DIAVN___", keys, longs={"Nobs": 7}, doubles={"LtPL": 0.5}, readme=["counts of customers"])
    got = projection.edit_metadata(binary.read(spark, path, "meta"), {"Nobs": 8}, {"Total": total}, ["LtPL"], ["edited"])
    places = F.row_number().over(Window.partitionBy("kind").orderBy("place")) - 1
    return got.select("kind", places.cast("int").alias("place"), "name", "long_value", "double_value")


_POLE = "pole AS (SELECT CAST(floor(epoch_us(ts) / 86400000000.0) + 40587 AS BIGINT) AS mjd, round(avg(value) / 1e3, 6) AS x, round(-avg(value) / 3e3, 6) AS y, round(count(*) / 1e5, 7) AS lod FROM events GROUP BY 1)"


def _pole(spark, d):
    day = (F.floor(C.days(F.col("ts"))) + 40587).cast("long")
    mean = table(spark, d, "events").groupBy(day.alias("mjd")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return mean.select("mjd", F.round(F.col("v") / 1e3, 6).alias("x"), F.round(-F.col("v") / 3e3, 6).alias("y"), F.lit(0.0).alias("ut1"), F.round(F.col("n") / 1e5, 7).alias("lod"))


@query("s20_earth_orientation", f"WITH {_POLE} SELECT mjd::DOUBLE AS mjd, x, y, lod FROM pole")
def s20(spark, d):
    """Daily means as a pole series, written in fixed columns and read back."""
    path = fresh_folder(spark, "pole")
    files.write_earth_orientation(_pole(spark, d), path)
    return files.earth_orientation(spark, path).select("mjd", *(F.round(c, 7).alias(c) for c in ("x", "y", "lod")))


@query(
    "n8_pole_at_times",
    f"WITH {_POLE}, q AS (SELECT o_orderkey, 60310 + o_orderkey % 2900 / 100.0 AS t FROM orders) SELECT o_orderkey, round(a.x + (t - floor(t)) * (b.x - a.x), 6) AS x FROM q LEFT JOIN pole a ON a.mjd = floor(t) LEFT JOIN pole b ON b.mjd = floor(t) + CASE WHEN t > floor(t) THEN 1 ELSE 0 END",
)
def n8p(spark, d):
    """The pole between its days, for times made of orders."""
    path = fresh_folder(spark, "pole")
    files.write_earth_orientation(_pole(spark, d), path)
    ask = table(spark, d, "orders").select("o_orderkey", (60310 + F.col("o_orderkey") % 2900 / 100).alias("mjd"))
    got = series.interpolate_steps(ask, files.earth_orientation(spark, path), "mjd", ["x"], 1.0)
    return got.select("o_orderkey", F.round("x", 6).alias("x"))
