"""Filters, key matching, coordinates and spectra that SQL can check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import keyed
from .matrices import rounded
from .registry import query, table


@query("j1_calculate", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax) * l_discount - 1, 6) AS v FROM lineitem")
def j1(spark, d):
    li = table(spark, d, "lineitem")
    v = C.calculate("q+t*d-1", {"q": F.col("l_quantity"), "t": F.col("l_tax"), "d": F.col("l_discount")})
    return rounded(li.select("l_orderkey", "l_linenumber", v.alias("v")))


@query("j11_key_replace", "SELECT p_partkey, rpad(replace(p_brand, 'Brand', 'B'), 24, ' ') AS key FROM part")
def j11(spark, d):
    return table(spark, d, "part").select("p_partkey", F.rpad(F.replace("p_brand", F.lit("Brand"), F.lit("B")), 24, " ").alias("key"))


@query("p1_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[[:lower:]]+ [[:alpha:]]+') AND NOT regexp_matches(p_name, 'bolt$')")
def p1(spark, d):
    p = F.col("p_name")
    return table(spark, d, "part").where(p.rlike(C.posix_pattern("^[[:lower:]]+ [[:alpha:]]+")) & ~p.rlike(C.posix_pattern("bolt$"))).select("p_partkey", "p_name")


@query("p2_pattern_list", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(1$)|([[:digit:]]5[[:digit:]]$)')")
def p2(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").rlike(C.posix_pattern("1$", "[[:digit:]]5[[:digit:]]$"))).select("c_custkey")


@query("p3_range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_custkey BETWEEN 10 AND 500")
def p3(spark, d):
    return table(spark, d, "orders").where("o_totalprice between 1000 and 200000 and o_custkey between 10 and 500").select("o_orderkey")


@query("p5_glob", "SELECT page_id FROM pages WHERE url LIKE 'http%/en/%' OR url LIKE '%ref=x'")
def p5(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike(C.glob_pattern("http*/en/*|*ref=x"))).select("page_id")


def stations(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (k * 37 % 360).cast("double").alias("lon"), (k * 11 % 160 - 80).cast("double").alias("lat"), (k % 500).cast("double").alias("h"), "c_acctbal")


_ST = "st AS (SELECT c_custkey, CAST(c_custkey * 37 % 360 AS DOUBLE) AS lon, CAST(c_custkey * 11 % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey % 500 AS DOUBLE) AS h, c_acctbal FROM customer)"


@query("p6_bounding_box", f"WITH {_ST} SELECT c_custkey FROM st WHERE (lon >= 340 OR lon <= 20) AND lat BETWEEN -10 AND 60")
def p6(spark, d):
    return stations(spark, d).where(C.in_box(F.col("lon"), F.col("lat"), -20, 20, -10, 60)).select("c_custkey")


@query("p9_name_regex", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE regexp_matches(s_name || n_name, '[13579].*A')")
def p9(spark, d):
    both = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.where(F.concat("s_name", "n_name").rlike("[13579].*A")).select("s_suppkey")


@query("p10_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def p10(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("p11_degree_window", "SELECT vec_id, CASE WHEN label BETWEEN 2 AND 6 THEN label ELSE 0 END AS l FROM embeddings")
def p11(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.when(F.col("label").between(2, 6), F.col("label")).otherwise(0).alias("l"))


@query("p12_reject_listed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def p12(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("p14_component_count", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 2 AND count(*) < 6")
def p14(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 2 and n < 6")


@query("n1_match_keys", "SELECT s_name AS key_a, c_name AS key_b FROM supplier JOIN customer ON substring(s_name, 10, 9) = substring(c_name, 10, 9)")
def n1(spark, d):
    a, b = table(spark, d, "supplier").select(F.col("s_name").alias("key")), table(spark, d, "customer").select(F.col("c_name").alias("key"))
    return keyed.correlate_keys(a, b, 10, 9).select("key_a", "key_b")


_CUST = "a AS (SELECT c_name AS key FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT replace(c_name, 'Customer', 'Stations') AS key FROM customer WHERE c_custkey % 3 = 0)"


@query("n2_match_full", f"WITH {_CUST} SELECT a.key AS key_a, b.key AS key_b FROM a FULL JOIN b ON substring(a.key, 9, 16) = substring(b.key, 9, 16)")
def n2(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key"))
    b = c.where("c_custkey % 3 = 0").select(F.replace("c_name", F.lit("Customer"), F.lit("Stations")).alias("key"))
    return keyed.correlate_keys(a, b, 9, 16, "full").select("key_a", "key_b")


@query("n4_union_unknowns", "SELECT l_partkey AS key, bool_or(l_returnflag = 'A') AS in_a, bool_or(l_returnflag = 'N') AS in_n, bool_or(l_returnflag = 'R') AS in_r FROM lineitem GROUP BY 1")
def n4(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(*(F.bool_or(F.col("l_returnflag") == f).alias(f"in_{f.lower()}") for f in "ANR"))


@query("n6_matching_rows", "SELECT count(*) AS matched, round(sum(l_quantity * p_retailprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def n6(spark, d):
    got = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey"))
    return got.agg(F.count("*").alias("matched"), F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("total"))


@query("n10_lookup_fallback", "SELECT c_custkey, coalesce(s.s_name, n.n_name) AS name FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey")
def n10(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return c.select("c_custkey", F.coalesce("s_name", "n_name").alias("name"))


_CODE = "printf('%05d%02d%d', {0} % {1}, {0} % {2}, {0} % {3})"


@query(
    "n10_prefix_lookup",
    f"WITH c AS (SELECT c_custkey, {_CODE.format('c_custkey', 20, 4, 9)} AS key FROM customer), d AS (SELECT {_CODE.format('s_suppkey', 30, 3, 5)} AS key, s_name, s_suppkey FROM supplier) SELECT c_custkey, coalesce((SELECT min(s_name) FROM d WHERE d.key[:7] = c.key[:7]), (SELECT min(s_name) FROM d WHERE d.key[:5] = c.key[:5])) AS s_name FROM c",
)
def n10p(spark, d):
    """A code looked up by seven signs, else by five, the first of several."""
    code = lambda k, a, b, c: F.format_string("%05d%02d%d", F.col(k) % a, F.col(k) % b, F.col(k) % c).alias("key")
    rows = table(spark, d, "customer").select("c_custkey", code("c_custkey", 20, 4, 9))
    dim = table(spark, d, "supplier").select(code("s_suppkey", 30, 3, 5), "s_name", "s_suppkey")
    return keyed.prefix_lookup(rows, dim, "key", ["s_name"], [7, 5], ["s_suppkey"]).select("c_custkey", "s_name")


@query("n13_user_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE p_brand WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 ELSE 2 END, p_partkey) AS place FROM part")
def n13(spark, d):
    order = F.when(F.col("p_brand") == "Brand#3", 0).when(F.col("p_brand") == "Brand#1", 1).otherwise(2)
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(order, "p_partkey")).cast("long").alias("place"))


@query("l9_apriori_agreement", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) AS spread FROM customer GROUP BY 1 HAVING max(c_acctbal) - min(c_acctbal) > 1e-30")
def l9(spark, d):
    return rounded(table(spark, d, "customer").groupBy("c_nationkey").agg((F.max("c_acctbal") - F.min("c_acctbal")).alias("spread")).where("spread > 1e-30"))


_G = f"exp(-pow(label * {500000 / C.EARTH_RADIUS!r}, 2) / (4 * 0.6931471805599453))"


@query("h3_gauss_smoothing", f"SELECT vec_id, round({_G}, 6) AS weight, round({_G} * embedding[1]::DOUBLE, 6) AS value FROM embeddings")
def h3(spark, d):
    w = C.gauss_weight(F.col("label"), 500)
    return rounded(table(spark, d, "embeddings").select("vec_id", w.alias("weight"), (w * F.col("embedding")[0].cast("double")).alias("value")))


@query("h21_power_law_diagonal", "SELECT DISTINCT l, round(pow(l, 4), 6) AS power, round(1e10 / pow(l, 4), 4) AS kaula FROM (SELECT CAST(label AS BIGINT) AS l FROM embeddings WHERE label > 0)")
def h21(spark, d):
    e = table(spark, d, "embeddings").where("label > 0").select(F.col("label").cast("long").alias("l")).distinct()
    return e.select("l", F.round(F.pow("l", F.lit(4)), 6).alias("power"), F.round(1e10 / F.pow("l", F.lit(4)), 4).alias("kaula"))


_N = f"({C.WGS84_A!r} / sqrt(1 - {C.WGS84_F * (2 - C.WGS84_F)!r} * pow(sin(radians(lat)), 2)))"


@query("g12_geodetic_to_ecef", f"WITH {_ST} SELECT c_custkey, round(({_N} + h) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round(({_N} + h) * cos(radians(lat)) * sin(radians(lon)), 3) AS y, round(({_N} * {1 - C.WGS84_F * (2 - C.WGS84_F)!r} + h) * sin(radians(lat)), 3) AS z FROM st")
def g12(spark, d):
    return rounded(stations(spark, d).select("c_custkey", *(v.alias(k) for k, v in C.to_ecef(F.col("lon"), F.col("lat"), F.col("h")).items())), 3)


@query("g12_ecef_to_geodetic", f"WITH {_ST} SELECT c_custkey, round(lat, 5) AS lat, round(h, 3) + 0.0 AS h FROM st")
def g12b(spark, d):
    st = stations(spark, d)
    xyz = C.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    back = st.select("c_custkey", *(v.alias(k) for k, v in xyz.items()))
    g = C.to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return back.select("c_custkey", (F.round(g["lat"], 5) + 0.0).alias("lat"), (F.round(g["h"], 3) + 0.0).alias("h"))


@query("g3_geocenter_rows", f"WITH {_ST} SELECT c_custkey, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS gx, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS gy, round(sin(radians(lat)), 6) + 0.0 AS gz FROM st")
def g3(spark, d):
    lam, phi = F.radians("lon"), F.radians("lat")
    row = {"gx": F.cos(phi) * F.cos(lam), "gy": F.cos(phi) * F.sin(lam), "gz": F.sin(phi)}
    return stations(spark, d).select("c_custkey", *((F.round(v, 6) + 0.0).alias(k) for k, v in row.items()))
