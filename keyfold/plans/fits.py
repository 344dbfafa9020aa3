"""Queries on time series: events by type, orders by status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import normals, series
from .matrices import rounded
from .registry import query, table

ORIGIN = "2024-01-01"
_T = "(epoch_us(ts) / 86400000000.0 - 19723)"
_EV = f"ev AS (SELECT event_type, event_id, user_id, {_T} AS t, value AS y FROM events)"
_MOM = """m AS (SELECT event_type, (min(t) + max(t)) / 2 AS t_ref, avg(t) AS tm, avg(y) AS ym FROM ev GROUP BY 1),
s AS (SELECT e.event_type, t_ref, tm, ym, count(*) AS n, sum((t - tm) * (t - tm)) AS stt, sum((t - tm) * (y - ym)) AS sty, sum((y - ym) * (y - ym)) AS syy FROM ev e JOIN m ON e.event_type = m.event_type GROUP BY 1, 2, 3, 4)"""


def events(spark, d):
    return table(spark, d, "events").select("event_type", "event_id", "user_id", C.days(F.col("ts"), ORIGIN).alias("t"), F.col("value").alias("y"))


@query("t1_fit_trend", f"WITH {_EV}, {_MOM} SELECT event_type, n, round(t_ref, 6) AS t_ref, round(ym + sty / stt * (t_ref - tm), 6) AS mean, round(sty / stt, 6) AS trend, round(sqrt((syy - sty * sty / stt) / n), 6) AS rms_post FROM s")
def t1(spark, d):
    return rounded(series.fit_trend(events(spark, d), "event_type", "t", "y"))


@query("t1_fit_harmonic")
def t1h(spark, d):
    return series.fit_terms(events(spark, d), "event_type", "t", "y", 15.0, [7.0])


@query("t2_power_law", f"WITH {_EV} SELECT event_type, round(pow(10, regr_intercept(log10(y), log10(t))), 6) AS a, round(regr_slope(log10(y), log10(t)), 6) AS p FROM ev WHERE y > 0 AND t > 0 GROUP BY 1")
def t2(spark, d):
    ev = events(spark, d).where("y > 0 and t > 0").select("event_type", F.log10("y").alias("ly"), F.log10("t").alias("lt"))
    got = ev.groupBy("event_type").agg(F.pow(F.lit(10.0), F.regr_intercept("ly", "lt")).alias("a"), F.regr_slope("ly", "lt").alias("p"))
    return rounded(got)


@query("t3_weighted_mean_trend", f"WITH {_EV}, w AS (SELECT *, 1.0 / (1 + user_id % 5) AS w FROM ev), q AS (SELECT event_type, sum(w) AS n, sum(w * (t - 15)) AS nt, sum(w * (t - 15) * (t - 15)) AS ntt, sum(w * y) AS b, sum(w * y * (t - 15)) AS bt FROM w GROUP BY 1) SELECT event_type, round((ntt * b - nt * bt) / (n * ntt - nt * nt), 6) AS mean, round((n * bt - nt * b) / (n * ntt - nt * nt), 6) AS trend FROM q")
def t3(spark, d):
    ev = events(spark, d).withColumn("w", 1.0 / (1 + F.col("user_id") % 5))
    x = series.fit_terms(ev, "event_type", "t", "y", 15.0, [], 1, "w")
    return rounded(x.groupBy(F.col("sys").alias("event_type")).agg(F.max(F.when(F.col("name") == "p0", F.col("x"))).alias("mean"), F.max(F.when(F.col("name") == "p1", F.col("x"))).alias("trend")))


@query("t4_amplitude_phase")
def t4(spark, d):
    return series.amplitude_phase(t1h(spark, d))


@query("t7_reference_time", f"WITH {_EV} SELECT event_type, round((min(t) + max(t)) / 2, 6) AS t_ref FROM ev GROUP BY 1")
def t7(spark, d):
    return rounded(events(spark, d).groupBy("event_type").agg(((F.min("t") + F.max("t")) / 2).alias("t_ref")))


@query("t8_total_fit", f"WITH {_EV}, {_MOM} SELECT e.event_id, round(ym + sty / stt * (t - tm), 6) AS fit, round(y - ym - sty / stt * (t - tm), 6) AS residual FROM ev e JOIN s ON e.event_type = s.event_type")
def t8(spark, d):
    ev = events(spark, d)
    got = ev.join(series.fit_trend(ev, "event_type", "t", "y"), "event_type")
    fit = F.col("mean") + F.col("trend") * (F.col("t") - F.col("t_ref"))
    return rounded(got.select("event_id", fit.alias("fit"), (F.col("y") - fit).alias("residual")))


@query("t9_fit_report", f"WITH {_EV}, {_MOM} SELECT event_type, n AS nobs, 2 AS npara, round(syy + n * ym * ym, 4) AS ltpl_apri, round(syy - sty * sty / stt, 4) AS ltpl_post, round(sqrt((syy - sty * sty / stt) / (n - 2)), 6) AS sigma0 FROM s")
def t9(spark, d):
    m = events(spark, d).groupBy("event_type").agg(F.sum(F.col("y") * F.col("y")).alias("ltpl_apri"))
    x = series.fit_terms(events(spark, d), "event_type", "t", "y", 15.0, []).where("name = 'p0'")
    got = x.join(m, F.col("sys") == m["event_type"]).select("event_type", F.col("nobs"), F.lit(2).alias("npara"), F.round("ltpl_apri", 4).alias("ltpl_apri"), F.round("ltpl", 4).alias("ltpl_post"), F.round("sigma0", 6).alias("sigma0"))
    return got


@query("t10_stack_fit", "WITH e AS (SELECT unnest(range(len(embedding))) AS coef, unnest(embedding)::DOUBLE AS y, CAST(vec_id AS DOUBLE) / 100 AS t FROM embeddings) SELECT coef, round(regr_slope(y, t), 6) AS trend, round(regr_intercept(y, t), 6) AS bias FROM e GROUP BY 1")
def t10(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id").cast("double") / 100).alias("t"), F.posexplode("embedding").alias("coef", "v"))
    e = e.select(F.col("coef").cast("long").alias("coef"), "t", F.col("v").cast("double").alias("y"))
    return rounded(e.groupBy("coef").agg(F.regr_slope("y", "t").alias("trend"), F.regr_intercept("y", "t").alias("bias")))


@query("t12_calendar", "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS dmy, strftime(o_orderdate, '%y:%j:') || lpad(CAST(CAST(date_part('hour', o_orderdate) * 3600 + date_part('minute', o_orderdate) * 60 + floor(date_part('second', o_orderdate)) AS BIGINT) AS VARCHAR), 5, '0') AS sinex, round(epoch_us(o_orderdate) / 86400000000.0 + 2440587.5, 6) AS jd, round(epoch_us(o_orderdate) / 86400000000.0 + 40587, 6) AS mjd FROM orders")
def t12(spark, d):
    o, ts = table(spark, d, "orders"), F.col("o_orderdate")
    return rounded(o.select("o_orderkey", F.date_format(ts, "dd-MM-yyyy").alias("dmy"), C.sinex_date(ts).alias("sinex"), C.julian_date(ts).alias("jd"), C.modified_julian_date(ts).alias("mjd")))


@query("t13_gps_week", "SELECT o_orderkey, CAST(floor(date_diff('day', DATE '1980-01-06', CAST(o_orderdate AS DATE)) / 7.0) AS BIGINT) AS week FROM orders")
def t13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.gps_week(F.col("o_orderdate")).alias("week"))


@query("t15_decimal_year", "SELECT o_orderkey, round(year(o_orderdate) + (epoch_us(o_orderdate) / 86400000000.0 - date_diff('day', DATE '1970-01-01', make_date(year(o_orderdate), 1, 1))) / date_diff('day', make_date(year(o_orderdate), 1, 1), make_date(year(o_orderdate) + 1, 1, 1)), 8) AS year FROM orders")
def t15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(C.decimal_year(F.col("o_orderdate")), 8).alias("year"))


@query("t16_sort_permutation", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events")
def t16(spark, d):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("a14_degree_variance", "SELECT l, round(sum(v * v), 6) AS variance, round(sum(v * v) / (2 * l + 1), 6) AS per_coefficient FROM (SELECT CAST(label AS BIGINT) AS l, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1")
def a14(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("l"), F.explode("embedding").alias("f")).withColumn("v", F.col("f").cast("double"))
    return rounded(e.groupBy("l").agg(F.sum(F.col("v") * F.col("v")).alias("variance")).withColumn("per_coefficient", F.col("variance") / (2 * F.col("l") + 1)))


@query("a15_basin_average", "WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT k, v FROM e WHERE vec_id = 0) SELECT e.vec_id, round(sum(e.v * b.v) / (SELECT v FROM b WHERE k = 0), 5) AS average FROM e JOIN b ON e.k = b.k GROUP BY 1")
def a15(spark, d):
    e = table(spark, d, "embeddings")
    basin = e.where("vec_id = 0").select(F.col("embedding").alias("basin")).limit(1)
    dot = F.aggregate(F.zip_with("embedding", "basin", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(basin)).select("vec_id", F.round(dot / F.col("basin")[0].cast("double"), 5).alias("average"))


@query("a16_rms", "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1")
def a16(spark, d):
    return rounded(table(spark, d, "events").groupBy("event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")))


@query("a17_mean_removal", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 9) AS y FROM events")
def a17(spark, d):
    e = table(spark, d, "events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return rounded(e.join(m, "event_type").select("event_id", (F.col("value") - F.col("m")).alias("y")), 9)


_LAGS = " UNION ALL ".join(f"SELECT user_id, {k} AS lag, round(sum(d * {'d' if not k else f'l{k}'}) / (max(n) - 1), 5) AS value FROM q GROUP BY 1" for k in range(4))


@query("a18_autocovariance", f"WITH m AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM events), q AS (SELECT user_id, d, n, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2, lag(d, 3) OVER w AS l3 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) {_LAGS}")
def a18(spark, d):
    return rounded(series.autocovariance(table(spark, d, "events"), "user_id", "event_id", "value", 3), 5)


@query("a19_valid_counts", f"WITH {_EV} SELECT user_id, count(y) AS n, round(min(t), 6) AS t0, round(max(t), 6) AS tn FROM ev GROUP BY 1")
def a19(spark, d):
    return rounded(events(spark, d).groupBy("user_id").agg(F.count("y").alias("n"), F.min("t").alias("t0"), F.max("t").alias("tn")))


@query("a20_climatology", "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def a20(spark, d):
    return rounded(table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("mean")), 4)


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("a22_pivot", "SELECT user_id, " + ", ".join(f"round(sum(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def a22(spark, d):
    return rounded(table(spark, d, "events").groupBy("user_id").pivot("event_type", _TYPES).agg(F.sum("value")))


@query("l1_build_normals", f"WITH {_EV} SELECT event_type AS sys, count(*) AS nobs, round(sum(y * y), 4) AS ltpl, round(sum(y), 4) AS b_p0, CAST(count(*) AS DOUBLE) AS n_p0_p0, round(sum(t - 15), 4) AS n_p0_p1, round(sum((t - 15) * y), 4) AS b_p1, round(sum((t - 15) * (t - 15)), 4) AS n_p1_p1 FROM ev GROUP BY 1")
def l1(spark, d):
    return rounded(normals.build(events(spark, d), {"p0": F.lit(1.0), "p1": F.col("t") - 15}, "y", "event_type"), 4)


@query("l3_change_apriori", f"WITH {_EV}, q AS (SELECT event_type, count(*)::DOUBLE AS n, sum(y) AS b, sum(y * y) AS l FROM ev GROUP BY 1) SELECT event_type AS sys, round(b - n * 10, 4) AS b, round(l - 10 * b - 10 * (b - n * 10), 4) AS ltpl FROM q")
def l3(spark, d):
    m = normals.build(events(spark, d), {"p0": F.lit(1.0)}, "y", "event_type")
    b = F.col("b_p0") - F.col("n_p0_p0") * 10
    return rounded(m.select("sys", b.alias("b"), (F.col("ltpl") - 10 * F.col("b_p0") - 10 * b).alias("ltpl")), 4)


@query("l13_solve_cholesky")
def l13(spark, d):
    return series.fit_terms(events(spark, d), "event_type", "t", "y", 15.0, [7.0, 1.0], 2)


@query("l15_sigma0", "SELECT event_type AS sys, round(stddev_samp(value), 6) AS sigma0 FROM events GROUP BY 1")
def l15(spark, d):
    x = normals.solve(normals.build(events(spark, d), {"p0": F.lit(1.0)}, "y", "event_type"), ["p0"])
    return rounded(x.select("sys", "sigma0"))


@query("n8_interpolate", f"WITH {_EV}, u AS (SELECT user_id, t, max(y) AS y FROM ev GROUP BY 1, 2), p AS (SELECT DISTINCT user_id, CAST(unnest([5, 15, 25]) AS DOUBLE) AS t FROM ev), a AS (SELECT p.user_id, p.t, max(CASE WHEN u.t <= p.t THEN u.t END) AS ta, min(CASE WHEN u.t >= p.t THEN u.t END) AS tb FROM p JOIN u ON u.user_id = p.user_id GROUP BY 1, 2) SELECT a.user_id, a.t, round(CASE WHEN ta = tb THEN x.y ELSE x.y + (a.t - ta) / (tb - ta) * (z.y - x.y) END, 5) AS y FROM a LEFT JOIN u x ON x.user_id = a.user_id AND x.t = a.ta LEFT JOIN u z ON z.user_id = a.user_id AND z.t = a.tb")
def n8(spark, d):
    ev = events(spark, d).groupBy("user_id", "t").agg(F.max("y").alias("y"))
    ask = ev.select("user_id").distinct().withColumn("t", F.explode(F.array(F.lit(5.0), F.lit(15.0), F.lit(25.0))))
    return rounded(series.interpolate(ask, ev, "user_id", "t", "y"), 5)


@query("n9_window_average", f"WITH {_EV} SELECT event_type, w AS week, round(avg(y), 6) AS y FROM ev, (SELECT unnest([0, 7, 14, 21]) AS w) WHERE t >= w AND t < w + 7 GROUP BY 1, 2")
def n9(spark, d):
    ev = events(spark, d).withColumn("week", (F.floor(F.col("t") / 7) * 7).cast("int")).where("week between 0 and 21")
    return rounded(ev.groupBy("event_type", "week").agg(F.avg("y").alias("y")))


@query("n11_subtract_station_mean", "SELECT e.event_id, round(e.value - m.m, 9) AS y FROM events e JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) m ON e.user_id = m.user_id")
def n11(spark, d):
    e = table(spark, d, "events")
    return rounded(e.join(e.groupBy("user_id").agg(F.avg("value").alias("m")), "user_id").select("event_id", (F.col("value") - F.col("m")).alias("y")), 9)


@query("p7_time_overlap", f"WITH {_EV}, s AS (SELECT user_id, min(t) AS t0, max(t) AS tn FROM ev GROUP BY 1) SELECT user_id FROM s WHERE NOT (t0 > 20 OR tn < 10)")
def p7(spark, d):
    s = events(spark, d).groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("tn"))
    return s.where("not (t0 > 20 or tn < 10)").select("user_id")


@query("p8_continuity", f"WITH {_EV}, s AS (SELECT user_id, count(DISTINCT floor(t)) AS days FROM ev GROUP BY 1) SELECT user_id, CAST(30 - days AS BIGINT) AS gaps FROM s WHERE 30 - days <= 10")
def p8(spark, d):
    s = events(spark, d).select("user_id", F.floor("t").alias("day")).distinct().groupBy("user_id").agg((F.lit(30) - F.count("*")).alias("gaps"))
    return s.where("gaps <= 10")
