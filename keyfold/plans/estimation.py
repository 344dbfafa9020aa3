"""Queries on autoregressive noise, intervals, time terms and tiled factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import autoregression, intervals, normals, series, systems, tiles, time_terms
from .fits import _EV, _T, events
from .matrices import rounded
from .registry import query, table

_DAY = f"dy AS (SELECT event_type, floor({_T})::DOUBLE AS t, avg(value) AS y FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


def daily(spark, d):
    """Daily means of each type of event."""
    return events(spark, d).where("y is not null").groupBy("event_type", F.floor("t").cast("double").alias("t")).agg(F.avg("y").alias("y"))


_AR = """m AS (SELECT event_type, avg(t) AS tm, avg(y) AS ym FROM dy GROUP BY 1), b AS (SELECT event_type, sum((t - tm) * (y - ym)) / sum((t - tm) * (t - tm)) AS s FROM dy JOIN m USING (event_type) GROUP BY 1),
r AS (SELECT event_type, t, y, y - ym - s * (t - tm) AS r, row_number() OVER (PARTITION BY event_type ORDER BY t) AS k FROM dy JOIN m USING (event_type) JOIN b USING (event_type)),
c AS (SELECT event_type, r - avg(r) OVER (PARTITION BY event_type) AS d, lag(r) OVER (PARTITION BY event_type ORDER BY t) - avg(r) OVER (PARTITION BY event_type) AS e, count(*) OVER (PARTITION BY event_type) AS n FROM r),
g AS (SELECT event_type, max(n) AS n, sum(d * d) / (max(n) - 1) AS g0, sum(d * e) / (max(n) - 1) AS g1 FROM c GROUP BY 1),
a AS (SELECT event_type, n, g1 / g0 AS phi, g0 - g1 * g1 / g0 AS sig2 FROM g), h AS (SELECT *, sig2 / (1 - phi * phi) AS v FROM a),
ar AS (SELECT event_type, n, phi, sig2, CASE WHEN v <= 2.1 * abs(v * phi) THEN 2.1 * abs(v * phi) ELSE v END AS v0, v * phi AS v1 FROM h)"""


def _fit(spark, d, order: int):
    return autoregression.two_pass_fit(daily(spark, d), "event_type", "t", "y", {"p0": F.lit(1.0), "p1": F.col("t") - 15}, order)


@query("t5_ar_model", f"WITH {_DAY}, {_AR} SELECT event_type, CAST(n AS BIGINT) AS n, round(phi, 6) AS phi, round(sig2, 4) AS sig2, round(v0, 4) AS v0, round(v1, 4) AS v1 FROM ar")
def t5(spark, d):
    """First-order models of the residuals of daily means about a trend."""
    got = _fit(spark, d, 1)[1]
    return got.select("event_type", "n", F.round(F.get("parameters", F.lit(0)), 6).alias("phi"), F.round("sig2", 4).alias("sig2"), F.round(F.get("band", F.lit(0)), 4).alias("v0"), F.round(F.get("band", F.lit(1)), 4).alias("v1"))


@query(
    "t5_ar_fit",
    f"""WITH RECURSIVE {_DAY}, {_AR}, w AS (SELECT event_type, k, sqrt(v0) AS l, y / sqrt(v0) AS z, 1 / sqrt(v0) AS z0, (t - 15) / sqrt(v0) AS z1 FROM r JOIN ar USING (event_type) WHERE k = 1
UNION ALL SELECT w.event_type, r.k, sqrt(v0 - v1 * v1 / (w.l * w.l)), (y - v1 / w.l * z) / sqrt(v0 - v1 * v1 / (w.l * w.l)), (1 - v1 / w.l * z0) / sqrt(v0 - v1 * v1 / (w.l * w.l)), (t - 15 - v1 / w.l * z1) / sqrt(v0 - v1 * v1 / (w.l * w.l)) FROM w JOIN r ON r.event_type = w.event_type AND r.k = w.k + 1 JOIN ar ON ar.event_type = w.event_type),
q AS (SELECT event_type, count(*) AS n, sum(z0 * z0) AS n00, sum(z0 * z1) AS n01, sum(z1 * z1) AS n11, sum(z0 * z) AS b0, sum(z1 * z) AS b1 FROM w GROUP BY 1)
SELECT event_type AS sys, CAST(n AS BIGINT) AS nobs, round((n11 * b0 - n01 * b1) / (n00 * n11 - n01 * n01), 5) AS mean, round((n00 * b1 - n01 * b0) / (n00 * n11 - n01 * n01), 6) AS trend FROM q""",
)
def t5b(spark, d):
    """Mean and trend weighted by those models."""
    got = _fit(spark, d, 1)[0]
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("x")))
    return got.groupBy("sys").agg(F.max("nobs").alias("nobs"), F.round(pick("p0"), 5).alias("mean"), F.round(pick("p1"), 6).alias("trend"))


_SOL = f"""er AS (SELECT user_id, event_id, {_T} AS t FROM events WHERE event_type = 'error'),
so AS (SELECT user_id, CAST(event_id AS VARCHAR) AS solution, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS stop, CASE WHEN event_id % 7 = 0 THEN 'V' ELSE 'P' END AS kind, event_id AS rank FROM er
UNION ALL SELECT user_id, 's' || event_id, t, t + 5, 'P', event_id + 1000000000 FROM (SELECT user_id, event_id, {_T} AS t FROM events WHERE event_type = 'signup'))"""


@query(
    "p13_solution_at_time",
    f"WITH {_SOL}, p AS (SELECT event_id, user_id, {_T} AS t FROM events WHERE event_type = 'purchase'), h AS (SELECT event_id, arg_min(solution, rank) AS solution FROM p JOIN so USING (user_id) WHERE kind <> 'V' AND coalesce(stop, 29.5) - start >= 0.5 AND start < t AND t < coalesce(stop, 29.5) GROUP BY 1) SELECT p.event_id, solution FROM p LEFT JOIN h USING (event_id)",
)
def p13(spark, d):
    """The interval between errors (or, else, after a signup) that holds each purchase."""
    ev = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    err = ev.where("event_type = 'error'").select("user_id", F.col("event_id").cast("string").alias("solution"), F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.when(F.col("event_id") % 7 == 0, "V").otherwise("P").alias("kind"), F.col("event_id").alias("rank"))
    sign = ev.where("event_type = 'signup'").select("user_id", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("solution"), F.col("t").alias("start"), (F.col("t") + 5).alias("end"), F.lit("P").alias("kind"), (F.col("event_id") + 1000000000).alias("rank"))
    got = intervals.solution_at(ev.where("event_type = 'purchase'").select("event_id", "user_id", "t"), err.unionByName(sign), "user_id", "t", 29.5, 0.5, 3.0)
    return got.select("event_id", "solution")


_CUM = "cu AS (SELECT CAST(o_custkey % 25 AS INTEGER) AS st, CASE o_orderkey % 3 WHEN 0 THEN '----' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS so, CASE o_orderkey // 3 % 2 WHEN 0 THEN 'STA' ELSE 'VEL' END AS ki, CASE o_orderkey // 6 % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS co, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3, 4)"


@query(
    "n12_reference_positions",
    f"""WITH {_CUM}, ok AS (SELECT st, so FROM cu GROUP BY 1, 2 HAVING count(*) = 6), r AS (SELECT st, so, co, max(v) FILTER (ki = 'STA') AS p, max(v) FILTER (ki = 'VEL') AS u FROM cu JOIN ok USING (st, so) GROUP BY 1, 2, 3),
q AS (SELECT c_custkey, c_nationkey AS st, CASE c_custkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS co, CAST(c_custkey % 5 AS VARCHAR) AS so, c_custkey % 40 / 4.0 AS t FROM customer)
SELECT q.c_custkey, round(coalesce(a.p + a.u * (t - 2), b.p + b.u * (t - 2)) / 7e3, 4) AS reference, coalesce(a.so, b.so) AS used FROM q LEFT JOIN r a ON a.st = q.st AND a.so = q.so AND a.co = q.co LEFT JOIN r b ON b.st = q.st AND b.so = '----' AND b.co = q.co""",
)
def n12(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    three = lambda c: F.when(c == 0, "X").when(c == 1, "Y").otherwise("Z")
    cum = o.groupBy((F.col("o_custkey") % 25).cast("int").alias("st"), F.when(k % 3 == 0, intervals.ANY).otherwise((k % 3).cast("string")).alias("solution"), F.when(F.floor(k / 3) % 2 == 0, "STA").otherwise("VEL").alias("kind"), three(F.floor(k / 6) % 3).alias("component"))
    cum = cum.agg(F.avg("o_totalprice").alias("value"), F.lit(2.0).alias("epoch"))
    c = F.col("c_custkey")
    points = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("st"), three(c % 3).alias("component"), (c % 5).cast("string").alias("solution"), (c % 40 / 4).alias("t"))
    return intervals.reference_positions(points, cum, "st", "t").select("c_custkey", F.round(F.col("reference") / 7e3, 4).alias("reference"), "used")


@query("l23_time_terms", f"WITH {_EV} SELECT event_type AS sys, round(count(*)::DOUBLE, 3) AS n00, round(sum(floor(t) - 15), 3) AS n01, round(sum((floor(t) - 15) * (floor(t) - 15)), 3) AS n11, round(sum(y), 3) AS b0, round(sum(y * (floor(t) - 15)), 3) AS b1, round(sum(y * y), 5) AS ltpl FROM ev WHERE y IS NOT NULL GROUP BY 1")
def l23(spark, d):
    """Each day's level of a type of event, as a mean and a trend over all days."""
    ev = events(spark, d).where("y is not null").withColumn("day", F.floor("t"))
    day = ev.groupBy(F.concat_ws("|", "event_type", F.col("day").cast("string")).alias("sys"), F.col("event_type").alias("grp"), F.col("day").cast("double").alias("t"))
    sums = day.agg(F.count("*").alias("nobs"), F.sum("y").alias("b_LEVEL"), F.sum(F.col("y") * F.col("y")).alias("ltpl"), F.count("*").cast("double").alias("n_LEVEL_LEVEL"))
    s = systems.settled(systems.from_moments(sums, ["LEVEL"]))
    names = s.stats.select("sys", F.substring_index("sys", "|", 1).alias("grp"), F.substring_index("sys", "|", -1).cast("double").alias("t"))
    got = systems.combine(systems.settled(time_terms.expand(s, names.select("sys", "t"), 15.0, mean="", trend="^LEVEL$")), names.select("sys", "grp"))
    cell = lambda i, j, n: F.round(F.max(F.when((F.col("row_key") == i) & (F.col("col_key") == j), F.col("value"))), 3).alias(n)
    n = got.cells.groupBy("sys").agg(cell("LEVEL", "LEVEL", "n00"), cell("LEVEL", "TR_LEVEL", "n01"), cell("TR_LEVEL", "TR_LEVEL", "n11"))
    b = got.rhs.groupBy("sys").agg(*(F.round(F.max(F.when(F.col("row_key") == k, F.col("value"))), 3).alias(c) for k, c in (("LEVEL", "b0"), ("TR_LEVEL", "b1"))))
    return n.join(b, "sys").join(got.stats.select("sys", F.round("ltpl", 5).alias("ltpl")), "sys")


def nation_normals(spark, d):
    """Normals of 25 unknowns, tied to each other by the suppliers they share orders with."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("c"))
    a, b = n, n.select(F.col("n").alias("n2"), "s", F.col("c").alias("c2"))
    cross = a.join(b, "s").where("n <= n2").groupBy("n", "n2").agg(F.sum(F.col("c") * F.col("c2")).cast("double").alias("v"))
    key = lambda c: F.format_string("N%02d", c)
    unit = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_nationkey").alias("n2"), (10.0 + F.col("n_nationkey")).alias("v"))
    return cross.unionByName(unit).groupBy(key("n").alias("row_key"), key("n2").alias("col_key")).agg(F.sum("v").alias("value"))


@query("a11_tiled_cholesky", "WITH n AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS c FROM customer GROUP BY 1, 2), k AS (SELECT n_nationkey AS n FROM nation) SELECT printf('N%02d', a.n) AS row_key, printf('N%02d', b.n) AS col_key, round(coalesce((SELECT sum(x.c * y.c) FROM n x JOIN n y ON x.s = y.s WHERE x.n = a.n AND y.n = b.n), 0)::DOUBLE + CASE WHEN a.n = b.n THEN 10 + a.n ELSE 0 END, 4) + 0.0 AS value FROM k a JOIN k b ON a.n <= b.n")
def a11(spark, d):
    """L L' of the factor by tiles of seven keys: the matrix again."""
    f = tiles.factor_cells(tiles.factor(nation_normals(spark, d), tile=7))
    other = f.select(F.col("row_key").alias("r2"), "col_key", F.col("value").alias("v2"))
    got = f.join(other, "col_key").where("row_key <= r2").groupBy("row_key", F.col("r2").alias("col_key")).agg(F.sum(F.col("value") * F.col("v2")).alias("value"))
    return got.select("row_key", "col_key", (F.round("value", 4) + 0.0).alias("value"))


@query("a10_tiled_solve", "SELECT printf('N%02d', n_nationkey) AS row_key, CAST(k AS INTEGER) AS rhs_no, round(CASE k WHEN 1 THEN n_nationkey + 1 ELSE 1 END, 5)::DOUBLE AS back FROM nation CROSS JOIN (SELECT unnest(range(1, 3)) AS k)")
def a10(spark, d):
    """A X for the solution X of A X = B: the two right sides again."""
    a = nation_normals(spark, d)
    rhs = table(spark, d, "nation").select(F.format_string("N%02d", "n_nationkey").alias("row_key"), F.posexplode(F.array(F.col("n_nationkey") + 1.0, F.lit(1.0))).alias("k", "value")).select("row_key", (F.col("k") + 1).alias("rhs_no"), "value")
    x = tiles.solve(tiles.factor(a, rhs, tile=9))
    both = a.unionByName(a.where("row_key <> col_key").select(F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), "value"))
    right = x.select(F.col("row_key").alias("col_key"), "rhs_no", F.col("value").alias("x"))
    return rounded(both.join(right, "col_key").groupBy("row_key", "rhs_no").agg(F.sum(F.col("value") * F.col("x")).alias("back")), 5)


_HARM = "h AS (SELECT event_type, y - avg(y) OVER (PARTITION BY event_type) AS y, cos(2 * pi() / 7 * (t - 15)) AS c, sin(2 * pi() / 7 * (t - 15)) AS s FROM ev WHERE y IS NOT NULL), q AS (SELECT event_type, count(*) AS n, sum(c * c) AS ncc, sum(c * s) AS ncs, sum(s * s) AS nss, sum(c * y) AS bc, sum(s * y) AS bs, sum(y * y) AS l FROM h GROUP BY 1), x AS (SELECT *, ncc * nss - ncs * ncs AS d, (nss * bc - ncs * bs) / (ncc * nss - ncs * ncs) AS xc, (ncc * bs - ncs * bc) / (ncc * nss - ncs * ncs) AS xs FROM q), z AS (SELECT *, (l - xc * bc - xs * bs) / (n - 2) AS v FROM x)"


@query(
    "t4_amplitude_errors",
    f"WITH {_EV}, {_HARM} SELECT event_type AS sys, round(sqrt(xc * xc + xs * xs), 5) AS amplitude, round(atan2(xs, xc) * 7 / (2 * pi()), 5) AS phase, round(sqrt(v * (xc * xc * nss - 2 * xc * xs * ncs + xs * xs * ncc) / d) / sqrt(xc * xc + xs * xs), 5) AS amplitude_error, round(sqrt(v * (xs * xs * nss + 2 * xc * xs * ncs + xc * xc * ncc) / d) / (xc * xc + xs * xs) * 7 / (2 * pi()), 5) AS phase_error FROM z",
)
def t4(spark, d):
    """The weekly harmonic of each type of event, with the errors of amplitude and phase."""
    ev = events(spark, d).where("y is not null").withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("event_type")))
    return rounded(series.amplitude_errors(ev, "event_type", "t", "y", 15.0, 7.0), 5)


@query("t11_climatology", "WITH m AS (SELECT o_orderpriority AS sys, month(o_orderdate) AS k, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2), a AS (SELECT sys, avg(y) AS y FROM m GROUP BY 1) SELECT sys, 'p0' AS row_key, round(y, 4) AS x FROM a UNION ALL SELECT m.sys, printf('m%02d', k), round(m.y - a.y, 4) FROM m JOIN a ON a.sys = m.sys")
def t11(spark, d):
    """Monthly means beside a mean: only their sum's constraint tells them apart."""
    got = series.climatology(table(spark, d, "orders"), "o_orderpriority", F.month("o_orderdate"), "o_totalprice", {"p0": F.lit(1.0)})
    return got.x.select("sys", "row_key", F.round("x", 4).alias("x"))


@query("a9_eigen_pairs", "WITH n AS (SELECT c_mktsegment AS s, c_nationkey AS n, count(*) AS c FROM customer GROUP BY 1, 2), k AS (SELECT s, count(*) AS keys, sum(c * c + 1.0 + n) AS trace, sum(c * c) AS cc, sum((c * c + 1.0 + n) * (c * c + 1.0 + n) - (c * c) * (c * c)) AS more FROM n GROUP BY 1) SELECT s AS sys, CAST(keys AS BIGINT) AS keys, round(trace::DOUBLE, 4) AS trace, round((cc * cc + more)::DOUBLE, 3) AS squares, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS off FROM k")
def a9p(spark, d):
    """Of the eigenpairs of one matrix a segment: sums of e and e^2, and the
    largest entries of A v - e v and of V'V - I."""
    n = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("sys"), F.col("c_nationkey").alias("n")).agg(F.count("*").alias("c"))
    key = lambda c: F.format_string("N%02d", c)
    pairs = n.join(n.select("sys", F.col("n").alias("n2"), F.col("c").alias("c2")), "sys").where("n <= n2")
    cells = pairs.select("sys", key("n").alias("row_key"), key("n2").alias("col_key"), (F.col("c") * F.col("c2") + F.when(F.col("n") == F.col("n2"), 1.0 + F.col("n")).otherwise(0.0)).alias("value"))
    rhs = n.select("sys", key("n").alias("row_key"), F.lit(0.0).alias("value"), F.lit(0.0).alias("x0"))
    none = {c: F.lit(None).cast("double") for c in ("stime", "etime", "ctime")}
    s = systems.Systems(cells, rhs, n.select("sys").distinct().withColumns({"nobs": F.lit(0).cast("long"), "ltpl": F.lit(0.0), "nfix": F.lit(0).cast("long"), "nred": F.lit(0).cast("long"), **none}))
    v = systems.eigen(s)
    right = v.select("sys", "place", F.col("row_key").alias("col_key"), F.col("component").alias("x"))
    av = systems.full(cells).join(right, ["sys", "col_key"]).groupBy("sys", "place", "row_key").agg(F.sum(F.col("value") * F.col("x")).alias("av"))
    rest = v.join(av, ["sys", "place", "row_key"]).groupBy("sys").agg(F.max(F.abs(F.col("av") - F.col("value") * F.col("component"))).alias("residual"))
    dots = v.join(v.select("sys", "row_key", F.col("place").alias("p2"), F.col("component").alias("y")), ["sys", "row_key"]).groupBy("sys", "place", "p2").agg(F.sum(F.col("component") * F.col("y")).alias("dot"))
    off = dots.groupBy("sys").agg(F.max(F.abs(F.col("dot") - F.when(F.col("place") == F.col("p2"), 1.0).otherwise(0.0))).alias("off"))
    e = v.select("sys", "place", "value").distinct().groupBy("sys").agg(F.count("*").alias("keys"), F.round(F.sum("value"), 4).alias("trace"), F.round(F.sum(F.col("value") * F.col("value")), 3).alias("squares"))
    return e.join(rest, "sys").join(off, "sys").select("sys", "keys", "trace", "squares", F.round("residual", 5).alias("residual"), F.round("off", 6).alias("off"))


@query(
    "t10_weighted_stack",
    """WITH e AS (SELECT unnest(range(len(embedding))) AS coef, unnest(embedding)::DOUBLE AS y, vec_id / 100.0 AS t, 1.0 / (1 + label) AS w FROM embeddings),
q AS (SELECT coef, count(*) AS n, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(w * y) AS b0, sum(w * t * y) AS b1, sum(w * y * y) AS l FROM e GROUP BY 1),
x AS (SELECT *, (s2 * b0 - s1 * b1) / (s0 * s2 - s1 * s1) AS p0, (s0 * b1 - s1 * b0) / (s0 * s2 - s1 * s1) AS p1 FROM q)
SELECT x.coef, round(any_value(p0), 6) AS bias, round(any_value(p1), 6) AS trend, round(any_value(sqrt((l - p0 * b0 - p1 * b1) / (n - 2))), 6) AS sigma0, round(sqrt(avg((y - p0 - p1 * t) * (y - p0 - p1 * t))), 6) AS rms FROM x JOIN e ON e.coef = x.coef GROUP BY 1""",
)
def t10w(spark, d):
    """Weighted fits of a stack, one for each coefficient, sigma0 and the rms of the residual fields."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 100).alias("t"), (1 / (1 + F.col("label"))).alias("w"), F.posexplode("embedding").alias("coef", "v"))
    e = e.select(F.col("coef").cast("long").alias("coef"), "t", "w", F.col("v").cast("double").alias("y"))
    terms = {"p0": F.lit(1.0), "p1": F.col("t")}
    x = normals.solve(normals.build(e, terms, "y", "coef", "w"), list(terms))
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("x")))
    fit = x.groupBy(F.col("sys").alias("coef")).agg(pick("p0").alias("bias"), pick("p1").alias("trend"), F.max("sigma0").alias("sigma0"))
    rms = series.residuals(e, "coef", "y", terms, x).groupBy("coef").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    return rounded(fit.join(rms, "coef"))


@query(
    "t8_term_fits",
    f"WITH {_EV}, q AS (SELECT event_type, count(*) AS n, sum(t - 15) AS s1, sum((t - 15) * (t - 15)) AS s2, sum(y) AS b0, sum(y * (t - 15)) AS b1 FROM ev WHERE y IS NOT NULL GROUP BY 1) SELECT event_id, round((s2 * b0 - s1 * b1) / (n * s2 - s1 * s1), 5) AS fit_mean, round((n * b1 - s1 * b0) / (n * s2 - s1 * s1) * (t - 15), 5) AS fit_trend FROM ev JOIN q USING (event_type) WHERE y IS NOT NULL",
)
def t8t(spark, d):
    """What the mean and the trend each give at every event."""
    ev = events(spark, d).where("y is not null")
    terms = {"mean": F.lit(1.0), "trend": F.col("t") - 15}
    got = series.residuals(ev, "event_type", "y", terms, normals.solve(normals.build(ev, terms, "y", "event_type"), list(terms)))
    return got.select("event_id", *(F.round(f"fit_{n}", 5).alias(f"fit_{n}") for n in terms))
