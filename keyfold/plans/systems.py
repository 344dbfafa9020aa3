"""Queries on whole normal-equation systems, of events by type: bias and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normals, systems
from .fits import _EV, events
from .matrices import rounded
from .registry import query

_Q = f"""WITH {_EV}, q AS (SELECT event_type AS sys, CASE WHEN event_type < 'q' THEN 'a' ELSE 'b' END AS grp, count(*) AS nobs, count(*)::DOUBLE AS n00, sum(t - 15) AS n01, sum((t - 15) * (t - 15)) AS n11,
  sum(y) AS b0, sum((t - 15) * y) AS b1, sum(y * y) AS l, min(t) AS t0, max(t) AS t1 FROM ev WHERE y IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, (n11 * b0 - n01 * b1) / (n00 * n11 - n01 * n01) AS x0, (n00 * b1 - n01 * b0) / (n00 * n11 - n01 * n01) AS x1 FROM q),
g AS (SELECT grp, sum(nobs) AS nobs, sum(n00) AS n00, sum(n01) AS n01, sum(n11) AS n11, sum(b0) AS b0, sum(b1) AS b1, sum(l) AS l, min(t0) AS t0, max(t1) AS t1 FROM q GROUP BY 1) """


def base(spark, d) -> systems.Systems:
    ev = events(spark, d)
    moments = normals.build(ev, {"p0": F.lit(1.0), "p1": F.col("t") - 15}, "y", "event_type")
    times = ev.where("y is not null").groupBy(F.col("event_type").alias("sys")).agg(F.min("t").alias("stime"), F.max("t").alias("etime"))
    return systems.from_moments(moments, ["p0", "p1"], times)


def wide(s: systems.Systems, names: list[str], *stats: str):
    """One row a system: n_<i>_<j>, b_<i>, ltpl and some statistics."""
    cell = lambda a, b: F.max(F.when((F.col("row_key") == a) & (F.col("col_key") == b), F.col("value"))).alias(f"n_{a}_{b}")
    n = s.cells.groupBy("sys").agg(*(cell(a, b) for i, a in enumerate(names) for b in names[i:]))
    b = s.rhs.groupBy("sys").agg(*(F.max(F.when(F.col("row_key") == a, F.col("value"))).alias(f"b_{a}") for a in names))
    return rounded(s.stats.select("sys", "ltpl", *stats).join(n, "sys").join(b, "sys"), 3)


def groups(s: systems.Systems):
    return s.stats.select("sys", F.when(F.col("sys") < "q", "a").otherwise("b").alias("grp"))


def _r(expr: str, name: str, digits: int = 3) -> str:
    return f"round({expr}, {digits}) AS {name}"


_N2 = f"{_r('n00', 'n_p0_p0')}, {_r('n01', 'n_p0_p1')}, {_r('n11', 'n_p1_p1')}, {_r('b0', 'b_p0')}, {_r('b1', 'b_p1')}"


@query("l5_fix_system", _Q + f"SELECT sys, {_r('l', 'ltpl')}, CAST(1 AS BIGINT) AS nfix, {_r('n00', 'n_p0_p0')}, {_r('b0', 'b_p0')} FROM q")
def l5(spark, d):
    return wide(systems.fix(base(spark, d), spark.createDataFrame([("p1",)], "row_key string")), ["p0"], "nfix")


def about_own(s: systems.Systems) -> systems.Systems:
    """The systems moved to a-priori values that differ from one to the other."""
    own = F.length("sys") / F.when(F.col("row_key") == "p0", 1.0).otherwise(10.0)
    s = systems.settled(s)
    return systems.settled(systems.shift_apriori(s, s.rhs.select("sys", "row_key", own.alias("x"))))


# The groups' sums about a-priori values m0, m1: of the systems' plain means, or means by span.
_MOVED = f"{_r('l - 2 * (m0 * b0 + m1 * b1) + m0 * m0 * n00 + 2 * m0 * m1 * n01 + m1 * m1 * n11', 'ltpl')}, {_r('n00', 'n_p0_p0')}, {_r('n01', 'n_p0_p1')}, {_r('n11', 'n_p1_p1')}, {_r('b0 - m0 * n00 - m1 * n01', 'b_p0')}, {_r('b1 - m0 * n01 - m1 * n11', 'b_p1')}"
_SPAN = "sum(length(sys) * (t1 - t0)) / sum(t1 - t0)"


@query("l6_combine_systems", _Q + f"SELECT grp AS sys, {_MOVED}, CAST(nobs AS BIGINT) AS nobs, CAST(0 AS BIGINT) AS nfix, CAST(0 AS BIGINT) AS nred, {_r('t0', 'stime')}, {_r('t1', 'etime')}, {_r('(t0 + t1) / 2', 'ctime')} FROM g JOIN (SELECT grp, avg(length(sys)) AS m0, avg(length(sys)) / 10 AS m1 FROM q GROUP BY 1) USING (grp)")
def l6(spark, d):
    s = about_own(base(spark, d))
    return wide(systems.combine(s, groups(s)), ["p0", "p1"], "nobs", "nfix", "nred", "stime", "etime", "ctime")


@query("l7_combine_same_keys", _Q + f"SELECT min(sys) AS sys, {_r('sum(l)', 'ltpl')}, CAST(sum(nobs) AS BIGINT) AS nobs, {_r('sum(n00)', 'n_p0_p0')}, {_r('sum(n01)', 'n_p0_p1')}, {_r('sum(n11)', 'n_p1_p1')}, {_r('sum(b0)', 'b_p0')}, {_r('sum(b1)', 'b_p1')} FROM q")
def l7(spark, d):
    s = base(spark, d)
    return wide(systems.combine(s, systems.same_keys(s)), ["p0", "p1"], "nobs")


@query("l4_set_apriori", _Q + f"SELECT sys, {_r('l - 2 * (2 * b0 + 0.5 * b1) + 4 * n00 + 2 * n01 + 0.25 * n11', 'ltpl')}, {_r('n00', 'n_p0_p0')}, {_r('n01', 'n_p0_p1')}, {_r('n11', 'n_p1_p1')}, {_r('b0 - 2 * n00 - 0.5 * n01', 'b_p0')}, {_r('b1 - 2 * n01 - 0.5 * n11', 'b_p1')} FROM q")
def l4(spark, d):
    new = spark.createDataFrame([("p0", 2.0), ("p1", 0.5)], "row_key string, x double")
    return wide(systems.change_apriori(base(spark, d), "set", new), ["p0", "p1"])


@query("l8_average_apriori", _Q + f"SELECT grp AS sys, {_MOVED}, {_r('m0', 'x0_p0', 6)}, {_r('m1', 'x0_p1', 6)} FROM g JOIN (SELECT grp, {_SPAN} AS m0, {_SPAN} / 10 AS m1 FROM q GROUP BY 1) USING (grp)")
def l8(spark, d):
    s = about_own(base(spark, d))
    both = systems.combine(s, groups(s), "span")
    at = both.rhs.groupBy("sys").agg(*(F.round(F.max(F.when(F.col("row_key") == p, F.col("x0"))), 6).alias(f"x0_{p}") for p in ("p0", "p1")))
    return wide(both, ["p0", "p1"]).join(at, "sys")


@query("l10_reduce_system", _Q + f"SELECT sys, {_r('l - b0 * b0 / n00', 'ltpl')}, CAST(1 AS BIGINT) AS nred, {_r('n11 - n01 * n01 / n00', 'n_p1_p1')}, {_r('b1 - n01 * b0 / n00', 'b_p1')} FROM q")
def l10(spark, d):
    return wide(systems.reduce(base(spark, d), "^p0$"), ["p1"], "nred")


@query("l12_regularise_matched", _Q + f"SELECT sys, {_r('l', 'ltpl')}, {_r('n00', 'n_p0_p0')}, {_r('n01 + 1', 'n_p0_p1')}, {_r('n11 + 6', 'n_p1_p1')}, {_r('b0', 'b_p0')}, {_r('b1', 'b_p1')} FROM q")
def l12(spark, d):
    matrix = spark.createDataFrame([("p0", "p1", 0.5), ("p1", "p1", 2.0), ("p1", "p9", 1.0)], "row_key string, col_key string, value double")
    return wide(systems.regularise(systems.regularise(base(spark, d), 2.0, matrix), 2.0, None, "^p1$"), ["p0", "p1"])


@query("l13_solve_system", _Q + f"SELECT sys, 'p0' AS row_key, {_r('x0', 'x', 5)}, {_r('sqrt(n11 / (n00 * n11 - n01 * n01) * (l - b0 * x0 - b1 * x1) / (nobs - 2))', 'sigma', 5)} FROM x UNION ALL SELECT sys, 'p1', round(x1, 5), round(sqrt(n00 / (n00 * n11 - n01 * n01) * (l - b0 * x0 - b1 * x1) / (nobs - 2)), 5) FROM x")
def l13(spark, d):
    return rounded(systems.solve(base(spark, d)).x, 5)


@query("l14_solve_truncated", _Q + f", e AS (SELECT *, (n00 + n11) / 2 + sqrt((n00 - n11) * (n00 - n11) / 4 + n01 * n01) AS e FROM q), v AS (SELECT *, n01 / sqrt(n01 * n01 + (e - n00) * (e - n00)) AS v0, (e - n00) / sqrt(n01 * n01 + (e - n00) * (e - n00)) AS v1 FROM e) SELECT sys, 'p0' AS row_key, {_r('v0 * (v0 * b0 + v1 * b1) / e', 'x', 5)} FROM v UNION ALL SELECT sys, 'p1', round(v1 * (v0 * b0 + v1 * b1) / e, 5) FROM v")
def l14(spark, d):
    return rounded(systems.solve(base(spark, d), keep=1).x.select("sys", "row_key", "x"), 5)


def _b(spark):
    return spark.createDataFrame([("p0", "p0", 1.0), ("p0", "p1", 2.0), ("p1", "p1", 0.5)], "row_key string, col_key string, value double")


_M00, _M01, _M11 = "(n00 + 4 * n01 + 4 * n11)", "(0.5 * n01 + n11)", "(0.25 * n11)"


@query("l16_transform", _Q + f"SELECT sys, {_r('l', 'ltpl')}, {_r(_M00, 'n_p0_p0')}, {_r(_M01, 'n_p0_p1')}, {_r(_M11, 'n_p1_p1')}, {_r('b0 + 2 * b1', 'b_p0')}, {_r('0.5 * b1', 'b_p1')} FROM q")
def l16(spark, d):
    return wide(systems.transform(base(spark, d), _b(spark)), ["p0", "p1"])


@query("l17_transform_errors", _Q + f"SELECT sys, {_r(f'x0 * x0 * {_M00} + 2 * x0 * x1 * {_M01} + x1 * x1 * {_M11}', 'ltpl')}, {_r(_M00, 'n_p0_p0')}, {_r(_M01, 'n_p0_p1')}, {_r(_M11, 'n_p1_p1')}, {_r(f'{_M00} * x0 + {_M01} * x1', 'b_p0')}, {_r(f'{_M01} * x0 + {_M11} * x1', 'b_p1')} FROM x")
def l17(spark, d):
    return wide(systems.transform_errors(base(spark, d), _b(spark)), ["p0", "p1"])


_VCE = "(q.n00 * g.n11 - 2 * q.n01 * g.n01 + q.n11 * g.n00) / (g.n00 * g.n11 - g.n01 * g.n01)"
_G0, _G1 = "((g.n11 * g.b0 - g.n01 * g.b1) / (g.n00 * g.n11 - g.n01 * g.n01))", "((g.n00 * g.b1 - g.n01 * g.b0) / (g.n00 * g.n11 - g.n01 * g.n01))"


@query("l18_variance_components", _Q + f"SELECT q.sys, q.grp, {_r(_VCE, 'contribution', 6)}, {_r(f'(q.l - 2 * ({_G0} * q.b0 + {_G1} * q.b1) + {_G0} * {_G0} * q.n00 + 2 * {_G0} * {_G1} * q.n01 + {_G1} * {_G1} * q.n11) / (q.nobs - {_VCE})', 'vce', 4)} FROM q JOIN g ON g.grp = q.grp")
def l18(spark, d):
    s = about_own(base(spark, d))
    got = systems.variance_components(s, groups(s), s.stats.select("sys", F.lit(1.0).alias("cv")))
    return got.select("sys", "grp", F.round("contribution", 6).alias("contribution"), F.round("vce", 4).alias("vce"))


@query("l21_scale_systems", _Q + f"SELECT sys, {_r('l / 4', 'ltpl')}, {_r('n00 / 4', 'n_p0_p0')}, {_r('n01 / 4', 'n_p0_p1')}, {_r('n11 / 4', 'n_p1_p1')}, {_r('b0 / 4', 'b_p0')}, {_r('b1 / 4', 'b_p1')} FROM q")
def l21(spark, d):
    s = base(spark, d)
    return wide(systems.scaled(s, s.stats.select("sys", F.lit(4.0).alias("cv"))), ["p0", "p1"])
