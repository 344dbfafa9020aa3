"""Time series (key, t, y): fits, interpolation, correlation in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import normals, systems


def fit_trend(df: DataFrame, by: str, t: str, y: str) -> DataFrame:
    """by, n, t_ref (middle of the time span), mean (at t_ref), trend, rms_post.

    Centred moments in two passes: sums of large times lose no digits."""
    rows = df.where(F.col(t).isNotNull() & F.col(y).isNotNull())
    m = rows.groupBy(by).agg(((F.min(t) + F.max(t)) / 2).alias("t_ref"), F.avg(t).alias("tm"), F.avg(y).alias("ym"))
    dt, dy = F.col(t) - F.col("tm"), F.col(y) - F.col("ym")
    s = rows.join(m, by).groupBy(by, "t_ref", "tm", "ym").agg(F.count("*").alias("n"), F.sum(dt * dt).alias("stt"), F.sum(dt * dy).alias("sty"), F.sum(dy * dy).alias("syy"))
    b = F.try_divide("sty", "stt")
    return s.select(by, "n", "t_ref", (F.col("ym") + b * (F.col("t_ref") - F.col("tm"))).alias("mean"), b.alias("trend"), F.sqrt(F.greatest(F.col("syy") - b * F.col("sty"), F.lit(0.0)) / F.col("n")).alias("rms_post"))


def fit_terms(df: DataFrame, by: str, t: str, y: str, t_ref: float, periods: list[float], degree: int = 1, weight: str | None = None) -> DataFrame:
    """Least squares of a polynomial and harmonics: sys, name, x, sigma, ..."""
    d = F.col(t) - F.lit(t_ref)
    terms: dict[str, Column] = {f"p{k}": F.pow(d, F.lit(k)) for k in range(degree + 1)}
    for k, p in enumerate(periods):
        terms[f"c{k}"], terms[f"s{k}"] = F.cos(d * (2 * 3.141592653589793 / p)), F.sin(d * (2 * 3.141592653589793 / p))
    return normals.solve(normals.build(df, terms, y, by, weight), list(terms))


def amplitude_phase(solved: DataFrame, k: int = 0) -> DataFrame:
    """Amplitude and phase of harmonic k of a solved fit."""
    c, s = (F.max(F.when(F.col("name") == f"{n}{k}", F.col("x"))) for n in "cs")
    return solved.groupBy("sys").agg(c.alias("c"), s.alias("s")).select("sys", F.hypot("c", "s").alias("amplitude"), F.atan2("s", "c").alias("phase"))


def amplitude_errors(df: DataFrame, by: str, t: str, y: str, t_ref: float, period: float, terms: dict[str, Column] | None = None) -> DataFrame:
    """sys, amplitude, phase (as a time: when the harmonic peaks after t_ref),
    and the standard errors of both, for a harmonic fitted beside `terms`.

    With c and s the coefficients and C their covariance, the amplitude's
    variance is (c, s) C (c, s)' / A^2, the phase's (-s, c) C (-s, c)' / A^4."""
    omega = 2 * 3.141592653589793 / period
    d = F.col(t) - F.lit(t_ref)
    every = {**(terms or {}), "zc": F.cos(omega * d), "zs": F.sin(omega * d)}
    got = systems.solve(systems.from_moments(normals.build(df, every, y, by), list(every)))
    x = got.x.groupBy("sys").agg(*(F.max(F.when(F.col("row_key") == k, F.col("x"))).alias(k) for k in ("zc", "zs")))
    pair = lambda a, b: F.max(F.when((F.col("row_key") == a) & (F.col("col_key") == b), F.col("value")))
    q = got.covariance.groupBy("sys").agg(pair("zc", "zc").alias("qcc"), pair("zc", "zs").alias("qcs"), pair("zs", "zs").alias("qss"))
    rows = x.join(q, "sys").join(got.stats.select("sys", "sigma0"), "sys")
    c, s, a = F.col("zc"), F.col("zs"), F.hypot("zc", "zs")
    error = lambda u, v: F.sqrt(u * u * F.col("qcc") + 2 * u * v * F.col("qcs") + v * v * F.col("qss")) * F.col("sigma0")
    return rows.select("sys", a.alias("amplitude"), (F.atan2(s, c) / omega).alias("phase"), F.try_divide(error(c, s), a).alias("amplitude_error"), (F.try_divide(error(-s, c), a * a) / omega).alias("phase_error"))


def climatology(df: DataFrame, by: str, month: Column, y: str, terms: dict[str, Column] | None = None) -> systems.Solution:
    """Twelve monthly means (m01 to m12) fitted beside other terms, which may
    hold a mean: then the months alone can't be told from it, and a block of
    ones, as heavy as the normals' mean diagonal, holds their sum at zero.
    A month without rows keeps its unknown out of the system."""
    names = [f"m{k:02d}" for k in range(1, 13)]
    every = {**(terms or {}), **{n: F.when(month == k, 1.0).otherwise(0.0) for k, n in enumerate(names, 1)}}
    s = systems.from_moments(normals.build(df, every, y, by), list(every))
    seen = s.cells.where("row_key = col_key and value > 0").select("sys", "row_key")
    live = systems.Systems(s.cells.join(seen, ["sys", "row_key"], "left_semi").join(seen.withColumnRenamed("row_key", "col_key"), ["sys", "col_key"], "left_semi").select("sys", "row_key", "col_key", "value"), s.rhs.join(seen, ["sys", "row_key"], "left_semi"), s.stats)
    return systems.solve(systems.hold_sum(live, "^m[0-9]{2}$"))


def residuals(df: DataFrame, by: str, y: str, terms: dict[str, Column], solved: DataFrame) -> DataFrame:
    """df with `fit` and `residual` of a solved fit (sys, name, x) of these
    terms, and a column of what each term gives, `fit_<name>`; rows of systems
    without a solution have nulls."""
    wide = solved.groupBy(F.col("sys").alias("fit_sys")).agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(f"x_{n}") for n in terms))
    joined = df.join(wide, F.col(by) == F.col("fit_sys"), "left")
    parts = {n: c * F.col(f"x_{n}") for n, c in terms.items()}
    total = sum(parts.values(), F.lit(0.0))
    return joined.select(*df.columns, total.alias("fit"), (F.col(y) - total).alias("residual"), *(v.alias(f"fit_{n}") for n, v in parts.items()))


def autocovariance(df: DataFrame, by: str, order: str, y: str, lags: int) -> DataFrame:
    """by, lag, value: sum of products of deviations over n - 1."""
    m = df.withColumn("d", F.col(y) - F.avg(y).over(Window.partitionBy(by)))
    w = Window.partitionBy(by).orderBy(order)
    lagged = m.select(by, "d", *(F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)), F.count("*").over(Window.partitionBy(by)).alias("n"))
    arr = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("d") * (F.col(f"l{k}") if k else F.col("d"))).alias("p")) for k in range(lags + 1)])
    return lagged.select(by, "n", F.inline(arr)).groupBy(by, "lag").agg(F.try_divide(F.sum("p"), F.max("n") - 1).alias("value"))


def interpolate(points: DataFrame, series: DataFrame, by: str, t: str, y: str) -> DataFrame:
    """As-of from both sides: y of `series` at the times of `points`, linear
    between neighbours, null outside the series.  One sort for each key: both
    tables go into one window, so no pair of rows is ever formed."""
    both = points.select(by, F.col(t).alias("t"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("ask"))
    both = both.unionByName(series.select(by, F.col(t).alias("t"), F.col(y).alias("y"), F.lit(0).alias("ask")))
    known = F.when(F.col("ask") == 0, F.struct("t", "y"))
    back = Window.partitionBy(by).orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("t", F.desc("ask")).rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumns({"a": F.last(known, ignorenulls=True).over(back), "b": F.first(known, ignorenulls=True).over(ahead)}).where("ask = 1")
    step = F.col("b.t") - F.col("a.t")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("a.t"), step), F.lit(0.0))
    return rows.select(by, "t", (F.col("a.y") + share * (F.col("b.y") - F.col("a.y"))).alias("y"))


def interpolate_steps(points: DataFrame, known: DataFrame, t: str, values: list[str], step: float) -> DataFrame:
    """points with `values` of an evenly spaced series (t, values), linear
    between its steps; null outside, and beside a step that isn't there.  A
    join on the step, so that one series for all points needs no order of them."""
    place = F.floor(F.col(t) / step + 1e-9)
    at = known.select(F.round(F.col(t) / step).cast("long").alias("step_at"), F.struct(*values).alias("low"))
    after = at.select((F.col("step_at") - 1).alias("step_before"), F.col("low").alias("high"))
    got = points.join(at, place == F.col("step_at"), "left").join(after, place == F.col("step_before"), "left")
    share = F.col(t) / step - place
    value = lambda c: F.when(share < 1e-9, F.col(f"low.{c}")).otherwise(F.col(f"low.{c}") + share * (F.col(f"high.{c}") - F.col(f"low.{c}"))).alias(c)
    return got.select(*points.columns, *(value(c) for c in values))
