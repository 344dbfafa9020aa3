"""Spherical-harmonic coefficient files in seven layouts, with their terms in
time, what their headers say, and the epochs in product names.

A reader is one projection of a scan of lines.  Layouts: grace (GRCOF2 and
rates GRDOTA), gins (fixed columns), icgem (gfc, gfct, trnd, dot, asin, acos),
short (a META line, then numbers), calsdv (calibrated errors), linear (a key
and a value a line), generic (numbers only).

Defined results: lines that don't fit, and comments, are left out; missing
errors are null; coefficients above lmax are left out; a harmonic of another
period than a year counts as semiannual; a file of no known layout is generic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _e, _fields, _lines, _number, coefficients

LAYOUTS = ("grace", "gins", "icgem", "short", "calsdv", "linear", "generic")
TERMS = ("static", "trend", "annual_sin", "annual_cos", "semiannual_sin", "semiannual_cos")
_OUT = ("l", "m", "c", "s", "sigma_c", "sigma_s")


def _parts(fields: Column, first: int) -> list[Column]:
    """l, m and four numbers from this field (from 1) on."""
    at = lambda k: F.try_element_at(fields, F.lit(first + k))
    return [at(0).try_cast("int").alias("l"), at(1).try_cast("int").alias("m"), *(_number(at(k)).alias(n) for k, n in enumerate(_OUT[2:], 2))]


def read(spark: SparkSession, path: str | list[str], layout: str, lmax: int | None = None) -> DataFrame:
    """path, term (one of TERMS), l, m, c, s, sigma_c, sigma_s."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    if layout in ("short", "linear"):
        return coefficients(spark, path, layout, lmax).select("path", F.lit("static").alias("term"), *_OUT)
    lines, f = _lines(spark, path), _fields(F.col("line"))
    tag = F.try_element_at(f, F.lit(1))
    static = F.lit("static").alias("term")
    if layout == "grace":
        rows = lines.where(tag.isin("GRCOF2", "GRDOTA")).select("path", F.when(tag == "GRDOTA", "trend").otherwise("static").alias("term"), *_parts(f, 2))
    elif layout == "calsdv":
        rows = lines.where(tag == "CALSDV").select("path", static, *_parts(f, 2))
        # Its numbers are the errors.
        rows = rows.select("path", "term", "l", "m", F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("s"), F.col("c").alias("sigma_c"), F.col("s").alias("sigma_s"))
    elif layout == "gins":
        cut = lambda a, n: F.substring("line", a, n)
        number = lambda a, n, name: _number(F.trim(cut(a, n))).alias(name)
        rows = lines.where(cut(7, 3) == "   ").select("path", static, F.trim(cut(1, 3)).try_cast("int").alias("l"), F.trim(cut(4, 3)).try_cast("int").alias("m"), number(10, 21, "c"), number(31, 21, "s"), number(53, 13, "sigma_c"), number(66, 13, "sigma_s"))
    elif layout == "icgem":
        year = _number(F.try_element_at(f, F.lit(8))) == 1
        season = lambda kind: F.when(year, f"annual_{kind}").otherwise(f"semiannual_{kind}")
        term = F.when(tag.isin("gfc", "gfct"), "static").when(tag.isin("trnd", "dot"), "trend").when(tag == "asin", season("sin")).when(tag == "acos", season("cos"))
        rows = lines.withColumn("term", term).where("term is not null").select("path", "term", *_parts(f, 2))
        rows = rows.withColumns({k: F.when(F.col("term") == "static", F.col(k)) for k in ("sigma_c", "sigma_s")})
    else:
        rows = lines.where(tag.rlike("^[0-9]+$")).select("path", static, *_parts(f, 1))
    rows = rows.where("l is not null and m is not null and m <= l and (c is not null or sigma_c is not null)")
    rows = rows.withColumn("s", F.when(F.col("c").isNotNull(), F.coalesce("s", F.lit(0.0)))) if layout != "calsdv" else rows
    return rows if lmax is None else rows.where(F.col("l") <= lmax)


def at_time(rows: DataFrame, t: float, origin: float) -> DataFrame:
    """path, l, m, c, s of the static part with all its terms at a decimal year."""
    import math

    w = 2 * math.pi * (t - origin)
    by = {"static": 1.0, "trend": t - origin, "annual_sin": math.sin(w), "annual_cos": math.cos(w), "semiannual_sin": math.sin(2 * w), "semiannual_cos": math.cos(2 * w)}
    factor = F.coalesce(*(F.when(F.col("term") == k, F.lit(v)) for k, v in by.items()))
    return rows.groupBy("path", "l", "m").agg(F.sum(F.col("c") * factor).alias("c"), F.sum(F.col("s") * factor).alias("s"))


def describe(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, layout, lmax, gm, radius, start, centre, end (decimal years) of
    each file, in one pass; null where the header doesn't say."""
    first = F.col("_metadata.file_block_start") == 0
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"), first.alias("head"))
    f = _fields(F.col("line"))
    tag = F.try_element_at(f, F.lit(1))
    field = lambda k: _number(F.try_element_at(f, F.lit(k)))
    has = lambda pattern: F.col("line").rlike(pattern)
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    pick = lambda cond, value: F.max(F.when(cond, value))
    top = F.min(F.when(F.col("head"), F.struct("n", "line")))["line"]
    got = lines.groupBy("path").agg(
        top.alias("top"),
        any_(has("product_type")).alias("icgem"),
        any_(tag == "CALSDV").alias("calsdv"),
        any_(has("^.(CN|SN) ") | has("^G[CS]N")).alias("linear"),
        pick(tag == "META", F.struct(field(2).alias("lmax"), field(3).alias("start"), field(4).alias("centre"), field(5).alias("end"))).alias("meta"),
        pick(tag == "EARTH", F.struct(field(2).alias("gm"), field(3).alias("radius"))).alias("earth"),
        pick(tag == "SHM", field(2)).alias("shm"),
        pick(tag == "max_degree", field(2)).alias("degree"),
        pick(tag == "earth_gravity_constant", field(2)).alias("constant"),
        pick(tag == "radius", field(2)).alias("radius"),
        pick(tag == "modelname", F.try_element_at(f, F.lit(2))).alias("model"),
        F.max(F.when(tag.isin("GRCOF2", "gfc", "gfct", "CALSDV"), F.try_element_at(f, F.lit(2)).try_cast("int"))).alias("seen"),
    )
    layout = F.when(F.col("top").contains("FIRST"), "grace").when(F.substring("top", 1, 6).contains("FIELD"), "gins").when(F.col("top").contains("META"), "short").when(F.col("icgem"), "icgem").when(F.col("calsdv"), "calsdv").when(F.col("linear"), "linear").otherwise("generic")
    span = epoch(F.col("top"), "grace")
    dates = {k: F.coalesce(F.col(f"meta.{k}"), F.when(F.col("layout") == "grace", span[k])) for k in ("start", "centre", "end")}
    got = got.withColumn("layout", layout)
    return got.select("path", "layout", F.coalesce("meta.lmax", "shm", "degree", "seen").cast("int").alias("lmax"), F.coalesce("earth.gm", "constant").alias("gm"), F.coalesce("earth.radius", F.col("radius")).alias("radius"), *(v.alias(k) for k, v in dates.items()))


def _year(year: Column, day: Column) -> Column:
    """A decimal year of a day number; leap years by the Gregorian rule."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return year + day / F.when(leap, 366).otherwise(365)


def _middle(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), ((start + end) / 2).alias("centre"), end.alias("end"))


def epoch(name: Column, kind: str) -> Column:
    """start, centre, end (decimal years) that a product's name or first line
    tells: `grace`, ...-YYYYDDD-YYYYDDD...; `gins`, days since 1950 around the
    last underscore; `icgem`, YYYYMMDD - YYYYMMDD.  Null if it tells nothing."""
    if kind == "grace":
        part = lambda k: F.regexp_extract(name, r"(\d{4})(\d{3})-(\d{4})(\d{3})", k).try_cast("int")
        return _middle(_year(part(1), part(2)), _year(part(3), part(4)))
    if kind == "gins":
        day = lambda k: F.date_add(F.lit("1950-01-01").cast("date"), F.regexp_extract(name, r"(\d{5})_(\d{5})(?!.*_)", k).try_cast("int"))
        point = lambda d: _year(F.year(d), F.dayofyear(d) - 1)
        return _middle(point(day(1)), point(day(2)))
    if kind == "icgem":
        date = lambda k: F.try_to_date(F.regexp_extract(name, r"(\d{8}) ?- ?(\d{8})", k), "yyyyMMdd")
        point = lambda d: _year(F.year(d), F.dayofyear(d) - 1)
        return _middle(point(date(1)), point(date(2)))
    raise ValueError(f"no epochs in names of kind {kind}")


def write(coeffs: DataFrame, path: str, layout: str) -> None:
    """l, m, c, s[, sigma_c, sigma_s] as icgem or grace lines or as plain
    numbers (generic), order by order."""
    tags = {"icgem": "gfc ", "grace": "GRCOF2 ", "generic": ""}
    if layout not in tags:
        raise ValueError(f"{layout} is not written here")
    errors = ["sigma_c", "sigma_s"] if {"sigma_c", "sigma_s"} <= set(coeffs.columns) else []
    rows = coeffs.select("m", "l", F.concat(F.lit(tags[layout]), F.concat_ws(" ", F.format_string("%5d%5d", "l", "m"), *(_e(F.col(c)) for c in ("c", "s", *errors)))).alias("value"))
    rows.orderBy("m", "l").select("value").write.text(path)
