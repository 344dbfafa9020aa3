"""Readers and writers of the text formats that analysts of gravity fields,
Earth models and tide gauges exchange.

Every reader is a projection over `spark.read.text`: files are read in
parallel, columns that aren't asked for are not parsed, and `path` holds the
file that a row came from.  Lines that don't fit a format are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("path"))


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, "\\s+", " ")), " ")


def _number(text: Column) -> Column:
    """A double; Fortran's D exponents count, other words are null."""
    return F.translate(text, "Dd", "EE").try_cast("double")


def keyed_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, row_key (the first 24 signs, blanks at the end cut), col_no from 0,
    value: a row for each number behind the key."""
    got = _lines(spark, path).where(F.length("line") > 24)
    got = got.select("path", F.rtrim(F.substring("line", 1, 24)).alias("row_key"), F.posexplode(_fields(F.expr("substring(line, 25)"))).alias("col_no", "text"))
    return got.select("path", "row_key", "col_no", _number(F.col("text")).alias("value"))


def love_numbers(spark: SparkSession, path: str | list[str], frame: str = "CF") -> DataFrame:
    """path, n, h, l, k of tables with the columns n, h, l, k and, at degree 1,
    a frame's code, of which the asked one's row stays; words such as INF are null."""
    if frame not in ("CE", "CM", "CF", "CL", "CH"):
        raise ValueError(f"unknown frame {frame}")
    got = _lines(spark, path).where(~F.ltrim("line").startswith("#")).withColumn("f", _fields(F.col("line")))
    n = F.try_element_at("f", F.lit(1)).try_cast("int")
    part = lambda k: F.nullif(F.abs(_number(F.try_element_at("f", F.lit(k)))), F.lit(float("inf"))) * F.signum(_number(F.try_element_at("f", F.lit(k))))
    rows = got.select("path", n.alias("n"), part(2).alias("h"), part(3).alias("l"), part(4).alias("k"), F.try_element_at("f", F.lit(5)).alias("frame"))
    return rows.where(F.col("n").isNotNull() & ((F.col("n") != 1) | F.col("frame").isNull() | (F.col("frame") == frame))).drop("frame")


def number_columns(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """path and the columns `names` of a table of numbers parted by blanks (a
    series `year c20 sigma`, say); lines that begin with no number are left out."""
    got = _lines(spark, path).withColumn("f", _fields(F.col("line")))
    rows = got.select("path", *[_number(F.try_element_at("f", F.lit(k + 1))).alias(n) for k, n in enumerate(names)])
    return rows.where(F.col(names[0]).isNotNull())


def _sid(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def tide_monthly(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """sid (the file's name), time, mm (null where -99999), missing_days, flag."""
    at = lambda a, n: F.trim(F.substring("line", a, n))
    rows = _lines(spark, path).select(_sid(F.col("path")).alias("sid"), at(2, 10).try_cast("double").alias("time"), F.nullif(at(13, 6).try_cast("int"), F.lit(-99999)).alias("mm"), at(20, 2).try_cast("int").alias("missing_days"), at(23, 3).alias("flag"))
    return rows.where("time is not null")


def tide_yearly(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """sid, time (the middle of the year), mm, incomplete (Y or N), flag."""
    at = lambda a, n: F.trim(F.substring("line", a, n))
    rows = _lines(spark, path).select(_sid(F.col("path")).alias("sid"), (at(2, 4).try_cast("double") + 0.5).alias("time"), F.nullif(at(7, 6).try_cast("int"), F.lit(-99999)).alias("mm"), at(14, 1).alias("incomplete"), at(16, 3).alias("flag"))
    return rows.where("time is not null")


def tide_catalogue(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """sid, lat, lon, name, coast, station, flag, t0, tn of the station list."""
    spans = {"sid": (1, 5), "lat": (8, 10), "lon": (20, 11), "name": (33, 40), "coast": (75, 3), "station": (80, 3), "flag": (85, 1), "t0": (88, 9), "tn": (99, 9)}
    cols = [F.trim(F.substring("line", a, n)) for a, n in spans.values()]
    rows = _lines(spark, path).select(*[(c.try_cast("double") if k in ("lat", "lon", "t0", "tn") else c).alias(k) for k, c in zip(spans, cols, strict=True)])
    return rows.where("lat is not null and lon is not null")


def earth_orientation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """mjd, x, y (arc seconds), ut1, lod (seconds) of daily series in columns of
    fixed width: date, modified Julian day, pole, time differences."""
    at = lambda a, n: F.trim(F.substring("line", a, n)).try_cast("double")
    rows = _lines(spark, path).select(at(13, 7).alias("mjd"), at(20, 11).alias("x"), at(31, 11).alias("y"), at(42, 12).alias("ut1"), at(54, 12).alias("lod"))
    return rows.where("mjd is not null and x is not null and y is not null")


def write_earth_orientation(rows: DataFrame, path: str) -> None:
    """mjd (whole days), x, y, ut1, lod as such lines, in order of days."""
    day = F.date_add(F.lit("1858-11-17").cast("date"), F.col("mjd").cast("int"))
    line = F.format_string("%4d%4d%4d%7d%11.6f%11.6f%12.7f%12.7f", F.year(day), F.month(day), F.dayofmonth(day), F.col("mjd").cast("int"), "x", "y", "ut1", "lod")
    rows.select("mjd", line.alias("value")).orderBy("mjd").select("value").write.text(path)


def coefficients(spark: SparkSession, path: str | list[str], layout: str, lmax: int | None = None) -> DataFrame:
    """path, l, m, c, s, sigma_c, sigma_s of spherical-harmonic coefficients.

    layout: `short` (a META line, then l m c s and perhaps two errors), `linear`
    (GCN or GSN, three signs each for l and m, value, perhaps an error) or
    `icgem` (gfc l m c s and perhaps two errors)."""
    lines = _lines(spark, path)
    if layout == "linear":
        tag, rest = F.upper(F.substring("line", 1, 3)), _fields(F.expr("substring(line, 11)"))
        rows = lines.where(tag.isin("GCN", "GSN")).select(
            "path", tag.alias("tag"), F.trim(F.substring("line", 5, 3)).try_cast("int").alias("l"), F.trim(F.substring("line", 8, 3)).try_cast("int").alias("m"),
            _number(F.try_element_at(rest, F.lit(1))).alias("v"), _number(F.try_element_at(rest, F.lit(2))).alias("e"),
        )
        of = lambda t, c: F.max(F.when(F.col("tag") == t, F.col(c)))
        got = rows.groupBy("path", "l", "m").agg(of("GCN", "v").alias("c"), F.coalesce(of("GSN", "v"), F.lit(0.0)).alias("s"), of("GCN", "e").alias("sigma_c"), of("GSN", "e").alias("sigma_s"))
    elif layout in ("short", "icgem"):
        f, skip = _fields(F.col("line")), 2 if layout == "icgem" else 1
        head = F.lower(F.try_element_at(f, F.lit(1))) == "gfc" if layout == "icgem" else F.ltrim("line").rlike("^[0-9]")
        part = lambda k: F.try_element_at(f, F.lit(skip + k))
        got = lines.where(head).select("path", part(0).try_cast("int").alias("l"), part(1).try_cast("int").alias("m"), *[_number(part(k)).alias(n) for k, n in ((2, "c"), (3, "s"), (4, "sigma_c"), (5, "sigma_s"))])
    else:
        raise ValueError(f"unknown layout {layout}")
    got = got.where("l is not null and m is not null and c is not null")
    return got if lmax is None else got.where(F.col("l") <= lmax)


def _e(c: Column) -> Column:
    return F.format_string("%21.14e", c)


def write_coefficients(coeffs: DataFrame, path: str, layout: str = "linear") -> None:
    """Write l, m, c, s (and sigma_c, sigma_s if both are columns) as text,
    order by order, in the layouts `short` and `linear` of `coefficients`."""
    errors = {"sigma_c", "sigma_s"} <= set(coeffs.columns)
    if layout == "short":
        cols = [_e(F.col(k)) for k in ("c", "s", *(("sigma_c", "sigma_s") if errors else ()))]
        rows = coeffs.select("m", "l", F.lit(0).alias("k"), F.concat_ws(" ", F.format_string("%5d%5d", "l", "m"), *cols).alias("value"))
    elif layout == "linear":
        row = lambda tag, v, e: F.concat(F.lit(tag + " "), F.format_string("%3d%3d", "l", "m"), F.lit(" " * 14), _e(F.col(v)), *([F.lit(" "), _e(F.col(e))] if errors else []))
        both = F.explode(F.when(F.col("m") > 0, F.array(F.struct(F.lit(0).alias("k"), row("GCN", "c", "sigma_c").alias("value")), F.struct(F.lit(1).alias("k"), row("GSN", "s", "sigma_s").alias("value")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), row("GCN", "c", "sigma_c").alias("value"))))).alias("x")
        rows = coeffs.select("m", "l", both).select("m", "l", "x.k", "x.value")
    else:
        raise ValueError(f"unknown layout {layout}")
    if layout == "short":
        top = coeffs.agg(F.coalesce(F.max("l"), F.lit(0)).alias("lmax")).select(F.lit(-1).alias("m"), F.lit(-1).alias("l"), F.lit(0).alias("k"), F.format_string("META %5d %s", "lmax", F.lit("0.000000 0.000000 0.000000")).alias("value"))
        rows = top.unionByName(rows)
    rows.orderBy("m", "l", "k").select("value").write.text(path)
