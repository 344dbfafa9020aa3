"""SINEX files: sectioned text of station solutions and their matrices.

Files are read in splits, whatever their size: a line's place is its split's
start and its number in the split, the few lines that open or close a section
are gathered first, and every other line looks its section up among them.
(Both scans are of one plan and so see the same splits.)  Everything else is
cutting columns of fixed width; sections that nothing asks for aren't parsed.

Defined results: comment lines (*) and lines outside sections are left out;
blank or unreadable numbers are null; an unknown section is no error; a file
without sections has no rows; a folder counts as one file, its parts in order
of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import glob_pattern

ESTIMATE, VECTOR, APRIORI, STATISTICS, SITES = "SOLUTION/ESTIMATE", "SOLUTION/NORMAL_EQUATION_VECTOR", "SOLUTION/APRIORI", "SOLUTION/STATISTICS", "SITE/ID"
MATRICES = "SOLUTION/(MATRIX_ESTIMATE|MATRIX_APRIORI|NORMAL_EQUATION_MATRIX) +([LU])( +(CORR|COVA|INFO))?"
#: Columns of a matrix line's three values.
VALUE_COLUMNS = (14, 36, 58)


def _cut(first: int, last: int) -> Column:
    return F.substring("line", first, last - first + 1)


def _text(first: int, last: int) -> Column:
    return F.trim(_cut(first, last))


def _number(c: Column) -> Column:
    return F.translate(F.trim(c), "Dd", "EE").try_cast("double")


def _int(first: int, last: int) -> Column:
    return _text(first, last).try_cast("int")


def _placed(spark: SparkSession, path: str | list[str], folders: bool) -> DataFrame:
    raw = spark.read.text(path)
    file = F.col("_metadata.file_path")
    owner = F.regexp_extract(file, "^(.*)/[^/]*$", 1) if folders else file
    place = F.struct(file.alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"))
    return raw.select(owner.alias("file"), place.alias("place"), F.rtrim("value").alias("line"))


def lines(spark: SparkSession, path: str | list[str], folders: bool = False) -> DataFrame:
    """file, place (rises along a file), section, line of all lines inside
    sections.  folders: the files of a folder are parts of one."""
    placed = _placed(spark, path, folders)
    edges = placed.where(F.col("line").startswith("+") | F.col("line").startswith("-"))
    # Tens of lines a file.
    edges = edges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("line").startswith("+"), F.trim(F.expr("substring(line, 2)"))).alias("name")))).alias("edges"))
    inside = placed.where(F.col("line").startswith(" ")).join(edges, "file")
    before = F.filter("edges", lambda e: e["place"] < F.col("place"))
    return inside.withColumn("section", F.try_element_at(before, F.lit(-1))["name"]).where("section is not null").select("file", "place", "section", "line")


def header(spark: SparkSession, path: str | list[str], folders: bool = False) -> DataFrame:
    """file, version, created, start, end, parameters, constraint, content."""
    first = _placed(spark, path, folders).where(F.col("line").startswith("%=SNX"))
    return first.select("file", _text(7, 10).alias("version"), _text(16, 27).alias("created"), _text(33, 44).alias("start"), _text(46, 57).alias("end"), _int(61, 65).alias("parameters"), _text(67, 67).alias("constraint"), _text(69, 80).alias("content"))


def block(found: DataFrame, name: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """file, place, line of a section, in the globs' terms (* and |): lines
    that `include` matches and `exclude` doesn't."""
    rows = found.where(F.col("section") == name).select("file", "place", "line")
    if include is not None:
        rows = rows.where(F.col("line").rlike(glob_pattern(include)))
    return rows if exclude is None else rows.where(~F.col("line").rlike(glob_pattern(exclude)))


def _angle(first: int) -> Column:
    """Degrees of a sign, degrees, minutes and seconds; -0 degrees counts as negative."""
    text = _text(first, first + 2)
    size = F.abs(text.try_cast("double")) + F.coalesce(_number(_cut(first + 4, first + 5)), F.lit(0.0)) / 60 + F.coalesce(_number(_cut(first + 7, first + 10)), F.lit(0.0)) / 3600
    return F.when(text.startswith("-"), -size).otherwise(size)


def sites(found: DataFrame) -> DataFrame:
    """file, site, point, domes, description, lon, lat, height."""
    rows = found.where(F.col("section") == SITES)
    return rows.select("file", _text(2, 5).alias("site"), _text(7, 8).alias("point"), _text(10, 18).alias("domes"), _text(22, 43).alias("description"), _angle(45).alias("lon"), _angle(57).alias("lat"), _number(_cut(69, 75)).alias("height"))


def _parameters(found: DataFrame, section: str) -> DataFrame:
    rows = found.where((F.col("section") == section) & _int(2, 6).isNotNull())
    return rows.select("file", _int(2, 6).alias("ix"), F.rpad(_cut(8, 26), 19, " ").alias("key"), _text(8, 13).alias("type"), _text(15, 18).alias("site"), _text(20, 21).alias("point"), _text(23, 26).alias("solution"), _text(28, 39).alias("epoch"), _text(41, 44).alias("unit"), _text(46, 46).alias("constraint"), _number(_cut(48, 68)).alias("value"), _number(_cut(70, 80)).alias("sigma"))


def estimates(found: DataFrame, section: str = ESTIMATE, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """file, ix, key (type, site, point and solution as in the file), these,
    epoch, unit, constraint, value, sigma; sections of right sides and a-priori
    values too.  include, exclude: globs over the keys."""
    return _matching(_parameters(found, section), "key", include, exclude)


def _matching(rows: DataFrame, key: str, include: str | None, exclude: str | None) -> DataFrame:
    if include is not None:
        rows = rows.where(F.col(key).rlike(glob_pattern(include)))
    return rows if exclude is None else rows.where(~F.col(key).rlike(glob_pattern(exclude)))


def statistics(found: DataFrame) -> DataFrame:
    """file, name, value."""
    return found.where(F.col("section") == STATISTICS).select("file", _text(2, 31).alias("name"), _number(F.expr("substring(line, 32)")).alias("value"))


def matrices(found: DataFrame) -> DataFrame:
    """file, matrix, triangle (L, U), content (CORR, COVA, INFO or empty),
    row_ix, col_ix, value: the stored triangle, a row for each value."""
    rows = found.where(F.col("section").rlike("^" + MATRICES))
    cell = F.posexplode(F.array(*(_cut(c, c + 20) for c in VALUE_COLUMNS))).alias("off", "text")
    rows = rows.select("file", F.regexp_extract("section", MATRICES, 1).alias("matrix"), F.regexp_extract("section", MATRICES, 2).alias("triangle"), F.regexp_extract("section", MATRICES, 4).alias("content"), _int(2, 6).alias("row_ix"), _int(8, 12).alias("first"), cell)
    return rows.where("text <> '' and trim(text) <> ''").select("file", "matrix", "triangle", "content", "row_ix", (F.col("first") + F.col("off")).alias("col_ix"), _number(F.col("text")).alias("value"))


def keyed_matrix(found: DataFrame, matrix: str = "MATRIX_ESTIMATE", rows: tuple[str | None, str | None] = (None, None), cols: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """file, row_key, col_key, value of the full symmetric matrix, for keys that
    match (include, exclude) on each axis."""
    keys = _parameters(found, ESTIMATE).select("file", "ix", "key")
    stored = matrices(found).where(F.col("matrix") == matrix).select("file", "row_ix", "col_ix", "value")
    both = stored.unionByName(stored.where("row_ix <> col_ix").select("file", F.col("col_ix").alias("row_ix"), F.col("row_ix").alias("col_ix"), "value"))
    left = _matching(keys.select("file", F.col("ix").alias("row_ix"), F.col("key").alias("row_key")), "row_key", *rows)
    right = _matching(keys.select("file", F.col("ix").alias("col_ix"), F.col("key").alias("col_key")), "col_key", *cols)
    return both.join(left, ["file", "row_ix"]).join(right, ["file", "col_ix"]).select("file", "row_key", "col_key", "value")


def estimate_lines(rows: DataFrame, sigma: bool = True) -> DataFrame:
    """ix, line of (ix, type, site, point, solution, epoch, unit, constraint, value[, sigma])."""
    form, cols = " %5d %-6s %4s %2s %4s %12s %-4s %1s %21.14E", ["ix", "type", "site", "point", "solution", "epoch", "unit", "constraint", "value"]
    return rows.select("ix", F.format_string(form + (" %11.5E" if sigma else ""), *cols, *(["sigma"] if sigma else [])).alias("line"))


def matrix_lines(cells: DataFrame) -> DataFrame:
    """ix, sub, line: a lower triangle (row_ix, col_ix from 1, value), three
    neighbours a line; missing cells are zeros."""
    low = cells.where("row_ix >= col_ix").withColumn("sub", F.floor((F.col("col_ix") - 1) / 3).cast("int"))
    value = lambda k: F.coalesce(F.sum(F.when((F.col("col_ix") - 1) % 3 == k, F.col("value"))), F.lit(0.0))
    packed = low.groupBy(F.col("row_ix").alias("ix"), "sub").agg(*(value(k).alias(f"v{k}") for k in range(3)))
    first = F.col("sub") * 3 + 1
    text = lambda k: F.when(first + k <= F.col("ix"), F.format_string(" %21.14E", f"v{k}")).otherwise("")
    return packed.select("ix", "sub", F.concat(F.format_string(" %5d %5d", "ix", first), *(text(k) for k in range(3))).alias("line"))


def site_lines(rows: DataFrame) -> DataFrame:
    """ix, line of (ix, site, point, domes, description, lon, lat, height), degrees."""

    def angle(c: str) -> Column:
        tenths = F.round(F.abs(F.col(c)) * 36000).cast("long")
        sign = F.when(F.col(c) < 0, "-").otherwise("")
        return F.concat(F.lpad(F.concat(sign, F.floor(tenths / 36000).cast("string")), 3, " "), F.format_string(" %2d %4.1f", F.floor(tenths / 600) % 60, (tenths % 600) / 10))

    return rows.select("ix", F.concat(F.format_string(" %4s %2s %9s P %-22s ", "site", "point", "domes", "description"), angle("lon"), F.lit(" "), angle("lat"), F.format_string(" %7.1f", "height")).alias("line"))


def statistics_lines(rows: DataFrame) -> DataFrame:
    """ix, line of (ix, name, value)."""
    return rows.select("ix", F.format_string(" %-30s %22.15E", "name", "value").alias("line"))


def write(spark: SparkSession, path: str, head: dict, sections: list[tuple[str, DataFrame]], single: bool = True) -> None:
    """A SINEX file (single) or a folder of parts that follow each other.

    head: created, start, end, parameters, constraint, content.  sections:
    names and lines (ix[, sub], line), sorted in ranges by ix and sub.  A single
    file is one task's stream of sorted lines; parts are written by many."""
    first = f"%=SNX 2.02 KFD {head.get('created', ''):12s} KFD {head.get('start', ''):12s} {head.get('end', ''):12s} P {head['parameters']:5d} {head.get('constraint', '2'):1s} {head.get('content', 'S')}"
    frame = [(0, 0, 0, 0, first)]
    out = None
    for k, (name, rows) in enumerate(sections, 1):
        frame += [(k, 0, 0, 0, "*" + "-" * 40), (k, 1, 0, 0, f"+{name}"), (k, 3, 0, 0, f"-{name}")]
        sub = F.col("sub") if "sub" in rows.columns else F.lit(0)
        part = rows.select(F.lit(k).alias("section"), F.lit(2).alias("step"), F.col("ix").cast("int").alias("ix"), sub.cast("int").alias("sub"), "line")
        out = part if out is None else out.unionByName(part)
    frame.append((len(sections) + 1, 0, 0, 0, "%ENDSNX"))
    edge = spark.createDataFrame(frame, "section int, step int, ix int, sub int, line string")
    order = ["section", "step", "ix", "sub"]
    whole = edge if out is None else edge.unionByName(out)
    dealt = whole.repartition(1) if single else whole.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
