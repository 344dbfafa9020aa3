"""Queries on calendar codes and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as K
from ..functions import statistics
from .registry import query, table

_DAY = "CAST(o_orderdate AS DATE)"
_DAYS = f"date_diff('day', DATE '1970-01-01', {_DAY})"


@query("t12_any_to_date", f"SELECT o_orderkey, strftime({_DAY}, '%d-%m-%Y') || ' 00:00:00' AS date, strftime({_DAY}, '%y:%j') || ':00000' AS sinex, lpad(CAST(CAST(floor(({_DAYS} - 3657) / 7.0) AS BIGINT) AS VARCHAR), 4, '0') AS week FROM orders")
def t12(spark, d):
    """Order days written in four codes, by key, and read back.  (A decimal year
    of nine digits is true to 0.02 s only, which may end the week before.)"""
    day = F.col("o_orderdate").cast("date")
    jd = F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(K.UNIX_JD)
    text = F.element_at(F.array(*(K.render(jd, c) for c in ("sinex", "date", "jd", "mjd"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return o.select("o_orderkey", *(K.convert(F.col("text"), c).alias(n) for n, c in (("date", "date"), ("sinex", "sinex"), ("week", "gps_week"))))


_C = K.MISSIONS["TOPEX"]


@query("t14_altimeter_cycle", f"SELECT o_orderkey, CASE WHEN jd BETWEEN {_C[1]!r} AND {_C[2]!r} THEN 'TOPEX ' || CAST(CAST(floor((jd - {_C[1]!r}) / {_C[0]!r}) AS BIGINT) + 1 AS VARCHAR) END AS cycle FROM (SELECT o_orderkey, {_DAYS} + 2440587.5::DOUBLE AS jd FROM orders)")
def t14(spark, d):
    jd = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) + F.lit(K.UNIX_JD)
    return table(spark, d, "orders").select("o_orderkey", K.render(jd, "cycle", "TOPEX").alias("cycle"))


@query("t6_student_p", "SELECT event_id, CAST(event_id % 3 AS INTEGER) AS kind, round(CASE event_id % 3 WHEN 0 THEN 1 - 2 / pi() * atan(t) WHEN 1 THEN 1 - t / sqrt(2 + t * t) ELSE 1 - sin(atan(t / 2)) * (1 + pow(cos(atan(t / 2)), 2) / 2) END, 9) AS p FROM (SELECT event_id, value / 10 AS t FROM events WHERE value >= 0)")
def t6(spark, d):
    kind = (F.col("event_id") % 3).cast("int")
    df = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), kind + 1)
    return table(spark, d, "events").where("value >= 0").select("event_id", kind.alias("kind"), F.round(statistics.student_p(F.col("value") / 10, df), 9).alias("p"))
