"""Queries on keyed matrices, with cells summed from lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keyed, normals, systems
from .registry import query, table

SIDE = 8
_A = f"a AS (SELECT l_suppkey % {SIDE} AS row_key, l_partkey % {SIDE} AS col_key, sum(l_quantity) / 1000 AS value FROM lineitem GROUP BY 1, 2)"
_B = f"b AS (SELECT l_partkey % {SIDE} AS row_key, CAST(l_linenumber AS BIGINT) AS col_key, sum(l_tax) AS value FROM lineitem GROUP BY 1, 2)"
_S = "s AS (SELECT l.col_key AS row_key, r.col_key AS col_key, sum(l.value * r.value) AS value FROM a l JOIN a r ON l.row_key = r.row_key GROUP BY 1, 2)"
_WITH = f"WITH {_A}, {_B}, {_S} "
_OUT = "row_key, col_key, round(value, 6) AS value"


def cells_a(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % SIDE).alias("row_key"), (F.col("l_partkey") % SIDE).alias("col_key")).agg((F.sum("l_quantity") / 1000).alias("value"))


def cells_b(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % SIDE).alias("row_key"), F.col("l_linenumber").cast("long").alias("col_key")).agg(F.sum("l_tax").alias("value"))


def cells_s(spark, d) -> DataFrame:
    """A symmetric positive matrix, A' A, in full."""
    return keyed.mirror(keyed.gram(cells_a(spark, d)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("a1_matmul", _WITH + "SELECT a.row_key, b.col_key, round(sum(a.value * b.value), 6) AS value FROM a JOIN b ON a.col_key = b.row_key GROUP BY 1, 2")
def a1(spark, d):
    return rounded(keyed.matmul(cells_a(spark, d), cells_b(spark, d)))


@query("a2_matvec", _WITH + "SELECT a.row_key, round(sum(a.value * b.value), 6) AS value FROM a JOIN b ON a.col_key = b.row_key WHERE b.col_key = 1 GROUP BY 1")
def a2(spark, d):
    return rounded(keyed.matvec(cells_a(spark, d), cells_b(spark, d).where("col_key = 1").select("row_key", "value")))


@query("a3_weighted_add", _WITH + "SELECT row_key, col_key, round(sum(value), 6) AS value FROM (SELECT row_key, col_key, 2 * value AS value FROM a UNION ALL SELECT row_key, col_key, -0.5 * value FROM b) GROUP BY 1, 2")
def a3(spark, d):
    return rounded(keyed.add(cells_a(spark, d), cells_b(spark, d), 2.0, -0.5))


@query("a4_propagate", _WITH + "SELECT x.col_key AS row_key, y.col_key, round(sum(x.value * s.value * y.value), 4) AS value FROM b x JOIN s ON x.row_key = s.row_key JOIN b y ON s.col_key = y.row_key GROUP BY 1, 2")
def a4(spark, d):
    return rounded(keyed.propagate(cells_s(spark, d), cells_b(spark, d)), 4)


_E = "e AS (SELECT vec_id AS row_key, unnest(range(len(embedding))) AS col_key, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def embedding_cells(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_key"), F.posexplode("embedding").alias("col_key", "v")).select("row_key", F.col("col_key").cast("long").alias("col_key"), F.col("v").cast("double").alias("value"))


@query("a5_gram", f"WITH {_E} SELECT l.col_key AS row_key, r.col_key, round(sum(l.value * r.value), 6) AS value FROM e l JOIN e r ON l.row_key = r.row_key AND l.col_key <= r.col_key GROUP BY 1, 2")
def a5(spark, d):
    return rounded(keyed.gram(embedding_cells(spark, d)))


@query("a6_patch", _WITH + "SELECT 'a' || row_key AS row_key, col_key, round(value, 6) AS value FROM a UNION ALL SELECT 'b' || row_key, col_key, round(value, 6) FROM b")
def a6(spark, d):
    tag = lambda df, t: df.withColumn("row_key", F.concat(F.lit(t), F.col("row_key")))
    return rounded(tag(cells_a(spark, d), "a").unionByName(tag(cells_b(spark, d), "b")))


@query("a7_correlation", _WITH + "SELECT s.row_key, s.col_key, round(CASE WHEN s.row_key = s.col_key THEN 1 ELSE s.value / (sqrt(i.value) * sqrt(j.value)) END, 6) AS value FROM s JOIN s i ON i.row_key = s.row_key AND i.col_key = s.row_key JOIN s j ON j.row_key = s.col_key AND j.col_key = s.col_key")
def a7(spark, d):
    return rounded(keyed.correlation(cells_s(spark, d)))


@query("a8_norm1", _WITH + "SELECT round(max(v), 6) AS value FROM (SELECT sum(abs(value)) AS v FROM b GROUP BY col_key)")
def a8(spark, d):
    return rounded(keyed.norm1(cells_b(spark, d)))


def _system(spark, d):
    """A' A + I: positive definite at every scale."""
    return normals.regularise(cells_s(spark, d), 1.0).withColumn("sys", F.lit(0).cast("long"))


@query("a9_eigenvalues")
def a9(spark, d):
    return normals.dense(_system(spark, d), "eigen")


@query("a10_inverse")
def a10(spark, d):
    return normals.dense(_system(spark, d), "inverse")


@query("a11_cholesky")
def a11(spark, d):
    return normals.dense(_system(spark, d), "cholesky")


@query("a12_trace", _WITH + "SELECT round(sum(value), 6) AS value FROM s WHERE row_key = col_key")
def a12(spark, d):
    return rounded(keyed.diagonal(cells_s(spark, d)).agg(F.sum("value").alias("value")))


@query("a13_block_merge", _WITH + f"SELECT 0 AS block_no, {_OUT} FROM a UNION ALL SELECT 1, {_OUT} FROM b")
def a13(spark, d):
    return rounded(keyed.stack(cells_a(spark, d), cells_b(spark, d)))


@query("j4_scale", _WITH + "SELECT row_key, col_key, round(value * 2.5, 6) AS value FROM a")
def j4(spark, d):
    return rounded(keyed.scale(cells_a(spark, d), 2.5))


@query("j6_expand", _WITH + f", k AS (SELECT DISTINCT row_key FROM b), c AS (SELECT DISTINCT col_key FROM a) SELECT k.row_key, c.col_key, round(coalesce(s.value, 0), 6) AS value FROM k CROSS JOIN c LEFT JOIN s ON s.row_key = k.row_key AND s.col_key = c.col_key")
def j6(spark, d):
    return rounded(keyed.mirror(keyed.upper(cells_s(spark, d))))


@query("j7_symmetrise_upper", _WITH + f"SELECT {_OUT} FROM s WHERE row_key <= col_key")
def j7(spark, d):
    return rounded(keyed.upper(cells_s(spark, d)))


@query("j8_diagonal", _WITH + "SELECT row_key, round(value, 6) AS value FROM s WHERE row_key = col_key")
def j8(spark, d):
    return rounded(keyed.diagonal(cells_s(spark, d)))


@query("j9_submatrix", _WITH + f"SELECT {_OUT} FROM a WHERE row_key BETWEEN 2 AND 5 AND col_key BETWEEN 0 AND 3")
def j9(spark, d):
    return rounded(keyed.submatrix(cells_a(spark, d), (2, 5), (0, 3)))


@query("j13_complement", _WITH + "SELECT row_key, col_key, round(CASE WHEN row_key = col_key THEN 1 ELSE 0 END - value, 6) AS value FROM a")
def j13(spark, d):
    return rounded(keyed.complement(cells_a(spark, d)))


@query("l5_fix", _WITH + f"SELECT {_OUT} FROM s WHERE row_key <= col_key AND row_key NOT IN (1, 3) AND col_key NOT IN (1, 3)")
def l5(spark, d):
    gone = spark.createDataFrame([(1,), (3,)], "row_key long")
    return rounded(normals.fix(keyed.upper(cells_s(spark, d)), gone))


_L6 = "SELECT l_returnflag AS grp, l_suppkey % 8 AS row_key, l_partkey % 8 AS col_key, round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2, 3"


@query("l6_combine", _L6)
def l6(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(normals.combine(li.select(F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 8).alias("row_key"), (F.col("l_partkey") % 8).alias("col_key"), F.col("l_quantity").alias("value"))))


@query("l7_auto_combine", "WITH k AS (SELECT o_custkey AS sys, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS keys FROM orders GROUP BY 1) SELECT keys, count(*) AS systems FROM k GROUP BY 1")
def l7(spark, d):
    k = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("keys"))
    return k.groupBy("keys").agg(F.count("*").alias("systems"))


@query("l10_reduce_one", _WITH + "SELECT s.row_key, s.col_key, round(s.value - u.value * v.value / p.value, 5) AS value FROM s JOIN s u ON u.row_key = s.row_key AND u.col_key = 0 JOIN s v ON v.row_key = s.col_key AND v.col_key = 0 JOIN s p ON p.row_key = 0 AND p.col_key = 0 WHERE s.row_key <= s.col_key AND s.row_key <> 0 AND s.col_key <> 0")
def l10(spark, d):
    return rounded(normals.reduce_one(keyed.upper(cells_s(spark, d)), 0), 5)


@query("l11_local_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS row_key, CAST(min(l_suppkey) AS VARCHAR) AS sys FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def l11(spark, d):
    rhs = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("row_key"), F.col("l_suppkey").cast("string").alias("sys"))
    return systems.local_keys(systems.Systems(rhs, rhs, rhs))


@query("l12_regularise", _WITH + "SELECT row_key, col_key, round(value + CASE WHEN row_key = col_key THEN 0.1 ELSE 0 END, 6) AS value FROM s")
def l12(spark, d):
    return rounded(normals.regularise(cells_s(spark, d), 0.1))
