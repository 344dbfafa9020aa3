"""Normal equations as tables.

cells (sys, row_key, col_key, value) hold the upper triangle of N, rhs (sys,
row_key, value) the right side, stats (sys, nobs, ltpl) the rest.  Building,
combining, fixing and changing the a-priori are joins and sums; dense solves
take one system a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(obs: DataFrame, terms: dict, y: str, by: str, weight: str | None = None) -> DataFrame:
    """One row a system with all moments: n_<i>_<j>, b_<i>, ltpl, nobs.

    terms: name to Column of each unknown's design coefficient.  One pass and
    one partial aggregation; rows with null y are no observations."""
    names = list(terms)
    w = F.col(weight) if weight else F.lit(1.0)
    rows = obs.where(F.col(y).isNotNull()).select(F.col(by).alias("sys"), F.col(y).alias("y"), w.alias("w"), *(c.cast("double").alias(f"x_{n}") for n, c in terms.items()))
    sums = [F.count("*").alias("nobs"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("ltpl")]
    for i, a in enumerate(names):
        sums.append(F.sum(F.col("w") * F.col(f"x_{a}") * F.col("y")).alias(f"b_{a}"))
        sums += [F.sum(F.col("w") * F.col(f"x_{a}") * F.col(f"x_{b}")).alias(f"n_{a}_{b}") for b in names[i:]]
    return rows.groupBy("sys").agg(*sums)


def solve(moments: DataFrame, names: list[str]) -> DataFrame:
    """sys, name, x, sigma, nobs, ltpl, sigma0 by Cholesky, one system a row.

    A singular system gives null unknowns; without redundancy sigma0 is null."""
    kind = dict(moments.dtypes)["sys"]

    def one(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n = np.array([[r[f"n_{names[min(i, j)]}_{names[max(i, j)]}"] for j in range(len(names))] for i in range(len(names))], float)
                b = np.array([r[f"b_{a}"] for a in names], float)
                try:
                    low = np.linalg.cholesky(n)
                    half = np.linalg.solve(low, b)
                    inv = np.linalg.inv(low)
                    x, cov, ltpl = inv.T @ half, inv.T @ inv, r["ltpl"] - half @ half
                except np.linalg.LinAlgError:
                    x, cov, ltpl = np.full(len(b), np.nan), np.full(n.shape, np.nan), np.nan
                free = r["nobs"] - len(names)
                s0 = np.sqrt(max(ltpl, 0) / free) if free > 0 and ltpl == ltpl else np.nan
                out += [(r["sys"], a, x[i], np.sqrt(cov[i, i]) * s0, r["nobs"], ltpl, s0) for i, a in enumerate(names)]
            got = pd.DataFrame(out, columns=["sys", "name", "x", "sigma", "nobs", "ltpl", "sigma0"])
            yield got.astype(object).where(got.notna(), None)

    return moments.mapInPandas(one, f"sys {kind}, name string, x double, sigma double, nobs long, ltpl double, sigma0 double")


def combine(cells: DataFrame, group: str = "grp") -> DataFrame:
    """Sum systems of a group, key by key."""
    return cells.groupBy(group, "row_key", "col_key").agg(F.sum("value").alias("value"))


def fix(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop rows and columns of fixed parameters (row_key)."""
    k = keys.select("row_key").distinct()
    return cells.join(k, "row_key", "left_anti").join(k.select(F.col("row_key").alias("col_key")), "col_key", "left_anti")


def regularise(cells: DataFrame, alpha: float) -> DataFrame:
    """N + alpha I on the parameters that have a diagonal cell."""
    return cells.withColumn("value", F.col("value") + F.when(F.col("row_key") == F.col("col_key"), F.lit(alpha)).otherwise(0.0))


def reduce_one(cells: DataFrame, key) -> DataFrame:
    """Eliminate one parameter: N22 - N21 N12 / N11 (upper triangle in and out)."""
    both = cells.unionByName(cells.where("row_key < col_key").select(F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), "value"))
    pivot = cells.where((F.col("row_key") == key) & (F.col("col_key") == key)).select(F.col("value").alias("p"))
    side = both.where((F.col("col_key") == key) & (F.col("row_key") != key)).select("row_key", F.col("value").alias("u"))
    rest = cells.where((F.col("row_key") != key) & (F.col("col_key") != key))
    other = side.select(F.col("row_key").alias("col_key"), F.col("u").alias("v"))
    got = rest.join(side, "row_key", "left").join(other, "col_key", "left").crossJoin(F.broadcast(pivot))  # pivot: one row
    return got.select("row_key", "col_key", (F.col("value") - F.coalesce(F.col("u") * F.col("v") / F.col("p"), F.lit(0.0))).alias("value"))


def dense(cells: DataFrame, what: str) -> DataFrame:
    """Dense results, one system (sys) a task, from the full symmetric cells:
    `eigen` (row_key: rank, value: eigenvalue), `cholesky` (cells of the upper
    factor), `inverse` (cells)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(set(pdf["row_key"]) | set(pdf["col_key"]))
        at = {k: i for i, k in enumerate(keys)}
        m = np.zeros((len(keys), len(keys)))
        m[[at[k] for k in pdf["row_key"]], [at[k] for k in pdf["col_key"]]] = pdf["value"]
        if what == "eigen":
            e = np.linalg.eigvalsh(m)
            return pd.DataFrame({"sys": pdf["sys"].iloc[0], "row_key": range(len(e)), "col_key": range(len(e)), "value": e})
        got = np.linalg.cholesky(m).T if what == "cholesky" else np.linalg.inv(m)
        i, j = np.triu_indices(len(keys))
        return pd.DataFrame({"sys": pdf["sys"].iloc[0], "row_key": np.array(keys)[i], "col_key": np.array(keys)[j], "value": got[i, j]})

    return cells.groupBy("sys").applyInPandas(one, "sys long, row_key long, col_key long, value double")
