"""Whole normal-equation systems: matrix, right side and statistics together.

Systems holds any number of systems, told apart by `sys`:
  cells (sys, row_key, col_key, value): upper triangle of N, row_key <= col_key
  rhs   (sys, row_key, value, x0): right side and a-priori value; every
        parameter of a system has a row here
  stats (sys, nobs, ltpl, nfix, nred, stime, etime, ctime)
Keys and sys are strings.  Fixing, combining, scaling, transforming and changes
of the a-priori are joins and sums over any number of cells; reducing and
solving take one system a row, so a system's matrix must fit in a task.

Defined results: empty tables give empty tables; null keys belong to no system;
a singular system is solved by nulls; without redundancy sigma0 is null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder

STATS = "sys string, nobs long, ltpl double, nfix long, nred long, stime double, etime double, ctime double"
META = ["nobs", "nfix", "nred", "stime", "etime", "ctime"]


class Systems(NamedTuple):
    cells: DataFrame
    rhs: DataFrame
    stats: DataFrame


def from_moments(moments: DataFrame, names: list[str], times: DataFrame | None = None) -> Systems:
    """Systems of what normals.build gives; times: (sys, stime, etime)."""
    names = sorted(names)
    m = moments.withColumn("sys", F.col("sys").cast("string"))
    have = set(moments.columns)
    pairs = [(a, b, f"n_{a}_{b}" if f"n_{a}_{b}" in have else f"n_{b}_{a}") for i, a in enumerate(names) for b in names[i:]]
    cell = [F.struct(F.lit(a).alias("row_key"), F.lit(b).alias("col_key"), F.col(c).cast("double").alias("value")) for a, b, c in pairs]
    side = [F.struct(F.lit(a).alias("row_key"), F.col(f"b_{a}").cast("double").alias("value"), F.lit(0.0).alias("x0")) for a in names]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    stats = m.select("sys", F.col("nobs").cast("long").alias("nobs"), F.col("ltpl").cast("double").alias("ltpl"), zero.alias("nfix"), zero.alias("nred"))
    if times is not None:
        stats = stats.join(times.select(F.col("sys").cast("string").alias("sys"), "stime", "etime"), "sys", "left")
    else:
        stats = stats.withColumns({"stime": none, "etime": none})
    return Systems(m.select("sys", F.inline(F.array(*cell))), m.select("sys", F.inline(F.array(*side))), stats.withColumn("ctime", (F.col("stime") + F.col("etime")) / 2))


def _stored(t: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back, for what is used
    more than once: plans of several steps would else repeat each other."""
    path = fresh_folder(t.sparkSession, name)
    t.write.parquet(path)
    return t.sparkSession.read.schema(t.schema).parquet(path)


def settled(s: Systems) -> Systems:
    """The systems, stored."""
    return Systems(*(_stored(t, name) for name, t in zip(s._fields, s, strict=True)))


def full(cells: DataFrame) -> DataFrame:
    """Both triangles."""
    return cells.unionByName(cells.where("row_key < col_key").select("sys", F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), "value"))


def times_vector(cells: DataFrame, x: DataFrame) -> DataFrame:
    """(sys, row_key, p): N x for x (sys, row_key, x)."""
    right = x.select("sys", F.col("row_key").alias("col_key"), "x")
    return full(cells).join(right, ["sys", "col_key"]).groupBy("sys", "row_key").agg(F.sum(F.col("value") * F.col("x")).alias("p"))


def shift_apriori(s: Systems, dx: DataFrame) -> Systems:
    """Move the a-priori by dx (sys, row_key, x): d - C dx, ltpl - d'dx - d_new'dx."""
    dx = dx.select("sys", "row_key", F.coalesce("x", F.lit(0.0)).alias("x"))
    rows = s.rhs.join(dx, ["sys", "row_key"], "left").join(times_vector(s.cells, dx), ["sys", "row_key"], "left").na.fill(0.0, ["x", "p"])
    rows = rows.withColumn("new", F.col("value") - F.col("p"))
    drop = rows.groupBy("sys").agg(F.sum((F.col("value") + F.col("new")) * F.col("x")).alias("drop"))
    stats = s.stats.join(drop, "sys", "left").withColumn("ltpl", F.col("ltpl") - F.coalesce("drop", F.lit(0.0))).drop("drop")
    return Systems(s.cells, rows.select("sys", "row_key", F.col("new").alias("value"), (F.col("x0") + F.col("x")).alias("x0")), stats)


def change_apriori(s: Systems, mode: str, values: DataFrame | None = None, pattern: str = "") -> Systems:
    """Set the a-priori of the parameters that match the pattern.

    `set`: to values (row_key, x), or zero if there are none; the system moves
    with it.  `add`: by values.  `replace`, `forget`: to values or to zero, the
    vector alone, as if it had always been so."""
    rows = s.rhs.where(F.col("row_key").rlike(pattern))
    if values is not None:
        rows = rows.join(values.select("row_key", "x"), "row_key", "inner" if mode in ("add", "replace") else "left")
    else:
        rows = rows.withColumn("x", F.lit(0.0))
    if mode in ("set", "add"):
        step = F.col("x") - F.col("x0") if mode == "set" else F.col("x")
        return shift_apriori(s, rows.select("sys", "row_key", step.alias("x")))
    if mode not in ("replace", "forget"):
        raise ValueError(f"no such mode: {mode}")
    new = rows.select("sys", "row_key", F.lit(0.0).alias("x") if mode == "forget" else F.col("x"))
    rhs = s.rhs.join(new, ["sys", "row_key"], "left").select("sys", "row_key", "value", F.coalesce("x", "x0").alias("x0"))
    return s._replace(rhs=rhs)


def fix(s: Systems, keys: DataFrame) -> Systems:
    """Take parameters (row_key) out at their a-priori: their rows and columns
    go, the others' right side and ltpl stay."""
    k = keys.select("row_key").distinct()
    gone = s.rhs.join(k, "row_key", "left_semi").groupBy("sys").agg(F.count("*").alias("more"))
    cells = s.cells.join(k, "row_key", "left_anti").join(k.select(F.col("row_key").alias("col_key")), "col_key", "left_anti")
    stats = s.stats.join(gone, "sys", "left").withColumn("nfix", F.col("nfix") + F.coalesce("more", F.lit(0))).drop("more")
    return Systems(cells.select("sys", "row_key", "col_key", "value"), s.rhs.join(k, "row_key", "left_anti").select(*s.rhs.columns), stats.select(*s.stats.columns))


def scaled(s: Systems, scale: DataFrame) -> Systems:
    """Divide N, right side and ltpl by a system's variance (sys, cv); 1 if none."""
    cv = F.coalesce("cv", F.lit(1.0))
    over = lambda df, c: df.join(scale.select("sys", "cv"), "sys", "left").withColumn(c, F.col(c) / cv).drop("cv")
    return Systems(over(s.cells, "value"), over(s.rhs, "value"), over(s.stats, "ltpl"))


def same_keys(s: Systems) -> DataFrame:
    """(sys, grp): systems of one set of keys share grp, the least of them."""
    # A set of keys is known by its text; \x1f stands between keys.
    keys = s.rhs.groupBy("sys").agg(F.array_join(F.sort_array(F.collect_set("row_key")), "\x1f").alias("keys"))
    return keys.join(keys.groupBy("keys").agg(F.min("sys").alias("grp")), "keys").select("sys", "grp")


def apriori_disagrees(s: Systems, groups: DataFrame, tolerance: float = 1e-30) -> DataFrame:
    """(grp, row_key, spread) of parameters whose a-priori differs in a group."""
    g = s.rhs.join(groups, "sys").groupBy("grp", "row_key").agg((F.max("x0") - F.min("x0")).alias("spread"))
    return g.where(F.col("spread") > tolerance)


def common_apriori(s: Systems, groups: DataFrame, by_span: bool = False) -> DataFrame:
    """(grp, row_key, x): the mean a-priori of a group's systems, weighted by
    their time spans if by_span.  A span that isn't positive is then an error;
    null values (of transformed parameters) don't count."""
    rows = s.rhs.join(groups, "sys")
    if not by_span:
        return rows.groupBy("grp", "row_key").agg(F.coalesce(F.avg("x0"), F.lit(0.0)).alias("x"))
    span = s.stats.select("sys", (F.col("etime") - F.col("stime")).alias("w"))
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("no positive time span to weigh the a-priori of system "), "sys")).cast("double"))
    rows = rows.join(span, "sys", "left").where(F.col("x0").isNotNull()).withColumn("w", w)
    return rows.groupBy("grp", "row_key").agg((F.sum(F.col("x0") * F.col("w")) / F.sum("w")).alias("x"))


def combine(s: Systems, groups: DataFrame, apriori: str = "mean") -> Systems:
    """Sum the systems of each group (sys, grp).  Matrices, right sides and
    counts add up, times span all.

    Right sides add up only about one a-priori, so every system first moves to
    its group's: `mean`, the mean of the systems' values; `span`, the mean
    weighted by time spans; `agree`, an error if they differ."""
    if apriori not in ("mean", "span", "agree"):
        raise ValueError(f"no such a-priori: {apriori}")
    if apriori == "agree":
        if not apriori_disagrees(s, groups).isEmpty():
            raise ValueError("a-priori values of combined systems differ")
    at = _stored(common_apriori(s, groups, apriori == "span"), "apriori")
    if apriori != "agree":
        own = s.rhs.join(groups, "sys").join(at, ["grp", "row_key"], "left")
        s = shift_apriori(s, _stored(own.select("sys", "row_key", (F.col("x") - F.coalesce("x0", F.lit(0.0))).alias("x")), "step"))
    cells = s.cells.join(groups, "sys").groupBy(F.col("grp").alias("sys"), "row_key", "col_key").agg(F.sum("value").alias("value"))
    rhs = s.rhs.join(groups, "sys").groupBy(F.col("grp").alias("sys"), "row_key").agg(F.sum("value").alias("value"))
    rhs = rhs.join(at.select(F.col("grp").alias("sys"), "row_key", F.col("x").alias("x0")), ["sys", "row_key"], "left")
    stats = s.stats.join(groups, "sys").groupBy(F.col("grp").alias("sys"))
    stats = stats.agg(*(F.sum(c).alias(c) for c in ("nobs", "ltpl", "nfix", "nred")), F.min("stime").alias("stime"), F.max("etime").alias("etime"))
    return Systems(cells, rhs.select("sys", "row_key", "value", "x0"), stats.withColumn("ctime", (F.col("stime") + F.col("etime")) / 2))


def regularise(s: Systems, alpha: float = 1.0, matrix: DataFrame | None = None, pattern: str = "") -> Systems:
    """N + alpha R on the parameters that a system has and that match: R is
    matrix (row_key, col_key, value, upper triangle; a diagonal has only
    row_key = col_key), or the unit matrix."""
    has = s.rhs.where(F.col("row_key").rlike(pattern)).select("sys", "row_key")
    if matrix is None:
        more = has.select("sys", "row_key", F.col("row_key").alias("col_key"), F.lit(float(alpha)).alias("value"))
    else:
        more = matrix.join(has, "row_key").join(has.withColumnRenamed("row_key", "col_key"), ["sys", "col_key"])
        more = more.select("sys", "row_key", "col_key", (F.col("value") * F.lit(float(alpha))).alias("value"))
    cells = s.cells.unionByName(more).groupBy("sys", "row_key", "col_key").agg(F.sum("value").alias("value"))
    return s._replace(cells=cells)


def hold_sum(s: Systems, pattern: str) -> Systems:
    """Hold the sum of the parameters that match at zero: a block of ones, times
    the mean of the system's diagonal, is added to N."""
    has = s.rhs.where(F.col("row_key").rlike(pattern)).select("sys", "row_key")
    mean = s.cells.where("row_key = col_key").groupBy("sys").agg(F.avg("value").alias("value"))
    pairs = has.join(has.select("sys", F.col("row_key").alias("col_key")), "sys").where("row_key <= col_key")
    more = pairs.join(mean, "sys").select("sys", "row_key", "col_key", "value")
    return s._replace(cells=s.cells.unionByName(more).groupBy("sys", "row_key", "col_key").agg(F.sum("value").alias("value")))


def local_keys(s: Systems) -> DataFrame:
    """row_key, sys of the parameters that only one system has."""
    return s.rhs.groupBy("row_key").agg(F.min("sys").alias("sys"), F.max("sys").alias("last")).where("sys = last").drop("last")


def eigen(s: Systems) -> DataFrame:
    """sys, place (from 1, eigenvalues rising), value, row_key, component: unit
    eigenvectors of each system's matrix, the largest component positive."""

    def work(keys, n, d, x0, _):
        e, v = np.linalg.eigh(n)
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(e))] < 0, -1.0, 1.0) if len(e) else v
        return keys, v.T, e, x0, 0.0

    got = _dense(s, work)
    n = F.size("keys")
    each = got.select("sys", "keys", "mat", n.alias("n"), F.posexplode("vec").alias("k", "value"))
    return each.select("sys", (F.col("k") + 1).alias("place"), _known(F.col("value")).alias("value"), F.inline(F.arrays_zip(F.col("keys").alias("row_key"), F.slice("mat", F.col("k") * F.col("n") + 1, F.col("n")).alias("component"))))


def transform(s: Systems, b: DataFrame) -> Systems:
    """N* = B N B', d* = B d for b ([sys,] row_key: new parameter, col_key: old
    one, value); with sys, each system has its own.  Parameters that B does not
    know stay; one that it knows by a null row_key drops out.  The a-priori is
    null where B made the parameter."""
    own = "sys" in b.columns
    at = ["sys"] if own else []
    known = b.select(*at, F.col("col_key").alias("row_key")).distinct()
    rest = s.rhs.join(known, [*at, "row_key"], "left_anti").select(*at, "row_key").distinct()
    whole = b.where("row_key is not null").select(*at, "row_key", "col_key", "value").unionByName(rest.select(*at, "row_key", F.col("row_key").alias("col_key"), F.lit(1.0).alias("value")))
    left = whole.select(*at, F.col("row_key").alias("i"), F.col("col_key").alias("row_key"), F.col("value").alias("u"))
    right = whole.select(*at, F.col("row_key").alias("j"), F.col("col_key").alias("col_key"), F.col("value").alias("v"))
    half = full(s.cells).join(left, [*at, "row_key"]).groupBy("sys", "i", "col_key").agg(F.sum(F.col("u") * F.col("value")).alias("h"))
    cells = half.join(right, [*at, "col_key"]).where("i <= j").groupBy("sys", F.col("i").alias("row_key"), F.col("j").alias("col_key")).agg(F.sum(F.col("h") * F.col("v")).alias("value"))
    rhs = s.rhs.join(left, [*at, "row_key"]).groupBy("sys", F.col("i").alias("row_key"))
    kept = F.when(F.count("*") == 1, F.max(F.when(F.col("i") == F.col("row_key"), F.col("x0") / F.col("u"))))
    return Systems(cells, rhs.agg(F.sum(F.col("u") * F.col("value")).alias("value"), kept.alias("x0")), s.stats)


def transform_errors(s: Systems, b: DataFrame) -> Systems:
    """Keep the solution, transform its errors (B square): x = N^-1 d, then
    N* = B N B', d* = N* x, ltpl = x' N* x."""
    x = solve(s).x.select("sys", "row_key", "x")
    new = transform(s, b)
    p = times_vector(new.cells, x).join(x, ["sys", "row_key"])
    rhs = s.rhs.select("sys", "row_key", "x0").join(p.select("sys", "row_key", F.col("p").alias("value")), ["sys", "row_key"])
    post = p.groupBy("sys").agg(F.sum(F.col("p") * F.col("x")).alias("post"))
    stats = s.stats.join(post, "sys", "left").withColumn("ltpl", F.col("post")).drop("post")
    return Systems(new.cells, rhs.select("sys", "row_key", "value", "x0"), stats)


class Solution(NamedTuple):
    """x (sys, row_key, x, sigma), covariance (sys, row_key, col_key, value:
    upper triangle, not scaled by sigma0), stats with sigma0."""

    x: DataFrame
    covariance: DataFrame
    stats: DataFrame


_DENSE = "sys string, keys array<string>, vec array<double>, x0 array<double>, mat array<double>, ltpl double, nobs long, nfix long, nred long, stime double, etime double, ctime double"


#: Unknowns of a system that one task solves.  Larger ones: tiles.factor.
MAX_UNKNOWNS = 6000


def _dense(s: Systems, work: Callable, mark: Column | None = None) -> DataFrame:
    """work(keys, N, d, x0, marks) -> (keys, matrix, vector, x0, what ltpl
    loses), or LinAlgError, once for each system; marks: of each key, the
    value of the condition `mark`."""
    rows = s.rhs.select("sys", "row_key", "value", "x0", (F.lit(False) if mark is None else mark).alias("mark"))
    few = F.when(F.count("*") <= MAX_UNKNOWNS, F.lit(True)).otherwise(F.raise_error(F.lit(f"over {MAX_UNKNOWNS} unknowns in one system")).cast("boolean"))
    r = rows.groupBy("sys").agg(few.alias("few"), F.sort_array(F.collect_list(F.struct("row_key", "value", "x0", "mark"))).alias("r")).where("few")
    c = s.cells.groupBy("sys").agg(F.collect_list(F.struct("row_key", "col_key", "value")).alias("c"))
    packed = s.stats.join(r, "sys").join(c, "sys", "left")
    flat = packed.select("sys", "ltpl", *META, F.col("r.row_key").alias("keys"), F.col("r.value").alias("vec"), F.col("r.x0").alias("x0"), F.col("r.mark").alias("mark"), F.col("c.row_key").alias("i"), F.col("c.col_key").alias("j"), F.col("c.value").alias("v"))

    def one(batches):
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                keys = np.array(t.keys, object)
                n, place = np.zeros((len(keys), len(keys))), pd.Index(keys)
                if t.i is not None and len(t.i):
                    i, j = place.get_indexer(t.i), place.get_indexer(t.j)
                    n[i, j] = t.v
                    n[j, i] = t.v
                try:
                    k, m, d, x0, loss = work(keys, n, np.array(t.vec, float), np.array(t.x0, float), np.array(t.mark, bool))
                except np.linalg.LinAlgError:
                    k, d, x0, m, loss = keys, np.full(len(keys), np.nan), t.x0, np.full(n.shape, np.nan), np.nan
                out.append((t.sys, list(k), d, x0, m.ravel(), t.ltpl - loss, t.nobs, t.nfix, t.nred, t.stime, t.etime, t.ctime))
            yield pd.DataFrame(out, columns=["sys", "keys", "vec", "x0", "mat", "ltpl", "nobs", "nfix", "nred", "stime", "etime", "ctime"])

    return flat.mapInPandas(one, _DENSE)


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _vector(d: DataFrame, **more: str) -> DataFrame:
    return d.select("sys", F.inline(F.arrays_zip(F.col("keys").alias("row_key"), *(F.col(c).alias(n) for n, c in more.items()))))


def _matrix(d: DataFrame) -> DataFrame:
    """The upper triangle; keys are in order."""
    n = F.size("keys")
    rows = d.select("sys", "keys", "mat", n.alias("n"), F.posexplode("keys").alias("a", "row_key"))
    rows = rows.select("sys", "row_key", "a", F.posexplode(F.arrays_zip(F.col("keys").alias("col_key"), F.slice("mat", F.col("a") * F.col("n") + 1, F.col("n")).alias("value"))).alias("b", "z"))
    return rows.where("a <= b").select("sys", "row_key", F.col("z.col_key").alias("col_key"), _known(F.col("z.value")).alias("value"))


def reduce(s: Systems, pattern: str) -> Systems:
    """Eliminate the parameters that match, block by block: C22 - C21 C11^-1 C12,
    d2 - C21 C11^-1 d1, ltpl - d1' C11^-1 d1.  A system whose C11 is singular
    keeps its keys with null values."""

    def work(keys, n, d, x0, gone):
        low = np.linalg.cholesky(n[np.ix_(gone, gone)])
        half, side = np.linalg.solve(low, n[np.ix_(gone, ~gone)]), np.linalg.solve(low, d[gone])
        return keys[~gone], n[np.ix_(~gone, ~gone)] - half.T @ half, d[~gone] - half.T @ side, x0[~gone], side @ side

    got = _dense(s, work, F.col("row_key").rlike(pattern))
    hits = s.rhs.where(F.col("row_key").rlike(pattern)).groupBy("sys").agg(F.count("*").alias("more"))
    stats = got.select("sys", "nobs", _known(F.col("ltpl")).alias("ltpl"), "nfix", "nred", "stime", "etime", "ctime").join(hits, "sys", "left")
    stats = stats.withColumn("nred", F.col("nred") + F.coalesce("more", F.lit(0))).drop("more")
    rhs = _vector(got, value="vec", x0="x0").withColumn("value", _known(F.col("value")))
    return Systems(_matrix(got), rhs, stats)


def _cholesky(keys, n, d, x0, _):
    low = np.linalg.cholesky(n)
    half, inv = np.linalg.solve(low, d), np.linalg.inv(low)
    return keys, inv.T @ inv, inv.T @ half, x0, half @ half


def solve(s: Systems, keep: int | None = None) -> Solution:
    """Solve by Cholesky, or if keep is given by the largest `keep` eigenvalues
    (as many as a smaller system has).  sigma0 = sqrt(ltpl / (nobs - (parameters
    + nred)))."""

    def truncated(keys, n, d, x0, _):
        e, v = np.linalg.eigh(n)
        if len(e) and e[-min(keep, len(e))] <= 0:
            raise np.linalg.LinAlgError
        e, v = e[-keep:], v[:, -keep:]
        cov = (v / e) @ v.T
        return keys, cov, cov @ d, x0, d @ cov @ d

    if keep is not None and keep < 1:
        raise ValueError("keep at least one eigenvalue")
    got = _dense(s, _cholesky if keep is None else truncated)
    free = F.col("nobs") - F.size("keys") - F.col("nred")
    s0 = F.when(free > 0, F.sqrt(F.greatest(_known(F.col("ltpl")), F.lit(0.0)) / free))
    got = got.withColumn("sigma0", s0)
    own = F.transform("keys", lambda k, i: F.get(F.col("mat"), i * (F.size("keys") + 1)))
    x = got.withColumn("own", own).select("sys", "sigma0", F.inline(F.arrays_zip(F.col("keys").alias("row_key"), F.col("vec").alias("x"), F.col("own").alias("q"))))
    x = x.select("sys", "row_key", _known(F.col("x")).alias("x"), (F.sqrt(_known(F.col("q"))) * F.col("sigma0")).alias("sigma"))
    stats = got.select("sys", "nobs", _known(F.col("ltpl")).alias("ltpl"), "nfix", "nred", "stime", "etime", "ctime", "sigma0")
    return Solution(x, _matrix(got), stats)


def variance_components(s: Systems, groups: DataFrame, scale: DataFrame) -> DataFrame:
    """One iteration: (sys, grp, contribution, vce) for groups (sys, grp) that
    were combined with variances scale (sys, cv).

    A system's contribution is trace(Cov N) / cv over its parameters, and its
    component ltpl / (nobs - contribution), with ltpl at the group's solution."""
    s = settled(s)
    both = settled(combine(scaled(s, scale), groups))
    best = solve(both)
    cov = full(best.covariance).select(F.col("sys").alias("grp"), "row_key", "col_key", F.col("value").alias("q"))
    trace = full(s.cells).join(groups, "sys").join(cov, ["grp", "row_key", "col_key"]).groupBy("sys").agg(F.sum(F.col("q") * F.col("value")).alias("trace"))
    # Each system moves from its own a-priori to the group's solution.
    x = best.x.join(both.rhs.select("sys", "row_key", "x0"), ["sys", "row_key"]).select(F.col("sys").alias("grp"), "row_key", (F.col("x") + F.col("x0")).alias("to"))
    dx = s.rhs.join(groups, "sys").join(x, ["grp", "row_key"]).select("sys", "row_key", (F.col("to") - F.coalesce("x0", F.lit(0.0))).alias("x"))
    at = shift_apriori(s, dx).stats.select("sys", "nobs", "ltpl")
    got = at.join(groups, "sys").join(trace, "sys").join(scale.select("sys", "cv"), "sys", "left")
    share = F.col("trace") / F.coalesce("cv", F.lit(1.0))
    return got.select("sys", "grp", share.alias("contribution"), F.try_divide("ltpl", F.col("nobs") - share).alias("vce"))


def iterate_components(s: Systems, groups: DataFrame, rounds: int = 5) -> DataFrame:
    """(sys, grp, cv, convergence) after some rounds of variance components,
    each round with the variances of the one before; convergence, the square
    root of their ratio, tends to 1.  One row a system is cut from the lineage
    at each round, in the session's checkpoint folder."""
    spark = s.stats.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(fresh_folder(spark, "checkpoints"))
    scale = s.stats.select("sys", F.lit(1.0).alias("cv"), F.lit(None).cast("double").alias("convergence"))
    for _ in range(max(rounds, 2)):
        new = variance_components(s, groups, scale).join(scale.select("sys", F.col("cv").alias("old")), "sys")
        scale = new.select("sys", F.col("vce").alias("cv"), F.sqrt(F.col("vce") / F.col("old")).alias("convergence")).checkpoint()
    return scale.join(groups, "sys").select("sys", "grp", "cv", "convergence")
