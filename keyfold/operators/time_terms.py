"""Parameters of many epochs as functions of time: each becomes a mean, a
trend, seasonal or polynomial terms, in the normal equations themselves.

The expansion is a sparse B for each system, at its own time, made of the
parameters that a pattern selects; systems.transform applies it, and combining
the results of all epochs gives the normals of the terms.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .systems import Systems, transform

KEY = 24


def expansion(s: Systems, times: DataFrame, origin: float, mean: str | None = None, trend: str | None = None, annual: str | None = None, semiannual: str | None = None, polynomial: str | None = None, degree: int = 1, omega: float = 2 * math.pi, squeeze: bool = False) -> DataFrame:
    """sys, row_key (new), col_key (old), value of the terms whose pattern (a
    regular expression, "" for all) a parameter matches.  New keys: the old one
    for the mean, TR_, AC_, AS_, SC_, SS_, Pn_ before its first 21 signs.

    times (sys, t).  squeeze: parameters without any term stay as they are;
    else B knows them by a zero and they drop out."""
    dt, key = F.col("t") - F.lit(float(origin)), F.col("row_key")
    named = lambda p: F.concat(F.lit(p), F.substring(key, 1, KEY - len(p)))
    term = lambda pattern, new, value: F.when(key.rlike(pattern), F.struct(new.alias("row_key"), value.alias("value")))
    terms = []
    if mean is not None:
        terms.append(term(mean, key, F.lit(1.0)))
    if trend is not None:
        terms.append(term(trend, named("TR_"), dt))
    for pattern, names, k in ((annual, ("AC_", "AS_"), 1), (semiannual, ("SC_", "SS_"), 2)):
        if pattern is not None:
            terms += [term(pattern, named(names[0]), F.cos(k * omega * dt)), term(pattern, named(names[1]), F.sin(k * omega * dt))]
    if polynomial is not None:
        terms += [term(polynomial, named(f"P{n}_"), F.pow(dt, F.lit(n))) for n in range(degree + 1)]
    if not terms:
        raise ValueError("no terms")
    rows = s.rhs.select("sys", "row_key").join(times.select("sys", F.col("t").cast("double").alias("t")), "sys")
    rows = rows.select("sys", key.alias("col_key"), F.filter(F.array(*terms), lambda x: x.isNotNull()).alias("terms"))
    made = rows.select("sys", "col_key", F.inline("terms")).select("sys", "row_key", "col_key", "value")
    if squeeze:
        return made
    none = rows.where(F.size("terms") == 0).select("sys", F.lit(None).cast("string").alias("row_key"), "col_key", F.lit(0.0).alias("value"))
    return made.unionByName(none)


def expand(s: Systems, times: DataFrame, origin: float, **terms) -> Systems:
    """The systems in terms of time; see expansion.  New parameters have no
    a-priori (null) but for means, which keep theirs: move a system to the
    a-priori zero first where others are set."""
    return transform(s, expansion(s, times, origin, **terms))
