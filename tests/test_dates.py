"""Calendar codes and distribution functions on known values."""

import math

import numpy as np
from pyspark.sql import functions as F

from keyfold.functions import calendar as K
from keyfold.functions import statistics


def test_codes_there_and_back(spark):
    rows = ["04:366:43200", "31-12-2004 12:00:00", "JD 2453371.0", "MJD 53370.5", "1303", "JASON1 110", "nonsense text", "", None, "99:001:00000", "32-13-2004", "2004.5"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = {r["t"]: r for r in df.select("t", K.parse(F.col("t")).alias("jd"), *(K.convert(F.col("t"), c).alias(c) for c in K.CODES)).collect()}
    for t in rows[:4]:
        assert abs(got[t]["jd"] - 2453371.0) < 1e-8
        assert (got[t]["sinex"], got[t]["date"], got[t]["gps_week"]) == ("04:366:43200", "31-12-2004 12:00:00", "1303")
        assert got[t]["week"][:9] == "1303.7857" and got[t]["mjd"] == "MJD 53370.500000000" and got[t]["year"][:8] == "2004.998"
    assert got["1303"]["jd"] == 2444244.5 + 1303 * 7 + 3.5 and got["1303"]["gps_week"] == got["1303"]["date"]
    length, first, _ = K.MISSIONS["JASON1"]
    assert abs(got["JASON1 110"]["jd"] - (first + length * 109.5)) < 1e-6
    for t in ("nonsense text", "", None, "32-13-2004"):
        assert got[t]["jd"] is None and got[t]["date"] is None and got[t]["sinex"] is None
    assert got["99:001:00000"]["date"] == "01-01-1999 00:00:00" and got["2004.5"]["date"] == "02-07-2004 00:00:00"
    line = spark.createDataFrame([("ab 04:366:43200 cd",)], "t string")
    row = line.select(K.convert_slice(F.col("t"), 4, 15, "mjd").alias("a"), K.sinex_to_week(F.lit("00:000:00000")).alias("b"), K.sinex_to_date(F.lit("04:060:00000")).alias("c"), K.year_to_sinex(F.lit(2001.0)).alias("d")).first()
    assert tuple(row) == ("ab MJD 53370.500000000 cd", 0.0, "29-02-2004", "01:001:00000")


def test_student_p_values(spark):
    rows = [(0.0, 5), (1.0, 1), (2.0, 2), (-2.0, 2), (2.228138852, 10), (1.959963985, 10**7), (40.0, 3), (None, 3), (1.0, 0), (1.0, None)]
    df = spark.createDataFrame(rows, "t double, n long")
    got = [r["p"] for r in df.coalesce(1).select(statistics.student_p(F.col("t"), F.col("n")).alias("p")).collect()]
    want = [1.0, 0.5, 1 - 2 / math.sqrt(6), 1 - 2 / math.sqrt(6), 0.05, 0.05, 3.4379e-5]
    assert np.allclose(got[:6], want[:6], atol=1e-6) and abs(got[6] / want[6] - 1) < 1e-2 and got[7:] == [None] * 3
    x = np.linspace(0, 1, 11)
    assert np.allclose(statistics.incomplete_beta(2, 3, x), 6 * x**2 - 8 * x**3 + 3 * x**4)
