"""Column functions: calendars, coordinates, patterns, the left-to-right calculator."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the mean earth.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
EARTH_RADIUS, RHO_EARTH, RHO_WATER = 6378136.3, 5517.0, 1025.0
# POSIX classes and what Java's patterns call them.
POSIX = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "blank": r"[ \t]"}


def posix_pattern(*patterns: str) -> str:
    """One Java pattern for POSIX extended patterns, any of which may match."""
    out = [re.sub(r"\[:(\w+):\]", lambda m: POSIX[m.group(1)], p) for p in patterns]
    return "|".join(f"({p})" for p in out)


def glob_pattern(glob: str) -> str:
    """An anchored pattern for globs with `*`, alternatives split by `|`."""
    return "^(" + "|".join(".*".join(re.escape(x) for x in g.split("*")) for g in glob.split("|")) + ")$"


def calculate(text: str, names: dict[str, Column]) -> Column:
    """Arithmetic from left to right, without precedence; x/0 is null."""
    parts = re.findall(r"[A-Za-z_]\w*|\d+\.?\d*(?:[eE][-+]?\d+)?|[-+*/]", text)
    value = lambda p: names[p] if p in names else F.lit(float(p))
    out = value(parts[0])
    for op, p in zip(parts[1::2], parts[2::2], strict=True):
        v = value(p)
        out = out + v if op == "+" else out - v if op == "-" else out * v if op == "*" else F.try_divide(out, v)
    return out


def days(ts: Column, origin: str = "1970-01-01") -> Column:
    """Days with their fraction since a date; no time zone plays a part."""
    d = F.datediff(ts.cast("date"), F.lit(origin).cast("date"))
    return d + (F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.date_part(F.lit("SECOND"), ts).cast("double")) / 86400.0


def julian_date(ts: Column) -> Column:
    return days(ts) + F.lit(2440587.5)


def modified_julian_date(ts: Column) -> Column:
    return days(ts) + F.lit(40587.0)


def gps_week(ts: Column) -> Column:
    return F.floor(F.datediff(ts.cast("date"), F.lit("1980-01-06").cast("date")) / 7).cast("long")


def decimal_year(ts: Column) -> Column:
    """The year and its share, leap years by the Gregorian rule."""
    y = F.year(ts)
    start, stop = F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y + 1, F.lit(1), F.lit(1))
    return y + (days(ts) - F.datediff(start, F.lit("1970-01-01").cast("date"))) / F.datediff(stop, start)


def sinex_date(ts: Column) -> Column:
    """yy:doy:sssss"""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.concat_ws(":", F.date_format(ts, "yy"), F.lpad(F.dayofyear(ts).cast("string"), 3, "0"), F.lpad(seconds.cast("string"), 5, "0"))


def to_ecef(lon: Column, lat: Column, h: Column) -> dict[str, Column]:
    """Geodetic WGS84 degrees and metres to x, y, z."""
    e2 = WGS84_F * (2 - WGS84_F)
    lam, phi = F.radians(lon), F.radians(lat)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2)))
    return {"x": (n + h) * F.cos(phi) * F.cos(lam), "y": (n + h) * F.cos(phi) * F.sin(lam), "z": (n * (1 - e2) + h) * F.sin(phi)}


def to_geodetic(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """x, y, z to degrees and metres by one step of Bowring's formula."""
    a, b = WGS84_A, WGS84_A * (1 - WGS84_F)
    e2, ep2 = 1 - (b / a) ** 2, (a / b) ** 2 - 1
    p, th = F.hypot(x, y), F.atan2(z * a, F.hypot(x, y) * b)
    phi = F.atan2(z + ep2 * b * F.pow(F.sin(th), F.lit(3)), p - e2 * a * F.pow(F.cos(th), F.lit(3)))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2)))
    return {"lon": F.degrees(F.atan2(y, x)), "lat": F.degrees(phi), "h": p * F.cos(phi) + z * F.sin(phi) - a * a / n}


def in_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Inside a box; it may cross Greenwich, and 360 degrees are all."""
    inside = F.lit(True) if east - west >= 360 else F.pmod(lon - west, F.lit(360.0)) <= (east - west) % 360
    return inside & lat.between(south, north)


def gauss_weight(degree: Column, radius_km: float) -> Column:
    """Gaussian smoothing of a degree for a half-width radius."""
    return F.exp(-F.pow(degree * (radius_km * 1000 / EARTH_RADIUS), F.lit(2)) / (4 * 0.6931471805599453))
