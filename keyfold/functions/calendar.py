"""Dates in eight codes, any to any, through the Julian date.

sinex `yy:doy:sssss`, date `dd-mm-yyyy[ hh:mm:ss]`, gps_week, year (decimal),
week (decimal GPS week), jd `JD x`, mjd `MJD x`, and cycle (an altimeter
mission's name and cycle number).  Built-in column functions only.  Texts that
are no date, and times outside a code's range, are null.  A time is rendered to
the nearest second.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Altimeter missions, length of a cycle in days, Julian dates of the first cycle's start and of the end.
MISSIONS = {
    "ENVISAT": (35.0, 2452368.39881944, 2452368.39881944 + 36500),
    "TOPEX": (9.91564189814815, 2448889.46068287, 2453471.16363426),
    "JASON1": (9.91564189814815, 2452289.71670139, 2452289.71670139 + 36500),
    "JASON2": (9.91564189814815, 2454659.5555555555, 2452289.71670139 + 36500),
}
CODES = ("sinex", "date", "gps_week", "year", "week", "jd", "mjd", "cycle")
UNIX_JD, GPS_JD, MJD_ZERO = 2440587.5, 2444244.5, 2400000.5


def _date_jd(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")) + F.lit(UNIX_JD)


def _year_jd(year: Column) -> Column:
    """The Julian date of a year's start."""
    return _date_jd(F.make_date(F.when(year.between(1, 9998), year), F.lit(1), F.lit(1)))


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _century(yy: Column) -> Column:
    return F.when(yy < 50, yy + 2000).otherwise(yy + 1900)


def detect(text: Column) -> Column:
    """The code of a text: dashes make a date, colons sinex; JD and MJD say so;
    a point makes a decimal year; more than five characters a mission's cycle;
    the rest is a GPS week."""
    return (
        F.when(text.contains("-"), "date").when(text.contains(":"), "sinex").when(text.contains("MJD"), "mjd").when(text.contains("JD"), "jd")
        .when(text.contains("."), "year").when(F.length(F.rtrim(text)) > 5, "cycle").when(text.isNotNull(), "gps_week")
    )


def parse(text: Column) -> Column:
    """The Julian date of a text in any code; of a week or a cycle the middle."""
    sinex, date, clock = r"(\d{2}):(\d{3}):(\d{5})", r"(\d{1,2})-(\d{1,2})-(\d{4})", r"(\d{1,2}):(\d{2}):(\d{2})"
    day, month, year = (_int(text, date, k) for k in (1, 2, 3))
    start = F.make_date(F.when(year > 0, year), F.when(month.between(1, 12), month), F.lit(1))
    seconds = F.coalesce(_int(text, clock, 1) * 3600 + _int(text, clock, 2) * 60 + _int(text, clock, 3), F.lit(0))
    number = F.regexp_extract(text, r"(-?\d+\.?\d*)\s*$", 1).try_cast("double")
    whole = F.floor(number).cast("int")
    cycle = F.lit(None).cast("double")
    for name, (length, first, last) in MISSIONS.items():
        n = _int(text, name + r"\s*(\d+)", 1)
        jd = first + length * (n - 0.5)
        cycle = F.when(n.isNotNull() & (jd >= first) & (jd <= last), jd).otherwise(cycle)
    got = {
        "date": _date_jd(start) + (day - 1) + seconds / 86400.0,
        "sinex": _year_jd(_century(_int(text, sinex, 1))) + (_int(text, sinex, 2) - 1) + _int(text, sinex, 3) / 86400.0,
        "jd": number,
        "mjd": number + MJD_ZERO,
        "year": _year_jd(whole) + (number - whole) * (_year_jd(whole + 1) - _year_jd(whole)),
        "cycle": cycle,
        "gps_week": GPS_JD + number * 7 + 3.5,
    }
    code, out = detect(text), F.lit(None).cast("double")
    for name, jd in got.items():
        out = F.when(code == name, jd).otherwise(out)
    return out


def moment(jd: Column) -> dict[str, Column]:
    """date and seconds of the day, to the nearest second."""
    total = F.round((jd - UNIX_JD) * 86400.0).cast("long")
    days = F.floor(total / 86400.0).cast("int")
    return {"date": F.date_add(F.lit("1970-01-01").cast("date"), days), "seconds": (total - days * F.lit(86400).cast("long")).cast("long")}


def render(jd: Column, code: str, mission: str = "TOPEX") -> Column:
    """A Julian date as text in a code."""
    if code not in CODES:
        raise ValueError(f"no such code: {code}")
    m, year = moment(jd), F.year(moment(jd)["date"])
    if code == "sinex":
        text = F.format_string("%02d:%03d:%05d", year % 100, F.dayofyear(m["date"]), m["seconds"])
        return F.when((year > 1950) & (year <= 2050), text)
    if code == "date":
        s = m["seconds"]
        clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
        return F.when(jd.isNotNull(), F.concat(F.date_format(m["date"], "dd-MM-yyyy "), clock))
    if code == "year":
        start = _year_jd(year)
        return F.when(jd.isNotNull(), F.format_string("%.9f", year + (jd - start) / (_year_jd(year + 1) - start)))
    weeks = (jd - GPS_JD) / 7.0
    if code == "gps_week":
        return F.when((weeks >= 0) & (weeks < 10000), F.format_string("%04d", F.floor(weeks)))
    if code == "week":
        return F.when(jd.isNotNull(), F.format_string("%.9f", weeks))
    if code in ("jd", "mjd"):
        return F.when(jd.isNotNull(), F.format_string("JD %.9f" if code == "jd" else "MJD %.9f", jd - (0 if code == "jd" else MJD_ZERO)))
    length, first, last = MISSIONS[mission]
    return F.when(jd.between(first, last), F.format_string(f"{mission} %d", F.floor((jd - first) / length) + 1))


def convert(text: Column, code: str, mission: str = "TOPEX") -> Column:
    """A text of any code in another.  A GPS week asked for as a GPS week comes
    as a date."""
    jd = parse(text)
    return render(jd, code, mission) if code != "gps_week" else F.when(detect(text) == "gps_week", render(jd, "date")).otherwise(render(jd, code))


def convert_slice(line: Column, first: int, last: int, code: str, mission: str = "TOPEX") -> Column:
    """A line whose characters first to last (from 1) are a date, with the date
    in another code."""
    new = convert(F.substring(line, first, last - first + 1), code, mission)
    return F.concat(F.substring(line, 1, first - 1), new, F.substr(line, F.lit(last + 1)))


def sinex_to_week(text: Column) -> Column:
    """The GPS week, with its fraction, of a sinex date; 00:000:00000 is 0."""
    return F.when(text == "00:000:00000", F.lit(0.0)).otherwise((parse(text) - GPS_JD) / 7.0)


def sinex_to_date(text: Column) -> Column:
    """dd-mm-yyyy of a sinex date."""
    return F.date_format(moment(parse(text))["date"], "dd-MM-yyyy")


def year_to_sinex(year: Column) -> Column:
    """A decimal year as sinex date."""
    whole = F.floor(year).cast("int")
    return render(_year_jd(whole) + (year - whole) * (_year_jd(whole + 1) - _year_jd(whole)), "sinex")
