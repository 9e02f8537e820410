"""ANSI dates as numbers YYYYMMDDHHMMSS, in which month, day and time may be zero."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mmX", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "MMM d HH:mm:ss yyyy", "dd/MMM/yyyy:HH:mm:ss",
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy MMM d",
)
MONTHS = {"en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")}
DAYS = {"en": ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"), "fr": ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")}
_RELATIVE = {
    "today": ("day", 0), "aujourdhui": ("day", 0), "yesterday": ("day", 1), "hier": ("day", 1), "thisweek": ("week", 0), "cettesemaine": ("week", 0), "lastweek": ("week", 1), "semainederniere": ("week", 1),
    "thismonth": ("month", 0), "cemois": ("month", 0), "lastmonth": ("month", 1), "moisdernier": ("month", 1), "thisyear": ("year", 0), "cetteannee": ("year", 0), "lastyear": ("year", 1), "anneederniere": ("year", 1),
}
_SEASON = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}


def pad(number: str) -> int:
    """Digits of a date, right-padded with zeros to 14 places."""
    if not re.fullmatch(r"\d{4,14}", number):
        raise ValueError(f"not a date: {number}")
    return int(number.ljust(14, "0"))


def valid(number: int) -> bool:
    """Fields in range; month and day may be zero."""
    y, mo, d, h, mi, s = (int(str(number).zfill(14)[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))
    return y > 0 and mo <= 12 and h < 24 and mi < 60 and s < 60 and d <= (calendar.monthrange(y, mo)[1] if mo else 0)


def ansi(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss").cast("bigint")


def parse(text: Column) -> Column:
    """The first format that fits, as an ANSI date; digits alone are padded, seasons become their first month; else null."""
    t = F.trim(text)
    digits = F.regexp_replace(t, "[-/ ]", "")
    plain = F.when(digits.rlike(r"^\d{4}(\d\d){0,5}$"), F.rpad(digits, 14, "0").cast("bigint"))
    named = F.regexp_replace(t, r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    known = F.coalesce(*[F.try_to_timestamp(named, F.lit(f)) for f in FORMATS])
    season = None
    for name, month in _SEASON.items():
        test = F.lower(t).rlike(rf"^{name} \d{{4}}$")
        value = F.regexp_extract(t, r"(\d{4})$", 1).cast("bigint") * 10_000_000_000 + month * 100_000_000
        season = F.when(test, value) if season is None else season.when(test, value)
    return F.coalesce(plain, ansi(known), season)


def relative(name: str, now: dt.datetime) -> int | None:
    """Start of a named day, week, month or year, of the last such weekday or month; None if the name is unknown."""
    key = re.sub(r"[^a-zéû]", "", name.lower()).replace("é", "e") if name.lower() not in (*MONTHS["fr"], *DAYS["fr"]) else name.lower()
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if key in _RELATIVE:
        unit, back = _RELATIVE[key]
        if unit == "day":
            day -= dt.timedelta(days=back)
        elif unit == "week":
            day -= dt.timedelta(days=day.weekday() + 7 * back)
        elif unit == "month":
            month = day.year * 12 + day.month - 1 - back
            day = day.replace(year=month // 12, month=month % 12 + 1, day=1)
        else:
            return (day.year - back) * 10_000_000_000
        return int(day.strftime("%Y%m%d")) * 1_000_000
    for names in DAYS.values():
        if key in names:
            day -= dt.timedelta(days=(day.weekday() - names.index(key)) % 7)
            return int(day.strftime("%Y%m%d")) * 1_000_000
    for names in MONTHS.values():
        if key in names:
            month = names.index(key) + 1
            return (day.year - (month > day.month)) * 10_000_000_000 + month * 100_000_000
    return None


def web(number: Column) -> Column:
    """An ANSI date as an RFC 1123 string in UTC; zero months and days count as 1."""
    s = F.lpad(number.cast("string"), 14, "0")
    at = lambda a, n: F.substring(s, a, n).cast("int")
    ts = F.make_timestamp(at(1, 4), F.greatest(at(5, 2), F.lit(1)), F.greatest(at(7, 2), F.lit(1)), at(9, 2), at(11, 2), at(13, 2))
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
