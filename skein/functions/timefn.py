"""Instants from ISO-8601 text, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?\s*([Zz]|[+-]\d{2}:?\d{2})?$"


def instant_micros(c: Column) -> Column:
    """Microseconds since 1970 in UTC; no offset means UTC, a date its midnight, unreadable text gives null."""
    s = F.trim(c)
    day, clock, zone = (F.regexp_extract(s, _ISO, i) for i in (1, 2, 3))
    clock = F.when(clock == "", F.lit("00:00:00")).when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    zone = F.when(F.upper(zone).isin("", "Z"), F.lit("+00:00")).when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    whole = F.concat(day, F.lit("T"), clock, zone)
    return F.when(day != "", F.unix_micros(F.try_to_timestamp(whole)))


def day_of(c: Column) -> Column:
    """yyyy-MM-dd of a day written with blanks, slashes, no signs or with a time after it; anything else gives null."""
    s = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    parts = r"^(\d{4})([-/.]?)(\d{2})\2(\d{2})(?:[Tt ].*)?$"
    y, m, d = (F.regexp_extract(s, parts, i) for i in (1, 3, 4))
    text = F.concat_ws("-", y, m, d)
    return F.when((y != "") & F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).isNotNull(), text)
