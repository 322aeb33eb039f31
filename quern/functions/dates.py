"""Date functions whose rules differ from Spark's built-ins of the same name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format tokens and their Java patterns.
TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss"}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def java_pattern(template: str) -> str:
    """A format of `TOKENS` and other text as a Java date pattern."""
    out = []
    for piece in re.findall(r"%.|[A-Za-z']+|[^A-Za-z'%]+|%", template):
        if piece in TOKENS:
            out.append(TOKENS[piece])
        elif re.fullmatch(r"[A-Za-z']+|%.", piece):
            out.append("'" + piece.replace("'", "''") + "'")
        else:
            out.append(piece)
    return "".join(out)


def date_format_mysql(x: Column, template: str) -> Column:
    return F.date_format(x.cast("timestamp_ntz"), java_pattern(template))


def str_to_date(x: Column, template: str) -> Column:
    """Text by a format; NULL where it doesn't fit."""
    return F.try_to_timestamp(x, F.lit(java_pattern(template))).cast("timestamp_ntz")


def date_add_interval(x: Column, n: int, unit: str) -> Column:
    """x plus n units; a day of the month that doesn't exist becomes the last one."""
    unit = unit.lower().rstrip("s")
    if unit in _MONTHS:
        months = n * _MONTHS[unit]
        return x + F.make_ym_interval(F.lit(0), F.lit(months))
    if unit == "week":
        unit, n = "day", n * 7
    days, hours, minutes, seconds = (n if unit == u else 0 for u in ("day", "hour", "minute", "second"))
    return x + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """b minus a by their dates alone: months are calendar months apart, weeks are whole weeks of days."""
    unit = unit.lower()
    a, b = a.cast("date"), b.cast("date")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if unit in ("month", "quarter"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return (months if unit == "month" else F.floor(months / 3)).cast("long")
    days = F.datediff(b, a)
    return F.call_function("div", days, F.lit(7)) if unit == "week" else days.cast("long")


def unix_timestamp_days(x: Column) -> Column:
    """Seconds since 1970 of a date; the time of day is left out."""
    return F.unix_date(x.cast("date")).cast("long") * 86400


def from_unixtime_utc(seconds: Column) -> Column:
    """UTC text of a number of seconds; negative numbers count as 0. Years after 9999 have no sign, which `yyyy` would give them."""
    return F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "y-MM-dd HH:mm:ss")


def week_of_year(x: Column) -> Column:
    """Whole weeks since 1 January: 0 for its first seven days."""
    return F.floor((F.dayofyear(x) - 1) / 7).cast("int")
