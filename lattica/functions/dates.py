"""Date and timestamp functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(field: str, d: Column) -> Column:
    """year, month, day, weekday (0 is Monday), day_of_year, quarter, hour, minute or second as an integer."""
    made = {"year": F.year, "month": F.month, "day": F.day, "weekday": F.weekday, "day_of_year": F.dayofyear, "quarter": F.quarter, "hour": F.hour, "minute": F.minute, "second": F.second}
    if field not in made:
        raise ValueError(f"unknown field {field!r}")
    return made[field](d).cast("bigint")


def truncate(d: Column, unit: str) -> Column:
    """To the first day of the year, quarter, month or week (Monday); other units leave it."""
    return F.trunc(d, unit) if unit in ("year", "quarter", "month", "week") else d


def add(d: Column, n: Column | int, unit: str) -> Column:
    """n days, weeks, months or years later, clamped to the month's end; other units leave it."""
    n = F.lit(n) if isinstance(n, int) else n
    made = {"day": lambda: F.date_add(d, n), "week": lambda: F.date_add(d, n * 7), "month": lambda: F.add_months(d, n), "year": lambda: F.add_months(d, n * 12)}
    return made[unit]() if unit in made else d


def diff_days(a: Column, b: Column) -> Column:
    return F.datediff(b, a).cast("bigint")


def diff_months(a: Column, b: Column) -> Column:
    """Difference of year and month, less one where b's day is before a's."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.day(b) < F.day(a)).cast("int")).cast("bigint")


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def parse_date(s: Column) -> Column:
    """YYYY-MM-DD; NULL for anything else and for days that do not exist."""
    return F.when(s.rlike(r"^-?\d{4,}-\d{2}-\d{2}$"), s.try_cast("date"))


def parse_timestamp(s: Column) -> Column:
    """Date and optional time after T or a space; minutes, seconds and fraction are optional."""
    whole = F.regexp_replace(F.regexp_replace(s, r"^(\S{10}[T ]\d{2})$", "$1:00"), r"(\.\d{6})\d+$", "$1")
    return F.when(s.rlike(r"^-?\d{4,}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?$"), whole.try_cast("timestamp_ntz"))


def add_seconds(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))


def micros_until(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1)))).cast("bigint")


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
