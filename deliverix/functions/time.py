"""Local wall-clock time without the session's zone.

An instant is epoch seconds. Its local time in a zone is a timestamp that prints as the wall clock while the
session's zone is UTC, so date functions on it are calendar functions in that zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def to_local(epoch: Column, tz: str = "UTC") -> Column:
    """Wall time of an instant; fractions of a second are cut."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch.cast("long")), tz)


def local_to_unix(local: Column, tz: str = "UTC") -> Column:
    """Instant of a wall time; the first of a repeated hour."""
    return F.unix_timestamp(F.to_utc_timestamp(local, tz))


def shift_days(local: Column, days: Column | int) -> Column:
    """Calendar days later (or earlier) at the same wall time."""
    return local + F.make_interval(days=F.lit(days) if isinstance(days, int) else days)


def local_days_shift(epoch: Column, days: Column | int, tz: str = "UTC") -> Column:
    """An instant moved by calendar days of its zone, which is not n * 86400 s across a clock change."""
    return local_to_unix(shift_days(to_local(epoch, tz), days), tz)


def period_month(local: Column) -> Column:
    return F.date_format(local, "yyyy-MM")


def period_week(local: Column) -> Column:
    """ISO week, YYYY-Www."""
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))


def month_start(local: Column) -> Column:
    return F.date_trunc("month", local)


def month_start_unix(epoch: Column, tz: str = "UTC") -> Column:
    return local_to_unix(month_start(to_local(epoch, tz)), tz)


def week_monday(local: Column) -> Column:
    return F.date_trunc("week", local)


def week_bounds(epoch: Column, tz: str = "UTC") -> dict[str, Column]:
    """period_week and the instants of its Monday 00:00 and of the next one."""
    monday = week_monday(to_local(epoch, tz))
    return {
        "period_week": period_week(to_local(epoch, tz)),
        "week_monday_unix": local_to_unix(monday, tz),
        "week_end_unix": local_to_unix(shift_days(monday, 7), tz),
    }


def week_label_to_monday(label: Column) -> Column:
    """Monday (date) of an ISO week label, from the week that holds January 4th."""
    year, week = F.substring(label, 1, 4).cast("int"), F.substring(label, 7, 2).cast("int")
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)))
    return F.to_date(first + F.make_interval(weeks=week - 1))


def week_tick(label: Column) -> Column:
    """MM/DD of a week's Monday."""
    return F.date_format(week_label_to_monday(label), "MM/dd")


def wall_minutes(later: Column, earlier: Column) -> Column:
    """Minutes between two wall times, with two decimals."""
    return F.round((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 60, 2)


def _ctime(value: Column) -> Column:
    """Month and day of 'Fri Sep 29 00:00:00 2023', without the name of the day, which is not checked against the date."""
    rest = F.regexp_extract(F.trim(value), r"^(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(\w{3}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2}\s+\d{4})$", 1)
    tidy = F.initcap(F.regexp_replace(rest, r"\s+", " "))
    return F.try_to_timestamp(F.nullif(tidy, F.lit("")), F.lit("MMM d H:m:s yyyy"))


def normalize_date(value: Column, to: str = "YYYY-MM") -> Column:
    """'YYYY-M', 'YYYY-MM' or ctime text as 'YYYY-MM' or ctime; anything else unchanged. Months are 1 to 12, a missing day is 1."""
    month_re = r"^\s*([+-]?\d+)\s*-\s*(\d+)\s*$"
    year, month = F.regexp_extract(value, month_re, 1), F.regexp_extract(value, month_re, 2).try_cast("int")
    ok = value.rlike(month_re) & month.between(1, 12)
    when = _ctime(value)
    year_number = year.try_cast("int")
    if to == "YYYY-MM":
        return F.when(ok, F.concat(year_number.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).when(when.isNotNull(), F.concat(F.year(when).cast("string"), F.date_format(when, "-MM"))).otherwise(value)
    if to == "ctime":
        # the day's name is always that of the first weekday, which the formatted time leaves unset
        shown = lambda d: F.concat(F.lit("Mon "), F.date_format(d, "MMM dd HH:mm:ss "), F.year(d).cast("string"))
        day = F.to_timestamp(F.to_date(F.coalesce(F.make_date(year_number, month, F.lit(1)), F.to_date(when))))
        return F.when(ok | when.isNotNull(), shown(day)).otherwise(value)
    return value


def normalize_month_key(value: Column) -> Column:
    return normalize_date(value, "YYYY-MM")
