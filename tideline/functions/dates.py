"""Calendar keys as DATE columns.

Grouping keys stay four-byte dates while rows are many; text labels such as
``2024-03`` are made from the few grouped rows. ``date_trunc`` and
``date_format`` are not used because both go through the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ts: Column | str) -> Column:
    return F.to_date(ts)


def week_of(day: Column | str) -> Column:
    """Monday of the ISO week."""
    return F.trunc(F.to_date(day), "week")


def month_of(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "month")


def month_label(month: Column | str) -> Column:
    """``yyyy-MM`` text of a date."""
    column = F.col(month) if isinstance(month, str) else month
    return F.substring(column.cast("string"), 1, 7)


def months_between_starts(first: Column | str, second: Column | str) -> Column:
    """Whole months from one month start to another."""
    years = F.year(second) - F.year(first)
    return (years * 12 + F.month(second) - F.month(first)).cast("bigint")


def whole_minutes(start: Column | str, end: Column | str) -> Column:
    """Signed whole minutes from one local time to another, cut towards zero.

    Subtracts local times; ``timestamp_diff`` would first place them in the session
    time zone, where a time skipped by daylight saving moves by an hour.
    """
    first = (F.col(start) if isinstance(start, str) else start).cast("timestamp_ntz")
    last = (F.col(end) if isinstance(end, str) else end).cast("timestamp_ntz")
    return (last - first).cast("interval minute").cast("bigint")


def is_midnight(ts: Column | str) -> Column:
    column = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return column == column.cast("date").cast("timestamp_ntz")
