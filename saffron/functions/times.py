"""Calendar helpers. Weekday numbers differ between sources, so each use names its encoding."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Weekday(Enum):
    SUNDAY_1 = "Sunday is 1"
    MONDAY_0 = "Monday is 0"
    SUNDAY_0 = "Sunday is 0"
    ISO = "Monday is 1"


def weekday(day: Column, encoding: Weekday) -> Column:
    n = F.dayofweek(day)
    return {Weekday.SUNDAY_1: n, Weekday.SUNDAY_0: n - 1, Weekday.MONDAY_0: F.pmod(n + 5, F.lit(7)), Weekday.ISO: F.pmod(n + 5, F.lit(7)) + 1}[encoding].cast("int")


def is_weekend(day: Column) -> Column:
    return weekday(day, Weekday.MONDAY_0) >= 5


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week(day: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def hour_of_week(at: Column) -> Column:
    """24 (Sunday at midnight) to 191."""
    return (F.dayofweek(at) * 24 + F.hour(at)).cast("int")


def in_last_days(day: Column, as_of: Column, days: int, skip: int = 0) -> Column:
    """Within ``days`` days that end ``skip`` days before ``as_of``, the last day included."""
    return (day > F.date_sub(as_of, days + skip)) & (day <= F.date_sub(as_of, skip))
