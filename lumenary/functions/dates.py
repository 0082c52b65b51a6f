"""Column functions on ISO date strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(c: Column) -> Column:
    """Timestamp of an ISO string, offset or ``Z`` heeded, naive ones as UTC; null where unreadable."""
    return F.try_to_timestamp(c)


def local_day(c: Column) -> Column:
    """The day that the string itself names."""
    return F.try_to_date(F.substring(c, 1, 10))


def utc_day(c: Column) -> Column:
    return F.to_date(instant(c))


def window_start(end: Column, days: int) -> Column:
    """First day of a window of ``days`` days that ends with ``end``."""
    return F.date_sub(end, days - 1)


def display(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")
