"""Time expressions. Callers pass the reference time; nothing here reads a clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(col: Column) -> Column:
    return F.to_date(col)


def date_literal(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def ntz_literal(as_of: dt.datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def since_day(col: Column, as_of: dt.date | str, days: int) -> Column:
    """Calendar window: from midnight `days` days before as_of."""
    return col >= F.date_add(date_literal(as_of), -days).cast("timestamp_ntz")


def since_instant(col: Column, as_of: dt.datetime | str, days: int) -> Column:
    """Instant window: from exactly `days` x 24 hours before as_of."""
    return col >= ntz_literal(as_of) - F.make_dt_interval(days=F.lit(days))


def older_than(col: Column, as_of: dt.datetime | str, minutes: int) -> Column:
    return col < ntz_literal(as_of) - F.make_dt_interval(mins=F.lit(minutes))


def valid_at(start: Column, end: Column, as_of: dt.datetime | str) -> Column:
    return ntz_literal(as_of).between(start, end)


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes between two times, cut off towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def whole_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def rounded_minutes(start: Column, end: Column) -> Column:
    """Minutes between two times, rounded half away from zero to an integer."""
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0), 0).cast("int")


def local_time(col: Column, zone: Column) -> Column:
    """Wall-clock time in `zone` of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), zone, col)


def local_hour(col: Column, zone: Column) -> Column:
    return F.hour(local_time(col, zone))


def local_weekday(col: Column, zone: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(local_time(col, zone)) - 1
