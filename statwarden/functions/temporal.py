"""Time differences that count the boundaries crossed, not the elapsed units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minute_boundaries(start: Column, end: Column) -> Column:
    """Minute marks between two instants: 10:00:59 -> 10:01:00 counts one."""

    def minute(ts):
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60)

    return minute(end) - minute(start)


def elapsed_millis(start: Column, end: Column) -> Column:
    def millis(ts):
        return F.unix_millis(ts.cast("timestamp"))

    return millis(end) - millis(start)


def add_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def add_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))
