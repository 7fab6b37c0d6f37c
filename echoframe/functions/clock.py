"""Turning timestamps into the numeric clocks the engine works on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, whatever the session time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def hours(ts: Column, since_hours: float = 0.0) -> Column:
    return micros(ts) / MICROS_PER_HOUR - since_hours


def days(ts: Column) -> Column:
    return micros(ts) / (24 * MICROS_PER_HOUR)
