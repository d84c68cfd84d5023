"""UTC date and hour to local time, hour of week, weekend and peak.

Local time is carried as whole wall-clock hours since Thursday 1 January 1970, 00:00. One time-zone
conversion per row gives it, and hour of day, day of week and hour of week are integer remainders
of it, whatever the session's own time zone is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens import fixed

_EPOCH_DAY = 3  # 1 January 1970 was a Thursday, Monday being 0


def local_hours() -> Column:
    """Wall-clock hours since the epoch, from the UTC date and hour and the segment's zone."""
    utc_hours = F.unix_date("observation_date").cast("bigint") * 24 + F.col("hour_utc")
    local = F.from_utc_timestamp(F.timestamp_seconds(utc_hours * 3600), F.col("time_zone"))
    return F.floor(F.unix_seconds(local) / 3600)


def hour_of_day(hours: Column) -> Column:
    return F.pmod(hours, F.lit(24)).cast("int")


def hour_of_week(hours: Column) -> Column:
    """Slot 0 is Monday 00:00."""
    return F.pmod(hours + _EPOCH_DAY * 24, F.lit(fixed.SLOTS_PER_WEEK)).cast("int")


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def is_weekday_peak(hours: Column) -> Column:
    """Monday to Friday, in the hours of `fixed.PEAK_HOURS`."""
    return (hour_of_week(hours) < 5 * 24) & hour_of_day(hours).isin(fixed.PEAK_HOURS)
