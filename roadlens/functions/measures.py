"""Speed conditions, unit conversion and aggregate building blocks as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens import fixed


def percentile_at(position: int) -> Column:
    """One of the 19 speed percentiles, counted from 1; NULL for a missing or short array."""
    return F.try_element_at("speed_percentiles_kph", F.lit(position))


def speeding() -> Column:
    """p85 above the limit; NULL where the hour has no distribution or the road no limit."""
    return F.when(F.col("speed_limit_kph") > 0,
                  F.col("p85_kph") > F.col("speed_limit_kph"))


def congested() -> Column:
    """Harmonic mean below 60 % of the limit; NULL where the road has no limit."""
    return F.when(F.col("speed_limit_kph") > 0,
                  F.col("harmonic_speed_kph") < fixed.JAM_SHARE * F.col("speed_limit_kph"))


def positions_above(limit: Column) -> Column:
    """How many of the 19 percentiles lie above `limit`.

    Nineteen comparisons instead of a filter over the array: a lambda is interpreted for every
    element, plain comparisons are compiled with the rest of the stage.
    """
    above = [F.coalesce((F.get("speed_percentiles_kph", F.lit(i)) > limit).cast("int"), F.lit(0))
             for i in range(len(fixed.PERCENTILE_LEVELS))]
    return sum(above[1:], above[0])


def over_limit_share() -> Column:
    """Share of the hour's vehicles above the limit, 0 to 0.95; NULL without a distribution."""
    return F.when(F.col("speed_percentiles_kph").isNotNull(),
                  positions_above(F.col("speed_limit_kph")) / F.lit(fixed.PERCENTILE_STEPS))


def spread_ratio() -> Column:
    return F.col("stddev_speed_kph") / F.col("harmonic_speed_kph")


def wide_spread() -> Column:
    return (spread_ratio() > fixed.WIDE_SPREAD).cast("int")


def jammed() -> Column:
    return (F.col("harmonic_speed_kph") < fixed.JAM_SHARE * F.col("speed_limit_kph")).cast("int")


def percent_true(flag: Column) -> Column:
    """Percentage of rows where `flag` holds, over the rows where it is known."""
    return 100.0 * F.avg(flag.cast("int"))


def mph(speed: Column) -> Column:
    """A `{value, unit}` speed in miles per hour; NULL for a unit that is neither."""
    value, unit = speed.getField("value"), speed.getField("unit")
    return (F.when(unit == "mph", value.cast("double"))
            .when(unit == "km/h", F.round(value / F.lit(fixed.KMH_PER_MPH))))


def whole_segment_limit() -> Column:
    """The posted limit that holds for every vehicle: the first element without a condition."""
    for_everyone = F.filter("speed_limits", lambda limit: limit["when"].isNull())
    return F.try_element_at(for_everyone, F.lit(1)).getField("max_speed")


def first_profile_speed(name: str) -> Column:
    """`week_speed` or `freeflow_speed` of the first speed profile."""
    return F.try_element_at("speed_profiles", F.lit(1)).getField(name)


def histogram_bucket(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal-width bucket, values outside the range going to the end buckets."""
    raw = F.floor((value - F.lit(float(low))) * bins / F.lit(float(high - low)))
    return F.least(F.lit(bins - 1).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), raw))


def bucket_middle(bucket: Column, low: float, high: float, bins: int) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * (bucket + F.lit(0.5)) / bins


def weighted_avg(value: Column, weight: Column) -> Column:
    """Mean of `value` weighted by `weight`, over the rows where both are known."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def vehicle_km(vehicles: Column, length_m: Column | None = None) -> Column:
    """Kilometres driven by `vehicles` on the segment."""
    return vehicles * (F.col("length_m") if length_m is None else length_m) / 1000.0


def mean_of_days(first: int, count: int) -> Column:
    """Mean of `count` values of the Monday-first day profile, starting at day `first` (1-based)."""
    total = F.aggregate(F.slice("aadt_by_day", first, count), F.lit(0.0),
                        lambda total, day: total + day)
    return total / count
