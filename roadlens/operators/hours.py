"""Segment-hours with their road attributes: the base of every speed report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import measures, timeaxis
from roadlens.functions.predicates import has_speed, in_region, in_window
from roadlens.params import Job


def hours_in_window(hourly: DataFrame, job: Job) -> DataFrame:
    """Hours of the window that carry a speed; the filter reaches the scan."""
    return hourly.filter(in_window(job) & has_speed())


def with_percentiles(hours: DataFrame) -> DataFrame:
    """p15 and p85 as columns of their own.

    Taken out of the array below the join, so a report that needs no more than these two lets the array
    of 19 go before the hours move.
    """
    return hours.withColumns({"p15_kph": measures.percentile_at(fixed.P15_POSITION),
                              "p85_kph": measures.percentile_at(fixed.P85_POSITION)})


def segment_keys(hourly: DataFrame, segments: DataFrame) -> list[str]:
    """Columns that join hours to their segment: the id, and the tile where both sides carry it.

    A segment lies in one tile, so the tile changes no row. As a key it lets a fact that is laid out by tile be
    pruned while the job runs, to the tiles that the filtered segments turn out to lie in.
    """
    return ["dseg_id", *(["tile_id"] if "tile_id" in hourly.columns and "tile_id" in segments.columns else [])]


def road_hours(hourly: DataFrame, segments: DataFrame, job: Job) -> DataFrame:
    """Hours of the window joined to the attributes of their segment.

    No hint on the join. Segments outnumber any broadcast limit in a large extract, so the choice
    is left to the sizes Spark measures: it broadcasts a small region, reads tables that are laid out
    alike without moving them (`sources.colocated`), and otherwise shuffles both
    sides on the segment id, splitting a partition that one segment has made large.
    """
    roads = segments.filter(in_region(job)).drop("map_version")
    hours = with_percentiles(hours_in_window(hourly, job)).drop("map_version")
    return hours.join(roads, segment_keys(hours, roads)).drop("tile_id")


def measured(hourly: DataFrame, segments: DataFrame, job: Job) -> DataFrame:
    """Segment-hours with local hour, weekend, speeding and congested flags.

    `is_weekend` follows the UTC date and `hour_local` the segment's own zone. The two flags are
    NULL where the hour cannot tell, so their averages are rates over the hours that can.
    """
    hours = road_hours(hourly, segments, job)
    return hours.select(
        "dseg_id", "observation_date", "hour_utc", "avg_speed_kph", "harmonic_speed_kph", "median_speed_kph",
        "speed_percentiles_kph", "p15_kph", "p85_kph", "frc", "speed_limit_kph", "length_m", "h3_r9",
        "min_lon", "min_lat", "max_lon", "max_lat",
        timeaxis.is_weekend(F.col("observation_date")).alias("is_weekend"),
        timeaxis.hour_of_day(timeaxis.local_hours()).alias("hour_local"),
        measures.speeding().alias("speeding"),
        measures.congested().alias("congested"))
