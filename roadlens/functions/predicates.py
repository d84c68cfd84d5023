"""Row filters as Column predicates; all reach the scan when the source is columnar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.params import Box, Job


def box_overlaps(box: Box, prefix: str = "") -> Column:
    """Features whose flat bounding-box columns touch `box`."""
    edge = lambda name: F.col(prefix + name)
    return ((edge("max_lon") >= box.west) & (edge("min_lon") <= box.east)
            & (edge("max_lat") >= box.south) & (edge("min_lat") <= box.north))


def bbox_overlaps(box: Box, column: str = "bbox") -> Column:
    """Features whose bounding-box struct touches `box`."""
    edge = lambda name: F.col(f"{column}.{name}")
    return ((edge("xmax") >= box.west) & (edge("xmin") <= box.east)
            & (edge("ymax") >= box.south) & (edge("ymin") <= box.north))


def centre_inside(box: Box) -> Column:
    """Features whose bounding-box centre lies in `box`, edges included."""
    lon = (F.col("min_lon") + F.col("max_lon")) / 2
    lat = (F.col("min_lat") + F.col("max_lat")) / 2
    return lon.between(box.west, box.east) & lat.between(box.south, box.north)


def in_region(job: Job) -> Column:
    return F.lit(True) if job.region is None else F.col("region") == job.region


def in_vintage(job: Job) -> Column:
    return F.lit(True) if job.vintage_year is None else F.col("vintage_year") == job.vintage_year


def in_window(job: Job) -> Column:
    """Observation dates of the job; prunes partitions when the table is laid out by date."""
    keep = F.lit(True)
    if job.first_date is not None:
        keep = keep & (F.col("observation_date") >= F.lit(job.first_date))
    if job.last_date is not None:
        keep = keep & (F.col("observation_date") <= F.lit(job.last_date))
    return keep


def has_speed() -> Column:
    return F.col("harmonic_speed_kph") > 0


def has_limit() -> Column:
    return F.col("speed_limit_kph") > 0


def has_distribution() -> Column:
    return F.col("speed_percentiles_kph").isNotNull()


def is_road() -> Column:
    return F.col("subtype") == "road"


def is_driveable(column: str = "road_class") -> Column:
    return F.col(column).isin(fixed.DRIVEABLE)


def on_ways(way_ids: list[int], column: str = "osm_way_ids") -> Column:
    """Whether a segment lies on any of the matched ways; NULL when that cannot be decided."""
    return F.arrays_overlap(F.col(column),
                            F.array(*[F.lit(way).cast("bigint") for way in way_ids]))


def on_named_road(street: str, limit_kph: float) -> Column:
    return (F.col("street_name") == street) & (F.round("speed_limit_kph") == limit_kph)
