"""Risky kilometres: how much is driven where and when, and in which condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import geometry, grid, measures, timeaxis
from roadlens.functions.predicates import (has_distribution, has_limit, in_region, in_vintage,
                                           in_window, on_named_road, on_ways)
from roadlens.operators.hours import road_hours
from roadlens.operators.week import week_totals
from roadlens.params import Job
from roadlens.sources.tables import RoadTables, require_rows

CONDITIONS = ["over_limit", "wide_spread", "jammed"]
KILOMETRES = ["vehicle_km", "measured_km"] + [f"{name}_km" for name in CONDITIONS]


def cell_week(volumes: DataFrame, job: Job) -> DataFrame:
    """Vehicle-kilometres of each cell in each hour of the week."""
    roads = volumes.filter(in_region(job) & in_vintage(job))
    return week_totals(roads, ["h3_r9"], "aadt_by_day_hour", F.col("length_m") / 1000.0,
                       "vehicle_km")


def cell_conditions(hourly: DataFrame, segments: DataFrame, job: Job) -> DataFrame:
    """Length-weighted share of each condition, per cell and local hour of the week.

    Only hours with a distribution on roads with a limit can be read; the rest stay unmeasured.
    An hour whose local time is unknown falls into slot -1, which no driving matches. As the slot is
    never NULL, the join above needs no NULL check that would convert every hour's time twice.
    """
    slot = F.coalesce(timeaxis.hour_of_week(timeaxis.local_hours()), F.lit(-1))
    readable = hourly.filter(has_distribution())
    hours = road_hours(readable, segments.filter(has_limit()), job).select(
        "h3_r9", "length_m",
        slot.alias("slot"),
        measures.over_limit_share().alias("over_limit"),
        measures.wide_spread().alias("wide_spread"),
        measures.jammed().alias("jammed"))
    metres = F.sum("length_m")
    return hours.groupBy("h3_r9", "slot").agg(
        *[F.try_divide(F.sum(F.col("length_m") * F.col(name)), metres).alias(name)
          for name in CONDITIONS])


def cell_slot_km(tables: RoadTables, job: Job) -> DataFrame:
    """Driven, measured and risky kilometres of each cell and hour of the week.

    Each side is added up to cell and slot before they meet, so hours never multiply roads.
    """
    driven = cell_week(tables.volumes, job)
    conditions = cell_conditions(tables.hourly, tables.segments, job)
    km = F.col("vehicle_km")
    return driven.join(conditions, ["h3_r9", "slot"], "left").select(
        "h3_r9", "slot", "vehicle_km",
        F.when(F.col("over_limit").isNotNull(), km).alias("measured_km"),
        *[(km * F.col(name)).alias(f"{name}_km") for name in CONDITIONS])


def _summed(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in KILOMETRES])


def risky_km_by_slot(cell_slots: DataFrame) -> DataFrame:
    """The week hour by hour: kilometres driven and the share of measured ones per condition.

    All 168 slots are returned; one in which nothing is driven has NULLs.
    """
    spark = cell_slots.sparkSession
    slots = spark.range(fixed.SLOTS_PER_WEEK).select(F.col("id").cast("int").alias("slot"))
    week = _summed(cell_slots, "slot")
    return slots.join(week, "slot", "left").select(
        "slot", *KILOMETRES,
        *[(100.0 * F.try_divide(F.col(f"{name}_km"), F.col("measured_km"))).alias(f"{name}_pct")
          for name in CONDITIONS])


def risky_totals(cell_slots: DataFrame) -> DataFrame:
    """Kilometres per day and share of the measured driving, one row per condition."""
    week = _summed(cell_slots)
    per_day = lambda name: F.col(name) / fixed.DAYS_PER_WEEK
    rows = F.array(*[
        F.struct(F.lit(name).alias("condition"),
                 per_day(f"{name}_km").alias("km_per_day"),
                 (100.0 * F.try_divide(F.col(f"{name}_km"), F.col("measured_km")))
                 .alias("pct_of_measured"))
        for name in CONDITIONS])
    return week.select(per_day("vehicle_km").alias("driven_km_per_day"),
                       (100.0 * F.try_divide(F.col("measured_km"), F.col("vehicle_km")))
                       .alias("measured_pct"),
                       F.inline(rows))


def hexagon_slots(cell_slots: DataFrame, resolution: int = 6) -> DataFrame:
    """Kilometres of each hexagon and hour of the week; cells without an id have no hexagon."""
    placed = cell_slots.filter(F.col("h3_r9").isNotNull())
    return _summed(placed.withColumn("hexagon", grid.h3_parent(F.col("h3_r9"), resolution)),
                   "hexagon", "slot")


def risky_km_by_hexagon(cell_slots: DataFrame, resolution: int = 6,
                        floor_km: float = fixed.MIN_MEASURED_KM_PER_DAY) -> DataFrame:
    """Kilometres per day of each hexagon; shares are NULL where too little is measured."""
    placed = cell_slots.filter(F.col("h3_r9").isNotNull())
    per_day = _summed(
        placed.withColumn("hexagon", grid.h3_parent(F.col("h3_r9"), resolution)), "hexagon"
    ).select("hexagon", *[(F.col(name) / fixed.DAYS_PER_WEEK).alias(name) for name in KILOMETRES])
    enough = F.col("measured_km") >= floor_km
    return per_day.filter(F.col("vehicle_km") > 0).select(
        "hexagon", *KILOMETRES,
        *[F.when(enough, 100.0 * F.try_divide(F.col(f"{name}_km"), F.col("measured_km")))
          .alias(f"{name}_pct") for name in CONDITIONS])


def route_hours(tables: RoadTables, job: Job, way_ids: list[int], nearby_street: str,
                nearby_limit_kph: float) -> DataFrame:
    """Hours of the matched route and of the road beside it, told apart by `on_route`.

    The segments are cut down before the join, so only their hours are joined.
    """
    nearby = on_named_road(nearby_street, nearby_limit_kph)
    roads = tables.segments.filter(on_ways(way_ids) | nearby).withColumn("on_route", on_ways(way_ids))
    hours = tables.hourly.filter(has_distribution() & in_window(job)).drop("tile_id", "map_version")
    return hours.join(roads.filter(in_region(job)).drop("tile_id", "map_version"), "dseg_id").select(
        "dseg_id", "street_name", "speed_limit_kph", "length_m", "geometry_wkt", "on_route",
        timeaxis.hour_of_day(timeaxis.local_hours()).alias("hour_local"),
        "harmonic_speed_kph", "speed_percentiles_kph")


def require_route(hours: DataFrame, way_ids: list[int], job: Job) -> DataFrame:
    require_rows(hours.filter("on_route").select("dseg_id"),
                 f"segment of region '{job.region}' lies on the ways {way_ids}",
                 "Choose the region the trip was driven in, or ways from its matched trace.")
    return hours


TRIP_ROWS_PER_TASK = 500_000


def trip_segments(trips: DataFrame, segments: DataFrame, rows_per_task: int = TRIP_ROWS_PER_TASK) -> DataFrame:
    """Segments of many matched trips: `trips` has `trip_id` and one `osm_way_id` per row.

    The array of way ids becomes rows and an equi-join, which shuffles by way id, where an array
    overlap would compare every trip with every segment. Nothing is made distinct before the join: its rows are
    dealt by trip, over one task for every `rows_per_task` rows of `trips`, and each task drops the repeats
    of its own trips. So the memory of a task stays the same however many trips there are.
    """
    ways = segments.select("dseg_id", F.explode("osm_way_ids").alias("osm_way_id"))
    found = trips.select("trip_id", "osm_way_id").join(ways, "osm_way_id").select("trip_id", "dseg_id")
    return found.repartition(trips.count() // rows_per_task + 1, "trip_id").distinct()


def route_profile(hours: DataFrame) -> DataFrame:
    """Mean speed, middle 70 % and limit of the route by local hour."""
    return hours.filter("on_route").groupBy("hour_local").agg(
        F.avg("harmonic_speed_kph").alias("harmonic_mean_kph"),
        F.avg(measures.percentile_at(fixed.P15_POSITION)).alias("p15_kph"),
        F.avg(measures.percentile_at(fixed.P85_POSITION)).alias("p85_kph"),
        F.avg("speed_limit_kph").alias("limit_kph"))


def percentile_rank(speed: float, curve: Column) -> Column:
    """Level, in per cent, of `speed` on a 19-value curve; 0 below p5 and 100 above p95.

    Between two levels it is interpolated; on a flat stretch the highest level counts.
    """
    levels = F.array(*[F.lit(float(level)) for level in fixed.PERCENTILE_LEVELS])
    target = F.lit(float(speed))
    below = F.size(F.filter(curve, lambda value: value <= target))
    low, high = F.get(curve, below - 1), F.get(curve, below)
    step = F.try_divide(target - low, high - low)
    return (F.when(target < F.get(curve, F.lit(0)), F.lit(0.0))
            .when(target > F.get(curve, F.lit(18)), F.lit(100.0))
            .when(below == 19, F.lit(95.0))
            .otherwise(F.get(levels, below - 1) + 5.0 * step))


def speed_on_distribution(hours: DataFrame, speed: float, at_hours: list[int],
                          route_name: str, nearby_name: str) -> DataFrame:
    """Where one speed falls on the typical distribution of each road at each hour.

    The typical distribution is the position-by-position mean of the percentile arrays.
    """
    road = F.when(F.col("on_route"), F.lit(route_name)).otherwise(F.lit(nearby_name))
    positions = range(1, len(fixed.PERCENTILE_LEVELS) + 1)
    typical = hours.filter(F.col("hour_local").isin(at_hours) & F.col("on_route").isNotNull()) \
        .groupBy(road.alias("road"), "hour_local").agg(
            F.avg("speed_limit_kph").alias("_limit"),
            *[F.avg(measures.percentile_at(p)).alias(f"_p{p}") for p in positions])
    curve = F.array(*[F.col(f"_p{p}") for p in positions])
    rank = F.col("_rank")
    return typical.withColumn("_rank", percentile_rank(speed, curve)).select(
        "road", "hour_local",
        F.round("_limit").alias("limit_kph"),
        F.round(F.col(f"_p{fixed.P50_POSITION}")).alias("median_kph"),
        F.round(F.col(f"_p{fixed.P85_POSITION}")).alias("p85_kph"),
        F.when(rank == 0, F.lit("slower than 95%"))
        .when(rank == 100, F.lit("faster than 95%"))
        .otherwise(F.concat(F.lit("faster than "), F.bround(rank).cast("int").cast("string"),
                            F.lit("%"))).alias("standing"))


def segment_over_limit(hours: DataFrame) -> DataFrame:
    """Share of vehicles over the limit on each segment of the route, with its geometry.

    The percentiles leave the top 5 % unread, so a road where everyone speeds counts 95 of 100
    and the share is stretched accordingly. Without a limit the share is NULL.
    """
    share = F.when(F.col("speed_limit_kph").isNotNull(),
                   100.0 * measures.positions_above(F.col("speed_limit_kph"))
                   / len(fixed.PERCENTILE_LEVELS))
    return hours.filter("on_route").groupBy("dseg_id").agg(
        F.min("street_name").alias("street_name"), F.min("geometry_wkt").alias("geometry_wkt"),
        F.round(F.min("speed_limit_kph"), 1).alias("speed_limit_kph"),
        F.round(F.avg("harmonic_speed_kph"), 1).alias("mean_speed_kph"),
        F.round(F.round(F.avg(share), 1) * 100.0 / 95.0, 1).alias("over_limit_pct"))


def segment_features(segments: DataFrame, properties: list[str]) -> DataFrame:
    """GeoJSON features of segments that carry a WKT line."""
    from roadlens.sources.export import geojson_features
    return geojson_features(segments,
                            geometry.geojson_line(geometry.wkt_vertices(F.col("geometry_wkt"))),
                            properties)


ROUTE_PROPERTIES = ["dseg_id", "street_name", "over_limit_pct", "mean_speed_kph", "speed_limit_kph"]


def route_features(hours: DataFrame) -> DataFrame:
    """GeoJSON features of the route's segments with the share of vehicles over the limit."""
    from roadlens.sources.export import geojson_features
    return geojson_features(segment_over_limit(hours),
                            geometry.geojson_line(geometry.wkt_vertices(F.col("geometry_wkt"))), ROUTE_PROPERTIES)
