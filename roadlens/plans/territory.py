"""From roads to postcodes: the cell layer, postcode labels, features and the claims panel."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import geometry, grid, measures, timeaxis
from roadlens.functions.predicates import has_limit, in_region, in_vintage, is_road
from roadlens.operators.hours import road_hours
from roadlens.operators.nearest import nearest_around, nearest_within
from roadlens.params import Job
from roadlens.session import durable
from roadlens.sources.tables import RoadTables

LEVEL = grid.LEVEL_FOR_RESOLUTION[9]

# Adds `easting` and `northing` to rows with `lon` and `lat`. Without one, distances follow the great circle.
Projection = Callable[[DataFrame], DataFrame] | None

VOLUME_COLUMNS = ["volume_km", "vehicle_km_per_day", "major_vehicle_km_per_day",
                  "weekday_vehicle_km_per_day", "weekend_vehicle_km_per_day"]


def volume_cells(volumes: DataFrame, job: Job, cell: Column) -> DataFrame:
    """Kilometres, traffic, major-road traffic and weekday and weekend traffic of each cell."""
    km = lambda vehicles: F.sum(measures.vehicle_km(vehicles))
    major = F.when(F.col("frc") <= 2, F.col("aadt")).otherwise(F.lit(0.0))
    return volumes.filter(in_region(job) & in_vintage(job)).groupBy(cell.alias("cell")).agg(
        (F.sum("length_m") / 1000).alias("volume_km"),
        km(F.col("aadt")).alias("vehicle_km_per_day"),
        km(major).alias("major_vehicle_km_per_day"),
        km(measures.mean_of_days(1, 5)).alias("weekday_vehicle_km_per_day"),
        km(measures.mean_of_days(6, 2)).alias("weekend_vehicle_km_per_day"))


def road_signals(hourly: DataFrame, segments: DataFrame, job: Job, cell: Column) -> DataFrame:
    """Mean and peak speed, spread, jams, speeding and thin hours of each measured segment.

    An hour of one vehicle has no distribution: it counts for the mean, not for speeding, and its
    share is a signal of its own. Peak is Monday to Friday in local time.
    """
    roads = segments.filter(has_limit()).withColumn("cell", cell)
    hours = road_hours(hourly, roads, job).select(
        "dseg_id", "cell", "length_m", F.col("harmonic_speed_kph").alias("speed"),
        measures.spread_ratio().alias("spread"), measures.jammed().alias("jammed"),
        measures.speeding().alias("speeding"),
        F.col("p85_kph").isNull().alias("lone"),
        timeaxis.is_weekday_peak(timeaxis.local_hours()).alias("peak"))
    return hours.groupBy("dseg_id").agg(
        F.min("cell").alias("cell"), F.min("length_m").alias("length_m"),
        F.avg("speed").alias("mean_speed_kph"),
        F.avg(F.when(F.col("peak"), F.col("speed"))).alias("peak_speed_kph"),
        F.avg("spread").alias("speed_spread"),
        (100.0 * F.avg("jammed")).alias("congested_hours_pct"),
        measures.percent_true(F.col("speeding")).alias("speeding_hours_pct"),
        measures.percent_true(F.col("lone")).alias("single_observation_pct"))


def cell_layer(tables: RoadTables, job: Job, cell: Column) -> DataFrame:
    """Every mapped cell with its traffic and speed signals; what is not measured stays NULL.

    Each table is reduced to one row per cell on its own, so the two joins neither multiply rows nor
    move them again: all three sides are already laid out by cell.
    """
    mapped = tables.segments.filter(in_region(job)).groupBy(cell.alias("cell")).agg(
        (F.sum("length_m") / 1000).alias("map_km"))
    signals = road_signals(tables.hourly, tables.segments, job, cell).groupBy("cell").agg(
        F.count("*").alias("observed_segments"), F.avg("mean_speed_kph").alias("naive_speed_kph"),
        *[measures.weighted_avg(F.col(name), F.col("length_m")).alias(name)
          for name in fixed.SPEED_SIGNALS])
    return mapped.join(volume_cells(tables.volumes, job, cell), "cell", "left") \
        .join(signals, "cell", "left")


def reach_summary(cells: DataFrame) -> DataFrame:
    """Cells and road kilometres on the map, with traffic, with speeds, and with both."""
    volume, speed = F.col("vehicle_km_per_day").isNotNull(), F.col("mean_speed_kph").isNotNull()
    kinds = {"on the map": F.lit(True), "with a traffic estimate": volume,
             "with observed speeds": speed, "with both": volume & speed}
    one = cells.agg(*[
        part for i, test in enumerate(kinds.values()) for part in (
            F.count(F.when(test, 1)).alias(f"cells{i}"),
            F.round(F.coalesce(F.sum(F.when(test, F.col("map_km"))), F.lit(0.0))).alias(f"km{i}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("reach"), F.col(f"cells{i}").alias("map_cells"),
                 F.col(f"km{i}").alias("road_km")) for i, kind in enumerate(kinds)])))


def _codes(map_segments: DataFrame, job: Job) -> DataFrame:
    """One row per road with all of its codes, each with the detail flag and the postcode in it."""
    pattern = fixed.POSTCODE_PATTERNS[job.postcode_level]
    codes = F.flatten(F.transform("postal_codes", lambda group: F.transform(
        group["postal_codes"], lambda code: F.struct(
            group["detailed"].alias("detailed"), code.alias("code"),
            F.regexp_extract(code, pattern, 1).alias("postcode")))))
    return map_segments.filter(in_region(job) & is_road()) \
        .withColumn("codes", F.filter(codes, lambda code: code["postcode"] != ""))


def cell_postcode(map_segments: DataFrame, job: Job, level: int = LEVEL,
                  count_by: str = "code") -> DataFrame:
    """The postcode most rows of a cell carry; equal counts go to the first in the alphabet.

    A road counts once for each of its codes, or once for each of its postcodes with
    `count_by="road"`. A road's line is decoded once, before its cells and codes become rows.
    """
    roads = _codes(map_segments, job).filter(F.size("codes") > 0)
    postcodes = F.transform("codes", lambda code: code["postcode"])
    if count_by == "road":
        postcodes = F.array_distinct(postcodes)
    rows = roads.select(geometry.wkb_cells(F.col("geometry"), level).alias("cells"), postcodes.alias("postcodes")) \
        .select(F.explode("cells").alias("cell"), "postcodes") \
        .select("cell", F.explode("postcodes").alias("postcode"))
    counts = rows.groupBy("cell", "postcode").agg(F.count("*").alias("rows"))
    first = F.min(F.struct((-F.col("rows")).alias("rank"), "postcode"))
    return counts.groupBy("cell").agg(first.alias("best")).select(
        "cell", F.col("best.postcode").alias("postcode"))


def postcode_size(map_segments: DataFrame, job: Job) -> DataFrame:
    """Distinct full codes per postcode: a stand-in for its addresses."""
    codes = _codes(map_segments, job).select(F.inline("codes"))
    return codes.filter("detailed").groupBy("postcode").agg(
        F.countDistinct("code").alias("addresses"))


def with_centres(cells: DataFrame, level: int = LEVEL,
                 project: Projection = None) -> DataFrame:
    """Cells with the longitude and latitude of their centre, and its place on a metric grid if there is one."""
    placed = cells.withColumns({"lon": grid.centre_lon(F.col("cell"), level), "lat": grid.centre_lat(F.col("cell"), level)})
    return placed if project is None else project(placed)


def mapped_cells(segments: DataFrame, job: Job, cell: Column, level: int = LEVEL,
                 project: Projection = None) -> DataFrame:
    """The cells that hold a mapped segment, with their centres."""
    cells = segments.filter(in_region(job)).select(cell.alias("cell")).distinct()
    return with_centres(cells, level, project)


def _inside_extent(mapped: DataFrame) -> Column:
    """Whether a centre lies in the extent of the mapped cells, as one scalar subquery."""
    extent = mapped.agg(F.struct(
        F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min("lat").alias("south"), F.max("lat").alias("north"))).scalar()
    return (F.col("lon").between(extent["west"], extent["east"])
            & F.col("lat").between(extent["south"], extent["north"]))


def edge_postcodes(labelled: DataFrame, mapped: DataFrame) -> DataFrame:
    """Postcodes with a labelled cell outside the extract; only part of their traffic is seen."""
    return labelled.filter(~_inside_extent(mapped)).select("postcode").distinct()


def inside_labels(labelled: DataFrame, mapped: DataFrame) -> DataFrame:
    return labelled.filter(_inside_extent(mapped))


def nearest_postcode(mapped: DataFrame, labelled: DataFrame,
                     reach_m: float = fixed.MAX_ASSIGNMENT_M) -> DataFrame:
    """Cell, postcode of the nearest labelled cell, and its distance; nothing beyond the reach."""
    metric_plane = "easting" in mapped.columns and "easting" in labelled.columns
    nearest = nearest_within if metric_plane else nearest_around
    return nearest(mapped, labelled, ["cell"], reach_m, ["postcode"], "cell")


def postcode_centres(labelled: DataFrame) -> DataFrame:
    """Mean centre and bounding box of the labelled cells of each postcode."""
    return labelled.groupBy("postcode").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min("lat").alias("south"), F.max("lat").alias("north"))


def postcode_features(assigned: DataFrame, sizes: DataFrame, edges: DataFrame,
                      centres: DataFrame) -> DataFrame:
    """Road features of each postcode, speed signals weighted by the traffic that meets them."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0.0))
    traffic = F.col("vehicle_km_per_day")
    observed = F.coalesce(F.col("observed_segments"), F.lit(0))
    rows = assigned.filter(F.col("postcode").isNotNull()).groupBy("postcode").agg(
        F.count("*").alias("cells"),
        *[total(name).alias(f"_{name}") for name in ["map_km", *VOLUME_COLUMNS]],
        *[measures.weighted_avg(F.col(name), traffic).alias(name) for name in fixed.SPEED_SIGNALS],
        measures.weighted_avg(F.col("naive_speed_kph"), observed).alias("naive_speed_kph"))
    share = lambda part, whole: F.try_divide(F.col(f"_{part}"), F.col(f"_{whole}"))
    features = rows.select(
        "postcode", "cells", F.col("_vehicle_km_per_day").alias("vehicle_km_per_day"),
        share("major_vehicle_km_per_day", "vehicle_km_per_day").alias("major_road_share"),
        F.least(F.lit(100.0), 100.0 * share("volume_km", "map_km")).alias("network_coverage_pct"),
        share("weekend_vehicle_km_per_day", "weekday_vehicle_km_per_day").alias("weekend_traffic_ratio"),
        *fixed.SPEED_SIGNALS, "naive_speed_kph")
    return features.filter(F.col("vehicle_km_per_day") > 0) \
        .join(edges, "postcode", "left_anti") \
        .join(sizes, "postcode").join(centres.select("postcode", "lat", "lon"), "postcode", "left")


def weighting_gap(features: DataFrame, min_cells: int = 50, min_addresses: int = 100) -> DataFrame:
    """The postcode whose traffic-weighted speed lies furthest above the plain one."""
    gap = F.col("mean_speed_kph") - F.col("naive_speed_kph")
    return features.filter((F.col("cells") >= min_cells) & (F.col("addresses") >= min_addresses)) \
        .withColumn("gap_kph", gap).filter(F.col("gap_kph").isNotNull()) \
        .select("postcode", "naive_speed_kph", "mean_speed_kph", "gap_kph") \
        .orderBy(F.desc("gap_kph"), "postcode").limit(1)


def placed_collisions(collisions: DataFrame, labelled: DataFrame, features: DataFrame,
                      reach_m: float = fixed.MAX_ASSIGNMENT_M) -> DataFrame:
    """Collisions and serious collisions per postcode, year and month.

    Reports move once, and are counted per exact place and month where they arrive and before places are assigned, so many
    reports at one spot are placed once. Places in postcodes without features are dropped. Collisions lie on a metric grid
    (`easting`, `northing`), and then the labelled cells must too, or on the globe (`lon`, `lat`).
    """
    on_grid = "easting" in collisions.columns
    if on_grid and "easting" not in labelled.columns:
        raise ValueError("These collisions are on a metric grid. Give the territory the projection to that grid.")
    spot = ["easting", "northing"] if on_grid else ["lon", "lat"]
    nearest = nearest_within if on_grid else nearest_around
    reports = collisions.select(*spot, "year", "month", F.col("severity").isin(fixed.SERIOUS_SEVERITIES).cast("int").alias("serious"))
    counts = {"collisions": F.count("*"), "ksi": F.coalesce(F.sum("serious"), F.lit(0))}
    found = nearest(reports, labelled, ["year", "month"], reach_m, ["postcode"], "cell", totals=counts)
    return found.join(features.select("postcode"), "postcode", "left_semi") \
        .groupBy("postcode", "year", "month").agg(
            F.sum("collisions").alias("collisions"), F.sum("ksi").alias("ksi"))


def collision_panel(placed: DataFrame, features: DataFrame, target_year: int = fixed.TARGET_YEAR,
                    history_year: int = fixed.HISTORY_YEAR) -> DataFrame:
    """One row per postcode and month: counts, last year's counts and the features."""
    scaffold = features.select("postcode", "addresses", "lat", "lon", *fixed.ROAD_FEATURES) \
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    target = placed.filter(F.col("year") == target_year).select("postcode", "month", "collisions", "ksi")
    history = placed.filter(F.col("year") == history_year).groupBy("postcode").agg(
        F.sum("collisions").alias("prior_collisions"), F.sum("ksi").alias("prior_ksi"))
    return scaffold.join(target, ["postcode", "month"], "left").join(history, "postcode", "left") \
        .fillna(0, ["collisions", "ksi", "prior_collisions", "prior_ksi"])


class Territory:
    """The frames between map and model, each built when it is first asked for.

    The labels and the mapped cells (one row per cell each) are written down once, because five frames read the
    labels and four the mapped cells. The assignment works on cell ids only, so the hours are read once.
    """

    def __init__(self, tables: RoadTables, job: Job, level: int, project: Projection):
        self.tables, self.job, self.level, self.project = tables, job, level, project
        self.cell = grid.cell_of_box(level)

    @cached_property
    def mapped(self) -> DataFrame:
        """Mapped cells with their centres."""
        return durable(mapped_cells(self.tables.segments, self.job, self.cell, self.level, self.project))

    @cached_property
    def labelled(self) -> DataFrame:
        """Cells with the postcode their roads carry."""
        return durable(with_centres(cell_postcode(self.tables.map_segments, self.job, self.level), self.level, self.project))

    @cached_property
    def inside(self) -> DataFrame:
        """The labelled cells inside the extract."""
        return inside_labels(self.labelled, self.mapped)

    @cached_property
    def edges(self) -> DataFrame:
        """Postcodes cut by the edge of the extract."""
        return edge_postcodes(self.labelled, self.mapped)

    @cached_property
    def nearest(self) -> DataFrame:
        """Mapped cells with the postcode they join."""
        return nearest_postcode(self.mapped, self.inside)

    @cached_property
    def layer(self) -> DataFrame:
        """Every mapped cell with its traffic and speed signals."""
        return cell_layer(self.tables, self.job, self.cell)

    @cached_property
    def assigned(self) -> DataFrame:
        """The layer with the postcode of each cell."""
        return self.layer.join(self.nearest.select("cell", "postcode"), "cell", "left")

    @cached_property
    def features(self) -> DataFrame:
        """One row per postcode."""
        return postcode_features(self.assigned, postcode_size(self.tables.map_segments, self.job), self.edges,
                                 postcode_centres(self.inside))


def territory(tables: RoadTables, job: Job, level: int = LEVEL, project: Projection = None) -> Territory:
    """Cells, labels, assignment and features of one region.

    Distances follow the great circle, in any region. With `project`, such as `metric.national_grid` in Britain, they are
    those of that grid, and collisions reported on it can be placed.
    """
    return Territory(tables, job, level, project)


def claims_panel(frames: Territory, collisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The panel and the features, both written down.

    The features (one row per postcode) place the collisions and carry the panel, and every model
    reads the panel: neither may go back to the hours. The panel reads the placed collisions for both
    years, so they are written down too (one row per postcode and month).
    """
    features = durable(frames.features)
    placed = durable(placed_collisions(collisions, frames.inside, features))
    return durable(collision_panel(placed, features)), features
