"""The map report: layers, attributes, limits and typical speeds, junctions, signs and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import grid, measures
from roadlens.functions.predicates import bbox_overlaps, is_driveable, is_road
from roadlens.params import Box
from roadlens.sources.tables import RoadTables


def roads(map_segments: DataFrame) -> DataFrame:
    """Segments that are roads, with a name and the three speeds in miles per hour.

    A road without a name is called by its first route.
    """
    route = F.try_element_at("routes", F.lit(1)).getField("name")
    return map_segments.filter(is_road()).select(
        "id", F.col("class").alias("road_class"),
        F.coalesce("names.primary", route).alias("name"),
        "bbox", "geometry", "connectors",
        measures.mph(measures.whole_segment_limit()).alias("limit_mph"),
        measures.mph(measures.first_profile_speed("week_speed")).alias("typical_mph"),
        measures.mph(measures.first_profile_speed("freeflow_speed")).alias("freeflow_mph"))


def road_order(classes: list[str]) -> Column:
    """Position of `road_class` in a list of classes, for presentation order."""
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("road_class"))


def layer_extents(tables: RoadTables) -> DataFrame:
    """Features and extent per layer and region, the outermost 0.1 % on each side left out."""
    layers = {"segment": tables.map_segments, "connector": tables.map_connectors,
              "traffic_sign": tables.traffic_signs, "traffic_signal": tables.traffic_signals,
              "signpost": tables.signposts}
    trimmed = lambda edge, share: F.round(F.percentile_approx(f"bbox.{edge}", share), 2)
    extents = [
        layer.groupBy(F.lit(name).alias("layer"), "region").agg(
            F.count("*").alias("features"),
            trimmed("ymin", 0.001).alias("south"), trimmed("ymax", 0.999).alias("north"),
            trimmed("xmin", 0.001).alias("west"), trimmed("xmax", 0.999).alias("east"))
        for name, layer in layers.items() if layer is not None]
    return reduce(DataFrame.unionByName, extents)


def signal_focus(signals: DataFrame) -> DataFrame:
    """Median position of the traffic signals, which falls in the urban core."""
    return signals.agg(
        F.percentile_approx((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, 0.5).alias("lon"),
        F.percentile_approx((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2, 0.5).alias("lat"))


def driveable_in(map_roads: DataFrame, box: Box) -> DataFrame:
    """All driveable roads touching a box."""
    return map_roads.filter(bbox_overlaps(box) & is_driveable()) \
        .select("id", "name", "road_class", "limit_mph", "typical_mph", "geometry")


def roads_inside(map_segments: DataFrame, box: Box, classes: list[str]) -> DataFrame:
    """Class and line of the roads of the given classes that touch a box."""
    return map_segments.filter(is_road() & F.col("class").isin(classes) & bbox_overlaps(box)) \
        .select("id", F.col("class").alias("road_class"), "geometry")


def limit_share(map_roads: DataFrame) -> DataFrame:
    """Segments per class and the share that carries a limit, most important class first."""
    has_limit = F.col("limit_mph").isNotNull().cast("int")
    return map_roads.groupBy("road_class").agg(
        F.count("*").alias("segments"), F.round(100 * F.avg(has_limit)).alias("limit_pct")) \
        .orderBy(road_order(fixed.DRIVEABLE + fixed.NOT_DRIVEABLE), "road_class")


def fill_rates(map_segments: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Share of the roads of a class whose attribute array holds a value, one column each."""
    names = fixed.MAP_ATTRIBUTES if attributes is None else attributes
    filled = lambda name: F.coalesce((F.size(name) > 0).cast("int"), F.lit(0))
    return map_segments.filter(is_road()).groupBy(F.col("class").alias("road_class")).agg(
        *[(100 * F.avg(filled(name))).alias(name) for name in names])


def speed_quartiles(map_roads: DataFrame) -> DataFrame:
    """Quartiles of limit, free-flow and typical speed per class, over roads that have both a
    limit and a typical speed. A class without any free-flow value has NULL quartiles."""
    both = map_roads.filter(F.col("limit_mph").isNotNull() & F.col("typical_mph").isNotNull()
                            & is_driveable())
    speeds = ["limit", "freeflow", "typical"]
    per_class = both.groupBy("road_class").agg(
        F.count("*").alias("segments"),
        *[F.percentile_approx(f"{s}_mph", [0.25, 0.5, 0.75]).alias(s) for s in speeds])
    return per_class.select("road_class", "segments", *[
        F.get(s, F.lit(i)).alias(f"{s}_{q}") for s in speeds
        for i, q in enumerate(["q1", "median", "q3"])])


def signals_per_cell(signals: DataFrame, level: int, box: Box | None = None) -> DataFrame:
    """Traffic signals per grid cell."""
    kept = signals if box is None else signals.filter(bbox_overlaps(box))
    return kept.groupBy(grid.cell_of_bbox(level).alias("cell")).agg(F.count("*").alias("signals"))


def connector_degree(map_roads: DataFrame, cap: int = 6) -> DataFrame:
    """Connectors by the number of driveable segments that meet there, `cap` meaning or more."""
    ends = map_roads.filter(is_driveable()).select(F.explode("connectors.connector_id").alias("connector_id"))
    degree = ends.groupBy("connector_id").agg(F.count("*").alias("segments"))
    return degree.groupBy(F.least("segments", F.lit(cap).cast("bigint")).alias("segments")).agg(
        F.count("*").alias("connectors"))


def signpost_readout(signposts: DataFrame, map_roads: DataFrame,
                     classes: tuple[str, ...] = ("motorway", "trunk")) -> DataFrame:
    """What signposts on major roads say, with the roads they lead from and to.

    A signpost names two segments. Both become rows, so the roads are joined and shuffled once,
    and an aggregate puts the two ends back together.
    """
    readable = signposts.filter(F.size("destination_info") > 0)
    legs = readable.select(
        F.col("id").alias("signpost_id"),
        F.inline(F.array(F.struct(F.lit("from").alias("leg"), F.col("from_segment.id").alias("id")),
                         F.struct(F.lit("to").alias("leg"), F.col("to_segment.id").alias("id")))))
    named = legs.join(map_roads.select("id", "name", "road_class"), "id")
    end = lambda leg, column: F.max(F.when(F.col("leg") == leg, F.col(column)))
    ends = named.groupBy("signpost_id").agg(
        end("from", "name").alias("from_road"), end("from", "road_class").alias("from_class"),
        end("to", "name").alias("to_road"), F.countDistinct("leg").alias("legs")) \
        .filter((F.col("legs") == 2) & F.col("from_class").isin(*classes))
    joined_text = lambda array, field: F.concat_ws(" | ", F.transform(
        array, lambda item: item[field]["primary"]))
    texts = readable.select(F.col("id").alias("signpost_id"),
                            joined_text("destination_info", "destination_name").alias("destinations"),
                            joined_text("route_info", "route_text").alias("routes"))
    return ends.drop("legs").join(texts, "signpost_id")


def conditional_limits(map_segments: DataFrame, mode: str = "hgv") -> DataFrame:
    """Limits that hold for one kind of vehicle only, with the stretch they hold on."""
    limits = map_segments.select("id", F.col("names.primary").alias("name"),
                                 F.explode("speed_limits").alias("limit"))
    return limits.filter(F.array_contains("limit.when.mode", mode)).select(
        "id", "name", F.col("limit.max_speed.value").alias("value"),
        F.col("limit.max_speed.unit").alias("unit"), F.col("limit.between").alias("between"),
        F.col("limit.when.mode").alias("mode"))


def signals_by_exposure(signals: DataFrame, volumes: DataFrame, level: int, k: int = 20) -> DataFrame:
    """Signals per million vehicle-kilometres in the cells with the most driving.

    Both sides are one row per grid cell before they meet.
    """
    exposure = volumes.groupBy(grid.cell_of_box(level).alias("cell")).agg(
        F.sum(measures.vehicle_km(F.col("aadt"))).alias("vehicle_km_per_day"))
    return exposure.join(signals_per_cell(signals, level), "cell") \
        .orderBy(F.desc("vehicle_km_per_day"), "cell").limit(k).select(
            "cell", F.round("vehicle_km_per_day").alias("vehicle_km_per_day"), "signals",
            F.round(F.try_divide(1e6 * F.col("signals"), F.col("vehicle_km_per_day")), 1)
            .alias("signals_per_million_km"))
