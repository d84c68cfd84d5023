"""The registered queries: each runs a report over the whole of the driver's tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens import fixed
from roadlens.functions import grid, metric
from roadlens.functions.predicates import in_vintage
from roadlens.operators.hours import measured
from roadlens.params import Job
from roadlens.operators import ordered, scales
from roadlens.plans import claims_model, map_report, risk, segment_hours, speed_report, territory, volume_report
from roadlens.session import durable, tune
from roadlens.sources import colocated, export
from roadlens.sources import tables as tables_module
from roadlens.sources.tables import RoadTables
from workload import adapters, stated

Query = Callable[[SparkSession, str], DataFrame]

JOB = Job(first_date=date(2025, 9, 1), last_date=date(2025, 9, 7), vintage_year=2025)

QUERIES: dict[str, Query] = {}


def with_local_folder(spark: SparkSession) -> SparkSession:
    """A local session without a checkpoint folder gets one; a cluster must name its own."""
    context = spark.sparkContext
    unset = context.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None
    if unset and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="roadlens-checkpoint-"))
    return spark


def _folder(spark: SparkSession) -> str:
    """The shared folder for tables that a query writes."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def register(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(with_local_folder(tune(spark)), sf_dir)
    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, default: int = 4, **places: int) -> DataFrame:
    """Doubles rounded for comparison, to `default` places unless said otherwise."""
    return df.select(*[
        F.round(f.name, places.get(f.name, default)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


# Risky kilometres ------------------------------------------------------------

def _tables(spark, sf_dir):
    """Segments, hours and volumes; the map's tables are built only where they are read."""
    return RoadTables(segments=adapters.segments(spark, sf_dir), hourly=adapters.hourly(spark, sf_dir),
                      volumes=adapters.volumes(spark, sf_dir))


def _cell_slots(spark, sf_dir):
    return risk.cell_slot_km(_tables(spark, sf_dir), JOB)


@register
def risky_km_by_slot(spark, sf_dir):
    return rounded(risk.risky_km_by_slot(_cell_slots(spark, sf_dir)))


@register
def risky_totals(spark, sf_dir):
    return rounded(risk.risky_totals(_cell_slots(spark, sf_dir)), km_per_day=3, driven_km_per_day=3)


@register
def risky_km_by_hexagon(spark, sf_dir):
    return rounded(risk.risky_km_by_hexagon(_cell_slots(spark, sf_dir)))


@register
def hexagon_slots(spark, sf_dir):
    return rounded(risk.hexagon_slots(_cell_slots(spark, sf_dir)))


# Speed report ----------------------------------------------------------------

def _measured(spark, sf_dir):
    return measured(adapters.hourly(spark, sf_dir), adapters.segments(spark, sf_dir), JOB)


@register
def network_extent(spark, sf_dir):
    return speed_report.network_extent(adapters.segments(spark, sf_dir))


@register
def observation_extent(spark, sf_dir):
    return speed_report.observation_extent(adapters.hourly(spark, sf_dir))


@register
def count_by_class(spark, sf_dir):
    return speed_report.count_by(adapters.segments(spark, sf_dir), "frc")


@register
def top_forms(spark, sf_dir):
    return speed_report.top_categories(adapters.segments(spark, sf_dir), "form_of_way", 8)


@register
def speed_limit_histogram(spark, sf_dir):
    return speed_report.histogram(adapters.segments(spark, sf_dir), F.col("speed_limit_kph"), 0, 140, 28)


@register
def segment_length_histogram(spark, sf_dir):
    return rounded(speed_report.histogram(adapters.segments(spark, sf_dir), F.col("length_m"), 0, 500, 50))


@register
def speed_histogram(spark, sf_dir):
    return rounded(speed_report.histogram(_measured(spark, sf_dir), F.col("avg_speed_kph"), 0, 150, 60))


@register
def network_focus(spark, sf_dir):
    return rounded(speed_report.mean_corner(adapters.segments(spark, sf_dir)), lon=6, lat=6)


@register
def longest_major_roads(spark, sf_dir):
    return speed_report.major_roads(adapters.segments(spark, sf_dir))


@register
def major_roads_at_focus(spark, sf_dir):
    roads = adapters.segments(spark, sf_dir)
    box = speed_report.around_focus(speed_report.mean_corner(roads), 0.12, 0.06)
    return speed_report.major_roads_in(roads, box)


@register
def coverage_by_class(spark, sf_dir):
    return speed_report.coverage_by_class(adapters.hourly(spark, sf_dir),
                                          adapters.segments(spark, sf_dir), JOB)


@register
def coverage_by_hour(spark, sf_dir):
    return speed_report.coverage_by_hour(adapters.hourly(spark, sf_dir),
                                         adapters.segments(spark, sf_dir), JOB)


@register
def three_averages(spark, sf_dir):
    return speed_report.three_averages(_measured(spark, sf_dir))


@register
def speed_sample(spark, sf_dir):
    return speed_report.speed_sample(_measured(spark, sf_dir), 0.02)


@register
def percentile_curve(spark, sf_dir):
    return speed_report.percentile_curve(_measured(spark, sf_dir))


@register
def congestion_ratio(spark, sf_dir):
    return rounded(speed_report.congestion_ratio(_measured(spark, sf_dir)), ratio=6)


@register
def congestion_ratio_histogram(spark, sf_dir):
    ratios = speed_report.congestion_ratio(_measured(spark, sf_dir))
    return rounded(speed_report.histogram(ratios, F.col("ratio"), 0, 2, 50))


@register
def median_congestion_ratio(spark, sf_dir):
    return rounded(speed_report.median_ratio(speed_report.congestion_ratio(_measured(spark, sf_dir))))


@register
def speed_by_class_hour(spark, sf_dir):
    return speed_report.speed_by_class_hour(_measured(spark, sf_dir))


@register
def speed_pivot(spark, sf_dir):
    return speed_report.speed_pivot(_measured(spark, sf_dir))


@register
def speeding_by_hour(spark, sf_dir):
    return speed_report.speeding_by_hour(_measured(spark, sf_dir))


@register
def speeding_by_class(spark, sf_dir):
    return speed_report.speeding_by_class(_measured(spark, sf_dir))


@register
def cell_congestion(spark, sf_dir):
    return speed_report.cell_congestion(_measured(spark, sf_dir))


@register
def most_congested_cells(spark, sf_dir):
    roads = adapters.segments(spark, sf_dir)
    box = speed_report.around_focus(speed_report.mean_corner(roads), 0.12, 0.06)
    return speed_report.most_congested(speed_report.cell_congestion(_measured(spark, sf_dir), box))


@register
def region_slice(spark, sf_dir):
    """Speeding by class in one region, its hours cut down by the region's tiles."""
    job = Job("austin", JOB.first_date, JOB.last_date, JOB.vintage_year)
    cut = _tables(spark, sf_dir).slice(job)
    return speed_report.speeding_by_class(measured(cut.hourly, cut.segments, job))


# The same reports from the table of sums -------------------------------------

def _sums(spark, sf_dir):
    """The week as two windows, each added up by a pass of its own and then merged."""
    hours, roads = adapters.hourly(spark, sf_dir), adapters.segments(spark, sf_dir)
    cut = date(2025, 9, 5)
    return segment_hours.merged(
        segment_hours.segment_hours(hours, roads, replace(JOB, last_date=cut)),
        segment_hours.segment_hours(hours, roads, replace(JOB, first_date=cut + timedelta(days=1))))


@register
def sums_coverage_by_class(spark, sf_dir):
    return segment_hours.coverage_by_class(_sums(spark, sf_dir), adapters.segments(spark, sf_dir))


@register
def sums_coverage_by_hour(spark, sf_dir):
    return segment_hours.coverage_by_hour(_sums(spark, sf_dir))


@register
def sums_three_averages(spark, sf_dir):
    return segment_hours.three_averages(_sums(spark, sf_dir))


@register
def sums_percentile_curve(spark, sf_dir):
    return segment_hours.percentile_curve(_sums(spark, sf_dir))


@register
def sums_congestion_ratio(spark, sf_dir):
    return rounded(segment_hours.congestion_ratio(_sums(spark, sf_dir)), ratio=6)


@register
def sums_speed_by_class_hour(spark, sf_dir):
    return segment_hours.speed_by_class_hour(_sums(spark, sf_dir), adapters.segments(spark, sf_dir))


@register
def sums_speeding_by_hour(spark, sf_dir):
    return segment_hours.speeding_by_hour(_sums(spark, sf_dir))


@register
def sums_speeding_by_class(spark, sf_dir):
    return segment_hours.speeding_by_class(_sums(spark, sf_dir), adapters.segments(spark, sf_dir))


@register
def sums_cell_congestion(spark, sf_dir):
    return segment_hours.cell_congestion(_sums(spark, sf_dir), adapters.segments(spark, sf_dir))


@register
def sums_road_signals(spark, sf_dir):
    return rounded(segment_hours.road_signals(_sums(spark, sf_dir), adapters.segments(spark, sf_dir), _cell()), default=6)


# Tables laid out by segment ---------------------------------------------------

@register
def colocated_cell_congestion(spark, sf_dir):
    """Segments and hours written in the same buckets, then joined and added up without moving either."""
    tag, layout = uuid.uuid4().hex, colocated.Layout(buckets=16)
    colocated.write_segments(adapters.segments(spark, sf_dir), f"segments_{tag}", layout, f"{_folder(spark)}/segments_{tag}")
    colocated.write_hours(adapters.hourly(spark, sf_dir), f"hours_{tag}", layout, f"{_folder(spark)}/hours_{tag}")
    tables = colocated.colocated_tables(spark, f"segments_{tag}", f"hours_{tag}")
    return speed_report.cell_congestion(measured(tables.hourly, tables.segments, JOB))


@register
def tile_pruned_speeding(spark, sf_dir):
    """Speeding by class in one region, from hours laid out by tile and date."""
    job = replace(JOB, region="austin")
    tag, layout = uuid.uuid4().hex, colocated.Layout(buckets=4, by_tile=True)
    colocated.write_hours(adapters.hourly(spark, sf_dir), f"hours_{tag}", layout, f"{_folder(spark)}/hours_{tag}")
    roads = adapters.segments(spark, sf_dir).filter(F.col("region") == job.region)
    tables = colocated.cut_by_tiles(RoadTables(segments=roads, hourly=spark.table(f"hours_{tag}")))
    return speed_report.speeding_by_class(measured(tables.hourly, tables.segments, job))


# Volume report ---------------------------------------------------------------

def _vintage(spark, sf_dir):
    return adapters.volumes(spark, sf_dir).filter(in_vintage(JOB))


@register
def volume_summary(spark, sf_dir):
    return volume_report.volume_summary(adapters.volumes(spark, sf_dir))


@register
def busiest_focus(spark, sf_dir):
    return rounded(volume_report.busiest_focus(_vintage(spark, sf_dir)), lon=6, lat=6)


@register
def busiest_at_focus(spark, sf_dir):
    """The hundred busiest segments around the focus; volumes by day in hundredths, as text."""
    roads = _vintage(spark, sf_dir)
    box = speed_report.around_focus(volume_report.busiest_focus(roads), 0.12, 0.06)
    hundredths = F.transform("aadt_by_day", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return volume_report.busiest_in(roads, box, 100).withColumn("aadt_by_day", F.array_join(hundredths, ","))


@register
def coverage_report(spark, sf_dir):
    return rounded(volume_report.coverage_report(adapters.coverage(spark, sf_dir)))


@register
def class_coverage(spark, sf_dir):
    return rounded(volume_report.class_coverage(adapters.volumes(spark, sf_dir),
                                                adapters.coverage(spark, sf_dir)))


@register
def volume_by_class(spark, sf_dir):
    return volume_report.volumes_by_class(_vintage(spark, sf_dir))


@register
def weekly_profile(spark, sf_dir):
    return rounded(volume_report.weekly_profile(_vintage(spark, sf_dir)))


@register
def day_shape(spark, sf_dir):
    return rounded(volume_report.day_shape(volume_report.weekly_profile(_vintage(spark, sf_dir))))


@register
def exposure_per_cell(spark, sf_dir):
    return volume_report.exposure_per_cell(_vintage(spark, sf_dir))


@register
def exposure_at_focus(spark, sf_dir):
    roads = _vintage(spark, sf_dir)
    box = speed_report.around_focus(volume_report.busiest_focus(roads), 0.12, 0.06)
    return volume_report.exposure_per_cell(roads, box)


@register
def osm_way_keys(spark, sf_dir):
    return volume_report.osm_way_keys(_vintage(spark, sf_dir))


@register
def gers_keys(spark, sf_dir):
    return volume_report.gers_keys(_vintage(spark, sf_dir))


@register
def peak_speed_by_exposure(spark, sf_dir):
    return volume_report.peak_speed_by_exposure(
        _vintage(spark, sf_dir), adapters.segments(spark, sf_dir), adapters.hourly(spark, sf_dir), JOB)


@register
def vintage_growth(spark, sf_dir):
    return rounded(volume_report.vintage_growth(adapters.volumes(spark, sf_dir),
                                                adapters.coverage(spark, sf_dir), 2024, 2025))


# Map report ------------------------------------------------------------------

def _roads(spark, sf_dir):
    return map_report.roads(adapters.map_segments(spark, sf_dir))


@register
def road_speeds(spark, sf_dir):
    return _roads(spark, sf_dir).select("id", "road_class", "name", "limit_mph", "typical_mph",
                                        "freeflow_mph")


@register
def layer_extents(spark, sf_dir):
    return map_report.layer_extents(adapters.road_tables(spark, sf_dir))


@register
def signal_focus(spark, sf_dir):
    return rounded(map_report.signal_focus(adapters.traffic_signals(spark, sf_dir)), lon=6, lat=6)


@register
def driveable_at_focus(spark, sf_dir):
    focus = map_report.signal_focus(adapters.traffic_signals(spark, sf_dir))
    box = speed_report.around_focus(focus, 0.015, 0.01)
    return map_report.driveable_in(_roads(spark, sf_dir), box).withColumn("geometry", F.hex("geometry"))


@register
def limit_share(spark, sf_dir):
    return map_report.limit_share(_roads(spark, sf_dir))


@register
def fill_rates(spark, sf_dir):
    return rounded(map_report.fill_rates(adapters.map_segments(spark, sf_dir)))


@register
def speed_quartiles(spark, sf_dir):
    return map_report.speed_quartiles(_roads(spark, sf_dir))


@register
def signs_by_type(spark, sf_dir):
    return speed_report.count_by(adapters.traffic_signs(spark, sf_dir), "subtype", "signs")


@register
def signals_per_cell(spark, sf_dir):
    return map_report.signals_per_cell(adapters.traffic_signals(spark, sf_dir),
                                       grid.LEVEL_FOR_RESOLUTION[8])


@register
def connector_degree(spark, sf_dir):
    return map_report.connector_degree(_roads(spark, sf_dir))


@register
def signpost_readout(spark, sf_dir):
    return map_report.signpost_readout(adapters.signposts(spark, sf_dir), _roads(spark, sf_dir))


@register
def conditional_limits(spark, sf_dir):
    limits = map_report.conditional_limits(adapters.map_segments(spark, sf_dir))
    between = F.array_join(F.transform("between", lambda v: v.cast("string")), ",")
    return limits.select("id", "name", "value", "unit", between.alias("between"), F.concat_ws(",", "mode").alias("mode"))


@register
def signals_by_exposure(spark, sf_dir):
    return map_report.signals_by_exposure(adapters.traffic_signals(spark, sf_dir),
                                          _vintage(spark, sf_dir), grid.LEVEL_FOR_RESOLUTION[9])


# A driver against the road ---------------------------------------------------

def _route(spark, sf_dir):
    # The ways of three neighbouring parts, and the parts of one name and limit beside them.
    return risk.route_hours(_tables(spark, sf_dir), JOB,
                            [4000010, 4000011, 4000012, 4000026], "red widget", 40)


@register
def route_profile(spark, sf_dir):
    return rounded(risk.route_profile(_route(spark, sf_dir)))


@register
def speed_on_distribution(spark, sf_dir):
    return risk.speed_on_distribution(_route(spark, sf_dir), 50, [3, 8, 12, 17], "route", "beside it")


@register
def segment_over_limit(spark, sf_dir):
    return risk.segment_over_limit(_route(spark, sf_dir))


@register
def trip_segments(spark, sf_dir):
    """Orders as trips over the ways of the parts they contain."""
    trips = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("trip_id"), (4000000 + F.col("l_partkey")).alias("osm_way_id"))
    return risk.trip_segments(trips, adapters.segments(spark, sf_dir))


@register
def segment_features(spark, sf_dir):
    return risk.segment_features(adapters.segments(spark, sf_dir),
                                 ["dseg_id", "frc", "speed_limit_kph", "street_name"])


# Territory -------------------------------------------------------------------

def _territory_tables(spark, sf_dir, corner=adapters.LONDON):
    return RoadTables(segments=adapters.segments(spark, sf_dir, corner), hourly=adapters.hourly(spark, sf_dir),
                      volumes=adapters.volumes(spark, sf_dir, corner), map_segments=adapters.map_segments(spark, sf_dir, corner))


def _territory(spark, sf_dir):
    """The job's region lies in Britain, whose collisions are reported on the national grid."""
    return territory.territory(_territory_tables(spark, sf_dir), JOB, project=metric.national_grid)


def _abroad(spark, sf_dir):
    """The same roads placed around Austin, where distances follow the great circle."""
    return territory.territory(_territory_tables(spark, sf_dir, adapters.AUSTIN), JOB)


def _cell():
    return grid.cell_of_box(territory.LEVEL)


@register
def volume_cells(spark, sf_dir):
    return rounded(territory.volume_cells(adapters.volumes(spark, sf_dir), JOB, _cell()), default=6)


@register
def road_signals(spark, sf_dir):
    return rounded(territory.road_signals(adapters.hourly(spark, sf_dir),
                                          adapters.segments(spark, sf_dir), JOB, _cell()), default=6)


@register
def cell_layer(spark, sf_dir):
    return rounded(territory.cell_layer(_tables(spark, sf_dir), JOB, _cell()), default=6)


@register
def reach_summary(spark, sf_dir):
    return territory.reach_summary(territory.cell_layer(_tables(spark, sf_dir), JOB, _cell()))


@register
def cell_postcode(spark, sf_dir):
    return territory.cell_postcode(adapters.map_segments(spark, sf_dir), JOB)


@register
def cell_postcode_by_road(spark, sf_dir):
    return territory.cell_postcode(adapters.map_segments(spark, sf_dir), JOB, count_by="road")


@register
def postcode_size(spark, sf_dir):
    return territory.postcode_size(adapters.map_segments(spark, sf_dir), JOB)


@register
def cell_centres(spark, sf_dir):
    mapped = territory.mapped_cells(adapters.segments(spark, sf_dir), JOB, _cell(), project=metric.national_grid)
    return rounded(mapped, lon=6, lat=6, easting=2, northing=2)


@register
def nearest_postcode(spark, sf_dir):
    return rounded(_territory(spark, sf_dir).nearest, distance_m=2)


@register
def cell_postcode_abroad(spark, sf_dir):
    return _abroad(spark, sf_dir).labelled.select("cell", "postcode", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@register
def nearest_postcode_abroad(spark, sf_dir):
    return rounded(_abroad(spark, sf_dir).nearest, distance_m=2)


@register
def postcode_features_abroad(spark, sf_dir):
    return rounded(_abroad(spark, sf_dir).features, default=6)


@register
def edge_postcodes(spark, sf_dir):
    return _territory(spark, sf_dir).edges


@register
def postcode_centres(spark, sf_dir):
    return rounded(territory.postcode_centres(_territory(spark, sf_dir).inside),
                   lat=6, lon=6, west=6, east=6, south=6, north=6)


@register
def postcode_features(spark, sf_dir):
    return rounded(_territory(spark, sf_dir).features, default=6)


@register
def feature_summary(spark, sf_dir):
    return rounded(ordered.summary(durable(_territory(spark, sf_dir).features), fixed.ROAD_FEATURES), default=3)


@register
def weighting_gap(spark, sf_dir):
    """With floors of 2 cells and 10 addresses; no postcode of the small extract has the 50 cells of the default."""
    return rounded(territory.weighting_gap(_territory(spark, sf_dir).features, 2, 10))


@register
def size_tracking(spark, sf_dir):
    return rounded(ordered.rank_correlation(durable(_territory(spark, sf_dir).features), "postcode", "addresses",
                                            fixed.ROAD_FEATURES))


@register
def collision_counts(spark, sf_dir):
    frames = _territory(spark, sf_dir)
    return territory.placed_collisions(adapters.collisions(spark, sf_dir), frames.inside,
                                       durable(frames.features))


def _panel(spark, sf_dir):
    return territory.claims_panel(_territory(spark, sf_dir), adapters.collisions(spark, sf_dir))


@register
def collision_panel(spark, sf_dir):
    return _panel(spark, sf_dir)[0].select(
        "postcode", "month", "collisions", "ksi", "prior_collisions", "prior_ksi", "addresses")


# Claims model ----------------------------------------------------------------

@register
def own_rate_ceiling(spark, sf_dir):
    return rounded(claims_model.own_rate_ceiling(_panel(spark, sf_dir)[0]))


@register
def own_rate_capture_curve(spark, sf_dir):
    """Share of the collisions found, postcode-months ordered by last year's count."""
    panel = _panel(spark, sf_dir)[0].select(
        "postcode", "month", F.col("collisions").cast("double").alias("observed"),
        F.col("prior_collisions").cast("double").alias("predicted"), F.lit("history").alias("model"))
    curve = claims_model.capture_curve(panel, ["model"])
    return rounded(curve.select("postcode", "month", "place", "row_share", "captured_share"))


@register
def feature_zscores(spark, sf_dir):
    return rounded(claims_model.feature_zscores(_panel(spark, sf_dir)[0]))


@register
def model_scores(spark, sf_dir):
    return rounded(claims_model.model_scores(_panel(spark, sf_dir)[0]))


@register
def block_scores(spark, sf_dir):
    """Blocks three levels below the default, because the small extract fills few of those."""
    return claims_model.block_scores(_panel(spark, sf_dir)[0], level=grid.LEVEL_FOR_RESOLUTION[4] + 3)


def _road_model(panel):
    return claims_model.fit_poisson(panel.filter(claims_model.is_train()),
                                    claims_model.feature_sets("collisions")["size + roads"], "collisions")


@register
def contributions(spark, sf_dir):
    panel = _panel(spark, sf_dir)[0]
    return rounded(claims_model.contributions(panel.filter(claims_model.is_test()), _road_model(panel)))


@register
def feature_importance(spark, sf_dir):
    panel = _panel(spark, sf_dir)[0]
    model = _road_model(panel)
    pushes = claims_model.contributions(panel.filter(claims_model.is_test()), model)
    return rounded(claims_model.feature_importance(pushes, model))


@register
def territory_multipliers(spark, sf_dir):
    panel = _panel(spark, sf_dir)[0]
    return rounded(claims_model.territory_multipliers(panel, _road_model(panel)))


@register
def effect_limit(spark, sf_dir):
    panel = _panel(spark, sf_dir)[0]
    return claims_model.effect_limit(claims_model.territory_multipliers(panel, _road_model(panel)))


@register
def contrasting_pair(spark, sf_dir):
    panel, features = _panel(spark, sf_dir)
    size_model = claims_model.fit_poisson(panel.filter(claims_model.is_train()),
                                          claims_model.feature_sets("collisions")["size"], "collisions")
    return rounded(claims_model.contrasting_pair(panel, features, size_model, _road_model(panel)))


# What makes the models provable: slopes of zero, and closed forms on stated weights ----------

@register
def score_equations(spark, sf_dir):
    """Of all ten fitted models: sums of predictions times feature, which are those of the counts."""
    panel = _panel(spark, sf_dir)[0]
    return rounded(claims_model.score_equations(panel, claims_model.month_models(panel)), default=3)


def _folded(spark, sf_dir):
    return durable(claims_model.with_folds(_panel(spark, sf_dir)[0], level=grid.LEVEL_FOR_RESOLUTION[4] + 3))


@register
def block_folds(spark, sf_dir):
    return _folded(spark, sf_dir).groupBy("block", "fold").agg(F.count("*").alias("rows"))


@register
def stated_fold_scores(spark, sf_dir):
    models = {"size": stated.SIZE_MODEL, "size + roads": stated.MODEL}
    folded = _folded(spark, sf_dir)
    scored = claims_model.fold_scores(folded, "collisions", {name: dict.fromkeys(range(fixed.BLOCK_FOLDS), m) for name, m in models.items()})
    return rounded(scored, default=3)


@register
def stated_scores(spark, sf_dir):
    models = {target: {"size": stated.SIZE_MODEL, "size + roads": stated.MODEL} for target in claims_model.TARGETS}
    return rounded(claims_model.model_scores(_panel(spark, sf_dir)[0], models))


@register
def stated_contributions(spark, sf_dir):
    return rounded(claims_model.contributions(_panel(spark, sf_dir)[0].filter(claims_model.is_test()), stated.MODEL))


@register
def stated_importance(spark, sf_dir):
    pushes = claims_model.contributions(_panel(spark, sf_dir)[0].filter(claims_model.is_test()), stated.MODEL)
    return rounded(claims_model.feature_importance(pushes, stated.MODEL))


@register
def stated_multipliers(spark, sf_dir):
    return rounded(claims_model.territory_multipliers(_panel(spark, sf_dir)[0], stated.MODEL))


@register
def stated_effect_limit(spark, sf_dir):
    return claims_model.effect_limit(claims_model.territory_multipliers(_panel(spark, sf_dir)[0], stated.MODEL))


@register
def stated_pair(spark, sf_dir):
    panel, features = _panel(spark, sf_dir)
    return rounded(claims_model.contrasting_pair(panel, features, stated.SIZE_MODEL, stated.MODEL))


# Scales and exports of maps ---------------------------------------------------

@register
def scale_ends(spark, sf_dir):
    """Ends of the scales of volumes and speeds per region, merged from sketches kept per tile and class."""
    tiles = adapters.segments(spark, sf_dir).select("dseg_id", "region", "tile_id", "frc")
    roads = tiles.join(_vintage(spark, sf_dir).select(F.col("segment_id").alias("dseg_id"), "aadt"), "dseg_id", "left") \
        .join(_sums(spark, sf_dir).groupBy("dseg_id").agg(
            F.try_divide(F.sum("harmonic_sum"), F.sum("hours")).alias("kph"), F.sum("hours").cast("double").alias("hours")), "dseg_id", "left")
    columns = ["aadt", "kph", "hours"]
    kept = durable(scales.sketches(roads, ["region", "tile_id", "frc"], columns))
    return rounded(scales.ends(scales.merged(kept, ["region"], columns), ["region"],
                               {"aadt": (0.05, 0.95), "kph": (0.1, 0.9), "hours": (0.02, 0.98)}))


@register
def route_features(spark, sf_dir):
    return risk.route_features(_route(spark, sf_dir))


@register
def cell_features(spark, sf_dir):
    layer = rounded(territory.cell_layer(_tables(spark, sf_dir), JOB, _cell()).select("cell", "map_km", "mean_speed_kph"), default=3)
    return export.cell_features(layer, territory.LEVEL, ["map_km", "mean_speed_kph"])


@register
def postcode_outlines(spark, sf_dir):
    """A feature per postcode: the squares of its assigned cells, with its features as properties."""
    frames = _territory(spark, sf_dir)
    shown = frames.features.select("postcode", "cells", F.round("addresses", 0).alias("addresses"))
    return export.area_features(frames.nearest.join(shown, "postcode"), "postcode", territory.LEVEL, ["postcode", "cells", "addresses"])


# Sources ----------------------------------------------------------------------

@register
def collisions_from_csv(spark, sf_dir):
    """Collision reports written as a delimited file and read back by column name: reports per month and severity."""
    path = f"{_folder(spark)}/collisions-{uuid.uuid4().hex}"
    adapters.collision_reports(spark, sf_dir).withColumn("other", F.lit("x,y")) \
        .select("date", "other", "collision_severity", "location_northing_osgr", "location_easting_osgr") \
        .write.csv(path, header=True)
    read = tables_module.collisions_csv(spark, path)
    return read.groupBy("year", "month", "severity").agg(F.count("*").alias("reports"), F.round(F.avg("easting"), 2).alias("easting"))


@register
def catalog_counts(spark, sf_dir):
    """Rows by class of one region, from tables named in the catalog, checked before the job starts."""
    tag, job = uuid.uuid4().hex, replace(JOB, region="london")
    names = {}
    for field, frame in (("segments", adapters.segments(spark, sf_dir)), ("volumes", adapters.volumes(spark, sf_dir))):
        names[field] = f"{field}_{tag}"
        frame.write.format("parquet").option("path", f"{_folder(spark)}/{names[field]}").saveAsTable(names[field])
    cut = RoadTables.from_catalog(spark, names).slice(job)
    tables_module.require_slice(cut.segments, job, "segments")
    return speed_report.count_by(cut.segments, "frc").join(speed_report.count_by(cut.volumes, "frc", "estimates"), "frc", "left")


@register
def decimal_sums(spark, sf_dir):
    """Kilometres by class added up as decimals and delivered as doubles."""
    metres = F.col("length_m").cast("decimal(12,1)")
    summed = adapters.segments(spark, sf_dir).groupBy("frc").agg(
        (F.sum(metres) / 1000).cast("decimal(20,4)").alias("km"), F.max(metres).alias("longest_m"))
    return export.decimals_to_double(summed)


@register
def major_roads_inside(spark, sf_dir):
    focus = map_report.signal_focus(adapters.traffic_signals(spark, sf_dir))
    box = speed_report.around_focus(focus, 0.15, 0.09)
    return map_report.roads_inside(adapters.map_segments(spark, sf_dir), box, fixed.MAJOR_ROADS).select("road_class", F.hex("geometry").alias("geometry"))


@register
def signals_per_cell_in_box(spark, sf_dir):
    signals = adapters.traffic_signals(spark, sf_dir)
    box = speed_report.around_focus(map_report.signal_focus(signals), 0.15, 0.09)
    return map_report.signals_per_cell(signals, grid.LEVEL_FOR_RESOLUTION[8], box)


@register
def cell_district(spark, sf_dir):
    return territory.cell_postcode(adapters.map_segments(spark, sf_dir), replace(JOB, postcode_level="district"))


@register
def district_size(spark, sf_dir):
    return territory.postcode_size(adapters.map_segments(spark, sf_dir), replace(JOB, postcode_level="district"))
