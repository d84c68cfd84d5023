"""Meaning of NULLs, limits, time zones and conditions on hand-made hours."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from roadlens.functions import measures, timeaxis
from roadlens.operators.hours import measured
from roadlens.params import Job
from roadlens.plans import risk, speed_report, volume_report
from roadlens.sources.export import decimals_to_double
from roadlens.sources.tables import RoadTables, tile_slice
from tests import frames

JOB = Job(region="london", first_date=date(2025, 9, 1), last_date=date(2025, 10, 31), vintage_year=2025)


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_flags_are_null_when_the_hour_cannot_tell(spark):
    roads = frames.segments(spark, frames.segment(1), frames.segment(2, limit=None),
                            frames.segment(3, limit=0.0))
    hours = frames.hours(
        spark, frames.hour(1, utc=1, percentiles=frames.curve(40.0)), frames.hour(1, utc=2),
        frames.hour(2, utc=3, percentiles=frames.curve(40.0)), frames.hour(3, utc=4),
        frames.hour(1, utc=5, harmonic=0.0, percentiles=frames.curve(0.0)))
    got = rows(measured(hours, roads, JOB), "hour_utc")
    assert set(got) == {1, 2, 3, 4}  # no speed, no row
    assert got[1].speeding is True and got[1].congested is False
    assert got[2].speeding is None and got[2].congested is False
    assert got[3].speeding is None and got[3].congested is None
    assert got[4].speeding is None and got[4].congested is None


@pytest.mark.parametrize("low, share", [(60.0, 0.95), (10.0, 0.0), (40.5, 0.45)])
def test_over_limit_share(spark, low, share):
    df = frames.hours(spark, frames.hour(1, percentiles=frames.curve(low))) \
        .withColumn("speed_limit_kph", F.lit(50.0))
    assert df.select(measures.over_limit_share()).first()[0] == pytest.approx(share)


def test_local_week(spark):
    """A London Sunday 23:00 UTC in summer is Monday 00:00; the weekend follows the UTC date."""
    day = date(2025, 9, 7)
    df = measured(frames.hours(spark, frames.hour(1, day, 23)), frames.segments(spark, frames.segment(1)), JOB)
    row = df.first()
    assert row.is_weekend is True and row.hour_local == 0
    slot = frames.hours(spark, frames.hour(1, day, 23)).withColumn("time_zone", F.lit("Europe/London")) \
        .select(timeaxis.hour_of_week(timeaxis.local_hours())).first()[0]
    assert slot == 0


def test_clock_change_shares_a_slot(spark):
    """On 26 October 2025 London has 25 hours: two UTC hours fall on 01:00."""
    day = date(2025, 10, 26)
    df = frames.hours(spark, *[frames.hour(1, day, utc) for utc in range(4)]) \
        .withColumn("time_zone", F.lit("Europe/London"))
    hours = [r[0] for r in df.select("hour_utc", timeaxis.hour_of_day(timeaxis.local_hours()).alias("h"))
             .orderBy("hour_utc").select("h").collect()]
    assert hours == [1, 1, 2, 3]


def test_time_axis_ignores_the_session_zone(spark):
    df = frames.hours(spark, frames.hour(1, date(2025, 9, 1), 0)).withColumn("time_zone", F.lit("America/Chicago"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert df.select(timeaxis.hour_of_week(timeaxis.local_hours())).first()[0] == 163
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_half_hour_zone(spark):
    df = frames.hours(spark, frames.hour(1, date(2025, 9, 1), 0)).withColumn("time_zone", F.lit("Asia/Kolkata"))
    assert df.select(timeaxis.hour_of_day(timeaxis.local_hours())).first()[0] == 5


def test_splitting_a_segment_changes_nothing(spark):
    hour = frames.hour(1, percentiles=frames.curve(45.0))
    whole = RoadTables(segments=frames.segments(spark, frames.segment(1, length=200.0)),
                       hourly=frames.hours(spark, hour),
                       volumes=frames.volumes(spark, frames.volume(1, length=200.0)))
    halves = RoadTables(segments=frames.segments(spark, frames.segment(1), frames.segment(2)),
                        hourly=frames.hours(spark, hour, (2, *hour[1:])),
                        volumes=frames.volumes(spark, frames.volume(1), frames.volume(2)))
    one = risk.risky_totals(risk.cell_slot_km(whole, JOB)).collect()
    two = risk.risky_totals(risk.cell_slot_km(halves, JOB)).collect()
    for a, b in zip(one, two):
        assert a.condition == b.condition
        assert a.km_per_day == pytest.approx(b.km_per_day)
        assert a.pct_of_measured == pytest.approx(b.pct_of_measured)


def test_unmeasured_driving_is_not_safe(spark):
    tables = RoadTables(
        segments=frames.segments(spark, frames.segment(1), frames.segment(2, cell=None)),
        hourly=frames.hours(spark, frames.hour(1, percentiles=frames.curve(60.0)), frames.hour(1, utc=9)),
        volumes=frames.volumes(spark, frames.volume(1), frames.volume(2, cell=None)))
    cells = risk.cell_slot_km(tables, JOB)
    by_slot = rows(risk.risky_km_by_slot(cells), "slot")
    assert len(by_slot) == 168
    wednesday_nine = by_slot[2 * 24 + 9]   # 8 UTC is 9 in London
    assert wednesday_nine.over_limit_pct == pytest.approx(95.0)
    assert wednesday_nine.measured_km == pytest.approx(wednesday_nine.vehicle_km / 2)
    assert by_slot[2 * 24 + 10].measured_km == 0 and by_slot[2 * 24 + 10].over_limit_pct is None
    total = risk.risky_totals(cells).first()
    assert total.driven_km_per_day == pytest.approx(sum(r.vehicle_km for r in by_slot.values()) / 7)
    hexagons = risk.risky_km_by_hexagon(cells).collect()
    assert [h.hexagon for h in hexagons] == ["86283082fffffff"]  # the cell without an id is left out
    assert hexagons[0].over_limit_pct is None                    # below the floor


def test_tile_slice_keeps_only_the_regions_tiles(spark):
    hours = frames.hours(spark, frames.hour(1), (2, *frames.hour(2)[1:8], 9))
    assert [r.dseg_id for r in tile_slice(hours, frames.segments(spark, frames.segment(1))).collect()] == [1]


def test_histogram_clamps(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (9.99,), (10.0,), (99.0,), (None,)], "x double")
    got = {r.bucket: r.rows for r in speed_report.histogram(df, F.col("x"), 0, 10, 5).collect()}
    assert got == {0: 2, 4: 3}


def test_cells_need_three_told_segments(spark):
    roads = frames.segments(spark, *[frames.segment(k) for k in range(1, 4)],
                            *[frames.segment(k, cell="892830828c7ffff") for k in range(4, 7)])
    hours = frames.hours(spark, *[frames.hour(k, percentiles=frames.curve(45.0)) for k in range(1, 6)],
                         frames.hour(6))
    cells = speed_report.cell_congestion(measured(hours, roads, JOB)).collect()
    assert [(c.h3_r9, c.segments, c.speeding_pct) for c in cells] == [(frames.CELL, 3, 100.0)]


def test_congestion_ratio_can_use_local_hours(spark):
    roads = frames.segments(spark, frames.segment(1, zone="America/Chicago"))
    hours = frames.hours(spark, frames.hour(1, utc=13, percentiles=frames.curve(20.0)),
                         frames.hour(1, utc=4, percentiles=frames.curve(50.0)))
    base = measured(hours, roads, JOB)
    assert speed_report.congestion_ratio(base).count() == 0                     # 13 UTC is no peak
    assert speed_report.congestion_ratio(base, "hour_local").first().ratio == pytest.approx(22 / 66)


def test_exposure_does_not_depend_on_the_cut(spark):
    one = volume_report.exposure_per_cell(frames.volumes(spark, frames.volume(1, length=3000.0))).first()
    many = volume_report.exposure_per_cell(
        frames.volumes(spark, *[frames.volume(k, length=300.0) for k in range(10)])).first()
    assert one.vehicle_km_per_day == many.vehicle_km_per_day == 3000.0


def test_standing_on_a_distribution(spark):
    df = spark.createDataFrame([(frames.curve(50.0, 5.0),)], "c array<double>")
    for speed, level in [(49.0, 0.0), (50.0, 5.0), (52.5, 7.5), (97.5, 52.5), (140.0, 95.0), (141.0, 100.0)]:
        assert df.select(risk.percentile_rank(speed, F.col("c"))).first()[0] == pytest.approx(level)


def test_route_and_road_beside_it(spark):
    tables = RoadTables(
        segments=frames.segments(spark, frames.segment(1, ways=[7, 8]), frames.segment(2, ways=[9], street="A20"),
                                 frames.segment(3, ways=[9], street="B1"), frames.segment(4, limit=None, ways=[8])),
        hourly=frames.hours(spark, *[frames.hour(k, percentiles=frames.curve(60.0)) for k in range(1, 5)]))
    hours = risk.route_hours(tables, JOB, [8], "A20", 50)
    assert {r.dseg_id: r.on_route for r in hours.collect()} == {1: True, 2: False, 4: True}
    over = rows(risk.segment_over_limit(hours), "dseg_id")
    assert over[1].over_limit_pct == 105.3  # 100 % of the readable ones, stretched by 100/95
    assert over[4].over_limit_pct is None
    with pytest.raises(ValueError, match="lies on the ways"):
        risk.require_route(risk.route_hours(tables, JOB, [99], "A20", 50), [99], JOB)


@pytest.mark.parametrize("segments", [20, 2000])
def test_sample_repeats_and_keeps_its_share_at_every_size(spark, segments):
    roads = frames.segments(spark, *[frames.segment(k, frc=k % 7) for k in range(segments)])
    hours = frames.hours(spark, *[frames.hour(k, utc=u, harmonic=100.0 + k) for k in range(segments) for u in range(24)])
    base = measured(hours, roads, JOB)
    take = lambda df: sorted(map(tuple, speed_report.speed_sample(df, 0.5).collect()))
    half = take(base)
    eligible = base.filter("frc <= 4").count()
    assert 0.43 * eligible < len(half) < 0.57 * eligible and max(r[-1] for r in half) <= 150.0
    assert half == take(base.repartition(7))


def test_decimals_become_doubles(spark):
    df = decimals_to_double(spark.sql("SELECT 1.0 * 2 AS a, 'x' AS b, 3 AS c"))
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "int"}


def test_trips_find_their_segments_once(spark):
    roads = frames.segments(spark, frames.segment(1, ways=[7, 8]), frames.segment(2, ways=[8]), frames.segment(3, ways=[9]))
    trips = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 9), (3, 5)], "trip_id long, osm_way_id long")
    assert sorted(map(tuple, risk.trip_segments(trips, roads).collect())) == [(1, 1), (1, 2), (2, 3)]


def test_trips_are_dealt_over_as_many_tasks_as_their_rows_need(spark):
    roads = frames.segments(spark, *[frames.segment(k, ways=[k, 2 * k]) for k in range(1, 30)])
    rows = [(trip, 1 + (trip * 5 + i) % 12) for trip in range(100) for i in range(3)] * 2
    trips = spark.createDataFrame([*rows, (None, 2), (None, 2), (7, None)], "trip_id long, osm_way_id long")
    found = risk.trip_segments(trips, roads, rows_per_task=50)
    assert found.rdd.getNumPartitions() == 603 // 50 + 1
    want = {(trip, k) for trip, way in [*rows, (None, 2)] for k in range(1, 30) if way in (k, 2 * k)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_extent_covers_dates_outside_any_window(spark):
    days = [(date(2020, 1, 1), None), (date(2025, 9, 1), [1]), (date(2025, 9, 1), [2]), (date(2031, 1, 1), [3])]
    (row,) = speed_report.observation_extent(
        spark.createDataFrame(days, "observation_date date, speed_percentiles_kph array<int>")).collect()
    assert (row.first_date, row.last_date, row.days, row.hourly_rows) == (date(2020, 1, 1), date(2031, 1, 1), 3, 4)
    assert row.single_observation_pct == 25.0
