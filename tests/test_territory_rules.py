"""Cells, postcodes, features and the panel on hand-made roads."""

import struct
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import grid
from roadlens.params import Job
from roadlens.plans import territory
from roadlens.sources.tables import RoadTables, collisions_csv, located_collisions
from tests import frames
from tests.test_plans import plan

JOB = Job(region="london", first_date=date(2025, 9, 1), last_date=date(2025, 9, 7), vintage_year=2025)
MAP = ("region string, id string, subtype string, geometry binary, "
       "postal_codes array<struct<detailed:boolean,postal_codes:array<string>>>")


def line(*points):
    return bytearray(struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points))


def road(key, codes, detailed=True, at=(-0.1, 51.5), region="london", subtype="road"):
    x, y = at
    return (region, key, subtype, line((x, y), (x + 1e-6, y)), [(detailed, codes)])


def test_counting_codes_or_roads(spark):
    roads = spark.createDataFrame([road("a", ["SW1 1AA", "SW1 1AB", "SW1 1AC"]), road("b", ["SW1 2AA"]),
                                   road("c", ["SW1 2AA"])], MAP)
    assert territory.cell_postcode(roads, JOB).first().postcode == "SW1 1"
    assert territory.cell_postcode(roads, JOB, count_by="road").first().postcode == "SW1 2"


def test_ties_go_to_the_first_in_the_alphabet(spark):
    roads = spark.createDataFrame([road("a", ["SW2 1AA"]), road("b", ["SW1 9AA"])], MAP)
    assert territory.cell_postcode(roads, JOB).first().postcode == "SW1 9"


def test_a_district_alone_labels_no_sector(spark):
    roads = spark.createDataFrame([road("a", ["SW10"], detailed=False), road("b", ["SW10 0AB"], subtype="rail"),
                                   road("c", ["SW10 0AB"], region="austin")], MAP)
    assert territory.cell_postcode(roads, JOB).count() == 0
    district = Job(region="london", postcode_level="district")
    assert territory.cell_postcode(roads, district).first().postcode == "SW10"
    assert territory.postcode_size(roads, district).count() == 0  # only full codes count


def test_postcode_cut_by_the_edge_is_left_out(spark):
    cell = "cell long, lon double, lat double"
    mapped = spark.createDataFrame([(1, 0.0, 50.0), (2, 1.0, 51.0)], cell)
    labelled = spark.createDataFrame([(1, 0.0, 50.0, "in"), (2, 1.0, 51.0, "cut"), (3, 1.01, 51.0, "cut")],
                                     cell + ", postcode string")
    assert [r.postcode for r in territory.edge_postcodes(labelled, mapped).collect()] == ["cut"]
    assert territory.inside_labels(labelled, mapped).count() == 2


def test_layer_keeps_every_mapped_cell_and_never_multiplies(spark):
    tables = RoadTables(
        segments=frames.segments(spark, frames.segment(1, length=100.0), frames.segment(2, length=300.0),
                                 frames.segment(3, lon=0.4)),
        hourly=frames.hours(spark, *[frames.hour(1, utc=u, harmonic=20.0) for u in range(21)],
                            *[frames.hour(2, utc=u, harmonic=40.0, percentiles=frames.curve(60.0)) for u in range(21)]),
        volumes=frames.volumes(spark, frames.volume(1, length=100.0), frames.volume(2, length=300.0)))
    rows = {r.map_km: r for r in territory.cell_layer(tables, JOB, grid.cell_of_box(17)).collect()}
    both, bare = rows[0.4], rows[0.1]
    assert both.vehicle_km_per_day == pytest.approx(400.0)       # 21 hours per road multiply nothing
    assert both.naive_speed_kph == pytest.approx(30.0)
    assert both.mean_speed_kph == pytest.approx(35.0)            # weighted by length
    assert both.speeding_hours_pct == pytest.approx(100.0)       # over the road that can tell
    assert both.single_observation_pct == pytest.approx(25.0)
    assert bare.vehicle_km_per_day is None and bare.mean_speed_kph is None
    reach = {r.reach: (r.map_cells, r.road_km) for r in territory.reach_summary(
        territory.cell_layer(tables, JOB, grid.cell_of_box(17))).collect()}
    assert reach["on the map"] == (2, 1.0) and reach["with both"] == (1, 0.0)


def test_collisions_file(spark, tmp_path):
    path = tmp_path / "collisions-2025.csv"
    path.write_text("accident,date,collision_severity,location_easting_osgr,location_northing_osgr\n"
                    "1,31/10/2025,1,530000,180000\n2,01/02/2025,3,NULL,180000\n3,02/02/2025,,530000.5,180000\n")
    rows = sorted(collisions_csv(spark, str(path)).collect(), key=lambda r: r.month)
    assert [(r.easting, r.year, r.month, r.severity) for r in rows] == [
        (530000.5, 2025, 2, None), (530000.0, 2025, 10, 1)]


@pytest.mark.parametrize("line", ["1,31/10/2025,1,53O000,180000", "1,31/10/2025,severe,530000,180000"])
def test_malformed_collisions_end_the_job(spark, tmp_path, line):
    path = tmp_path / "collisions.csv"
    path.write_text(f"accident,date,collision_severity,location_easting_osgr,location_northing_osgr\n{line}\n")
    with pytest.raises(Exception, match="Cannot read"):
        collisions_csv(spark, str(path)).collect()


def test_panel_has_twelve_months_and_zeros(spark):
    features = spark.createDataFrame([("SW1 1", 10, 51.5, -0.1, *[1.0] * 10)],
                                     ["postcode", "addresses", "lat", "lon", *fixed.ROAD_FEATURES])
    labelled = spark.createDataFrame([(1, 0.0, 0.0, "SW1 1")],
                                     "cell long, easting double, northing double, postcode string")
    reports = spark.createDataFrame(
        [(5.0, 5.0, "03/02/2025", 1), (5.0, 5.0, "04/02/2025", 3), (9.0, 9.0, "04/03/2024", 2), (9e5, 9.0, "04/03/2024", 2)],
        "location_easting_osgr double, location_northing_osgr double, date string, collision_severity int")
    placed = territory.placed_collisions(located_collisions(reports), labelled, features)
    panel = {r.month: r for r in territory.collision_panel(placed, features).collect()}
    assert sorted(panel) == list(range(1, 13))
    assert (panel[2].collisions, panel[2].ksi) == (2, 1) and (panel[3].collisions, panel[3].ksi) == (0, 0)
    assert all((r.prior_collisions, r.prior_ksi) == (1, 1) for r in panel.values())


def test_features_weight_speed_by_traffic(spark):
    columns = ["cell", "map_km", *territory.VOLUME_COLUMNS, "observed_segments", "naive_speed_kph", *fixed.SPEED_SIGNALS, "postcode"]
    rows = [(1, 1.0, 2.0, 900.0, 900.0, 1000.0, 500.0, 1, 100.0, *[100.0] * 6, "A"),
            (2, 1.0, 1.0, 100.0, 0.0, 100.0, 50.0, 9, 20.0, *[20.0] * 6, "A"),
            (3, 1.0, None, None, None, None, None, None, None, *[None] * 6, "A"),
            (4, 1.0, None, None, None, None, None, None, None, *[None] * 6, "B")]
    schema = ", ".join(f"{c} {'string' if c == 'postcode' else 'long' if c in ('cell', 'observed_segments') else 'double'}" for c in columns)
    assigned = spark.createDataFrame(rows, schema)
    sizes = spark.createDataFrame([("A", 5), ("B", 5), ("C", 1)], "postcode string, addresses long")
    centres = spark.createDataFrame([("A", 51.0, 0.0)], "postcode string, lat double, lon double")
    none = spark.createDataFrame([], "postcode string")
    features = territory.postcode_features(assigned, sizes, none, centres)
    row, = features.collect()  # B has no traffic, C no cells
    assert row.cells == 3 and row.mean_speed_kph == pytest.approx(92.0) and row.naive_speed_kph == pytest.approx(28.0)
    assert row.network_coverage_pct == 100.0 and row.major_road_share == pytest.approx(0.9)
    assert row.weekend_traffic_ratio == pytest.approx(0.5)
    gap = territory.weighting_gap(features, 3, 5).first()
    assert gap.gap_kph == pytest.approx(64.0)
    edges = spark.createDataFrame([("A",)], "postcode string")
    assert territory.postcode_features(assigned, sizes, edges, centres).count() == 0


def test_collisions_are_placed_once_for_both_years(spark, monkeypatch):
    features = spark.createDataFrame([("SW1 1", 5, 51.5, -0.1, *[1.0] * 10)], "postcode string, addresses long, lat double, lon double, "
                                     + ", ".join(f"{name} double" for name in fixed.ROAD_FEATURES))
    inside = spark.createDataFrame([(7, 0.0, 0.0, "SW1 1")], "cell long, easting double, northing double, postcode string")
    reports = spark.createDataFrame([(10.0, 0.0, 2025, 3, 3), (10.0, 5.0, 2024, 5, 1)],
                                    "easting double, northing double, year int, month int, severity int")
    read, build = [], territory.collision_panel
    monkeypatch.setattr(territory, "collision_panel", lambda placed, *rest: read.append(placed) or build(placed, *rest))
    panel, _ = territory.claims_panel(SimpleNamespace(features=features, inside=inside), reports)
    assert {(r.month, r.collisions, r.prior_collisions, r.prior_ksi) for r in panel.collect() if r.collisions} == {(3, 1, 1, 1)}
    assert "Join" not in plan(read[0])


def test_reports_move_once_and_are_counted_where_they_arrive(spark):
    labelled = spark.createDataFrame([(1, 0.0, 0.0, "SW1 1"), (2, 9000.0, 0.0, "SW1 2")],
                                     "cell long, easting double, northing double, postcode string")
    reports = spark.createDataFrame(
        [(5.0, 5.0, 2025, 2, 1), (5.0, 5.0, 2025, 2, 3), (5.0, 5.0, 2025, 2, None), (5.0, 5.0, 2025, 3, None), (-5.0, 5.0, 2025, 2, 2),
         (9001.0, 0.0, 2024, 2, 2), (4500.0, 0.0, 2024, 2, 2), (None, 5.0, 2025, 2, 1)],
        "easting double, northing double, year int, month int, severity int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = territory.placed_collisions(reports, labelled, labelled.select("postcode"))
        exchanges = [line for line in plan(placed).splitlines() if "Arguments: hashpartitioning(" in line]
        rows = placed.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The reports once, the labels by small square and by tile, then placed rows and features by postcode.
    assert sum("_home#" in line for line in exchanges) == 1 and not any("(easting#" in line for line in exchanges)
    assert sorted(tuple(r) for r in rows) == [("SW1 1", 2025, 2, 4, 2), ("SW1 1", 2025, 3, 1, 0), ("SW1 2", 2024, 2, 1, 1)]
