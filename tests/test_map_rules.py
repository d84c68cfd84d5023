"""Map attributes: units, conditional limits, empty arrays, junctions, geometry."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from roadlens.functions import geometry, grid, measures, metric
from roadlens.plans import map_report
from roadlens.sources.export import geojson_features, write_geojson_lines


@pytest.mark.parametrize("value, unit, mph", [(50.0, "mph", 50.0), (96.0, "km/h", 60.0), (10.0, "knots", None)])
def test_units(spark, value, unit, mph):
    df = spark.createDataFrame([((value, unit),)], "s struct<value:double,unit:string>")
    assert df.select(measures.mph(F.col("s"))).first()[0] == mph


def test_limit_for_everyone_comes_first(spark):
    df = spark.sql("""SELECT array(
        named_struct('max_speed', named_struct('value', 40D, 'unit', 'mph'), 'when', named_struct('mode', array('hgv'))),
        named_struct('max_speed', named_struct('value', 60D, 'unit', 'mph'), 'when', NULL)) AS speed_limits""")
    assert df.select(measures.whole_segment_limit()["value"]).first()[0] == 60.0


def test_empty_and_missing_arrays_are_not_filled(spark):
    df = spark.createDataFrame([("road", "trunk", [1]), ("road", "trunk", []), ("road", "trunk", None)],
                               "subtype string, class string, toll array<int>")
    assert map_report.fill_rates(df, ["toll"]).first().toll == pytest.approx(100 / 3)


def test_busy_connectors_share_the_last_bucket(spark):
    ends = [("trunk", [Row(connector_id="hub"), Row(connector_id=f"c{i}")]) for i in range(9)]
    df = spark.createDataFrame(ends, "road_class string, connectors array<struct<connector_id:string>>")
    assert {r.segments: r.connectors for r in map_report.connector_degree(df).collect()} == {1: 9, 6: 1}


def test_signpost_needs_both_roads(spark):
    roads = spark.createDataFrame([("a", "M1", "motorway"), ("b", "A1", "trunk"), ("c", "Lane", "service")],
                                  "id string, name string, road_class string")
    posts = spark.sql("""
        SELECT id, named_struct('id', f) AS from_segment, named_struct('id', t) AS to_segment,
               array(named_struct('destination_name', named_struct('primary', 'Leeds')),
                     named_struct('destination_name', named_struct('primary', 'York'))) AS destination_info,
               array(named_struct('route_text', named_struct('primary', 'M1'))) AS route_info
        FROM VALUES ('1', 'a', 'b'), ('2', 'a', 'gone'), ('3', 'c', 'a'), ('4', 'a', 'a') v(id, f, t)""")
    got = sorted(map_report.signpost_readout(posts, roads).collect(), key=lambda r: r.signpost_id)
    assert [(r.signpost_id, r.from_road, r.to_road, r.destinations, r.routes) for r in got] == [
        ("1", "M1", "A1", "Leeds | York", "M1"), ("4", "M1", "M1", "Leeds | York", "M1")]


@pytest.mark.parametrize("child, resolution, parent", [
    ("89283082803ffff", 6, "86283082fffffff"), ("89283082803ffff", 8, "8828308281fffff")])
def test_h3_parent(spark, child, resolution, parent):
    df = spark.createDataFrame([(child,)], "c string")
    assert df.select(grid.h3_parent(F.col("c"), resolution)).first()[0] == parent


def test_grid_round_trip(spark):
    points = [(-0.1234, 51.5), (179.99, -89.99), (-180.0, -90.0), (-97.74, 30.27), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn(
        "cell", grid.cell_of_point(F.col("lon"), F.col("lat"), 17))
    for r in df.select("*", grid.centre_lon(F.col("cell"), 17).alias("x"), grid.centre_lat(F.col("cell"), 17).alias("y"),
                       grid.grid_parent(F.col("cell"), 17, 10).alias("up"),
                       grid.cell_of_point(F.col("lon"), F.col("lat"), 10).alias("coarse")).collect():
        half = 180.0 / (1 << 17)
        assert abs(r.x - r.lon) <= half * 1.0001 and abs(r.y - r.lat) <= half * 1.0001
        assert r.up == r.coarse


@pytest.mark.parametrize("line", [
    [(0.1, 50.1), (0.14, 50.13)], [(0.14, 50.1), (0.1, 50.13), (0.1, 50.2)], [(0.1, 50.1), (0.13, 50.1)],
    [(0.1, 50.1)], [(0.1, 50.2), (0.1, 50.1)]])
def test_line_cover_against_dense_points(spark, line):
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in line],)], "v array<struct<lon:double,lat:double>>")
    cover = set(df.select(grid.cells_of_line(F.col("v"), 15)).first()[0])
    dense = [line[0]]
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        dense += [(x0 + (x1 - x0) * i / 5000, y0 + (y1 - y0) * i / 5000) for i in range(5001)]
    points = spark.createDataFrame(dense, "lon double, lat double")
    touched = {r[0] for r in points.select(grid.cell_of_point(F.col("lon"), F.col("lat"), 15)).distinct().collect()}
    assert touched <= cover and len(cover - touched) <= 1  # a corner may be cut between two samples


def test_wkt_and_wkb_agree(spark):
    blob = struct.pack("<BII4d", 1, 2, 2, -0.5, 51.0, 0.25, 51.5)
    big = struct.pack(">BII4d", 0, 2, 2, -0.5, 51.0, 0.25, 51.5)
    with_z = struct.pack("<BII6d", 1, 1002, 2, -0.5, 51.0, 9.0, 0.25, 51.5, 9.0)
    df = spark.createDataFrame([("LINESTRING (-0.5 51.0, 0.25 51.5)", bytearray(b)) for b in (blob, big, with_z)],
                               "wkt string, wkb binary")
    for r in df.select(geometry.wkt_vertices(F.col("wkt")).alias("a"), geometry.wkb_vertices("wkb").alias("b")).collect():
        assert r.a == r.b and [tuple(v) for v in r.a] == [(-0.5, 51.0), (0.25, 51.5)]


def test_missing_geometry(spark):
    df = spark.createDataFrame([(None, None), ("LINESTRING EMPTY", None)], "wkt string, wkb binary")
    assert [tuple(r) for r in df.select(geometry.wkt_vertices(F.col("wkt")), geometry.wkb_vertices("wkb")).collect()] \
        == [(None, None), (None, None)]


def test_national_grid_at_a_published_point(spark):
    """The worked example of the national mapping agency: 52 39 28.8 N, 1 42 57.8 E (WGS84)."""
    df = spark.createDataFrame([(1.716073973, 52.658007833)], "lon double, lat double")
    row = metric.national_grid(df).first()
    assert row.easting == pytest.approx(651409.8, abs=6) and row.northing == pytest.approx(313177.3, abs=6)


def test_haversine(spark):
    df = spark.createDataFrame([(-0.1276, 51.5072, 2.3522, 48.8566)], "a double, b double, c double, d double")
    assert df.select(metric.haversine_m(*[F.col(x) for x in "abcd"])).first()[0] == pytest.approx(343_556, rel=1e-3)


def test_features_are_written_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "LINESTRING (0 1, 2 3)"), (2, 5.0, "LINESTRING (4 5, 6 7)")],
                               "id int, speed double, wkt string")
    features = geojson_features(df, geometry.geojson_line(geometry.wkt_vertices(F.col("wkt"))), ["id", "speed"])
    write_geojson_lines(features, str(tmp_path / "out"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()),
                 key=lambda f: f["properties"]["id"])
    assert got[0] == {"type": "Feature", "properties": {"id": 1, "speed": None},
                      "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}}
    assert got[1]["properties"]["speed"] == 5.0


def wkb_line(points, order="<", extra=0, srid=False):
    kind = 2 | (0x80000000 if extra else 0) | (0x20000000 if srid else 0)
    body = struct.pack(order + "BI", 1 if order == "<" else 0, kind) + (struct.pack(order + "I", 4326) if srid else b"")
    return body + struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "2d", *p) + struct.pack(order + "d", 7.0) * extra for p in points)


@pytest.mark.parametrize("mixed", [False, True])
def test_cells_of_wkb_lines_equal_the_cover_of_their_vertices(spark, mixed):
    rng = np.random.default_rng(8)
    step = 360 / (1 << 17)
    rows = [(None,), (wkb_line([]),), (wkb_line([(0.5 * step, 0.5 * step)]),), (wkb_line([(0.0, 0.0), (0.0, 3 * step), (step, 3 * step)]),)]
    for n in rng.integers(1, 9, 200):
        points = (rng.normal(0, 4, (n, 2)) * step).round(9) + ([0.0, 0.0], [-0.1, 51.5], [-97.8, 30.2])[rng.integers(3)]
        rows.append((wkb_line([tuple(p) for p in points]),))
    if mixed:
        rows += [(wkb_line([(0.1, 0.2), (0.1003, 0.2004)], order, extra, srid),) for order in "<>" for extra in (0, 1) for srid in (False, True)]
    df = spark.createDataFrame(rows, "geometry binary").coalesce(1)
    vertices = geometry.wkb_vertices("geometry")
    made = df.select(geometry.wkb_cells(F.col("geometry"), 17).alias("fast"), vertices.alias("v")) \
        .select("fast", F.size("v").alias("n"), grid.cells_of_line(F.col("v"), 17).alias("slow")).collect()
    assert sum(r.fast is None for r in made) == 1
    for r in made:
        if r.n is not None and r.n > 0:
            assert r.fast == sorted(set(r.slow)) and len(r.fast) >= 1
    assert [r.fast for r in made if r.n == 0] == [[]]
