"""Quantiles from merged sketches against sorted values, and features of cells, areas and routes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.functions import grid
from roadlens.operators import scales
from roadlens.plans import risk
from roadlens.sources import export
from tests import frames


def test_ends_are_exact_up_to_k_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i % 3}", i % 17, float(v), None if i % 5 else float(i)) for i, v in enumerate(rng.lognormal(3, 1, 3000))]
    rows += [("r0", 3, float("nan"), None), ("r9", 1, None, None)]
    df = spark.createDataFrame(rows, "region string, cell int, x double, y double")
    kept = scales.sketches(df, ["region", "cell"], ["x", "y"])
    made = {(r.region, r.scale): (r.low, r.high) for r in scales.ends(
        scales.merged(kept, ["region"], ["x", "y"]), ["region"], {"x": (0.05, 0.95), "y": (0.1, 0.98)}).collect()}
    for region in ("r0", "r1", "r2"):
        for column, (low, high) in {2: (0.05, 0.95), 3: (0.1, 0.98)}.items():
            values = sorted(r[column] for r in rows if r[0] == region and r[column] is not None and r[column] == r[column])
            at = lambda share: values[max(1, int(np.ceil(share * len(values) - 1e-9))) - 1]
            assert made[region, "xy"[column - 2]] == (at(low), at(high))
    assert made["r9", "x"] == made["r9", "y"] == (None, None)


def test_ends_of_many_rows_stay_within_the_rank_error(spark):
    df = spark.range(300_000).select((F.col("id") % 40).alias("cell"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double").alias("x"))
    kept = scales.sketches(df, ["cell"], ["x"], k=512)
    row = scales.ends(scales.merged(kept, [], ["x"], k=512), [], {"x": (0.05, 0.98)}).first()
    below = df.agg(F.avg((F.col("x") <= row.low).cast("int")).alias("low"), F.avg((F.col("x") <= row.high).cast("int")).alias("high")).first()
    assert abs(below.low - 0.05) <= scales.rank_error(512) and abs(below.high - 0.98) <= scales.rank_error(512)


def test_cell_squares_close_and_hold_their_centre(spark, tmp_path):
    points = [(-0.1278, 51.5074), (-97.74, 30.27), (151.2, -33.9)]
    cells = spark.createDataFrame([(*p, i) for i, p in enumerate(points)], "lon double, lat double, n int") \
        .select(grid.cell_of_point(F.col("lon"), F.col("lat"), 17).alias("cell"), "n", F.lit(float("nan")).alias("x"))
    rows = {json.loads(r.feature)["properties"]["n"]: json.loads(r.feature) for r in export.cell_features(cells, 17, ["n", "x"]).collect()}
    for i, (lon, lat) in enumerate(points):
        ring = rows[i]["geometry"]["coordinates"][0]
        assert rows[i]["properties"]["x"] is None and ring[0] == ring[-1] and len(ring) == 5
        (w, s), (e, n) = ring[0], ring[2]
        assert w <= lon <= e and s <= lat <= n and e - w == pytest.approx(360 / 2 ** 17, abs=1e-6)
    export.write_cell_features(export.cell_features(cells, 17, ["n"]), str(tmp_path / "out"), 2)
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_an_area_is_the_squares_of_its_cells(spark):
    rows = [("A", 40, 2), ("B", 7, 5), ("A", 12, 2), (None, 3, 1)]
    cells = spark.createDataFrame(rows, "postcode string, cell long, size int")
    made = {r.postcode: json.loads(r.feature) for r in export.area_features(cells, "postcode", 17, ["postcode", "size"]).collect()}
    assert len(made["A"]["geometry"]["coordinates"]) == 2 and made["A"]["properties"] == {"postcode": "A", "size": 2}
    one = json.loads(export.cell_features(cells.filter("cell = 12"), 17, ["size"]).first().feature)
    assert made["A"]["geometry"]["coordinates"][0] == one["geometry"]["coordinates"]
    assert made[None]["properties"]["postcode"] is None


def test_route_features_leave_unknown_shares_null(spark):
    hours = spark.createDataFrame(
        [(1, "High St", 30.0, "LINESTRING (0 51, 0.1 51.1)", True, frames.curve(20.0), 25.0),
         (2, None, None, "LINESTRING (0.1 51.1, 0.2 51.1)", True, frames.curve(20.0), 25.0),
         (3, "Aside", 30.0, "LINESTRING (1 51, 1 52)", False, frames.curve(20.0), 25.0)],
        "dseg_id long, street_name string, speed_limit_kph double, geometry_wkt string, on_route boolean, speed_percentiles_kph array<double>, harmonic_speed_kph double")
    made = {f["properties"]["dseg_id"]: f for f in (json.loads(r.feature) for r in risk.route_features(hours).collect())}
    assert sorted(made) == [1, 2] and made[2]["properties"]["over_limit_pct"] is None
    assert made[1]["properties"]["over_limit_pct"] == round(round(100 * 8 / 19, 1) * 100 / 95, 1)
    assert made[1]["geometry"] == {"type": "LineString", "coordinates": [[0.0, 51.0], [0.1, 51.1]]}
