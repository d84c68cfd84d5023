"""The nearest neighbour by great circle against brute force, in every latitude and across the date line."""

import math

import numpy as np
import pytest

from roadlens.functions import metric
from roadlens.operators.nearest import Bands, nearest_around
from roadlens.plans import territory

R = metric.EARTH_RADIUS_M


def haversine(a, b):
    lon_a, lat_a, lon_b, lat_b = map(math.radians, (*a, *b))
    h = math.sin((lat_b - lat_a) / 2) ** 2 + math.cos(lat_a) * math.cos(lat_b) * math.sin((lon_b - lon_a) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def around(rng, lon, lat, n, spread_m):
    """Points about a place, some across a pole or the date line."""
    out = []
    for _ in range(n):
        north, east = rng.normal(0, spread_m, 2) / R
        la = math.degrees(math.radians(lat) + north)
        lo = lon + math.degrees(east / max(math.cos(math.radians(lat)), 1e-3))
        if abs(la) > 90:
            la, lo = math.copysign(180 - abs(la), la), lo + 180
        out.append(((lo + 180) % 360 - 180, la))
    return out


@pytest.mark.parametrize("place", [(-0.1, 51.5), (-97.8, 30.2), (144.9, -37.8), (179.999, 0.0), (-179.99, -16.8), (25.0, 89.99),
                                   (10.0, -89.995), (10.0, 70.0), (0.0, 0.0)])
@pytest.mark.parametrize("reach", [1500.0, 40000.0])
def test_nearest_by_brute_force(spark, place, reach):
    rng = np.random.default_rng(int(place[1] * 10) + 1000)
    points, targets = around(rng, *place, 120, 1.5 * reach), around(rng, *place, 60, 1.5 * reach)
    targets += targets[:3]                                     # equal distances go to the smaller name
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)] + [(999, None, None)], "id int, lon double, lat double")
    t = spark.createDataFrame([(i, *x, f"t{i}") for i, x in enumerate(targets)], "cell int, lon double, lat double, name string")
    made = {r.id: (r.name, r.distance_m) for r in nearest_around(p, t, ["id"], reach, ["name"], "cell").collect()}
    expected = {}
    for i, x in enumerate(points):
        distance, cell = min((round(haversine(x, y), 6), k) for k, y in enumerate(targets))
        if distance < reach:
            expected[i] = f"t{cell}", distance
    assert {i: n for i, (n, _) in made.items()} == {i: n for i, (n, _) in expected.items()}
    assert all(made[i][1] == pytest.approx(d, abs=1e-3) for i, (_, d) in expected.items())


def test_a_target_is_copied_nine_times_at_most(spark):
    from pyspark.sql import functions as F
    bands = Bands(1500.0)
    rows = spark.range(0, 18000).select((F.col("id") / 100 - 90).alias("lat")).select(bands.row(F.col("lat")).alias("r"), "lat")
    widths = rows.select(bands.columns(F.col("r")).alias("n"), F.cos(F.radians("lat")).alias("c")).collect()
    # A column is as wide as the reach on the ground, and not much wider except beside a pole.
    for r in widths:
        ground = 2 * math.pi * R * abs(r.c) / r.n
        assert r.n == 1 or ground >= 1500.0
        assert abs(r.c) < 0.01 or ground < 1500.0 * 1.2


def test_the_british_grid_refuses_other_places(spark):
    df = spark.createDataFrame([(-97.8, 30.2)], "lon double, lat double")
    with pytest.raises(Exception, match="outside the British National Grid"):
        metric.national_grid(df).collect()
    labelled = spark.createDataFrame([(1, "A", 0.0, 51.0)], "cell long, postcode string, lon double, lat double")
    collisions = spark.createDataFrame([(1.0, 2.0, 2025, 1, 3)], "easting double, northing double, year int, month int, severity int")
    with pytest.raises(ValueError, match="metric grid"):
        territory.placed_collisions(collisions, labelled, labelled.select("postcode"))


def test_collisions_in_degrees_are_placed(spark):
    labelled = spark.createDataFrame([(1, "A", -97.80, 30.20), (2, "B", -97.70, 30.20)], "cell long, postcode string, lon double, lat double")
    collisions = spark.createDataFrame([(-97.801, 30.201, 2025, 1, 1), (-97.801, 30.201, 2025, 1, 3), (-97.705, 30.199, 2025, 2, 3), (-97.75, 30.20, 2025, 2, 3),
                                        (None, None, 2025, 2, 3)], "lon double, lat double, year int, month int, severity int")
    rows = territory.placed_collisions(collisions, labelled, labelled.select("postcode")).collect()
    assert sorted(tuple(r) for r in rows) == [("A", 2025, 1, 2, 1), ("B", 2025, 2, 1, 0)]
