"""Roads north of latitude 61, where the published area of the British grid ends and its plane goes on."""

import math
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from roadlens import fixed
from roadlens.functions import metric
from roadlens.operators import ordered
from workload import queries
from workload.check import differences, oracle_rows
from workload.oracle import oracle_sql
from workload.queries import QUERIES
from workload.views_sql import with_national_grid

# Forty map blocks of the adapters, in two rows, the southern one from latitude 61.1 on.
FIRST, LAST = 330 * 20, 332 * 20
TABLES = {
    "part": f"""SELECT k AS p_partkey, 'part ' || k AS p_name, 'form ' || (k % 6) AS p_type, (k * 7919 // 13 % 50 + 1)::INTEGER AS p_size
                FROM range({FIRST * 245}, {LAST * 245}) t(k)""",
    "orders": f"SELECT k AS o_orderkey FROM range({FIRST * 1838}, {LAST * 1838}, 5) t(k)",
    "lineitem": f"""SELECT i * 3 AS l_orderkey, {FIRST * 245} + i * 11 % {(LAST - FIRST) * 245} AS l_partkey, (i % 7 + 1)::INTEGER AS l_linenumber,
                           (i * 13 % 50 + 1)::DOUBLE AS l_quantity, (i % 11 / 100)::DOUBLE AS l_discount, (i % 9 / 100)::DOUBLE AS l_tax
                    FROM range(0, 30000) t(i)""",
    "events": f"""SELECT k AS event_id, k * 31 % 1500 AS user_id, ['view', 'error', 'purchase'][(k % 3 + 1)::INTEGER] AS event_type,
                         (k % 20)::DOUBLE AS value FROM range({FIRST * 1225}, {LAST * 1225}, 2) t(k)"""}


@pytest.fixture(scope="module")
def north(tmp_path_factory):
    folder = tmp_path_factory.mktemp("north")
    for name, sql in TABLES.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_the_plane_keeps_distances(spark):
    """Steps of some 100 m east and north against the ellipsoid: as long as between 49 and 61 degrees, where scale is 0.9996 to 1.0028."""
    a, b = metric.WGS84_AXES
    e2, step = 1 - b * b / (a * a), 0.001
    places = [(lon, lat) for lon in (-9.0, -2.0, -0.3, 2.0) for lat in (49.8, 55.0, 61.0, 61.1, 63.2, 70.0, 83.99)]
    rows = [(i, j, lon + east, lat + north) for i, (lon, lat) in enumerate(places) for j, (east, north) in enumerate([(0, 0), (step, 0), (0, step)])]
    made = {(r.i, r.j): (r.easting, r.northing) for r in
            metric.national_grid(spark.createDataFrame(rows, "i int, j int, lon double, lat double")).collect()}
    for i, (_, lat) in enumerate(places):
        phi = math.radians(lat)
        nu = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        rho = nu * (1 - e2) / (1 - e2 * math.sin(phi + math.radians(step / 2)) ** 2)
        east, north = nu * math.cos(phi) * math.radians(step), rho * math.radians(step)
        assert 0.9995 < math.dist(made[i, 0], made[i, 1]) / east < 1.0030
        assert 0.9995 < math.dist(made[i, 0], made[i, 2]) / north < 1.0030


def test_the_plane_is_that_of_the_sql(spark):
    places = [(-0.468292236328125, 61.104583740234375), (-9.0, 62.0), (2.0, 63.2), (-2.0, 83.9)]
    rows = metric.national_grid(spark.createDataFrame(places, "lon double, lat double")).collect()
    values = ", ".join(f"({lon!r}::DOUBLE, {lat!r}::DOUBLE)" for lon, lat in places)
    expected = {(r[0], r[1]): r[2:] for r in duckdb.sql(
        f"SELECT lon, lat, easting, northing FROM ({with_national_grid(f'(SELECT * FROM (VALUES {values}) v(lon, lat))')})").fetchall()}
    for r in rows:
        assert (r.easting, r.northing) == pytest.approx(expected[r.lon, r.lat], abs=1e-5)


@pytest.mark.parametrize("place", [(-9.1, 62.0), (2.1, 62.0), (-2.0, 49.7), (-2.0, 84.1)])
def test_other_places_are_refused(spark, place):
    with pytest.raises(Exception, match="outside the British National Grid"):
        metric.national_grid(spark.createDataFrame([place], "lon double, lat double")).collect()


def test_block_scores(spark, north):
    rows = QUERIES["block_scores"](spark, north).collect()
    assert len(rows) == 5 and all(r.folds == 5 for r in rows)


@pytest.mark.parametrize("name", ["score_equations", "stated_effect_limit"])
def test_same_rows_as_the_sql(spark, north, name):
    frame = QUERIES[name](spark, north)
    rows = [tuple(row) for row in frame.collect()]
    names, _, expected = oracle_rows(north, oracle_sql()[name])
    assert rows and differences(frame.columns, rows, names, expected) is None


def test_size_tracking(spark, north):
    """Shares that are equal but for the order of their additions may rank apart, so ranks agree closely, not to the last digit."""
    made = {r.feature: r.correlation for r in QUERIES["size_tracking"](spark, north).collect()}
    _, _, expected = oracle_rows(north, oracle_sql()["size_tracking"])
    assert made == pytest.approx(dict(expected), abs=0.002)


def test_size_tracking_builds_the_features_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        read.add(1)
        return value

    rows = [(f"p{i}", i, *[float(i * j % 7) for j in range(len(fixed.ROAD_FEATURES))]) for i in range(20)]
    made = spark.createDataFrame(rows, ["postcode", "size", *fixed.ROAD_FEATURES])
    features = made.withColumn("addresses", counted.asNondeterministic()(F.col("size").cast("double")))
    monkeypatch.setattr(queries, "_territory", lambda *_: SimpleNamespace(features=features))
    assert len(QUERIES["size_tracking"](spark, "").collect()) == len(fixed.ROAD_FEATURES)
    assert read.value == len(rows)


def test_a_column_that_does_not_vary_has_no_correlation(spark):
    rows = spark.createDataFrame([("p", 1.0, 5.0, 2.0), ("q", 2.0, 5.0, 4.0), ("r", 3.0, 5.0, 3.0)], "key string, size double, same double, other double")
    found = ordered.rank_correlation(rows, "key", "size", ["same", "other"]).collect()
    assert {r.feature: r.correlation for r in found} == {"same": None, "other": pytest.approx(0.5)}
