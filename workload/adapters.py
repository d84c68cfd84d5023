"""The driver's tables seen as road tables.

Every row of the source table becomes a row of the road table (two per part for the volumes, one
per vintage). Integer arithmetic and plain double products only, so that the SQL in `oracle.py`,
which repeats these views, agrees bit for bit.

`part` -> segments, volumes, coverage; `lineitem` -> hourly speeds; `orders` -> map segments;
`customer` -> connectors and signals; `events` -> signs and collisions; `supplier` -> signposts.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens import fixed
from roadlens.sources.tables import RoadTables, located_collisions

# Parts per block of 49 cells; the other tables are larger or smaller by these ratios.
PARTS_PER_BLOCK = 245
ORDERS_PER_BLOCK = 1838
CUSTOMERS_PER_BLOCK = 184
EVENTS_PER_BLOCK = 1225
SUPPLIERS_PER_BLOCK = 12
H3_BASE = 617700169286418431

ROAD_CLASSES = fixed.DRIVEABLE + ["footway"]


def _i(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def _div(column: Column, by: int) -> Column:
    return F.floor(column / F.lit(by)).cast("bigint")


def _region(block: Column) -> Column:
    return F.element_at(F.array(F.lit("london"), F.lit("austin"), F.lit("losangeles")),
                        (block % 3 + 1).cast("int"))


# South-west corner of the first block, in millionths of a degree.
LONDON, AUSTIN = (-500000, 51200000), (-97950000, 30100000)


def _place(df: DataFrame, key: str, per_block: int, corner: tuple[int, int] = LONDON) -> DataFrame:
    """Block, cell of the block and south-west corner in millionths of a degree."""
    k = _i(key)
    return (df.withColumn("k", k)
            .withColumn("b", _div(F.col("k"), per_block))
            .withColumn("j", F.col("k") * 13 % 49)
            .withColumn("region", _region(F.col("b")))
            .withColumn("lon_u", corner[0] + F.col("b") % 20 * 50000 + F.col("j") % 7 * 5000
                        + F.col("k") % 5 * 400)
            .withColumn("lat_u", corner[1] + _div(F.col("b"), 20) % 400 * 30000
                        + _div(F.col("j"), 7) * 3000 + F.col("k") % 3 * 300))


def _degrees(micro: Column) -> Column:
    return micro / F.lit(1000000.0)


def _text(micro: Column) -> Column:
    return F.format_string("%.6f", _degrees(micro))


def segments(spark: SparkSession, sf_dir: str, corner: tuple[int, int] = LONDON) -> DataFrame:
    return _segments_with_size(spark, sf_dir, corner).drop("p_size")


def _segments_with_size(spark: SparkSession, sf_dir: str, corner: tuple[int, int] = LONDON) -> DataFrame:
    part = _place(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", PARTS_PER_BLOCK, corner)
    k, b, j = F.col("k"), F.col("b"), F.col("j")
    frc = k % 7 + F.when(k % 7 < 5, 0).otherwise(1)
    cell = (F.lit(H3_BASE) + j % 7 * (1 << 18) + _div(j, 7) * (1 << 21) + b % 7 * (1 << 24)
            + _div(b, 7) % 7 * (1 << 27) + _div(b, 49) % 7 * (1 << 30) + _div(b, 343) % 7 * (1 << 36))
    zone = F.element_at(F.array(F.lit("Europe/London"), F.lit("America/Chicago"),
                                F.lit("America/Los_Angeles")), (b % 3 + 1).cast("int"))
    lon, lat = F.col("lon_u"), F.col("lat_u")
    return part.select(
        k.alias("dseg_id"), frc.cast("int").alias("frc"),
        F.when(F.col("p_size") % 10 != 0, (20 + 10 * (F.col("p_size") % 10)).cast("double"))
        .alias("speed_limit_kph"),
        (10 + k * 37 % 490).cast("double").alias("length_m"),
        F.when(k % 11 != 0, F.col("p_name")).alias("street_name"),
        F.col("p_type").alias("form_of_way"),
        F.concat(F.lit("LINESTRING ("), _text(lon), F.lit(" "), _text(lat), F.lit(", "),
                 _text(lon + 2000), F.lit(" "), _text(lat + 1000), F.lit(")")).alias("geometry_wkt"),
        _degrees(lon).alias("min_lon"), _degrees(lat).alias("min_lat"),
        _degrees(lon + 2000).alias("max_lon"), _degrees(lat + 1000).alias("max_lat"),
        F.lower(F.hex(cell)).alias("h3_r9"), zone.alias("time_zone"),
        F.when(b % 3 == 0, F.lit("GBR")).otherwise(F.lit("USA")).alias("country_iso3"),
        F.array(4000000 + k, 4000000 + 2 * k).alias("osm_way_ids"),
        "region", b.alias("tile_id"), "p_size")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    h = 5 + F.col("l_quantity") * 2
    order = F.col("l_orderkey")
    curve = F.expr("array(" + ", ".join(
        f"(5 + l_quantity * 2) * {0.5 + 0.05 * i!r}D" for i in range(1, 20)) + ")")
    return items.select(
        F.col("l_partkey").alias("dseg_id"),
        # Some days lie before the job's week and some after it; some hours report no speed.
        F.date_add(F.lit("2025-08-31").cast("date"), (order % 10).cast("int")).alias("observation_date"),
        ((order * 7 + F.col("l_linenumber") * 5) % 24).cast("int").alias("hour_utc"),
        (h * (1 + F.col("l_discount")) + F.when(F.col("l_linenumber") == 5, 60.0).otherwise(0.0)).alias("avg_speed_kph"),
        F.when((order * 3 + F.col("l_linenumber")) % 29 != 0, h).otherwise(0.0).alias("harmonic_speed_kph"),
        (h * (1 + F.col("l_discount") / 2)).alias("median_speed_kph"),
        (h * F.col("l_tax") * 10).alias("stddev_speed_kph"),
        F.when(F.col("l_linenumber") != 6, curve).alias("speed_percentiles_kph"),
        _div(F.col("l_partkey"), PARTS_PER_BLOCK).alias("tile_id"))


def volumes(spark: SparkSession, sf_dir: str, corner: tuple[int, int] = LONDON) -> DataFrame:
    """Small parts carry no estimate; the largest ones only gained theirs in the later vintage."""
    part = _segments_with_size(spark, sf_dir, corner)
    k = F.col("dseg_id")
    vintages = F.when(F.col("p_size") > 45, F.array(F.lit(2025))) \
        .otherwise(F.array(F.lit(2024), F.lit(2025)))
    base = (100 + k * 7919 % 20000).cast("double")
    rows = part.filter("p_size > 8").withColumn("vintage_year", F.explode(vintages)) \
        .withColumn("aadt", F.when(F.col("vintage_year") == 2025, base).otherwise(base * 0.97))
    aadt = F.col("aadt")
    by_hour = F.expr("array(" + ", ".join(
        f"aadt * {1.05 if s < 120 else 0.85}D * {1 + s % 24 * (23 - s % 24)} / 2048"
        for s in range(fixed.SLOTS_PER_WEEK)) + ")")
    return rows.select(
        "region", "vintage_year", k.alias("segment_id"), "frc", "aadt",
        F.array(*[aadt * 1.05] * 5, *[aadt * (0.75 + 0.05 * (k % 4))] * 2).alias("aadt_by_day"),
        by_hour.alias("aadt_by_day_hour"),
        F.when(k % 13 != 0, F.concat(
            (4000000 + k).cast("string"), F.lit(":"), (k % 90).cast("string"), F.lit(":0,"),
            (4000000 + 2 * k).cast("string"), F.lit(":5:1"))).alias("osm_id"),
        F.concat(F.lit("g"), k.cast("string"), F.lit(":0.0:1.0")).alias("gers_id"),
        "geometry_wkt", "min_lon", "min_lat", "max_lon", "max_lat", "h3_r9", "length_m")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres per region, vintage and key, and how many carry an estimate. Class 7 has two keys."""
    part = _segments_with_size(spark, sf_dir) \
        .withColumn("vintage_year", F.explode(F.array(F.lit(2024), F.lit(2025)))) \
        .withColumn("key", F.when((F.col("frc") == 7) & (F.col("dseg_id") % 3 == 0), 9).otherwise(F.col("frc")))
    covered = (F.col("p_size") > 8) & ((F.col("vintage_year") == 2025) | (F.col("p_size") <= 45))
    return part.groupBy("region", "vintage_year", "frc", "key").agg(
        F.sum("length_m").alias("total_length_m"),
        F.sum(F.when(covered, F.col("length_m")).otherwise(0.0)).alias("covered_length_m")
    ).select("region", "vintage_year",
             F.concat(F.lit("FRC"), F.col("key").cast("string")).alias("frc_key"), "frc",
             F.concat(F.lit("class "), F.col("key").cast("string")).alias("frc_label"),
             "total_length_m", "covered_length_m",
             (100.0 * F.col("covered_length_m") / F.col("total_length_m")).alias("coverage_pct"))


@F.arrow_udf(T.BinaryType())
def _wkb_line(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array) -> pa.Array:
    """Three points as little-endian WKB LineStrings."""
    rows = np.empty(len(a), dtype=[("head", "S9"), ("xy", "<f8", 6)])
    rows["head"] = struct.pack("<BII", 1, 2, 3)
    rows["xy"] = np.stack([column.to_numpy(zero_copy_only=False) for column in (a, b, c, d, e, f)], axis=1)
    size, data = rows.dtype.itemsize, rows.tobytes()
    return pa.array([data[i:i + size] for i in range(0, len(data), size)], pa.binary())


def map_segments(spark: SparkSession, sf_dir: str, corner: tuple[int, int] = LONDON) -> DataFrame:
    orders = _place(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", ORDERS_PER_BLOCK, corner)
    k, b, j = F.col("k"), F.col("b"), F.col("j")
    lon, lat = F.col("lon_u"), F.col("lat_u")
    line = [_degrees(x) for x in (lon, lat, lon + 1500, lat + 700, lon + 4000, lat + 900)]
    everyone = F.lit(None).cast("struct<mode:array<string>>")
    limit = lambda value, unit, when, between=F.lit(None): F.struct(
        F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit")).alias("max_speed"),
        between.cast("array<double>").alias("between"), when.alias("when"))
    half = F.when(k % 24 == 0, F.array(F.lit(0.0), F.lit(0.5)))
    trucks = F.struct(F.array(F.lit("hgv")).alias("mode"))
    limits = (F.when(k % 10 == 9, F.array().cast(
        "array<struct<max_speed:struct<value:double,unit:string>,between:array<double>,"
        "when:struct<mode:array<string>>>>"))
        .when(k % 12 == 0, F.array(limit(F.lit(40), "mph", trucks, half), limit(F.lit(96), "km/h", everyone)))
        .otherwise(F.array(limit(20 + 10 * (k % 6), "mph", everyone))))
    speed = lambda value: F.struct(value.cast("double").alias("value"), F.lit("km/h").alias("unit"))
    profile = F.struct(speed(10 + k % 60).alias("week_speed"),
                       F.when(k % 5 != 0, speed(20 + k % 70)).alias("freeflow_speed"))
    profiles = F.when(k % 10 != 9, F.array(profile)).otherwise(F.array().cast(
        "array<struct<week_speed:struct<value:double,unit:string>,"
        "freeflow_speed:struct<value:double,unit:string>>>"))
    # Roads of the seventh column of a block carry no code; every eighth only its district.
    district = F.concat(F.lit("SW"), (b % 90 + 1).cast("string"))
    sector = F.concat(district, F.lit(" "),
                      (F.when(k % 5 == 4, _div(j, 7) + 1).otherwise(_div(j, 7))).cast("string"))
    code = F.concat(sector, F.lit("A"), F.chr(65 + k % 26))
    second = F.concat(sector, F.lit("B"), F.chr(65 + k % 24))
    codes = (F.when(j % 7 == 6, F.array().cast("array<struct<detailed:boolean,postal_codes:array<string>>>"))
             .when(k % 8 == 0, F.array(F.struct(F.lit(False).alias("detailed"), F.array(district).alias("postal_codes"))))
             .when(k % 9 == 0, F.array(F.struct(F.lit(True).alias("detailed"), F.array(code, second).alias("postal_codes"))))
             .otherwise(F.array(F.struct(F.lit(True).alias("detailed"), F.array(code).alias("postal_codes")))))
    attributes = [a for a in fixed.MAP_ATTRIBUTES if a not in ("speed_limits", "speed_profiles", "routes")]
    filled = [(F.when(k % 17 == 0, F.lit(None).cast("array<int>"))
               .when(k % (i + 2) == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
              .alias(name) for i, name in enumerate(attributes)]
    hub = F.when(k % 50 == 0, k - k % 500).otherwise(k * 2)
    return orders.select(
        "region", F.concat(F.lit("r"), k.cast("string")).alias("id"),
        F.when(k % 20 == 19, F.lit("rail")).otherwise(F.lit("road")).alias("subtype"),
        F.element_at(F.array(*[F.lit(c) for c in ROAD_CLASSES]), (k % 10 + 1).cast("int")).alias("class"),
        F.struct(F.when(k % 3 != 0, F.concat(F.lit("Road "), (k % 500).cast("string"))).alias("primary")).alias("names"),
        F.when(k % 4 == 0, F.array(F.struct(F.concat(F.lit("A"), (k % 100).cast("string")).alias("name"))))
        .otherwise(F.array().cast("array<struct<name:string>>")).alias("routes"),
        F.struct(_degrees(lon).alias("xmin"), _degrees(lat).alias("ymin"),
                 _degrees(lon + 4000).alias("xmax"), _degrees(lat + 900).alias("ymax")).alias("bbox"),
        _wkb_line(*line).alias("geometry"),
        F.array(F.struct(F.concat(F.lit("c"), hub.cast("string")).alias("connector_id"), F.lit(0.0).alias("at")),
                F.struct(F.concat(F.lit("c"), (k * 2 + 2 + k % 4).cast("string")).alias("connector_id"), F.lit(1.0).alias("at")))
        .alias("connectors"),
        limits.alias("speed_limits"), profiles.alias("speed_profiles"), codes.alias("postal_codes"), *filled)


def _point_layer(df: DataFrame) -> list[Column]:
    lon, lat = F.col("lon_u"), F.col("lat_u")
    return [F.col("region"),
            F.struct(_degrees(lon).alias("xmin"), _degrees(lat).alias("ymin"),
                     _degrees(lon).alias("xmax"), _degrees(lat).alias("ymax")).alias("bbox")]


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _place(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", CUSTOMERS_PER_BLOCK)
    return rows.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), *_point_layer(rows))


def traffic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _place(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", CUSTOMERS_PER_BLOCK)
    return rows.select(F.concat(F.lit("t"), F.col("k").cast("string")).alias("id"), *_point_layer(rows))


def traffic_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _place(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", EVENTS_PER_BLOCK)
    return rows.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"),
                       F.col("event_type").alias("subtype"), *_point_layer(rows))


def signposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _place(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", SUPPLIERS_PER_BLOCK)
    k = F.col("k")
    origin = k * 150 + k % 4
    road = lambda number: F.struct(F.concat(F.lit("r"), number.cast("string")).alias("id"))
    town = lambda text: F.struct(F.struct(text.alias("primary")).alias("destination_name"))
    route = lambda text: F.struct(F.struct(text.alias("primary")).alias("route_text"))
    towns = F.when(k % 3 == 0, F.array().cast("array<struct<destination_name:struct<primary:string>>>")) \
        .otherwise(F.array(town(F.concat(F.lit("Town "), F.col("s_nationkey").cast("string"))),
                           town(F.lit("Centre"))))
    return rows.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        road(origin).alias("from_segment"), road(origin + 1).alias("to_segment"),
        towns.alias("destination_info"),
        F.array(route(F.concat(F.lit("M"), (k % 30).cast("string")))).alias("route_info"),
        *_point_layer(rows))


def collision_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the collisions file delivers them; some reports carry no coordinates."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, user = F.col("event_id"), F.col("user_id")
    b = _div(k, EVENTS_PER_BLOCK)
    missing = F.col("value") < 2
    day = F.concat(F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/"),
                   F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/"),
                   (2024 + _div(k, 12) % 2).cast("string"))
    return events.select(
        F.when(~missing, (504900 + b % 20 * 3488 + (user * 137 + k * 7) % 2400).cast("double"))
        .alias("location_easting_osgr"),
        F.when(~missing, (146200 + _div(b, 20) % 400 * 3337 + (user * 311 + k * 17) % 2300).cast("double"))
        .alias("location_northing_osgr"),
        day.alias("date"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2)
        .otherwise(3).alias("collision_severity"))


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located_collisions(collision_reports(spark, sf_dir))


def road_tables(spark: SparkSession, sf_dir: str) -> RoadTables:
    return RoadTables(
        segments=segments(spark, sf_dir), hourly=hourly(spark, sf_dir),
        volumes=volumes(spark, sf_dir), coverage=coverage(spark, sf_dir),
        map_segments=map_segments(spark, sf_dir), map_connectors=connectors(spark, sf_dir),
        traffic_signs=traffic_signs(spark, sf_dir), traffic_signals=traffic_signals(spark, sf_dir),
        signposts=signposts(spark, sf_dir))
