"""Small hand-made road tables."""

from datetime import date

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("dseg_id", T.LongType()), T.StructField("frc", T.IntegerType()),
    T.StructField("speed_limit_kph", T.DoubleType()), T.StructField("length_m", T.DoubleType()),
    T.StructField("h3_r9", T.StringType()), T.StructField("time_zone", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("tile_id", T.LongType()),
    T.StructField("street_name", T.StringType()), T.StructField("geometry_wkt", T.StringType()),
    T.StructField("osm_way_ids", T.ArrayType(T.LongType())),
    T.StructField("min_lon", T.DoubleType()), T.StructField("min_lat", T.DoubleType()),
    T.StructField("max_lon", T.DoubleType()), T.StructField("max_lat", T.DoubleType())])

HOUR = T.StructType([
    T.StructField("dseg_id", T.LongType()), T.StructField("observation_date", T.DateType()),
    T.StructField("hour_utc", T.IntegerType()), T.StructField("avg_speed_kph", T.DoubleType()),
    T.StructField("harmonic_speed_kph", T.DoubleType()),
    T.StructField("median_speed_kph", T.DoubleType()),
    T.StructField("stddev_speed_kph", T.DoubleType()),
    T.StructField("speed_percentiles_kph", T.ArrayType(T.DoubleType())),
    T.StructField("tile_id", T.LongType())])

VOLUME = T.StructType([
    T.StructField("region", T.StringType()), T.StructField("vintage_year", T.IntegerType()),
    T.StructField("segment_id", T.LongType()), T.StructField("frc", T.IntegerType()),
    T.StructField("aadt", T.DoubleType()), T.StructField("aadt_by_day", T.ArrayType(T.DoubleType())),
    T.StructField("aadt_by_day_hour", T.ArrayType(T.DoubleType())),
    T.StructField("h3_r9", T.StringType()), T.StructField("length_m", T.DoubleType()),
    T.StructField("min_lon", T.DoubleType()), T.StructField("min_lat", T.DoubleType()),
    T.StructField("max_lon", T.DoubleType()), T.StructField("max_lat", T.DoubleType())])

CELL = "89283082803ffff"


def curve(low, step=1.0):
    return [low + step * i for i in range(19)]


def segment(key, limit=50.0, length=100.0, cell=CELL, zone="Europe/London", region="london",
            frc=3, street=None, ways=None, lon=-0.1, lat=51.5):
    return (key, frc, limit, length, cell, zone, region, 1, street,
            f"LINESTRING ({lon} {lat}, {lon + 0.001} {lat + 0.001})", ways or [key],
            lon, lat, lon + 0.001, lat + 0.001)


def hour(key, day=date(2025, 9, 3), utc=8, harmonic=40.0, stddev=4.0, percentiles=None):
    return (key, day, utc, harmonic + 2, harmonic, harmonic + 1, stddev, percentiles, 1)


def volume(key, aadt=1000.0, length=100.0, cell=CELL, frc=3, region="london", year=2025, lon=-0.1,
           lat=51.5):
    return (region, year, key, frc, aadt, [aadt] * 7, [aadt / 24] * 168, cell, length, lon, lat,
            lon + 0.001, lat + 0.001)


def segments(spark, *rows):
    return spark.createDataFrame(list(rows), SEGMENT)


def hours(spark, *rows):
    return spark.createDataFrame(list(rows), HOUR)


def volumes(spark, *rows):
    return spark.createDataFrame(list(rows), VOLUME)
