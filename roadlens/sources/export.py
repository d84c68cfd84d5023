"""Results out of Spark: doubles instead of decimals, and GeoJSON features as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions import grid


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every decimal column cast to double, so no consumer meets `decimal.Decimal` objects."""
    return df.select(*[
        F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.DecimalType) else F.col(field.name)
        for field in df.schema.fields])


def geojson_features(df: DataFrame, geometry: Column, properties: list[str], keep: list[str] | None = None) -> DataFrame:
    """One GeoJSON Feature per row in a column `feature`, beside the columns to keep. NaN and NULL properties become null."""
    types = {field.name: field.dataType for field in df.schema.fields}

    def clean(name: str) -> Column:
        value = F.col(name)
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        return value.alias(name)

    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct(*[clean(name) for name in properties]).alias("properties"),
                       geometry.alias("geometry"))
    return df.select(*(keep or []), F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file per task: nothing is gathered on the driver."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def cell_outline(cell: Column, level: int) -> Column:
    """Struct that `to_json` writes as a GeoJSON Polygon: the square of a grid cell, counter-clockwise from its south-west corner."""
    half = 180.0 / (1 << level)
    lon, lat = grid.centre_lon(cell, level), grid.centre_lat(cell, level)
    corner = lambda x, y: F.array(F.round(lon + x * half, 7), F.round(lat + y * half, 7))
    ring = F.array(*[corner(x, y) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def cell_features(cells: DataFrame, level: int, properties: list[str], cell: str = "cell") -> DataFrame:
    """A feature per grid cell, with its square, in a column `feature` beside `cell`."""
    keyed = geojson_features(cells.withColumn("_outline", cell_outline(F.col(cell), level)), F.col("_outline"), properties, keep=[cell])
    return keyed.withColumnRenamed(cell, "cell")


def area_features(cells: DataFrame, key: str, level: int, properties: list[str]) -> DataFrame:
    """A feature per area whose geometry is the squares of its cells, as one MultiPolygon in the order of the cells.

    `cells` has a row per cell with the area's `key`; the area's properties are the same in all of its rows. The squares of an
    area are gathered in one row, so an area must be of bounded size, as a postcode is.
    """
    square = cell_outline(F.col("cell"), level)["coordinates"]
    squares = F.transform(F.sort_array(F.collect_list(F.struct("cell", square.alias("ring")))), lambda s: s["ring"])
    areas = cells.groupBy(key).agg(squares.alias("_squares"), *[F.min(p).alias(p) for p in properties if p != key])
    outline = F.struct(F.lit("MultiPolygon").alias("type"), F.col("_squares").alias("coordinates"))
    return geojson_features(areas.withColumn("_outline", outline), F.col("_outline"), properties, keep=[key])


def write_cell_features(features: DataFrame, path: str, files: int) -> None:
    """Newline-delimited features by range of cell: neighbours lie in one file, and a map reads the files of its range."""
    features.repartitionByRange(files, "cell").sortWithinPartitions("cell") \
        .select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
