"""Named tables and files as DataFrames, with the checks a job makes before it starts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions.predicates import in_region, in_vintage
from roadlens.params import Job


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """`catalog.schema.table`, or an error that says what to set."""
    if not spark.catalog.tableExists(name):
        raise ValueError(
            f"Cannot read table '{name}'. Check the catalog and schema the listing was attached "
            f"as (SHOW CATALOGS lists them) and that this session may read it.")
    return spark.table(name)


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class RoadTables:
    """The tables the reports read. A job only needs the ones its reports touch."""

    segments: DataFrame | None = None
    hourly: DataFrame | None = None
    volumes: DataFrame | None = None
    coverage: DataFrame | None = None
    map_segments: DataFrame | None = None
    map_connectors: DataFrame | None = None
    traffic_signs: DataFrame | None = None
    traffic_signals: DataFrame | None = None
    signposts: DataFrame | None = None

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str]) -> "RoadTables":
        """`names` maps a field of this class to `catalog.schema.table`."""
        return cls(**{field: catalog_table(spark, name) for field, name in names.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: dict[str, str]) -> "RoadTables":
        return cls(**{field: parquet_table(spark, path) for field, path in paths.items()})

    def slice(self, job: Job) -> "RoadTables":
        """Every table restricted to the job's region and vintage; hours by the region's tiles."""
        def cut(df: DataFrame | None, *keep: Callable) -> DataFrame | None:
            for predicate in keep:
                df = None if df is None else df.filter(predicate(job))
            return df

        segments = cut(self.segments, in_region)
        hourly = self.hourly
        if job.region is not None and segments is not None and hourly is not None:
            hourly = tile_slice(hourly, segments)
        return RoadTables(
            segments=segments, hourly=hourly,
            volumes=cut(self.volumes, in_region, in_vintage),
            coverage=cut(self.coverage, in_region, in_vintage),
            map_segments=cut(self.map_segments, in_region),
            map_connectors=cut(self.map_connectors, in_region),
            traffic_signs=cut(self.traffic_signs, in_region),
            traffic_signals=cut(self.traffic_signals, in_region),
            signposts=cut(self.signposts, in_region))


def tile_slice(hourly: DataFrame, segments: DataFrame) -> DataFrame:
    """Hours in the tiles that hold the segments.

    Written as a semi join, so a table laid out by tile is pruned at run time and the tile list
    never passes through the driver.
    """
    tiles = segments.select("tile_id").distinct()
    return hourly.join(tiles, "tile_id", "left_semi")


def require_rows(df: DataFrame, what: str, remedy: str) -> DataFrame:
    """Fail early, with the fix in the message, when a slice holds nothing."""
    if df.isEmpty():
        raise ValueError(f"No {what}. {remedy}")
    return df


def require_slice(df: DataFrame, job: Job, what: str) -> DataFrame:
    vintage = "" if job.vintage_year is None else f", vintage {job.vintage_year}"
    return require_rows(df, f"{what} for region '{job.region}'{vintage}",
                        "List the distinct regions and vintages of the table to see what it holds.")


COLLISION_COLUMNS = T.StructType([
    T.StructField("location_easting_osgr", T.DoubleType()),
    T.StructField("location_northing_osgr", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("collision_severity", T.IntegerType()),
])


def collisions_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reported collisions with coordinates, read from delimited files by column name.

    The header decides the position of each column, and only the four that are used are parsed.
    An empty field and the text NULL are unknown; any other value that does not parse ends the job,
    so that no report is lost without a word.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)

    def parsed(field: T.StructField) -> Column:
        text = F.nullif(F.nullif(F.trim(field.name), F.lit("")), F.lit("NULL"))
        value = text.try_cast(field.dataType)
        refused = F.raise_error(F.concat(F.lit(f"Cannot read {field.name}: "), text)).cast(field.dataType)
        return F.when(text.isNotNull() & value.isNull(), refused).otherwise(value).alias(field.name)

    return located_collisions(raw.select(*[parsed(field) for field in COLLISION_COLUMNS.fields]))


def located_collisions(collisions: DataFrame) -> DataFrame:
    """Rows without coordinates dropped; year, month and severity flag added."""
    day = F.to_date("date", "dd/MM/yyyy")
    return (collisions
            .dropna(subset=["location_easting_osgr", "location_northing_osgr"])
            .select(F.col("location_easting_osgr").alias("easting"),
                    F.col("location_northing_osgr").alias("northing"),
                    F.year(day).alias("year"), F.month(day).alias("month"),
                    F.col("collision_severity").alias("severity")))
