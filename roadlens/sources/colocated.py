"""Segments and hours laid out alike, so that they meet without being moved.

Both tables are cut into the same number of buckets by segment id and sorted inside a bucket. A join, or a
group-by, on the segment id then reads bucket by bucket: no shuffle, whatever the size of either side. The
hours are also partitioned by date (and by tile, where asked for), so a window or a region reads only its folders,
and a new day is appended without touching the rest. Tiles are dealt over a fixed number of folders, so files do
not multiply with the map.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.sources.tables import RoadTables, catalog_table

KEY = "dseg_id"
TILE_FOLDER = "tile_folder"
TILE_FOLDERS = 48       # with fewer tiles each has a folder of its own


@dataclass(frozen=True)
class Layout:
    """Buckets are a choice for life of the table: about the fact's bytes of one date over 128 MB, or the cores at hand."""

    buckets: int
    by_tile: bool = False

    def partitions(self) -> list[str]:
        return ([TILE_FOLDER] if self.by_tile else []) + ["observation_date"]


def bucket_of(buckets: int) -> Column:
    """The bucket Spark files a segment under."""
    return F.pmod(F.hash(KEY), F.lit(buckets))


def tile_folder() -> Column:
    """The folder that the hours of a tile lie in."""
    return F.pmod("tile_id", F.lit(TILE_FOLDERS)).cast("int")


def write_segments(segments: DataFrame, name: str, layout: Layout, folder: str | None = None) -> None:
    """The segment table `name`; one file a bucket."""
    laid = segments.repartition(layout.buckets, KEY)
    _writer(laid, layout, folder).saveAsTable(name)


def write_hours(hours: DataFrame, name: str, layout: Layout, folder: str | None = None, append: bool = False) -> None:
    """The hours table `name`; with `append` further dates of an existing one.

    Rows are dealt out by date and bucket, so a date and bucket come from one task and are one file. A segment
    has at most 24 hours a date, so no key makes a task large.
    """
    if layout.by_tile:
        hours = hours.withColumn(TILE_FOLDER, tile_folder())
    laid = hours.repartition(*layout.partitions(), bucket_of(layout.buckets))
    _writer(laid, layout, folder).partitionBy(*layout.partitions()).mode("append" if append else "errorifexists").saveAsTable(name)


def _writer(df: DataFrame, layout: Layout, folder: str | None):
    writer = df.write.format("parquet").bucketBy(layout.buckets, KEY).sortBy(KEY)
    return writer if folder is None else writer.option("path", folder)


def bucketing(spark: SparkSession, name: str) -> tuple[int, list[str]] | None:
    """Number of buckets and bucket columns of a catalog table; None for a table without buckets."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if "Num Buckets" not in said:
        return None
    return int(said["Num Buckets"]), [c.strip(" `") for c in said["Bucket Columns"].strip("[]").split(",")]


def colocated_tables(spark: SparkSession, segments: str, hourly: str, **others: str) -> RoadTables:
    """Road tables whose segments and hours are laid out alike, or an error that says what differs."""
    layouts = {name: bucketing(spark, name) for name in (segments, hourly) if catalog_table(spark, name) is not None}
    known = [layouts[segments], layouts[hourly]]
    if None in known or known[0] != known[1] or known[0][1] != [KEY]:
        raise ValueError(f"'{segments}' and '{hourly}' are not laid out alike by {KEY}: {layouts}. "
                         f"Write both with write_segments and write_hours and the same Layout.")
    return RoadTables.from_catalog(spark, {"segments": segments, "hourly": hourly, **others})


def attach(spark: SparkSession, name: str, folder: str, layout: Layout, schema: DataFrame, hours: bool) -> None:
    """Name a folder that an earlier session wrote, with its buckets and partitions, in this session's catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    parts = f"PARTITIONED BY ({', '.join(layout.partitions())}) " if hours else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts}"
              f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {layout.buckets} BUCKETS LOCATION '{folder}'")
    if hours:
        spark.catalog.recoverPartitions(name)


def cut_by_tiles(tables: RoadTables, most_tiles: int = 100_000) -> RoadTables:
    """The hours of the tiles that the segments lie in, pruned while the job runs.

    A table partitioned by tile, or by the folders of tiles of this module, is pruned by the tiles of the other side when
    that side is broadcast. The distinct tiles are counted first (one narrow pass over the segments) and broadcast only up to
    `most_tiles` of 8 bytes each; beyond, the join is left to Spark.
    """
    tiles, on = tables.segments.select("tile_id").distinct(), ["tile_id"]
    if TILE_FOLDER in tables.hourly.columns:
        tiles, on = tiles.withColumn(TILE_FOLDER, tile_folder()), [TILE_FOLDER, "tile_id"]
    small = tiles.limit(most_tiles + 1).count() <= most_tiles
    return replace(tables, hourly=tables.hourly.join(F.broadcast(tiles) if small else tiles, on, "left_semi"))
