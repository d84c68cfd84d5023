"""Bounded nearest neighbour as a bucketed equi-join, on a metric plane or on the globe."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.functions.metric import EARTH_RADIUS_M, haversine_m, planar_m


PAD = 1.001      # squares are a little wider than the reach, for what rounding could take off
FINE = 2         # small squares along a side of a wide one
TILE = 4         # wide squares along a side of a tile


def nearest_within(points: DataFrame, targets: DataFrame, keys: list[str], reach_m: float, label: list[str],
                   tie_break: str, each_row: bool = False, totals: dict[str, Column] | None = None) -> DataFrame:
    """For each point the columns `label` of the nearest target closer than `reach_m`.

    Both sides have `easting` and `northing` in metres; `keys` identify a point. Points without a
    target in reach are left out. Equal distances go to the smaller `tie_break`. With `each_row` every row of
    `points` is a point of its own: `keys` are only carried along, and nothing moves after the search. With `totals` the rows
    of one place and equal `keys` become one such point with these aggregates, after they moved and before they are searched.

    The plane is cut into squares just wider than the reach. Each target is copied to its own and the
    eight squares around it, so a point only meets the targets filed under its own square, and every
    target in reach is among them. `targets` must be sparse - one row per map cell - which bounds the
    candidates of a point by the number of cells in nine squares, however many points share a place.
    A square is one row with its candidates, grouped by the small square they lie in: a point moves once, meets
    one row, asks the small squares about it first, and the others only if there is no target so close.
    It leaves the join as one row that has its neighbour: no candidate is sorted or moved.

    Points and targets move by tiles of sixteen squares. A target moves to the tiles that its nine squares lie in, which are
    nine in four on average, and is copied to the squares where it arrived.
    """
    width = PAD * reach_m / FINE
    small = lambda column: F.floor(F.col(column) / F.lit(width))
    wide = lambda column: F.floor(small(column) / FINE)
    of_tile = lambda square: F.floor(square / TILE)
    tile = lambda east, north: F.shiftleft(east, 32).bitwiseXOR(north)
    around = lambda square: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda step: square + step)
    tiles = lambda square: F.explode(F.array_distinct(F.transform(around(square), of_tile)))
    inside = lambda square, tile: F.explode(F.filter(around(F.col(square)), lambda other: of_tile(other) == F.col(tile)))
    groups = _candidates(targets, "easting", "northing", label, tie_break) \
        .withColumns({"_se": small("_tx"), "_sn": small("_ty")}).dropna(subset=["_se", "_sn"]) \
        .groupBy("_se", "_sn").agg(F.collect_list("_target").alias("_targets")) \
        .withColumns({"_ge": F.floor(F.col("_se") / FINE), "_gn": F.floor(F.col("_sn") / FINE)}) \
        .withColumn("_te", tiles(F.col("_ge"))).withColumn("_tn", tiles(F.col("_gn"))) \
        .withColumn("_tile", tile(F.col("_te"), F.col("_tn"))).repartition("_tile") \
        .withColumn("_we", inside("_ge", "_te")).withColumn("_wn", inside("_gn", "_tn")) \
        .select("_tile", "_we", "_wn",
                F.struct(((F.col("_se") + 0.5) * width).alias("_mx"), ((F.col("_sn") + 0.5) * width).alias("_my"), "_targets").alias("_group"))
    placed, carried = _placed(points, "easting", "northing", keys, {"_home": tile(of_tile(wide("_x")), of_tile(wide("_y")))}, totals)
    beside = F.lit(1.5 * width)                     # from a point to the middle of a small square it may need
    close = lambda group: (F.abs(group["_mx"] - F.col("_x")) <= beside) & (F.abs(group["_my"] - F.col("_y")) <= beside)
    return _best(placed, {"_tile": F.col("_home"), "_we": wide("_x"), "_wn": wide("_y")}, groups, close, reach_m / FINE, planar_m,
                 carried, reach_m, label, each_row or totals is not None)


def _placed(points: DataFrame, x: str, y: str, keys: list[str], home: dict[str, Column],
            totals: dict[str, Column] | None) -> tuple[DataFrame, list[str]]:
    """Points with coordinates, and the columns that name where they move to; and the columns they carry along.

    With `totals` rows of one place are added up where they arrive: they move once, and the join finds them in place.
    """
    rows = points.withColumns({"_x": F.col(x), "_y": F.col(y)}).dropna(subset=["_x", "_y"]).withColumns(home)
    if totals is None:
        return rows.select(*keys, "_x", "_y", *home), keys
    counted = rows.repartition(*home).groupBy(*home, "_x", "_y", *keys).agg(*[total.alias(name) for name, total in totals.items()])
    return counted, [*keys, *totals]


def _candidates(targets: DataFrame, x: str, y: str, label: list[str], tie_break: str) -> DataFrame:
    """Targets as their coordinates and one struct with all that a point asks of them."""
    return targets.select(F.col(x).alias("_tx"), F.col(y).alias("_ty"), F.struct(
        F.col(x).alias("_tx"), F.col(y).alias("_ty"), F.col(tie_break).alias("_tie"),
        *[F.col(name).alias(f"_label_{name}") for name in label]).alias("_target"))


def _best(points: DataFrame, square: dict[str, Column], groups: DataFrame, close: Callable[[Column], Column],
          close_m: float, distance_m: Callable[..., Column], keys: list[str], reach_m: float, label: list[str], each_row: bool) -> DataFrame:
    """The nearest target of each point within the reach; equal distances go to the smaller tie-break.

    `square` gives a point's square; `groups` has a row for each square and group of targets in it, and `close` tells
    which groups hold every target nearer to a point than `close_m`.
    """
    arrays = groups.groupBy(*square).agg(F.collect_list("_group").alias("_groups"))

    def nearest(found: Column, width: float) -> Column:
        reached = F.transform(F.flatten(F.transform(found, lambda group: group["_targets"])), lambda target: F.struct(
            distance_m(F.col("_x"), F.col("_y"), target["_tx"], target["_ty"]).alias("_distance"), target["_tie"].alias("_tie"),
            *[target[f"_label_{name}"].alias(f"_label_{name}") for name in label]))
        return F.array_min(F.filter(reached, lambda candidate: candidate["_distance"] < width))

    near = F.coalesce(nearest(F.filter("_groups", close), close_m), nearest(F.col("_groups"), reach_m))
    own = reduce(lambda a, b: a & b, [F.col(name) == column for name, column in square.items()])
    # Exploded, not filtered: a filter would move below and run the search once more.
    found = points.join(arrays, own).select(*keys, F.explode(F.array_compact(F.array(near))).alias("_best"))
    if not each_row:
        found = found.groupBy(*keys).agg(F.min("_best").alias("_best"))
    return found.select(*keys, F.col("_best._distance").alias("distance_m"),
                        *[F.col(f"_best._label_{name}").alias(name) for name in label])


class Bands:
    """The globe in rows as high as the reach, each cut into as many columns as are no narrower than it.

    A row's columns are as wide, in degrees, as the reach can be anywhere in the row or the two beside it, so a target
    within reach of a point lies in the point's column or one beside it, counted in the point's row. Near a pole a row
    has one column, and the columns close around the date line.
    """

    def __init__(self, reach_m: float):
        angle = PAD * reach_m / EARTH_RADIUS_M
        self.height = math.degrees(angle)
        self.half_chord = math.sin(min(angle / 2, math.pi / 2))

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.height)

    def columns(self, row: Column) -> Column:
        """How many columns the row has."""
        south, north = (row - 1) * self.height - 90.0, (row + 2) * self.height - 90.0
        outermost = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))
        share = F.lit(self.half_chord) / F.greatest(F.cos(F.radians(outermost)), F.lit(1e-12))
        width = F.degrees(2 * F.asin(F.least(share, F.lit(1.0)))) * PAD
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")

    def column(self, lon: Column, row: Column) -> Column:
        count = self.columns(row)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * count), count)


def nearest_around(points: DataFrame, targets: DataFrame, keys: list[str], reach_m: float, label: list[str],
                   tie_break: str, each_row: bool = False, totals: dict[str, Column] | None = None) -> DataFrame:
    """`nearest_within` for `lon` and `lat` in degrees, anywhere on the globe; the great circle decides.

    Each target is filed in its own row and the rows above and below, there in its own column and the ones beside
    it, by that row's columns: nine copies at most. Small columns are a column's parts, counted in the same row; a row of
    one column has no parts. `targets` must be sparse, as for `nearest_within`. Points without coordinates have no neighbour.
    """
    bands, beside = Bands(reach_m), F.sequence(F.lit(-1), F.lit(1))
    small_row = lambda lat: F.floor((lat + 90.0) / F.lit(bands.height / FINE))

    def small_column(lon: Column, count: Column) -> tuple[Column, Column]:
        """The small column in a row of so many columns, and how many there are."""
        parts = F.when(count > 1, count * FINE).otherwise(count)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * parts), parts), parts

    copies = _candidates(targets, "lon", "lat", label, tie_break) \
        .withColumn("_row", F.explode(F.transform(beside, lambda step: bands.row(F.col("_ty")) + step))) \
        .withColumns({"_count": bands.columns(F.col("_row")), "_own": bands.column(F.col("_tx"), F.col("_row"))})
    columns = F.array_distinct(F.transform(beside, lambda step: F.pmod(F.col("_own") + step, F.col("_count"))))
    groups = copies.select("_row", F.explode(columns).alias("_column"), small_row(F.col("_ty")).alias("_sr"),
                           small_column(F.col("_tx"), F.col("_count"))[0].alias("_sc"), "_target") \
        .dropna(subset=["_row", "_column"]).groupBy("_row", "_column", "_sr", "_sc").agg(F.collect_list("_target").alias("_targets")) \
        .select("_row", "_column", F.struct("_sr", "_sc", "_targets").alias("_group"))
    row = bands.row(F.col("_y"))
    mine, parts = small_column(F.col("_x"), bands.columns(row))
    placed, carried = _placed(points, "lon", "lat", keys, {"_home_row": row, "_home_column": bands.column(F.col("_x"), row)}, totals)
    placed = placed.withColumns({"_pr": small_row(F.col("_y")), "_pc": mine, "_parts": parts})
    close = lambda group: (F.abs(group["_sr"] - F.col("_pr")) <= 1) \
        & (F.pmod(group["_sc"] - F.col("_pc") + 1, F.col("_parts")) <= 2)
    return _best(placed, {"_row": F.col("_home_row"), "_column": F.col("_home_column")}, groups, close, reach_m / FINE, haversine_m,
                 carried, reach_m, label, each_row or totals is not None)
