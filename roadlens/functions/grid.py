"""Map cells: parents of delivered H3 ids, and a nested square grid for everything else.

Spark has no H3 functions. The parent of an id is plain bit arithmetic and exact. Cells of points
and lines use a square grid on longitude and latitude instead: level `n` cuts 360 degrees into
2^n columns and rows of the same angular size, and a cell is the Morton key of its column and row,
so the parent one level up is the key shifted right by two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grid level that comes closest in area to an H3 resolution around 50 degrees latitude.
LEVEL_FOR_RESOLUTION = {4: 10, 6: 12, 8: 15, 9: 17}

_H3_RESOLUTION_SHIFT = 52
_H3_DIGITS = 15


def h3_parent(cell: Column, resolution: int) -> Column:
    """Parent id (hex text) of an H3 id (hex text) at a coarser resolution."""
    key = F.conv(cell, 16, 10).cast("bigint")
    unused = (1 << (3 * (_H3_DIGITS - resolution))) - 1
    cleared = key.bitwiseAND(F.lit(~(15 << _H3_RESOLUTION_SHIFT)).cast("bigint"))
    parent = (cleared.bitwiseOR(F.lit(resolution << _H3_RESOLUTION_SHIFT).cast("bigint"))
              .bitwiseOR(F.lit(unused).cast("bigint")))
    return F.lower(F.hex(parent))


def _spread_bits(value: Column) -> Column:
    """Move bit i of `value` to bit 2i: its binary digits read in base four."""
    return F.conv(F.bin(value), 4, 10).cast("bigint")


def _gather_bits(cell: Column, of_row: bool) -> Column:
    """Column or row of a Morton key: each base-four digit holds one bit of both."""
    digits = F.translate(F.conv(cell.cast("string"), 10, 4), "0123", "0011" if of_row else "0101")
    return F.conv(digits, 2, 10).cast("bigint")


def grid_units(degrees: Column, offset: float, level: int) -> Column:
    """Position along one axis, in cells."""
    return (degrees + F.lit(offset)) / F.lit(360.0) * F.lit(float(1 << level))


def cell_of_indices(column: Column, row: Column) -> Column:
    """Morton key of grid column and row."""
    return _spread_bits(column) + 2 * _spread_bits(row)


def cell_of_point(lon: Column, lat: Column, level: int) -> Column:
    column = F.floor(grid_units(lon, 180.0, level))
    row = F.floor(grid_units(lat, 90.0, level))
    return cell_of_indices(column, row)


def cell_of_box(level: int) -> Column:
    """Cell of the centre of the flat bounding-box columns."""
    return cell_of_point((F.col("min_lon") + F.col("max_lon")) / 2,
                         (F.col("min_lat") + F.col("max_lat")) / 2, level)


def cell_of_bbox(level: int, column: str = "bbox") -> Column:
    """Cell of the centre of a bounding-box struct."""
    edge = lambda name: F.col(f"{column}.{name}")
    return cell_of_point((edge("xmin") + edge("xmax")) / 2, (edge("ymin") + edge("ymax")) / 2,
                         level)


def grid_parent(cell: Column, level: int, parent_level: int) -> Column:
    return F.shiftright(cell, 2 * (level - parent_level))


def centre_lon(cell: Column, level: int) -> Column:
    return (_gather_bits(cell, of_row=False) + F.lit(0.5)) * F.lit(360.0 / (1 << level)) - F.lit(180.0)


def centre_lat(cell: Column, level: int) -> Column:
    return (_gather_bits(cell, of_row=True) + F.lit(0.5)) * F.lit(360.0 / (1 << level)) - F.lit(90.0)


def cells_of_line(vertices: Column, level: int) -> Column:
    """Every cell a line passes through, as an array without repeats.

    `vertices` is `array<struct<lon, lat>>`. Each piece between two vertices is cut at the grid
    columns it crosses; inside one column the rows between its two ends are all the rows it
    touches, so the cover is exact and its size follows the length of the line.
    """
    points = F.transform(vertices, lambda v: F.struct(
        grid_units(v["lon"], 180.0, level).alias("x"), grid_units(v["lat"], 90.0, level).alias("y")))
    count = F.size(vertices)
    starts = F.slice(points, F.lit(1), F.greatest(count - 1, F.lit(1)))
    ends = F.when(count == 1, points).otherwise(
        F.slice(points, F.lit(2), F.greatest(count - 1, F.lit(0))))

    def eastward(a: Column, b: Column) -> Column:
        """The piece from its western to its eastern end."""
        ends = F.array_sort(F.array(a, b))
        return F.struct(ends[0].alias("west"), ends[1].alias("east"))

    def with_slope(piece: Column) -> Column:
        run = piece["east"]["x"] - piece["west"]["x"]
        slope = F.when(run > 0, (piece["east"]["y"] - piece["west"]["y"]) / run).otherwise(F.lit(0.0))
        return F.struct(piece["west"]["x"].alias("x0"), piece["west"]["y"].alias("y0"),
                        piece["east"]["x"].alias("x1"), piece["east"]["y"].alias("y1"), slope.alias("slope"))

    def piece_cells(piece: Column) -> Column:
        at = lambda x: piece["y0"] + (x - piece["x0"]) * piece["slope"]

        def column_rows(column: Column) -> Column:
            enter = F.when(column > piece["x0"], at(column)).otherwise(piece["y0"])
            leave = F.when(column + 1 < piece["x1"], at(column + 1)).otherwise(piece["y1"])
            return F.struct(_spread_bits(column).alias("column"),
                            F.least(enter, leave).alias("low"), F.greatest(enter, leave).alias("high"))

        def column_cells(part: Column) -> Column:
            rows = F.sequence(F.floor(part["low"]), F.floor(part["high"]))
            return F.transform(rows, lambda row: part["column"] + 2 * _spread_bits(row))

        columns = F.transform(F.sequence(F.floor(piece["x0"]), F.floor(piece["x1"])), column_rows)
        return F.flatten(F.transform(columns, column_cells))

    # Each step binds its results before the next one uses them, so nothing is worked out twice.
    pieces = F.transform(F.zip_with(starts, ends, eastward), with_slope)
    return F.array_distinct(F.flatten(F.transform(pieces, piece_cells)))
