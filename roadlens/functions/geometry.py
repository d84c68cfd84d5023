"""Line geometry to vertices, and vertices to GeoJSON."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTICES = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()),
                                     T.StructField("lat", T.DoubleType())]))


def wkt_vertices(wkt: Column) -> Column:
    """Vertices of a WKT LineString, JVM-side; NULL for an empty or missing geometry."""
    body = F.regexp_extract(wkt, r"^\s*LINESTRING\s*Z?\s*\(([^()]*)\)", 1)
    pairs = F.transform(F.split(body, ","), lambda pair: F.split(F.trim(pair), r"\s+"))
    vertices = F.transform(pairs, lambda xy: F.struct(xy[0].cast("double").alias("lon"),
                                                      xy[1].cast("double").alias("lat")))
    return F.when(body != "", vertices)


def _line_coordinates(blob: bytes) -> np.ndarray:
    """Longitudes and latitudes of one WKB LineString, either byte order, with or without Z and M."""
    order = "<" if blob[0] == 1 else ">"
    kind = int(np.frombuffer(blob, order + "u4", 1, 1)[0])
    has_srid, plain = bool(kind & 0x20000000), kind & 0x1FFFFFFF
    extra = bool(kind & 0x80000000) + bool(kind & 0x40000000)
    if plain >= 1000:
        extra, plain = {1: 1, 2: 1, 3: 2}[plain // 1000], plain % 1000
    if plain != 2:
        raise ValueError(f"Expected a LineString, found WKB geometry type {plain}.")
    start = 9 if has_srid else 5
    count = int(np.frombuffer(blob, order + "u4", 1, start)[0])
    values = np.frombuffer(blob, order + "f8", count * (2 + extra), start + 4)
    return values.reshape(count, 2 + extra)[:, :2].astype("f8")


_PLAIN_HEAD = np.frombuffer(b"\x01\x02\x00\x00\x00", "u1")       # little-endian LineString without Z, M and SRID


def _all_coordinates(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all lines one after another, and the number of vertices of each; none for NULL.

    Plain little-endian lines, which is how most files come, are read in one go from the batch's buffer; any other
    line is read on its own.
    """
    blobs = blobs.cast(pa.large_binary())
    begins, ends, data = _spans(blobs)
    known = blobs.is_valid().to_numpy(zero_copy_only=False)
    sizes, flat = np.zeros(len(blobs), "i8"), []
    plain = known & (ends - begins >= 9)
    if plain.any():
        at = begins[plain][:, None] + np.arange(9)
        heads = data[at]
        counts = np.ascontiguousarray(heads[:, 5:]).view("<u4")[:, 0].astype("i8")
        fits = (heads[:, :5] == _PLAIN_HEAD).all(1) & (9 + 16 * counts == (ends - begins)[plain])
        plain[np.flatnonzero(plain)[~fits]] = False
        sizes[plain] = counts[fits]
    if plain.all() or (plain == known).all():
        where = np.repeat(begins[plain] + 9, sizes[plain] * 16) + _counting(sizes[plain] * 16)
        return data[where].view("<f8").reshape(-1, 2), sizes
    for i, blob in enumerate(blobs.to_pylist()):
        if blob is not None:
            line = _line_coordinates(blob)
            sizes[i] = len(line)
            flat.append(line)
    return (np.concatenate(flat) if flat else np.empty((0, 2))), sizes


def _spans(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each value in the array's data, and the data."""
    offsets = np.frombuffer(blobs.buffers()[1], "i8", len(blobs) + 1, blobs.offset * 8)
    body = blobs.buffers()[2]
    return offsets[:-1], offsets[1:], np.frombuffer(body, "u1") if body is not None and body.size else np.zeros(0, "u1")


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


@F.arrow_udf(VERTICES)
def wkb_vertices(blobs: pa.Array) -> pa.Array:
    """Vertices of WKB LineStrings. Spark has no built-in that reads coordinates out of WKB.

    A batch comes in and goes out as Arrow: the coordinates of all lines form two flat arrays.
    """
    flat, sizes = _all_coordinates(blobs)
    points = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))],
        names=["lon", "lat"])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), points, mask=blobs.is_null())


def _spread(values: np.ndarray) -> np.ndarray:
    """Bit i of each value moved to bit 2i."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        values = (values | (values << shift)) & mask
    return values


def covered_cells(flat: np.ndarray, sizes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Line number and cell of every cell each line passes through, both ascending, without repeats.

    The same cover as `grid.cells_of_line`: pieces are cut at the grid columns they cross, and inside one column a piece
    touches the run of rows between its ends. Runs of all lines are unrolled together.
    """
    line = np.repeat(np.arange(len(sizes)), sizes)
    x, y = ((flat[:, i] + offset) / 360.0 * float(1 << level) for i, offset in ((0, 180.0), (1, 90.0)))
    same = line[1:] == line[:-1]
    begin = np.flatnonzero(same)
    end = begin + 1
    lone = np.flatnonzero(sizes[line] == 1)                       # a line of one vertex is a piece of no length
    begin, end = np.concatenate([begin, lone]), np.concatenate([end, lone])
    owner = line[begin]
    swap = (x[end] < x[begin]) | ((x[end] == x[begin]) & (y[end] < y[begin]))
    west, east = np.where(swap, end, begin), np.where(swap, begin, end)
    x0, y0, x1, y1 = x[west], y[west], x[east], y[east]
    run = x1 - x0
    slope = np.divide(y1 - y0, run, out=np.zeros_like(run), where=run > 0)
    first = np.floor(x0).astype("i8")
    columns = np.floor(x1).astype("i8") - first + 1
    piece = np.repeat(np.arange(len(owner)), columns)
    column = first[piece] + _counting(columns)
    enter = np.where(column > x0[piece], y0[piece] + (column - x0[piece]) * slope[piece], y0[piece])
    leave = np.where(column + 1 < x1[piece], y0[piece] + (column + 1 - x0[piece]) * slope[piece], y1[piece])
    low = np.floor(np.minimum(enter, leave)).astype("i8")
    rows = np.floor(np.maximum(enter, leave)).astype("i8") - low + 1
    key = np.repeat(_spread(column), rows) | _spread(np.repeat(low, rows) + _counting(rows)) << 1
    of = np.repeat(owner[piece], rows)
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    return of[fresh], key[fresh]


def wkb_cells(blobs: Column, level: int) -> Column:
    """Every grid cell a WKB LineString passes through, as an array without repeats; NULL for NULL.

    Lines are read from WKB in Python anyway, so the cover is worked out there, for a whole batch at once, and no vertex
    comes back to the JVM.
    """
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def cells(batch: pa.Array) -> pa.Array:
        flat, sizes = _all_coordinates(batch)
        of, key = covered_cells(flat, sizes, level)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))]).astype("i4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key, pa.int64()), mask=batch.is_null())
    return cells(blobs)


def geojson_line(vertices: Column) -> Column:
    """Struct that `to_json` writes as a GeoJSON LineString."""
    return F.struct(F.lit("LineString").alias("type"),
                    F.transform(vertices, lambda v: F.array(v["lon"], v["lat"])).alias("coordinates"))


def geojson_point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
