"""Degrees to metres: great-circle distance and the British National Grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: published geodetic constants ------------------------------
EARTH_RADIUS_M = 6371008.8

WGS84_AXES = (6378137.0, 6356752.314245)
AIRY_AXES = (6377563.396, 6356256.909)
# WGS84 to OSGB36: shifts in metres, rotations in seconds of arc, scale in parts per million.
OSGB_SHIFT_M = (-446.448, 125.157, -542.060)
OSGB_ROTATION_SECONDS = (-0.1502, -0.2470, -0.8421)
OSGB_SCALE_PPM = 20.4894
NATIONAL_GRID_SCALE = 0.9996012717
NATIONAL_GRID_ORIGIN_DEGREES = (49.0, -2.0)          # latitude, longitude
NATIONAL_GRID_FALSE_ORIGIN_M = (400000.0, -100000.0)  # easting, northing
NATIONAL_GRID_AREA = (-9.01, 49.75, 2.01, 61.01)      # west, south, east, north, degrees
# --- end of fixed values -----------------------------------------------------

# The published area ends with the surveyed land, the projection does not: meridians draw together to the north, so
# places there lie nearer to the central meridian, in metres, and the series is more exact than in Cornwall.
NATIONAL_GRID_NORTH_END = 84.0


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat \
        + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def planar_m(x_a: Column, y_a: Column, x_b: Column, y_b: Column) -> Column:
    return F.sqrt((x_a - x_b) * (x_a - x_b) + (y_a - y_b) * (y_a - y_b))


def _national_grid_arrays(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WGS84 degrees to National Grid metres: datum shift, then the transverse Mercator series."""
    a, b = WGS84_AXES
    phi, lam = np.radians(lat), np.radians(lon)
    nu = a / np.sqrt(1 - (1 - b * b / (a * a)) * np.sin(phi) ** 2)
    point = np.stack([nu * np.cos(phi) * np.cos(lam), nu * np.cos(phi) * np.sin(lam),
                      b * b / (a * a) * nu * np.sin(phi)])

    rx, ry, rz = np.radians(np.array(OSGB_ROTATION_SECONDS) / 3600)
    grow = 1 + OSGB_SCALE_PPM * 1e-6
    turn = np.array([[grow, -rz, ry], [rz, grow, -rx], [-ry, rx, grow]])
    x, y, z = turn @ point + np.array(OSGB_SHIFT_M)[:, None]

    a, b = AIRY_AXES
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    flat = np.hypot(x, y)
    beta = np.arctan2(z * a, flat * b)  # Bowring: exact to below a millimetre on the ground
    phi = np.arctan2(z + (a * a - b * b) / b * np.sin(beta) ** 3, flat - e2 * a * np.cos(beta) ** 3)
    phi0, lam0 = np.radians(NATIONAL_GRID_ORIGIN_DEGREES)
    d, dphi, sphi = np.arctan2(y, x) - lam0, phi - phi0, phi + phi0

    a, b = a * NATIONAL_GRID_SCALE, b * NATIONAL_GRID_SCALE
    sin, cos, tan2 = np.sin(phi), np.cos(phi), np.tan(phi) ** 2
    nu, rho = a / np.sqrt(1 - e2 * sin ** 2), a * (1 - e2) / (1 - e2 * sin ** 2) ** 1.5
    eta2 = nu / rho - 1
    arc = b * ((1 + n + 1.25 * n ** 2 + 1.25 * n ** 3) * dphi
               - (3 * n + 3 * n ** 2 + 2.625 * n ** 3) * np.sin(dphi) * np.cos(sphi)
               + (1.875 * n ** 2 + 1.875 * n ** 3) * np.sin(2 * dphi) * np.cos(2 * sphi)
               - 35 / 24 * n ** 3 * np.sin(3 * dphi) * np.cos(3 * sphi))
    e0, n0 = NATIONAL_GRID_FALSE_ORIGIN_M
    easting = e0 + nu * cos * d + nu / 6 * cos ** 3 * (nu / rho - tan2) * d ** 3 \
        + nu / 120 * cos ** 5 * (5 - 18 * tan2 + tan2 ** 2 + 14 * eta2 - 58 * tan2 * eta2) * d ** 5
    northing = n0 + arc + nu / 2 * sin * cos * d ** 2 \
        + nu / 24 * sin * cos ** 3 * (5 - tan2 + 9 * eta2) * d ** 4 \
        + nu / 720 * sin * cos ** 5 * (61 - 58 * tan2 + tan2 ** 2) * d ** 6
    return easting, northing


@F.pandas_udf(T.StructType([T.StructField("easting", T.DoubleType()),
                            T.StructField("northing", T.DoubleType())]))
def _national_grid(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    west, south, east, _ = NATIONAL_GRID_AREA
    outside = (lon < west) | (lon > east) | (lat < south) | (lat > NATIONAL_GRID_NORTH_END)
    if outside.any():
        raise ValueError(f"({lon[outside].iloc[0]}, {lat[outside].iloc[0]}) lies outside the British National Grid. "
                         f"Leave the projection out: distances then follow the great circle.")
    easting, northing = _national_grid_arrays(lon.to_numpy(), lat.to_numpy())
    return pd.DataFrame({"easting": easting, "northing": northing})


def national_grid(df: DataFrame) -> DataFrame:
    """`df` with `easting` and `northing` on the British National Grid, from `lon` and `lat`.

    Good to about 5 m, which is what the published seven-parameter shift gives. North of the published area, up to
    84 degrees, the same plane goes on: distances on it are as true as in Britain, but no survey says how far the shift
    is off there. Other places raise. Runs in batches on
    one row per cell. As Spark expressions the series would repeat its terms hundreds of times over
    in every filter that is pushed through it; for the same reason the function is declared
    non-deterministic, which keeps filters on its result above it.
    """
    xy = _national_grid.asNondeterministic()("lon", "lat")
    return df.withColumn("_xy", xy).select(
        *df.columns, F.col("_xy.easting").alias("easting"), F.col("_xy.northing").alias("northing"))


def local_plane(centre_lat: float):
    """Projection for regions without a grid of their own: metres east and north, equirectangular.

    Distances east to west are off by a few per cent at the northern and southern edge of a region
    that spans two degrees.
    """
    scale = math.pi * EARTH_RADIUS_M / 180

    def project(df: DataFrame) -> DataFrame:
        return df.select(*df.columns,
                         (F.col("lon") * scale * math.cos(math.radians(centre_lat))).alias("easting"),
                         (F.col("lat") * scale).alias("northing"))
    return project
