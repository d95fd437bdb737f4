"""Grid cells and distances."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F, types as T

from ._col import col

LAT_M, LON_M = 111000.0, 99000.0          # fixed values: planar metres per degree
EARTH_MILES = 3958.8                      # fixed value


def planar_m(lat1, lon1, lat2, lon2) -> Column:
    """Planar distance in metres."""
    dy, dx = (col(lat1) - col(lat2)) * LAT_M, (col(lon1) - col(lon2)) * LON_M
    return F.sqrt(dy * dy + dx * dx)


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def cell(value, size: float) -> Column:
    return F.floor(col(value) / F.lit(float(size))).cast("bigint")


def cell_sizes(radius_m: float) -> tuple[float, float]:
    """Cell height and width in degrees so that points within the radius are in the same or a touching cell."""
    return radius_m / LAT_M, radius_m / LON_M


def neighbor_cells(lat, lon, radius_m: float) -> Column:
    """array<struct<cy,cx>> of the point's cell and the eight around it."""
    h, w = cell_sizes(radius_m)
    cy, cx = cell(lat, h), cell(lon, w)
    return F.array(*[F.struct((cy + dy).alias("cy"), (cx + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])


@F.arrow_udtf(returnType=T.StructType([T.StructField("cy", T.LongType()), T.StructField("cx", T.LongType())]))
class NeighborCells:
    """SQL table function form of :func:`neighbor_cells`: neighbor_cells(lat, lon, radius_m)."""

    def eval(self, lat, lon, radius_m):
        import pyarrow as pa
        rows = [(math.floor(a / (r / LAT_M)) + dy, math.floor(o / (r / LON_M)) + dx)
                for a, o, r in zip(lat.to_pylist(), lon.to_pylist(), radius_m.to_pylist()) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        yield pa.table({"cy": pa.array([y for y, _ in rows], pa.int64()), "cx": pa.array([x for _, x in rows], pa.int64())})
