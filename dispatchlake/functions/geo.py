"""Distances on the sphere and grid cells for neighbour joins."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M = 6_371_000.0
DEPOT_LAT, DEPOT_LNG = 37.760175, 29.042555
#: Metres of a degree of latitude, rounded down, so that a cell is never too small.
DEGREE_M = 111_194.0


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance; null if a coordinate is."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would hide a null


def metres_or_infinity(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Infinity where a side is missing, so that nothing is near it."""
    return F.coalesce(metres(lat1, lng1, lat2, lng2), F.lit(math.inf))


def _row(lat: Column, radius_m: float) -> Column:
    return F.floor(lat / (radius_m / DEGREE_M)).cast("long")


def _columns_of(row: Column, radius_m: float) -> Column:
    """Cells in a row of cells: each as wide as the radius at least, next to the row too, so fewer towards the poles and one there."""
    step = radius_m / DEGREE_M
    widest = (F.abs(row) + 2) * step
    wide = F.cos(F.radians(widest)) * (360 / step)
    return F.when(widest >= 90, 1).otherwise(F.greatest(F.floor(wide), F.lit(1))).cast("long")


def _column(lng: Column, columns: Column) -> Column:
    turned = F.pmod(lng, F.lit(360.0)) / 360
    return F.least(F.floor(turned * columns).cast("long"), columns - 1)


def cell(lat: Column, lng: Column, radius_m: float) -> tuple[Column, Column]:
    """Grid cell no smaller than ``radius_m`` either way, at any latitude."""
    row = _row(lat, radius_m)
    return row, _column(lng, _columns_of(row, radius_m))


def around(lat: Column, lng: Column, radius_m: float) -> Column:
    """The point's cell and all others that can hold points within ``radius_m``, round the globe: up to nine."""
    row = _row(lat, radius_m)
    out = []
    for i in (-1, 0, 1):
        columns = _columns_of(row + i, radius_m)
        at = _column(lng, columns)
        out += [F.struct((row + i).alias("cell_lat"), F.pmod(at + j, columns).alias("cell_lng")) for j in (-1, 0, 1)]
    return F.array_distinct(F.array(*out))
