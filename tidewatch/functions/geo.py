"""Geography as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EARTH_RADIUS_KM, GRID_DEGREES, PRECISION_RADIUS_KM, lookup


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def grid_cell(lat: Column, lon: Column, degrees: int = GRID_DEGREES) -> Column:
    """``degrees:row:column`` of the cell; latitude 90 and longitude 180 are in cells of their own."""
    row, column = F.floor((lat + 90) / degrees), F.floor((lon + 180) / degrees)
    return F.concat_ws(":", F.lit(str(degrees)), row.cast("string"), column.cast("string"))


def cell_centre(cell: Column) -> Column:
    """struct(lat, lon) of a cell's centre, null for text that names no cell."""
    parts = F.split(cell, ":")
    size, row, column = (parts[i].try_cast("double") for i in range(3))
    good = (F.size(parts) == 3) & size.isNotNull() & row.isNotNull() & column.isNotNull()
    return F.when(good, F.struct(((row + 0.5) * size - 90).alias("lat"), ((column + 0.5) * size - 180).alias("lon")))


def leading_number(text: Column) -> Column:
    """The number that a text begins with, so that '12abc' is 12."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def unit_sums(lat: Column, lon: Column, weight: Column) -> dict[str, Column]:
    """Aggregates x, y, z and weight whose direction is the weighted spherical centre."""
    la, lo = F.radians(lat), F.radians(lon)
    return {"x": F.sum(weight * F.cos(la) * F.cos(lo)), "y": F.sum(weight * F.cos(la) * F.sin(lo)), "z": F.sum(weight * F.sin(la)), "w": F.sum(F.when(lat.isNotNull() & lon.isNotNull(), weight))}


def direction(x: Column, y: Column, z: Column, w: Column) -> Column:
    """struct(lat, lon) of a sum of unit vectors; null if there is none or they cancel out."""
    flat = F.sqrt(x * x + y * y)
    good = (w > 0) & (F.sqrt(flat * flat + z * z) / w > 1e-12)
    return F.when(good, F.struct(F.degrees(F.atan2(z, flat)).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon")))


def compatible(distance_km: Column, precision_a: Column, precision_b: Column) -> Column:
    """Whether two locations may be the same, given their precisions."""
    return distance_km <= lookup(precision_a, PRECISION_RADIUS_KM, 2000.0) + lookup(precision_b, PRECISION_RADIUS_KM, 2000.0)
