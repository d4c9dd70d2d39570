"""Geography as Column expressions: one definition for every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, unit: str = "km") -> Column:
    """Great-circle distance in km or m."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * (1000 if unit == "m" else 1) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def valid(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180)


def grid_cell(lat: Column, lng: Column, degrees: float = 0.01) -> Column:
    """Number of the square cell of a global grid: the default cell scheme, without UDFs."""
    return (F.floor((lat + 90) / degrees) * F.lit(round(360 / degrees) + 1) + F.floor((lng + 180) / degrees)).cast("long")
