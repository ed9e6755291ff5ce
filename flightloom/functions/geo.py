"""Spherical geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom.constants import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def dms(degrees: Column, is_lat: bool) -> Column:
    """Degrees, minutes and seconds with a letter of direction."""
    size = F.abs(degrees)
    minutes = (size - F.floor(size)) * 60
    letter = F.when(degrees >= 0, "N" if is_lat else "E").otherwise("S" if is_lat else "W")
    return F.concat(F.floor(size).cast("string"), F.lit("°"), F.floor(minutes).cast("string"), F.lit("'"), F.format_string("%.1f", (minutes - F.floor(minutes)) * 60), F.lit('"'), letter)


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / F.lit(degrees)).cast("long")


def outside_margin(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column, margin: float = 0.2) -> Column:
    """Whether a place lies in the outer `margin` of a view, or beyond it, so that the view should move."""
    high, wide = (north - south) * margin, (east - west) * margin
    return (lat < south + high) | (lat > north - high) | (lon < west + wide) | (lon > east - wide)
