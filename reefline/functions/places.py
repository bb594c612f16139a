"""Latitude zones, sun height, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone(lat: Column, cold_beyond: float = 60.0, cold_name: str = "polar") -> Column:
    """Latitude zone; latitude 0 is tropical, a missing latitude has no zone."""
    return (
        F.when(lat.between(-30.0, 30.0), F.lit("tropical"))
        .when(F.abs(lat) > cold_beyond, F.lit(cold_name))
        .when(lat.isNotNull(), F.lit("temperate"))
    )


def dms_to_degrees(parts: Column, hemisphere: Column) -> Column:
    """[degrees, minutes, seconds] and a hemisphere letter to signed decimal degrees."""
    value = F.get(parts, 0) + F.get(parts, 1) / 60.0 + F.get(parts, 2) / 3600.0
    return F.when(hemisphere.isin("S", "W"), -value).otherwise(value)


def solar_elevation(lat: Column, at: Column) -> Column:
    """Degrees of the sun above the horizon from latitude and local solar time."""
    declination = F.radians(
        F.lit(23.45) * F.sin(F.radians(F.lit(360.0) * (F.lit(284) + F.dayofyear(at)) / F.lit(365.0)))
    )
    hour = F.hour(at) + F.minute(at) / F.lit(60.0)
    angle = F.radians(F.lit(15.0) * (hour - F.lit(12.0)))
    height = F.sin(declination) * F.sin(F.radians(lat)) + F.cos(declination) * F.cos(
        F.radians(lat)
    ) * F.cos(angle)
    return F.degrees(F.asin(height))
