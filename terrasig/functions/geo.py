"""Great-circle distance, unit-sphere coordinates and coordinate sanity predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasig.functions.numbers import clip

EARTH_M = 6_371_000.0
EARTH_KM = 6371.0088


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2.0 * radius) * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres, with the longitude difference wrapped over the antimeridian."""
    dlon = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return haversine_m(lat1, F.lit(0.0), lat2, dlon, EARTH_KM)


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere. Cubes in this space have no pole and no date line."""
    return (
        F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        F.sin(F.radians(lat)),
    )


def chord(metres: float, radius: float = EARTH_M) -> float:
    """Unit-sphere chord that spans a surface distance."""
    return 2.0 * math.sin(min(metres / (2.0 * radius), math.pi / 2))


def valid_coord(lat: Column, lon: Column) -> Column:
    """In range and not the exact (0, 0) that stands for a missing coordinate."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def near_null_island(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) < 1.0) & (F.abs(lon) < 1.0)


def pixel_metres(lat: Column, arcsec: float = 1.0) -> tuple[Column, Column]:
    """Ground size (dx, dy) of a raster pixel at a latitude."""
    dy = F.lit(111_320.0 * arcsec / 3600.0)
    return dy * F.cos(F.radians(lat)), dy
