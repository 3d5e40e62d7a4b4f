"""Cell, tile, block and geohash keys.

The snapping rules differ on purpose: each belongs to one input product and unifying them would move points between
cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasig.functions.numbers import clip

# Fixed values of the geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Fixed shape of the world grid: latitude step 0.5, longitude step 0.625.
WORLD_DLAT, WORLD_DLON, WORLD_NLAT, WORLD_NLON = 0.5, 0.625, 361, 576


def _floor_long(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def snap(x: Column, deg: float) -> Column:
    return _floor_long(x / F.lit(deg))


def offset_cell(lat: Column, lon: Column, deg: float) -> tuple[Column, Column]:
    """Cells counted from the south-west corner of the globe."""
    return _floor_long((lat + 90.0) / F.lit(deg)), _floor_long((lon + 180.0) / F.lit(deg))


def weather_cell(x: Column, deg: float, digits: int = 2) -> Column:
    """Nearest grid node, ties to even."""
    return F.round(F.rint(x / F.lit(deg)) * F.lit(deg), digits)


def world_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of the world grid; longitude wraps, the polar rows are half height."""
    i = _floor_long((lat + 90.0 + WORLD_DLAT / 2) / F.lit(WORLD_DLAT))
    j = F.pmod(_floor_long((lon + 180.0 + WORLD_DLON / 2) / F.lit(WORLD_DLON)), F.lit(WORLD_NLON).cast("bigint"))
    return clip(i, 0, WORLD_NLAT - 1).cast("bigint"), j


def tile(x: Column, deg: float) -> Column:
    return (F.floor(x / F.lit(deg)) * F.lit(deg)).cast("bigint")


def block_id(lat: Column, lon: Column, deg: float = 0.25) -> Column:
    return F.concat_ws("_", snap(lat, deg).cast("string"), snap(lon, deg).cast("string"))


def lon360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def lon180(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def geohash7(lat: Column, lon: Column) -> Column:
    """Seven-character geohash: 18 longitude bits and 17 latitude bits, interleaved longitude first."""
    top_lon, top_lat = (1 << 18) - 1, (1 << 17) - 1
    x = clip(F.floor((lon + 180.0) / 360.0 * F.lit(1 << 18)), 0, top_lon).cast("bigint")
    y = clip(F.floor((lat + 90.0) / 180.0 * F.lit(1 << 17)), 0, top_lat).cast("bigint")
    chars = []
    for c in range(7):
        code = F.lit(0).cast("bigint")
        for b in range(5):
            pos = 5 * c + b
            src, width = (x, 18) if pos % 2 == 0 else (y, 17)
            bit = F.shiftright(src, width - 1 - pos // 2).bitwiseAND(F.lit(1).cast("bigint"))
            code = code + bit * (1 << (4 - b))
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)
