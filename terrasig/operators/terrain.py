"""Terrain derivatives of elevation patches held as one row-major array per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.functions import geo

FEATURES = (
    "elev_m", "slope_deg", "aspect_sin", "aspect_cos", "curvature", "tri", "roughness_std", "relief_range", "tpi",
)
NO_DATA_BELOW = -400.0


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _median(sorted_a: Column) -> Column:
    n = F.size(sorted_a)
    return (
        F.element_at(sorted_a, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_a, F.floor((n + 2) / 2).cast("int"))
    ) / 2.0


#: Weights over the three by three cells around a point, row by row: slope to the east and to the south (eight cells apart),
#: and bending along a row and along a column.
EAST = (-1, 0, 1, -2, 0, 2, -1, 0, 1)
SOUTH = (-1, -2, -1, 0, 0, 0, 1, 2, 1)
ALONG_ROW = (0, 0, 0, 1, -2, 1, 0, 0, 0)
ALONG_COLUMN = (0, 1, 0, 0, -2, 0, 0, 1, 0)
_MIDDLE = 4


def _weighed(window: str, weights: tuple[int, ...]) -> Column:
    """The window's cells times their weights, added up."""
    products = F.zip_with(window, F.array(*[F.lit(float(w)) for w in weights]), lambda z, w: z * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _spread(values: str, mean: str) -> Column:
    """Population standard deviation of an array around its known mean."""
    return F.sqrt(_mean(F.transform(values, lambda x: (x - F.col(mean)) * (x - F.col(mean)))))


def derive(patches: DataFrame, rows: int, cols: int, z: str = "z", arcsec: float = 1.0) -> DataFrame:
    """Nine terrain features per point; a patch that is too small or more than half holes yields no row.

    ``patches(id, lat, z)``. A stencil of weights is laid over the window around the patch's centre, the rest are folds over
    the whole patch: array expressions of the row, so nothing is shuffled.
    """
    if rows < 5 or cols < 5:
        return patches.filter(F.lit(False)).select("*", *[F.lit(None).cast("double").alias(f) for f in FEATURES])
    cells = F.transform(z, lambda x: F.when(x >= NO_DATA_BELOW, x))
    df = patches.withColumn("_cells", cells).withColumn("_known", F.sort_array(F.filter("_cells", lambda x: x.isNotNull())))
    df = df.filter(F.size("_known") >= rows * cols / 2.0)
    top = (rows // 2 - 1) * cols + cols // 2
    window = F.concat(*[F.slice("_cells", top + i * cols, 3) for i in range(3)])
    middle = _median(F.col("_known"))
    df = df.withColumn("_window", F.transform(window, lambda x: F.coalesce(x, middle))).withColumn("_centre", F.element_at("_window", _MIDDLE + 1))
    wide, high = geo.pixel_metres(F.col("lat"), arcsec)
    df = df.withColumns({"_east": _weighed("_window", EAST) / (8 * wide), "_south": _weighed("_window", SOUTH) / (8 * high), "_level": _mean(F.col("_known"))})
    facing = F.atan2(F.col("_south"), -F.col("_east"))
    bend = _weighed("_window", ALONG_ROW) / (wide * wide) + _weighed("_window", ALONG_COLUMN) / (high * high)
    features = {  # the names are fixed
        "elev_m": F.col("_centre"),
        "slope_deg": F.degrees(F.atan(F.hypot("_east", "_south"))),
        "aspect_sin": F.sin(facing),
        "aspect_cos": F.cos(facing),
        "curvature": bend * 1e4,
        "tri": _mean(F.transform("_window", lambda x: F.abs(x - F.col("_centre")))),
        "roughness_std": _spread("_known", "_level"),
        "relief_range": F.array_max("_known") - F.array_min("_known"),
        "tpi": F.col("_centre") - F.col("_level"),
    }
    return df.withColumns(features).drop("_cells", "_known", "_window", "_centre", "_east", "_south", "_level")


def on_land(df: DataFrame) -> DataFrame:
    """Flat and at sea level means open water."""
    return df.filter(~((F.col("elev_m") <= 0.5) & (F.col("roughness_std") < 0.1)))
