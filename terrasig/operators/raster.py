"""Pixels as rows: point sampling, depth weighting and the lithology dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasig.functions.numbers import clip

# Fixed class codes of the global lithology map.
LITHOLOGY = {
    1: ("su", "unconsolidated sediments"),
    2: ("vb", "basic volcanic rocks"),
    3: ("ss", "siliciclastic sedimentary rocks"),
    4: ("pb", "basic plutonic rocks"),
    5: ("sm", "mixed sedimentary rocks"),
    6: ("sc", "carbonate sedimentary rocks"),
    7: ("va", "acid volcanic rocks"),
    8: ("mt", "metamorphic rocks"),
    9: ("pa", "acid plutonic rocks"),
    10: ("vi", "intermediate volcanic rocks"),
    11: ("wb", "water bodies"),
    12: ("py", "pyroclastics"),
    13: ("pi", "intermediate plutonic rocks"),
    14: ("ev", "evaporites"),
    15: ("nd", "no data"),
    16: ("ig", "ice and glaciers"),
}
# Fixed thickness weights (cm) of the 0-30 cm depth slices and divisors to physical units.
DEPTH_WEIGHT = {"0-5cm": 5.0, "5-15cm": 10.0, "15-30cm": 15.0}
UNIT_DIVISOR = {"clay": 10.0, "sand": 10.0, "bdod": 100.0, "cfvo": 10.0}
TILE_DEG = 2.0


def lithology(spark: SparkSession) -> DataFrame:
    rows = [(code, abbr, name) for code, (abbr, name) in LITHOLOGY.items()]
    return spark.createDataFrame(rows, "code int, abbr string, name string")


def depth_mean(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Depth-weighted mean of the slices that are present, in physical units: one column per property."""
    weight = F.lit(None).cast("double")
    for depth, w in DEPTH_WEIGHT.items():
        weight = F.when(F.col("depth") == depth, F.lit(w)).otherwise(weight)
    present = pixels.withColumn("_w", F.when(F.col("value").isNotNull(), weight))

    def mean(prop: str) -> Column:
        mine = F.col("prop") == prop
        total = F.sum(F.when(mine, F.col("value") * F.col("_w")))
        return total / F.sum(F.when(mine, F.col("_w"))) / F.lit(UNIT_DIVISOR[prop])

    return present.groupBy(*keys).agg(*[mean(p).alias(p) for p in UNIT_DIVISOR])


def soil_features(means: DataFrame) -> DataFrame:
    """Mask pixels without texture and derive silt as the remainder."""
    valid = (F.col("clay") > 0) & (F.col("sand") > 0)
    keep = lambda c: F.when(valid, c)
    return means.withColumns(
        {
            "clay_pct": keep(F.col("clay")),
            "sand_pct": keep(F.col("sand")),
            "silt_pct": keep(100.0 - F.col("clay") - F.col("sand")),
            "bdod_g_cm3": keep(F.col("bdod")),
            "cfvo_pct": keep(F.col("cfvo")),
        }
    ).drop(*UNIT_DIVISOR)


def pixel_of(lat: Column, lon: Column, size: int) -> dict[str, Column]:
    """Tile corner and (row, col) of the pixel under a point; rows run north to south and edges are clamped."""
    la, lo = F.floor(lat / TILE_DEG) * TILE_DEG, F.floor(lon / TILE_DEG) * TILE_DEG
    step = TILE_DEG / size
    inside = lambda x: clip(F.floor(x).cast("int"), 0, size - 1)
    return {
        "tile_lat": la.cast("bigint"),
        "tile_lon": lo.cast("bigint"),
        "row": inside((la + TILE_DEG - lat) / step),
        "col": inside((lon - lo) / step),
    }


def sample(points: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Pixel values under each point: an equi join on (tile, row, col); points off the map keep NULLs."""
    keyed = points.withColumns(pixel_of(F.col("lat"), F.col("lon"), size))
    return keyed.join(pixels, ["tile_lat", "tile_lon", "row", "col"], "left")
