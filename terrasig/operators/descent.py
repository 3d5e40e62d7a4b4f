"""Proximity by descent through nested cells of the unit sphere.

Space is cut into 8^k cubes at level k, and the occupied cells of a level carry their number of rows, their sums and the
tight box around what they hold. Pairs of cells are bounded by their boxes: a pair that cannot matter any more is dropped, one
that is cheap to open is left for the end, the others are split into their occupied children. So a crowded place is looked
into only where it can decide something, and no row meets all rows of a crowded cell.

A round is a handful of equi joins on cell ids, written to the checkpoint folder; the number of rounds is bounded by `LEVELS`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.functions import geo
from terrasig.session import cut_lineage

#: Cells of the last level are 19 cm wide.
LEVELS = 26
#: Rows that a cell may hold (nearest: that all cells left for a point may hold) to be opened instead of split.
OPEN = 32
#: All pairs of cells of this level start the nearest-neighbour descent: at most 512 on either side, whatever the data.
START = 3

_SLACK = 1e-9
_AXES = ("x", "y", "z")


def _placed(df: DataFrame) -> DataFrame:
    """Unit-sphere coordinates and the cell of the last level, of rows with coordinates."""
    df = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    df = df.withColumns(dict(zip(_AXES, geo.unit_xyz(F.col("lat"), F.col("lon")), strict=True)))
    top = (1 << LEVELS) - 1
    return df.withColumns({f"f{a}": F.least(F.lit(top), F.floor((F.col(a) + 1.0) * float(1 << (LEVELS - 1)))).cast("bigint") for a in _AXES})


def _cells(spots: DataFrame, level: int, side: str, *aggs: Column) -> DataFrame:
    """Occupied cells of a level: `<side>_c*` the cell, `<side>_u*` its parent, `<side>_l*`, `<side>_h*` its tight box."""
    keys = [F.shiftright(f"f{a}", LEVELS - level).alias(f"{side}_c{a}") for a in _AXES]
    box = [f(a).alias(f"{side}_{n}{a}") for a in _AXES for n, f in (("l", F.min), ("h", F.max))]
    cells = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_n"), *box, *aggs)
    return cells.withColumns({f"{side}_u{a}": F.shiftright(f"{side}_c{a}", 1) for a in _AXES})


def _bounds(side: str, other: str) -> tuple[Column, Column]:
    """Least and greatest distance (chord) that two boxes allow."""
    low, high = F.lit(0.0), F.lit(0.0)
    for a in _AXES:
        l1, h1, l2, h2 = (F.col(f"{s}_{n}{a}") for s in (side, other) for n in "lh")
        gap, far = F.greatest(F.lit(0.0), l2 - h1, l1 - h2), F.greatest(h2 - l1, h1 - l2)
        low, high = low + gap * gap, high + far * far
    return F.sqrt(low), F.sqrt(high)


def _ids(side: str, part: str = "c") -> list[str]:
    return [f"{side}_{part}{a}" for a in _AXES]


def _at_levels(spots: DataFrame, levels: Sequence[int], side: str) -> DataFrame:
    """Every row once for each of the levels, with its cell there."""
    df = spots.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    return df.withColumns({f"{side}_c{a}": F.expr(f"shiftright(f{a}, {LEVELS} - level)") for a in _AXES})


def _front(pairs: DataFrame, level: int, opened: int) -> DataFrame:
    """Pairs of (p cell, v cell) that can still hold a nearest vertex, marked `ready` where opening them is cheap."""
    low, high = _bounds("p", "v")
    cell = Window.partitionBy(*_ids("p"))
    pairs = pairs.withColumns({"_low": low, "_high": high})
    pairs = pairs.withColumn("best", F.least("best", F.min("_high").over(cell))).filter(F.col("_low") <= F.col("best") * (1 + _SLACK) + 1e-15)
    ready = (F.sum("v_n").over(cell) <= opened) | F.lit(level == LEVELS)
    return cut_lineage(pairs.select(*_ids("p"), *_ids("v"), "best", ready.alias("ready"), F.lit(level).alias("level")))


def nearest_candidates(at: DataFrame, ways: DataFrame, opened: int = OPEN) -> DataFrame:
    """(id, lat, lon, vertex, v_lat, v_lon): few vertices for every point, the nearest among them.

    `at` (id, lat, lon) and `ways` (vertex, lat, lon) are distinct in their coordinates. Points descend as cells too, so that
    points of one place share the search until it is down to `opened` vertices.
    """
    at, ways = cut_lineage(_placed(at)), cut_lineage(_placed(ways))
    side = 1 << START
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(side - 1).cast("bigint"))
    pairs = _cells(at, START, "p").withColumn("best", F.lit(float("inf")))
    for c in _ids("v"):
        pairs = pairs.withColumn(c, F.explode(axis))
    pairs = pairs.join(_cells(ways, START, "v"), _ids("v"))
    level, done, levels = START, None, []
    while True:
        front = _front(pairs, level, opened)
        ready = front.filter("ready").select("level", *_ids("p"), *_ids("v"))
        done = ready if done is None else done.unionByName(ready)
        levels.append(level)
        rest = front.filter("not ready")
        if level == LEVELS or rest.isEmpty():
            break
        level += 1
        rest = rest.select("best", *[F.col(c).alias(c.replace("_c", "_u")) for c in (*_ids("p"), *_ids("v"))])
        pairs = rest.join(_cells(at, level, "p"), _ids("p", "u")).join(_cells(ways, level, "v"), _ids("v", "u"))
    # size estimates do not see that a row is named once a level, so broadcasts would be chosen from them
    met = _at_levels(at.select("id", "lat", "lon", "fx", "fy", "fz"), levels, "p").drop("fx", "fy", "fz").hint("merge").join(done, ["level", *_ids("p")])
    named = ways.select("vertex", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), "fx", "fy", "fz")
    return met.join(_at_levels(named, levels, "v").hint("merge"), ["level", *_ids("v")]).select("id", "lat", "lon", "vertex", "v_lat", "v_lon")


def nearest(points: DataFrame, vertices: DataFrame, opened: int = OPEN) -> DataFrame:
    """Nearest vertex of every point with its surface distance (m), ties to the lower vertex: ``id, vertex, metres``."""
    ways = vertices.groupBy("lat", "lon").agg(F.min("id").alias("vertex"))
    at = points.groupBy("lat", "lon").agg(F.min("id").alias("id"))
    metres = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon"))
    found = nearest_candidates(at, ways, opened).withColumn("metres", metres)
    best = found.groupBy("lat", "lon").agg(F.min(F.struct("metres", "vertex")).alias("b"))
    best = best.select("lat", "lon", "b.vertex", "b.metres")
    return points.select("id", "lat", "lon").join(best, ["lat", "lon"]).select("id", "vertex", "metres")


def radius_parts(points: DataFrame, spots: DataFrame, radius_km: float, opened: int = OPEN) -> tuple[DataFrame, DataFrame]:
    """What lies within a radius of each point, as (id, sum) of whole cells and (id, lat, lon, v_lat, v_lon, v) pairs that
    still need their distance. `points` (id, lat, lon), `spots` (lat, lon, v)."""
    reach = geo.chord(radius_km * 1000.0, geo.EARTH_KM * 1000.0)
    level = max(1, min(LEVELS, math.floor(math.log2(2.0 / reach)))) if reach > 0 else LEVELS
    points, spots = _placed(points.select("id", "lat", "lon")), cut_lineage(_placed(spots))
    points = cut_lineage(points.withColumns({f"p_{n}{a}": F.col(a) for a in _AXES for n in "lh"}).drop(*_AXES))
    spot = ["id", *[f"p_{n}{a}" for a in _AXES for n in "lh"]]
    # a cell is at least as wide as the radius, so only the cells next to the point's own can hold something
    step = F.array(*[F.lit(k).cast("bigint") for k in (-1, 0, 1)])
    pairs = points.select(*spot, *[F.shiftright(f"f{a}", LEVELS - level).alias(f"_{a}") for a in _AXES])
    for a in _AXES:
        pairs = pairs.withColumn("_k", F.explode(step)).withColumn(f"v_c{a}", F.col(f"_{a}") + F.col("_k")).drop("_k", f"_{a}")
    # size estimates do not see that a point stands beside 27 cells or is told of many, so broadcasts would be chosen from them
    pairs = pairs.hint("merge").join(_cells(spots, level, "v", F.sum("v").alias("v_sum")), _ids("v"))
    whole, rims, levels = None, None, []
    while True:
        low, high = _bounds("p", "v")
        pairs = pairs.withColumns({"_low": low, "_high": high}).filter(F.col("_low") <= reach * (1 + _SLACK) + 1e-15)
        kind = F.when(F.col("_high") <= reach * (1 - _SLACK), "whole").when((F.col("v_n") <= opened) | F.lit(level == LEVELS), "rim").otherwise("split")
        state = cut_lineage(pairs.select(*spot, *_ids("v"), "v_sum", kind.alias("kind"), F.lit(level).alias("level")))
        inner = state.filter("kind = 'whole'").groupBy("id").agg(F.sum("v_sum").alias("sum"))
        rim = state.filter("kind = 'rim'").select("id", "level", *_ids("v"))
        whole, rims = (inner, rim) if whole is None else (whole.unionByName(inner), rims.unionByName(rim))
        levels.append(level)
        rest = state.filter("kind = 'split'")
        if level == LEVELS or rest.isEmpty():
            break
        level += 1
        rest = rest.select(*spot, *[F.col(c).alias(c.replace("_c", "_u")) for c in _ids("v")])
        pairs = rest.hint("merge").join(_cells(spots, level, "v", F.sum("v").alias("v_sum")), _ids("v", "u"))
    named = _at_levels(spots.select(F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), "v", "fx", "fy", "fz"), levels, "v")
    opened_pairs = rims.hint("merge").join(named, ["level", *_ids("v")]).hint("merge").join(points.select("id", "lat", "lon"), "id")
    return whole, opened_pairs.select("id", "lat", "lon", "v_lat", "v_lon", "v")


def radius_sum(points: DataFrame, pixels: DataFrame, radius_km: float, value: str, out: str) -> DataFrame:
    """Sum of pixel values whose centre is within the radius of each point; 0 where there is none."""
    spots = pixels.groupBy("lat", "lon").agg(F.sum(value).alias("v"))
    whole, pairs = radius_parts(points, spots, radius_km)
    close = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon")) <= radius_km
    total = whole.select("id", F.col("sum").alias("v")).unionByName(pairs.filter(close).select("id", "v")).groupBy("id").agg(F.sum("v").alias(out))
    return points.select("id").hint("merge").join(total, "id", "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
