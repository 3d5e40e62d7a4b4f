"""Spatial joins as equi joins on cubes of the unit sphere.

A surface radius is a chord s, and space is cut into cubes of edge 2s, which have neither poles nor a date line. Each cube is
split into 16x16x16 fine cells; an occupied cell is named to every cube that holds a point within s of it, so a point looks into
its own cube only. A fine cell wholly inside the radius needs no distance at all, one wholly outside is dropped, and only
cells on the rim are opened, so a crowded cell never meets every point near it row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.functions import geo, grids
from terrasig.session import cut_lineage

FINE = 8
#: Fine cells along a cube's edge, as a power of two.
CUBE_BITS = 4
SLACK = 1e-9
WINDOW_CELLS = 8
_CUBE = ("cx", "cy", "cz")
_CELL = ("fx", "fy", "fz")


def _with_cells(df: DataFrame, edge: float) -> DataFrame:
    """Unit-sphere coordinates and the fine and coarse cell of each row."""
    xyz = geo.unit_xyz(F.col("lat"), F.col("lon"))
    df = df.withColumns(dict(zip("xyz", xyz, strict=True)))
    df = df.withColumns({f: F.floor(F.col(a) / (edge / FINE)).cast("bigint") for f, a in zip(_CELL, "xyz", strict=True)})
    return df.withColumns({c: F.shiftright(f, CUBE_BITS) for c, f in zip(_CUBE, _CELL, strict=True)})


def _reach(points: DataFrame, cells: DataFrame, edge: float) -> DataFrame:
    """(point, occupied fine cell) with the nearest and farthest distance the cell allows."""
    # one cell more than the radius on either side covers the rounding of cell borders
    for c, f in zip(_CUBE, _CELL, strict=True):
        first, last = (F.shiftright(F.col(f) + k, CUBE_BITS) for k in (-FINE - 1, FINE + 1))
        cells = cells.withColumn(c, F.explode(F.sequence(first, last)))
    # size estimates do not see that rows multiply, so a broadcast would be chosen from them
    j = points.select("id", "lat", "lon", *"xyz", *_CUBE).join(cells.hint("merge"), list(_CUBE))
    size = edge / FINE
    lo2, hi2 = F.lit(0.0), F.lit(0.0)
    for f, a in zip(_CELL, "xyz", strict=True):
        low, high = F.col(f) * F.lit(size), (F.col(f) + 1) * F.lit(size)
        gap = F.greatest(F.lit(0.0), low - F.col(a), F.col(a) - high)
        far = F.greatest(F.abs(F.col(a) - low), F.abs(F.col(a) - high))
        lo2, hi2 = lo2 + gap * gap, hi2 + far * far
    return j.withColumns({"_min": F.sqrt(lo2), "_max": F.sqrt(hi2)})


def _occupied(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_n"), *aggs)


def without_neighbours(candidates: DataFrame, positives: DataFrame, key: str, min_m: float) -> DataFrame:
    """Candidates with no positive closer than ``min_m``, at any latitude."""
    edge = geo.chord(min_m) * (1 + SLACK)
    pos = _with_cells(positives.select("lat", "lon").distinct(), edge)
    pts = _with_cells(candidates.select(F.col(key).alias("id"), "lat", "lon"), edge)
    reach = _reach(pts, _occupied(pos), edge).filter(F.col("_min") <= edge)
    whole = F.col("_max") < edge * (1 - 2 * SLACK)
    sure = reach.filter(whole).select("id")
    rim = reach.filter(~whole).select("id", "lat", "lon", *_CELL).join(sure.distinct(), "id", "left_anti").alias("r")
    # a semi join stops at the first close positive, so a crowded cell emits one row per candidate and not all pairs
    p = pos.select(*_CELL, "lat", "lon").hint("merge").alias("p")
    same = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in _CELL]
    close = geo.haversine_m(F.col("r.lat"), F.col("r.lon"), F.col("p.lat"), F.col("p.lon")) < min_m
    hit = rim.join(p, [*same, close], "left_semi")
    out = sure.unionByName(hit.select("id")).distinct().withColumnRenamed("id", key)
    return candidates.join(out, key, "left_anti")


def zonal_sum(pixels: DataFrame, value: str) -> DataFrame:
    """Pixels summed onto the world grid by centre; pixels repeated beyond a full turn are counted once."""
    once = pixels.filter((F.col("lon") >= -180.0) & (F.col("lon") < 180.0))
    i, j = grids.world_cell(F.col("lat"), F.col("lon"))
    return once.groupBy(i.alias("world_i"), j.alias("world_j")).agg(F.sum(value).alias(value))


def density_windows(events: DataFrame, deg: float = 0.25, cells: int = WINDOW_CELLS) -> DataFrame:
    """Per populated anchor cell: events, distinct dates and occupied cells of the window to its north-east.

    Events are first reduced to cell counts and distinct (cell, date) pairs; those, not the events, are copied to the
    at most cells*cells anchors that see them.
    """
    i, j = grids.offset_cell(F.col("lat"), F.col("lon"), deg)
    keyed = events.select(i.alias("i"), j.alias("j"), "d")
    per_cell = keyed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    per_date = keyed.filter(F.col("d").isNotNull()).distinct()
    anchors = per_cell.select(F.col("i").alias("ai"), F.col("j").alias("aj"))

    def seen_from(df: DataFrame) -> DataFrame:
        back = F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))
        df = df.withColumn("_di", F.explode(back)).withColumn("_dj", F.explode(back))
        df = df.withColumns({"ai": F.col("i") - F.col("_di"), "aj": F.col("j") - F.col("_dj")}).drop("_di", "_dj")
        return df.join(anchors, ["ai", "aj"], "left_semi")

    counts = seen_from(per_cell).groupBy("ai", "aj").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("occupied"))
    dates = seen_from(per_date).groupBy("ai", "aj").agg(F.count_distinct("d").alias("dates"))
    return counts.join(dates, ["ai", "aj"], "left").withColumn("dates", F.coalesce("dates", F.lit(0)))


def pick_windows(scored: DataFrame, top: int, score: str, cells: int = WINDOW_CELLS) -> DataFrame:
    """Greedy non-overlapping windows: the best one, then the best that does not overlap it, and so on.

    Each round is one max over the remaining anchors; only the ``top`` picked anchors reach the driver.
    """
    picked: list[tuple] = []
    left = cut_lineage(scored)
    cols = [score, "events", "dates", "occupied", "ai", "aj"]
    for _ in range(top):
        row = left.agg(F.max(F.struct(*[F.col(c) for c in cols])).alias("b")).first()
        if row is None or row["b"] is None:
            break
        b = row["b"]
        picked.append((len(picked) + 1, b["ai"], b["aj"], b["events"], b["dates"], b["occupied"]))
        left = left.filter((F.abs(F.col("ai") - b["ai"]) >= cells) | (F.abs(F.col("aj") - b["aj"]) >= cells))
    schema = "rank int, ai bigint, aj bigint, events bigint, dates bigint, occupied bigint"
    return scored.sparkSession.createDataFrame(picked, schema)


def _boxes_by_tile(boxes: DataFrame, tile_deg: float) -> DataFrame:
    """Boxes of each tile that can be some point's first: the first one that holds the whole tile (`_whole`), and of the boxes
    that hold a part of it those with a lower name."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tile_deg), F.floor(hi / tile_deg)))
    tiled = boxes.filter(F.col("region").isNotNull()).withColumn("_ti", span(F.col("y0"), F.col("y1"))).withColumn("_tj", span(F.col("x0"), F.col("x1")))
    # a box that ends within rounding of the tile's border counts as a part, which is tested point by point
    holds = lambda k, lo, hi: (F.col(lo) < F.col(k) * tile_deg - SLACK) & (F.col(hi) > (F.col(k) + 1) * tile_deg + SLACK)
    tiled = tiled.withColumn("_whole", F.coalesce(holds("_ti", "y0", "y1") & holds("_tj", "x0", "x1"), F.lit(False)))
    first = tiled.filter("_whole").groupBy("_ti", "_tj").agg(F.min("region").alias("_first"))
    part = tiled.filter("not _whole").join(first, ["_ti", "_tj"], "left").filter(F.col("_first").isNull() | (F.col("region") < F.col("_first")))
    no = F.lit(None).cast("double")
    whole = first.select("_ti", "_tj", F.col("_first").alias("region"), *[no.alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit(True).alias("_whole"))
    return part.select(whole.columns).unionByName(whole)


def first_box(points: DataFrame, boxes: DataFrame, tile_deg: float = 10.0) -> DataFrame:
    """First region (by name) whose box holds the point, NULL for none.

    Boxes are cut into tiles, so the containment test meets only boxes of the point's own tile, and of those only the ones
    named before the first box that holds the whole tile.
    """
    keyed = points.select(
        "id", "lat", "lon", F.floor(F.col("lat") / tile_deg).alias("_ti"), F.floor(F.col("lon") / tile_deg).alias("_tj")
    )
    inside = keyed.join(_boxes_by_tile(boxes, tile_deg), ["_ti", "_tj"]).filter(
        F.col("_whole") | F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))
    )
    hit = inside.groupBy("id").agg(F.min("region").alias("region"))
    return points.select("id").join(hit, "id", "left")


def nearest_valid_cell(points: DataFrame, valid: DataFrame, reach: int = 2) -> DataFrame:
    """The point's own cell if valid, else the nearest valid one within +-reach; ties go to scan order."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    near = points.select("id", "i", "j").withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    near = near.select("id", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "di", "dj")
    d2 = F.col("di") * F.col("di") + F.col("dj") * F.col("dj")
    best = near.join(valid.select("i", "j"), ["i", "j"]).groupBy("id").agg(
        F.min_by(F.struct("i", "j", d2.alias("d2")), F.struct(d2, "di", "dj")).alias("_b")
    )
    joined = points.select("id", F.col("i").alias("_i"), F.col("j").alias("_j")).join(best, "id", "left")
    return joined.select(
        "id",
        F.coalesce("_b.i", "_i").alias("i"),
        F.coalesce("_b.j", "_j").alias("j"),
        F.coalesce(F.col("_b.d2") > 0, F.lit(False)).alias("snapped"),
    )


def ring_max(points: DataFrame, field: DataFrame, step: float, deg: float, value: str) -> DataFrame:
    """Own value and the maximum over the 3x3 ring of offsets, missing neighbours skipped."""
    offs = F.array(*[F.lit(k * step) for k in (-1, 0, 1)])
    ring = points.select("id", "lat", "lon").withColumn("_a", F.explode(offs)).withColumn("_b", F.explode(offs))
    ring = ring.select(
        "id",
        ((F.col("_a") == 0) & (F.col("_b") == 0)).alias("_own"),
        grids.snap(F.col("lat") + F.col("_a"), deg).alias("i"),
        grids.snap(F.col("lon") + F.col("_b"), deg).alias("j"),
    )
    return ring.join(field, ["i", "j"], "left").groupBy("id").agg(
        F.max(F.when(F.col("_own"), F.col(value))).alias("own"), F.max(value).alias("nearby_max")
    )


def node_representatives(sites: DataFrame, lat0: float, lon0: float, nlat: int, nlon: int, step: float) -> DataFrame:
    """Nearest site of each lattice node, if it is closer than half a step.

    Within half a step a site's only possible node is the one it rounds to, so no node-by-site product is formed.
    """
    gi, gj = F.rint((F.col("lat") - lat0) / step), F.rint((F.col("lon") - lon0) / step)
    d2 = F.pow(F.col("lat") - (F.lit(lat0) + gi * step), F.lit(2.0)) + F.pow(
        F.col("lon") - (F.lit(lon0) + gj * step), F.lit(2.0)
    )
    near = sites.select("id", gi.cast("int").alias("gi"), gj.cast("int").alias("gj"), d2.alias("d2")).filter(
        (F.col("d2") < (step / 2) ** 2) & F.col("gi").between(0, nlat - 1) & F.col("gj").between(0, nlon - 1)
    )
    return near.groupBy("gi", "gj").agg(F.min_by("id", F.struct("d2", "id")).alias("id"))
