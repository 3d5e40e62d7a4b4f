"""Training-matrix builds: background points, strata, susceptibility, trigger and fire tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.functions import grids
from terrasig.operators import climate, sampling, terrain
from terrasig.plans.joins import STRATA_SQL, strata
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables
from terrasig.plans.views import with_views
from terrasig.session import cut_lineage

BBOX = (-180.0, -60.0, 180.0, 60.0)
SEED = 17
#: Background rows for each positive.
BACKGROUND_RATIO = 5
#: Candidates for each positive: some fall into water or too near to an event.
OVERSAMPLE = 8
#: Cells of a domain that give fire strata.
MAX_CELLS = {"us": 320, "canada": 220}


def dem(t: Tables, points: DataFrame) -> DataFrame:
    """Elevation patch of each point's one-degree tile: an equi join of points with tiles."""
    n = t.read("embeddings").agg(F.count(F.lit(1))).scalar()
    key = F.pmod(grids.snap(F.col("lat"), 1.0) * 31 + grids.snap(F.col("lon"), 1.0), n)
    tiles = t.patch.select(F.col("id").alias("_tile"), "z")
    # size estimates do not see that an event gives several points, so the points would be broadcast from them
    return points.withColumn("_tile", key).hint("merge").join(tiles, "_tile").drop("_tile")


def terrain_of(t: Tables, points: DataFrame) -> DataFrame:
    return terrain.derive(dem(t, points), 8, 8).drop("z")


def positives(t: Tables) -> DataFrame:
    return sampling.dedupe_locations(t.point.select("id", "lat", "lon"), F.col("id"))


@query("bg_target_group")
def bg_target_group(t: Tables) -> DataFrame:
    return sampling.background_near(positives(t), OVERSAMPLE, BBOX, SEED, radius_m=12_000.0, min_m=500.0)


@query("bg_uniform")
def bg_uniform(t: Tables) -> DataFrame:
    pos = positives(t)
    return sampling.background_uniform(pos, pos.count() * OVERSAMPLE, BBOX, SEED, min_m=500.0)


def susceptibility(t: Tables) -> DataFrame:
    """Deduplicated positives and accessibility-matched background with terrain, on land, blocked and capped."""
    pos = cut_lineage(positives(t))
    bg = sampling.background_near(pos, OVERSAMPLE, BBOX, SEED, radius_m=12_000.0, min_m=500.0)
    points = pos.withColumn("label", F.lit(1)).unionByName(bg.drop("anchor").withColumn("label", F.lit(0)))
    rows = cut_lineage(terrain.on_land(terrain_of(t, points)))
    n_pos = pos.count()
    capped = sampling.cap_per_label(
        rows, "label", F.xxhash64(F.lit(SEED), "id"), {1: n_pos, 0: n_pos * BACKGROUND_RATIO}
    )
    return capped.withColumn("block_id", grids.block_id(F.col("lat"), F.col("lon"), 10.0))


@query("build_susceptibility")
def build_susceptibility(t: Tables) -> DataFrame:
    return susceptibility(t).select("id", "lat", "lon", "label", "block_id", *terrain.FEATURES)


def trigger(t: Tables, n_controls: int = 4) -> DataFrame:
    """Cases and season-matched controls with rain features, complete strata only."""
    ev = sampling.keys_with_at_least(t.event, ["cell"], 4)
    cases = ev.select(F.col("event_id").alias("stratum"), "cell", "d")
    rows = sampling.case_control_rows(cases, sampling.draw_controls(cases, t.event, 1996, 2001, n_controls, SEED))
    # size estimates see neither the controls of a case nor the days that fill a series: what is joined below would be broadcast from
    # them. A series has no gaps, so its ends say which rows have features, before any are derived
    ends = t.daily.groupBy("cell").agg(F.date_add(F.min("d"), climate.RAIN_SPINUP).alias("_from"), F.max("d").alias("_to"))
    known = rows.hint("merge").join(ends, "cell").filter(F.col("d").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    rows = cut_lineage(sampling.complete_strata(cut_lineage(known)))
    days = rows.groupBy("cell").agg(F.collect_set("d").alias("_days"))  # no more than the calendar has
    daily = t.daily.select("cell", "d", "precip").hint("merge").join(days, "cell")
    feats = climate.rain_features(daily, only=F.array_contains("_days", F.col("d")))
    return rows.select("stratum", "cell", "d", "label").hint("merge").join(feats, ["cell", "d"]).select("stratum", "cell", "d", "label", *feats.columns[2:], F.col("cell").cast("string").alias("wx_cell"))


@query("build_trigger")
def build_trigger(t: Tables) -> DataFrame:
    return trigger(t)


def fire_cells(dense: DataFrame, most: dict[str, int] = MAX_CELLS) -> DataFrame:
    """The cells of each domain, by hash where there are more than `most`."""
    domain = F.when(F.col("cell") % 2 == 0, "us").otherwise("canada")
    cells = dense.select("cell").distinct().withColumn("domain", domain)
    parts = [sampling.sample_k(cells.where(F.col("domain") == name), ["domain"], ["cell"], k, SEED) for name, k in most.items()]
    return reduce(DataFrame.unionByName, parts)


@query("build_fire_strata")
def build_fire_strata(t: Tables) -> DataFrame:
    """Dense cells only, at most `MAX_CELLS` of them by hash, four fires per cell, controls clear of any fire by 21 days."""
    dense = sampling.keys_with_at_least(t.event, ["cell"], 4)
    cells = fire_cells(dense)
    fires = dense.join(cells, "cell")
    cases = sampling.sample_k(fires, ["cell"], ["event_id"], 4, SEED).select(
        F.col("event_id").alias("stratum"), "cell", "d"
    )
    rows = sampling.case_control_rows(cases, sampling.draw_controls(cases, t.event, 1996, 2001, 4, SEED, exclusion_days=21))
    return rows.join(cells, "cell")


@query(
    "temporal_freeze",
    with_views(
        "event",
        """SELECT stratum, event_id, d, label FROM (SELECT *, MAX(label) OVER (PARTITION BY stratum) AS hi, MIN(label) OVER (PARTITION BY stratum) AS lo FROM (
             SELECT s.* FROM strata s JOIN (SELECT stratum, MIN(year(d)) AS cy FROM strata WHERE label = 1 GROUP BY 1) c ON c.stratum = s.stratum WHERE c.cy <= 1999 AND year(s.d) <= 1999))
           WHERE hi = 1 AND lo = 0""",
        STRATA_SQL,
    ),
)
def temporal_freeze(t: Tables) -> DataFrame:
    return sampling.temporal_freeze(strata(t), 1999).select("stratum", "event_id", "d", "label")
