"""Discharge: river mask, channel snapping, seasonal flow rank and the forecast outlook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.functions.dates import season_key
from terrasig.operators import series

MIN_RIVER_M3S = 5.0
REACH = 2
#: Season keys on either side of a lead's day that make its season, and the days it needs.
HALFWIDTH, MIN_DAYS = 15, 30


def cell_medians(flow: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median flow per grid cell and whether the cell is a river; a cell's record is bounded by the calendar."""
    return flow.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med")).withColumn(
        "is_river", F.col("med") >= MIN_RIVER_M3S
    )


def _nearby(points: DataFrame, medians: DataFrame, keep: Column) -> DataFrame:
    """Each point's grid cells within +-2: 25 keys per point and an equi join."""
    step = F.sequence(F.lit(-REACH), F.lit(REACH))
    keyed = points.withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    keyed = keyed.withColumns({"i": F.col("pi") + F.col("di"), "j": F.col("pj") + F.col("dj")})
    return keyed.join(medians.filter(keep), ["i", "j"])


def snap_channel(points: DataFrame, medians: DataFrame) -> DataFrame:
    """Largest-median river cell within +-2 cells of (pi, pj); ties go to scan order."""
    near = _nearby(points, medians, F.col("is_river"))
    best = near.groupBy("id").agg(
        F.min_by(F.struct("cell", "med"), F.struct(-F.col("med"), "di", "dj")).alias("_b")
    )
    return best.select("id", F.col("_b.cell").alias("channel"), F.col("_b.med").alias("med"))


def match_gauge(points: DataFrame, medians: DataFrame) -> DataFrame:
    """River cell whose log median is closest to the gauge's; cells under 1 m3/s are no candidates."""
    near = _nearby(points.filter(F.col("gauge_median").isNotNull()), medians, F.col("med") >= 1.0)
    err = F.round(F.abs(F.log10("med") - F.log10(F.greatest(F.lit(0.1), F.col("gauge_median")))), 9)
    best = near.withColumn("err", err).groupBy("id").agg(
        F.min_by(F.struct("cell", "err"), F.struct("err", "di", "dj")).alias("_b")
    )
    return best.select("id", F.col("_b.cell").alias("matched"), F.col("_b.err").alias("err"))


def flow_percentiles(flow: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Seasonal and all-time flow percentile and the seasonal median of every cell-day."""
    df = series.alltime_percentiles(flow, key, {value: "flow_pctl_alltime"})
    df = df.withColumn("_sk", season_key(F.col(date)))
    pools = series.season_pools(df, key, "_sk", [value])
    pool = F.col(f"pool_{value}")
    n = F.size(pool)
    lower, upper = F.element_at(pool, F.floor((n + 2) / 2).cast("int")), F.element_at(pool, F.floor((n + 1) / 2).cast("int"))
    ranked = df.join(pools.filter(n > 0), [key, "_sk"])
    return ranked.select(
        key,
        date,
        value,
        series.rank_in_pool_member(pool, F.col(value)).alias("flow_pctl_seasonal"),
        "flow_pctl_alltime",
        ((lower + upper) / 2.0).alias("median_here"),
    )


def flow_rank(flow: DataFrame, key: str, date: str, value: str, only: Column | None = None) -> DataFrame:
    """Seasonal flow percentile alone: (key, date, flood_pctl)."""
    return series.seasonal_percentiles(flow, key, date, {value: "flood_pctl"}, only=only).drop(value)


def forecast_outlook(forecast: DataFrame, flow: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Rank each lead in the season of its own validity date; first lead and week maximum (earliest wins ties). A key's leads
    meet only the days of its record that are near one of them, and are ranked by counting."""
    leads = forecast.withColumn("valid", F.date_add("init", F.floor(F.col("lead_h") / 24).cast("int"))).withColumn(
        "_sk", season_key(F.col("valid"))
    )
    asked = leads.groupBy(key).agg(
        F.collect_list(F.struct("init", "lead_h", "valid", F.col(value).alias("value"), "_sk")).alias("_leads"),
        (F.min("_sk") - HALFWIDTH).alias("_from"),
        (F.max("_sk") + HALFWIDTH).alias("_to"),
    )
    days = flow.select(key, season_key(F.col(date)).alias("_day"), F.col(value).alias("_v"))
    near = days.join(asked, key).filter(F.col("_day").between(F.col("_from"), F.col("_to")))
    met = near.select(key, "_day", "_v", F.posexplode("_leads").alias("_i", "_l")).filter(F.abs(F.col("_day") - F.col("_l._sk")) <= HALFWIDTH)
    counted = met.groupBy(key, "_i").agg(
        F.first("_l").alias("_l"),
        F.count("_v").alias("_n"),
        F.count_if(F.col("_v") > F.col("_l.value")).alias("_above"),
        F.count_if(F.col("_day") == F.col("_l._sk")).alias("_same"),
    )
    known = (F.col("_same") > 0) & (F.col("_n") >= MIN_DAYS) & F.col("_l.value").isNotNull()
    share = (F.col("_n") - F.col("_above")).cast("double") / F.col("_n")
    ranked = counted.filter(known).select(key, "_l.init", "_l.lead_h", "_l.valid", F.col("_l.value").alias(value), share.alias("pctl"))
    out = ranked.groupBy(key, "init").agg(
        F.min_by(F.struct("valid", value, "pctl"), "lead_h").alias("_t"),
        F.min_by(F.struct("valid", "pctl"), F.struct(-F.col("pctl"), "lead_h")).alias("_w"),
    )
    return out.select(
        key,
        "init",
        F.col("_t.valid").alias("today_valid"),
        F.col(f"_t.{value}").alias(f"today_{value}"),
        F.col("_t.pctl").alias("today_pctl"),
        F.col("_w.pctl").alias("week_max_pctl"),
        F.col("_w.valid").alias("week_max_valid"),
    )



