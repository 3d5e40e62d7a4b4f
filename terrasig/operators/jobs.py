"""End-to-end jobs: each is one DataFrame over all locations, ready for a partitioned write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.operators import quality, series, serving
from terrasig.session import cut_lineage
from terrasig.sources import sinks


def nightly_update(
    places: DataFrame,
    history: DataFrame,
    tail: DataFrame,
    backup: DataFrame | None,
    flow: DataFrame,
    trust: DataFrame,
    cut: Column,
    as_of: Column,
    fire: DataFrame | None = None,
    outlook: DataFrame | None = None,
    fire_threshold: float = 0.98,
    watch_threshold: float = 0.95,
) -> DataFrame:
    """Merge, fill, rank, compose: the published row of every location.

    ``history`` and ``tail`` (cell, d, precip) split at ``cut``; ``backup`` (cell, d, other) bridges a stalled tail and
    carries the calendar, and where it is None the history's own record, which goes on behind the cut, is read once for both; ``flow`` (cell, d, m3s) is ranked on each location's own as-of day; ``trust`` (cell, data_quality). ``as_of`` is the run date,
    so a re-run gives the same table. ``fire`` (cell, fire_date, fire_danger) adds the fire branch; an alert needs trusted
    sources and a reading at most a week old. ``outlook`` (cell, week_max_pctl, week_max_valid) adds the river's week ahead.
    """
    filled = fill(history, tail, backup, cut, as_of)
    record = Window.partitionBy("cell").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = filled.withColumn("_last", F.max(F.when(F.col("precip").isNotNull(), F.col("d"))).over(record))
    df = series.rolling_sums(filled, "cell", "d", "precip", (3, 30, 90, 365), "p")
    df = df.withColumns({c: F.round(c, 6) for c in ("p3d", "p30d", "p90d", "p365d")})
    df = df.withColumn("_fresh", F.col("d") == F.col("_last")).drop("_last")
    df = series.asked_percentiles(
        df,
        "cell",
        "d",
        {"p3d": "rain3d_pctl", "p30d": "rain30d_pctl", "p90d": "spi90", "p365d": "spi365"},
        only=F.col("_fresh"),
    )
    # one row a location: its last day with rain
    df = cut_lineage(df)
    on_day = flow.join(df.select("cell", F.col("d").alias("last_valid")), "cell")
    ranked = series.asked_percentiles(on_day, "cell", "d", {"m3s": "flood_pctl"}, only=F.col("d") == F.col("last_valid")).select("cell", "d", "flood_pctl")
    state = (
        df.withColumn("staleness_days", F.datediff(as_of, F.col("d")))
        .join(ranked, ["cell", "d"], "left")
        .join(trust, "cell", "left")
        .join(places, "cell", "left")
        .withColumn("staleness_days", F.col("staleness_days").cast("bigint"))
    )
    if fire is not None:
        fresh = F.datediff(as_of, F.col("fire_date")) <= serving.STALE_AFTER_DAYS
        trusted = ~serving.yes(F.col("data_quality") == "disagree")
        state = state.join(fire, "cell", "left").withColumns(
            {
                "fire_alert": serving.yes((F.col("fire_danger") >= fire_threshold) & fresh) & trusted,
                "fire_watch": serving.yes(F.col("fire_danger") >= watch_threshold),
            }
        )
    if outlook is not None:
        ahead = outlook.select("cell", F.col("week_max_pctl").alias("flood_week_max_pctl"), F.col("week_max_valid").alias("flood_week_max_date"))
        state = state.join(ahead, "cell", "left")
    for name, kind in (
        ("fire_alert", "boolean"),
        ("fire_watch", "boolean"),
        ("fire_danger", "double"),
        ("flood_week_max_pctl", "double"),
        ("flood_week_max_date", "date"),
    ):
        if name not in state.columns:
            state = state.withColumn(name, F.lit(None).cast(kind))
    return serving.compose_status(state).withColumnsRenamed({"cell": "location_id", "d": "as_of"})


def fill(history: DataFrame, tail: DataFrame, backup: DataFrame | None, cut: Column, as_of: Column) -> DataFrame:
    """Merged series (`quality.merge_tail`) with its trailing gap bridged, on all days that the merged series or the backup has.

    They are stacked and folded per day behind one exchange by cell, which the ranks then share.
    """
    day = lambda df, precip, other, rank: df.select("cell", "d", precip.cast("double").alias("precip"), other.cast("double").alias("other"), rank.cast("int").alias("_tail"))
    none, before = F.lit(None), F.col("d") < cut
    if backup is None:  # a day whose _tail is missing gives no value to the merged series
        known = day(history, F.when(before, F.col("precip")), F.col("precip"), F.when(before, F.lit(0)))
    else:
        known = day(history.filter(before), F.col("precip"), none, F.lit(0)).unionByName(day(backup, none, F.col("other"), none))
    stacked = known.unionByName(day(tail, F.col("precip"), none, F.lit(1)))
    both = stacked.repartition("cell").groupBy("cell", "d").agg(F.max_by("precip", "_tail").alias("precip"), F.max("other").alias("other"))
    return quality.bridge(both, "cell", "d", {"precip": ("other", "ratio", (0.25, 4.0), None)}, as_of).drop("other")


def publish(rows: DataFrame, old_history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three published tables: JSON records, the one-fetch index and the upserted history."""
    records = serving.location_record(rows)
    index = rows.select("location_id", "status", "message", "as_of", "staleness_days")
    day = rows.select(*old_history.columns)
    return records, index, sinks.upsert_history(old_history, day)
