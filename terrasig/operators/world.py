"""World fields: percentile columns, alert masks, exposure and the parity with the point path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.functions.dates import FORTNIGHTS, fortnight
from terrasig.operators import climate

POPULATED = 1000.0
WINDOW_DAYS = 400
PARITY_BAR = 0.10


def wide(ranks: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(signal, cell, d, pctl) to one row per cell-day. The signal list is fixed, so no pivot pass is needed."""
    pick = lambda s: F.max(F.when(F.col("signal") == s, F.col("pctl"))).alias(s)
    return ranks.filter(F.col("signal").isin(*signals)).groupBy("cell", "d").agg(*[pick(s) for s in signals])


def alerts(fields: DataFrame) -> DataFrame:
    """Masks of the world product; a comparison with a missing percentile is false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return fields.withColumns(
        {
            "landslide_rain": yes(F.col("rain3d") >= 0.98) | yes(F.col("rain30d") >= 0.98),
            "fire": yes((F.col("vpd") >= 0.95) & (F.col("kbdi") >= 0.90)),
            "drought": yes(F.col("spi90") <= 0.05),
        }
    )


def exposure(masks: DataFrame, people: DataFrame) -> DataFrame:
    """Flagged cells, people in them and the most extreme flagged cell, populated cells first, per day and alert."""
    rows = masks.select(
        "cell",
        "d",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("alert"), F.col(a).alias("flag"), x.alias("extreme"))
                    for a, x in (("landslide_rain", F.col("rain3d")), ("fire", F.col("vpd")), ("drought", -F.col("spi90")))
                ]
            )
        ),
    ).join(people, "cell")
    order = F.struct(F.round("extreme", 9), -F.col("cell"))
    top = lambda cond: F.max_by(F.when(cond, F.col("cell")), F.when(cond, order))
    return rows.groupBy("d", "alert").agg(
        F.count_if("flag").alias("cells"),
        F.round(F.sum(F.when(F.col("flag"), F.col("people")).otherwise(0.0))).cast("bigint").alias("people"),
        F.coalesce(top(F.col("flag") & (F.col("people") > POPULATED)), top(F.col("flag"))).alias("extreme_cell"),
    )


def parity(ranks: DataFrame, point: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Mean absolute difference between the ladder path and the sliding-season path, against the 0.10 bar. Both hold a
    cell-day in one row, so signals are only told apart after the join."""
    pair = lambda s: F.struct(F.lit(s).alias("signal"), F.abs(F.col(f"_r_{s}") - F.col(s)).alias("diff"))
    ranks = ranks.select("cell", "d", *[F.col(s).alias(f"_r_{s}") for s in signals])
    both = point.join(ranks, ["cell", "d"]).select(F.inline(F.array(*[pair(s) for s in signals]))).filter(F.col("diff").isNotNull())
    return both.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("diff").alias("mean_abs_diff"),
        (F.avg("diff") <= PARITY_BAR).alias("pass"),
    )


def seeds(ladder: DataFrame, scoring_fortnight: Column, window_days: int) -> DataFrame:
    """Starting deficiency and climatological annual rain per cell, read from the ladder: ``cell, q0, r_annual``.

    A short window that started saturated would never dry to a desert's equilibrium, and rain measured inside the window
    would bake that year's anomaly into the drying rate. Both come from the cell's own record instead: the median
    deficiency of the window's first fortnight, and the mean over the fortnights of the median yearly total.
    """
    median = F.element_at("q", 11)
    start = F.pmod(scoring_fortnight - F.lit(window_days // 14), F.lit(FORTNIGHTS))
    return ladder.filter(F.col("signal").isin("kbdi", "spi365")).groupBy("cell").agg(
        F.max(F.when((F.col("signal") == "kbdi") & (F.col("fortnight") == start), median)).alias("q0"),
        F.avg(F.when(F.col("signal") == "spi365", median)).alias("r_annual"),
    )


def read_by_window(date: Column, day: Column, days: int = WINDOW_DAYS) -> dict[str, Column]:
    """The days whose fortnights `score_window` reads in the ladder, by signal: that of the day, and what `seeds` reads (the first
    of the window for `kbdi`, every one for `spi365`)."""
    here = fortnight(date)
    start = F.pmod(fortnight(day) - F.lit((days + 1) // 14), F.lit(FORTNIGHTS))
    asked = {s: here == fortnight(day) for s in climate.LADDER_SIGNALS if s != "spi365"}
    return asked | {"kbdi": (here == fortnight(day)) | (here == start)}


def score_window(daily: DataFrame, ladder: DataFrame, day: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Percentile fields of one day from a trailing window and the stored ladder alone.

    The filter on the date reaches the scan, so a nightly run reads ``days`` days and not the archive.
    """
    window = daily.filter(F.col("d").between(F.date_sub(day, days), day))
    seeded = window.join(seeds(ladder, fortnight(day), days + 1), "cell")
    signals = climate.world_signals(seeded, q0="q0", r_annual="r_annual").filter(F.col("d") == day)
    long = signals.unpivot(["cell", "d"], list(climate.LADDER_SIGNALS), "signal", "v").filter(F.col("v").isNotNull())
    ranked = long.withColumn("fortnight", fortnight(F.col("d"))).join(ladder, ["signal", "cell", "fortnight"])
    return ranked.select("signal", "cell", "d", climate.ladder_rank(F.col("v"), F.col("q")).alias("pctl"))
