"""Source agreement, history/tail merging and trailing-gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.functions.numbers import clip

RECENT_DAYS = 120
MIN_MONTHS = 48
FILL_AFTER_DAYS = 5
MIN_OVERLAP_DAYS = 120
# Fixed correction per field: mode, limits of the correction, clamp of the corrected value.
CORRECTIONS = {
    "precip": ("ratio", (0.25, 4.0), None),
    "tmax": ("offset", (-10.0, 10.0), None),
    "rh": ("offset", (-10.0, 10.0), (1.0, 100.0)),
    "ws": ("ratio", (0.05, 4.0), None),
}


def monthly_totals(df: DataFrame, key: str, date: str, value: str, out: str) -> DataFrame:
    return df.groupBy(key, F.trunc(date, "month").alias("m")).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(out))


def agreement(a: DataFrame, b: DataFrame, key: str, lo: Column, hi: Column) -> DataFrame:
    """Months shared by two sources: Pearson correlation (0 without variance) and the ratio of totals."""
    both = a.join(b, [key, "m"]).filter(F.col("m").between(lo, hi))
    varied = (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    return both.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.when(varied, F.corr("a", "b")).otherwise(F.lit(0.0)).alias("corr_monthly"),
        (F.sum("a") / F.nullif(F.sum("b"), F.lit(0.0))).alias("ratio"),
    )


def recent_total(df: DataFrame, key: str, date: str, value: str, end: Column, out: str) -> DataFrame:
    """Total of the trailing window that ends on ``end``, missing as 0."""
    recent = df.filter(F.col(date) > F.date_sub(end, RECENT_DAYS))
    return recent.groupBy(key).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(out))


def verdicts(agree: DataFrame, recent: DataFrame, key: str) -> DataFrame:
    """Long-run, recent-window and combined verdict with reasons.

    The combined verdict tolerates a constant ratio, because percentiles do: it asks for the pattern, a sane ratio and a
    recent ratio close to the pair's own baseline. A cell that only one side knows is unverified.
    """
    a, b = F.coalesce("a_mm", F.lit(0.0)), F.coalesce("b_mm", F.lit(0.0))
    wet_enough = F.greatest(a, b) >= 30.0
    ratio_now = (a + 1.0) / (b + 1.0)
    df = agree.join(recent, key, "full_outer").withColumns(
        {
            "recent_ratio": F.when(wet_enough, ratio_now),
            "recent": F.when(~wet_enough | ratio_now.between(0.4, 2.5), "ok").otherwise("disagree"),
            "longrun": F.when((F.coalesce("n_months", F.lit(0)) < MIN_MONTHS) | F.col("ratio").isNull(), "unverified")
            .when((F.col("corr_monthly") >= 0.60) & F.col("ratio").between(0.6, 1.6), "ok")
            .otherwise("disagree"),
        }
    )
    drift = F.abs(F.log(F.col("recent_ratio") / F.col("ratio"))) > F.log(F.lit(2.2))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("corr_monthly") < 0.60, "pattern"),
            F.when(~F.col("ratio").between(0.25, 4.0), "long-run ratio"),
            F.when(drift, "recent drift"),
        )
    )
    unproven = F.col("longrun") == "unverified"
    return df.withColumns(
        {
            "reasons": F.when(unproven, "longrun unverified").otherwise(F.concat_ws("; ", reasons)),
            "verdict": F.when(unproven, "unverified").when(F.size(reasons) > 0, "disagree").otherwise("ok"),
        }
    )


def merge_tail(history: DataFrame, tail: DataFrame, cut: Column, key: str = "cell", date: str = "d") -> DataFrame:
    """All tail days, and those of the history before the cut that the tail lacks; a tail day wins whole, with its nulls.

    The two are stacked and folded per day, so both are read once and combine before the exchange.
    """
    values = [c for c in history.columns if c not in (key, date)]
    stacked = history.filter(F.col(date) < cut).withColumn("_tail", F.lit(0)).unionByName(tail.withColumn("_tail", F.lit(1)))
    return stacked.groupBy(key, date).agg(*[F.max_by(c, "_tail").alias(c) for c in values]).select(*history.columns)


def fill_trailing_gap(
    primary: DataFrame,
    other: DataFrame,
    key: str,
    date: str,
    value: str,
    other_value: str,
    as_of: Column,
    mode: str = "ratio",
    limits: tuple[float, float] = (0.25, 4.0),
    clamp: tuple[float, float] | None = None,
) -> DataFrame:
    """Bridge one field's trailing gap; see ``fill_trailing_gaps``."""
    return fill_trailing_gaps(primary, other, key, date, {value: (other_value, mode, limits, clamp)}, as_of)


def fill_trailing_gaps(
    primary: DataFrame, other: DataFrame, key: str, date: str, fields: dict[str, tuple], as_of: Column
) -> DataFrame:
    """Bridge only the days after each field's last value from a bias-corrected second source.

    ``fields`` maps a primary column to (other column, "ratio" or "offset", correction limits, value clamp or None).
    Gaps inside the record stay gaps: filling them would move the climatology every percentile is taken against. The two
    sources meet in one outer join and all corrections come from one pass over it.
    """
    both = primary.withColumn("_had", F.lit(True)).join(other, [key, date], "full_outer")
    some = F.col("_had")
    for value in fields:
        some = some | F.col(value).isNotNull()
    return bridge(both, key, date, fields, as_of).filter(some).select(key, date, *fields)


def bridge(both: DataFrame, key: str, date: str, fields: dict[str, tuple], as_of: Column) -> DataFrame:
    """`fill_trailing_gaps` of two sources that stand side by side, one row per day. A key's record is read in order of date, so
    a run that is repeated gives the same corrections."""
    whole = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    aggs = {}
    for i, (value, (source, mode, limits, _)) in enumerate(fields.items()):
        shared = F.col(value).isNotNull() & F.col(source).isNotNull()
        p, e = F.when(shared, F.col(value)), F.when(shared, F.col(source))
        if mode == "ratio":
            corr = (F.coalesce(F.sum(p).over(whole), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum(e).over(whole), F.lit(0.0)) + 1.0)
        else:
            corr = F.avg(p - e).over(whole)
        aggs |= {
            f"_last{i}": F.max(F.when(F.col(value).isNotNull(), F.col(date))).over(whole),
            f"_overlap{i}": F.count(p).over(whole),
            f"_corr{i}": F.least(F.lit(limits[1]), F.greatest(F.lit(limits[0]), corr)),
        }
    df = both.withColumns(aggs)
    filled = {}
    for i, (value, (source, mode, _, clamp)) in enumerate(fields.items()):
        fixed = F.col(source) * F.col(f"_corr{i}") if mode == "ratio" else F.col(source) + F.col(f"_corr{i}")
        if clamp:
            fixed = clip(fixed, *clamp)
        due = (
            (F.col(date) > F.col(f"_last{i}"))
            & (F.col(f"_overlap{i}") >= MIN_OVERLAP_DAYS)
            & (F.datediff(as_of, F.col(f"_last{i}")) > FILL_AFTER_DAYS)
        )
        filled[value] = F.coalesce(F.col(value), F.when(due, F.round(fixed, 3)))
    return df.withColumns(filled).drop(*aggs)
