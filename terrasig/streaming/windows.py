"""Windowed totals that read the same on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, keys: list[str], value: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    w = F.window(ts, every)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def sliding(df: DataFrame, ts: str, keys: list[str], value: str, width: str, step: str, late: str = "2 days") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def sliding_of_days(df: DataFrame, ts: str, keys: list[str], value: str, days: int, late: str = "2 days") -> DataFrame:
    """Trailing totals of so many days, a window for every day: rows become days first, so that a day and not each row enters
    the windows. Both steps are states of one stream."""
    day = tumbling(df, ts, keys, value, "1 day", late)
    w = F.window(F.window_time("w"), f"{days} days", "1 day")
    return day.groupBy(w.alias("long"), *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumnRenamed("long", "w")


def sessions(df: DataFrame, ts: str, keys: list[str], value: str, gap: str, late: str = "2 days") -> DataFrame:
    """Runs of rows no further apart than the gap."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def window_start(c: str = "w") -> Column:
    return F.to_date(F.col(f"{c}.start"))
