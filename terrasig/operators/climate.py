"""Rain, drought and fire feature sets, the drought-index recursion and the quantile ladder."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.functions.dates import fortnight
from terrasig.functions.numbers import clip
from terrasig.operators import series

RAIN_WINDOWS = (1, 3, 7, 14, 30)
SPI_WINDOWS = (30, 90, 180, 365)
RAIN_SPINUP = 30
YEAR_SPINUP = 365
LADDER_RUNGS = 21
LADDER_SIGNALS = ("rain3d", "rain30d", "spi90", "spi180", "spi365", "kbdi", "vpd", "tmax", "ws")
WET_DAY_MM = 2.5


def vpd_kpa(tmax: Column, rh: Column) -> Column:
    """Vapour-pressure deficit from the day's maximum temperature; humidity is clipped to 0-100."""
    es = F.lit(0.6108) * F.exp(F.lit(17.27) * tmax / (tmax + F.lit(237.3)))
    return es * (F.lit(1.0) - clip(rh, 0.0, 100.0) / F.lit(100.0))


def rain_features(daily: DataFrame, key: str = "cell", date: str = "d", value: str = "precip", only: Column | None = None) -> DataFrame:
    """Sixteen rain features per cell-day; rows inside the 30-day spin-up are dropped. ``only`` names the rows to rank and return;
    the record they are ranked in holds every row."""
    spun_up, flag = F.col("rn") > RAIN_SPINUP, [] if only is None else [only.alias("_only")]
    df = series.rolling_sums(daily.select(key, date, value, *flag), key, date, value, RAIN_WINDOWS, "precip_")
    df = series.with_position(df, key, date)
    totals = [f"precip_{w}d" for w in RAIN_WINDOWS]
    df = df.withColumn("_mean30", F.avg("precip_30d").over(Window.partitionBy(key)))
    over = F.when(F.col("_mean30") > 0, F.col("precip_30d") / F.col("_mean30"))
    df = series.seasonal_percentiles(
        df.withColumn("_over", over),
        key,
        date,
        {t: f"{t}_pctl_seasonal" for t in totals},
        only=spun_up if only is None else spun_up & F.col("_only"),
        alltime={t: f"{t}_pctl" for t in totals},
        drop=["_mean30", "rn", value, "_only"],
    )
    return df.withColumn("precip_30d_over_climo_mean", F.col("_over")).drop("_over")


def spi_features(daily: DataFrame, key: str = "cell", date: str = "d", value: str = "precip", every: int = 1) -> DataFrame:
    """Empirical SPI for four windows plus the eight-week trend; every feature must exist. ``every`` n: only each n-th day."""
    df = series.rolling_sums(daily.select(key, date, value), key, date, value, SPI_WINDOWS, "_tot")
    df = series.with_position(df, key, date)
    df = series.seasonal_percentiles(
        df,
        key,
        date,
        {f"_tot{w}d": f"spi{w}" for w in SPI_WINDOWS},
        only=(F.col("rn") > YEAR_SPINUP) & (F.col("rn") % every == 0),
        change={"spi90_trend_8w": ("spi90", 56)},
        drop=[value, "rn", *[f"_tot{w}d" for w in SPI_WINDOWS]],
    )
    names = [f"spi{w}" for w in SPI_WINDOWS] + ["spi90_trend_8w"]
    complete = F.col(names[0]).isNotNull()
    for n in names[1:]:
        complete = complete & F.col(n).isNotNull()
    return df.filter(complete).select(key, date, *names)


def kbdi_fold(
    tmax_c: np.ndarray, rain_mm: np.ndarray, q0: float = 0.0, r_annual_mm: float | None = None, spell0: float = 0.0
) -> tuple[np.ndarray, float]:
    """Daily moisture deficiency (0-800) of one cell and the wet-spell total it ends with.

    Only the day-to-day recursion is a loop; temperatures, rain and the drying term are vectorised. Without
    ``r_annual_mm`` the annual rain comes from the series itself, which is right only for series of years.
    """
    t_f = np.where(np.isnan(tmax_c), 15.0, tmax_c) * 9.0 / 5.0 + 32.0
    inches = np.nan_to_num(rain_mm, nan=0.0) / 25.4
    if r_annual_mm is None:
        annual = float(inches.sum()) / max(1.0, len(inches) / 365.25)
    else:
        annual = r_annual_mm / 25.4
    denom = 1.0 + 10.88 * math.exp(-0.0441 * annual)
    rate = np.where(t_f > 50.0, np.maximum(0.0, 0.968 * np.exp(0.0486 * t_f) - 8.30) * 1e-3 / denom, 0.0)
    before = spell0
    q = q0
    out = np.empty(len(inches))
    for i, (r, k) in enumerate(zip(inches.tolist(), rate.tolist(), strict=True)):
        if r > 0.0:
            spell = before + r
            wetting = r if before >= 0.20 else max(0.0, spell - 0.20)
            q = max(0.0, q - wetting * 100.0)
            before = spell
        else:
            before = 0.0
        q = min(800.0, q + (800.0 - q) * k)
        out[i] = q
    return out, before


def kbdi(
    daily: DataFrame,
    key: str = "cell",
    date: str = "d",
    q0: str | None = None,
    r_annual: str | None = None,
    keep: Sequence[str] = (),
    only: Column | None = None,
) -> DataFrame:
    """KBDI per cell-day. The recursion is sequential inside a cell and parallel over cells.

    ``q0`` and ``r_annual`` name columns holding the cell's starting deficiency and climatological annual rain (mm);
    a window shorter than a year needs both. ``keep`` passes columns through, which is cheaper than joining the result
    back; ``only`` names the rows to return of the whole recursion. A cell's group is bounded by its calendar.
    """
    types, some = dict(daily.dtypes), only is not None
    out = [key, date, *keep]
    need = [c for c in ("tmax", "precip", q0, r_annual) if c and c not in out]
    schema = ", ".join([*[f"{c} {types[c]}" for c in out], "kbdi double"])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(date)
        numbers = lambda c: rows.column(c).to_numpy().astype("float64")
        start = float(np.nan_to_num(numbers(q0)[0])) if q0 else 0.0
        annual = float(np.nan_to_num(numbers(r_annual)[0])) if r_annual else None
        values, _ = kbdi_fold(numbers("tmax"), numbers("precip"), start, annual)
        # stored to 1e-6: days that are equal up to float noise must tie when they are ranked
        done = rows.select(out).append_column("kbdi", pa.array(np.round(values, 6)))
        return done.filter(rows.column("_only")) if some else done

    asked = [F.coalesce(only, F.lit(False)).alias("_only")] if some else []
    return daily.select(*out, *need, *asked).groupBy(key).applyInArrow(run, schema)


def fire_base(daily: DataFrame, key: str = "cell", date: str = "d") -> DataFrame:
    """Fire-weather raw values: KBDI, VPD, days since rain and the two antecedent totals."""
    df = kbdi(daily, key, date, keep=("tmax", "precip", "rh", "ws"))
    df = df.withColumn("vpd", vpd_kpa(F.col("tmax"), F.col("rh")))
    df = series.days_since(df, key, date, F.col("precip") >= WET_DAY_MM, "days_since_rain")
    return series.rolling_sums(df, key, date, "precip", (30, 90), "precip_")


def fire_features(daily: DataFrame, key: str = "cell", date: str = "d", freshest: bool = False, only: Column | None = None) -> DataFrame:
    """Fourteen fire features; a missing value scores percentile 0, rows in the spin-up year are dropped.

    ``freshest`` ranks only the last day with a temperature of each key, which is what a nightly run needs; ``only`` names the
    rows to rank and return.
    """
    df = series.with_position(fire_base(daily, key, date), key, date)
    if freshest:
        last = F.max(F.when(F.col("tmax").isNotNull(), F.col(date))).over(Window.partitionBy(key))
        df = df.withColumn("_fresh", F.col(date) == last)
        only = F.col("_fresh")
    seasonal = {
        "kbdi": "kbdi_pctl_seasonal",
        "vpd": "vpd_pctl_seasonal",
        "tmax": "tmax_pctl_seasonal",
        "rh": "rh_pctl_seasonal",
        "ws": "ws_pctl_seasonal",
        "precip_30d": "precip_30d_pctl_seasonal",
        "precip_90d": "precip_90d_pctl_seasonal",
    }
    spun_up = F.col("rn") > YEAR_SPINUP
    if only is None:
        df = series.seasonal_percentiles(
            df, key, date, seasonal, missing_as=0.0, only=spun_up, alltime={"kbdi": "kbdi_pctl"}, drop=["rn", "precip", "precip_30d", "precip_90d"]
        )
    else:
        df = series.alltime_percentiles(df, key, {"kbdi": "kbdi_pctl"}, missing_as=0.0)
        df = series.pooled_percentiles(df, key, date, seasonal, missing_as=0.0, only=only).filter(spun_up)
    return df.select(
        key,
        date,
        "kbdi",
        "kbdi_pctl",
        "kbdi_pctl_seasonal",
        F.col("vpd").alias("vpd_kpa"),
        "vpd_pctl_seasonal",
        F.col("tmax").alias("tmax_c"),
        "tmax_pctl_seasonal",
        F.col("rh").alias("rh_pct"),
        "rh_pctl_seasonal",
        F.col("ws").alias("ws_ms"),
        "ws_pctl_seasonal",
        "days_since_rain",
        "precip_30d_pctl_seasonal",
        "precip_90d_pctl_seasonal",
    )


def fire_percentiles(daily: DataFrame, only: Column, season: Column, key: str = "cell", date: str = "d") -> DataFrame:
    """(key, date, kbdi_pctl, vpd_pctl, tmax_pctl): season percentiles of the days named by ``only``, as `fire_features` has them.
    ``season`` names the rows that their pools may hold; no other row leaves the recursion."""
    df = series.with_position(daily, key, date).withColumn("vpd", vpd_kpa(F.col("tmax"), F.col("rh")))
    df = kbdi(df, key, date, keep=("rn", "tmax", "vpd"), only=season)
    names = ("kbdi", "vpd", "tmax")
    return series.seasonal_percentiles(
        df, key, date, {n: f"{n}_pctl" for n in names}, missing_as=0.0, only=only & (F.col("rn") > YEAR_SPINUP), drop=["rn", *names]
    )


def vpd_reading(daily: DataFrame, key: str = "cell", date: str = "d") -> DataFrame:
    """(key, date, vpd_pctl_seasonal) of each key's last day with a temperature, as `fire_features` has it; none in the spin-up
    year. The drought index and the other signals are not derived for it."""
    df = series.with_position(daily.select(key, date, "tmax", vpd_kpa(F.col("tmax"), F.col("rh")).alias("vpd")), key, date)
    last = F.max(F.when(F.col("tmax").isNotNull(), F.col(date))).over(Window.partitionBy(key))
    df = df.withColumn("_last", last)
    ranked = series.asked_percentiles(df, key, date, {"vpd": "vpd_pctl_seasonal"}, F.col(date) == F.col("_last"), missing_as=0.0)
    return ranked.filter(F.col("rn") > YEAR_SPINUP).select(key, date, "vpd_pctl_seasonal")


def world_signals(
    daily: DataFrame, key: str = "cell", date: str = "d", names: Sequence[str] = LADDER_SIGNALS, only: Column | None = None, **kbdi_options: str
) -> DataFrame:
    """The climatology signals per cell-day, wide; ``only`` names the rows to return.

    The drought index comes last: totals stand on the exchange of the series, and what is returned is all that is dealt anew.
    """
    df = daily.withColumn("vpd", vpd_kpa(F.col("tmax"), F.col("rh")))
    df = series.rolling_sums(df, key, date, "precip", (3, 30), "rain")
    df = series.rolling_sums(df, key, date, "precip", (90, 180, 365), "spi", suffix="")
    df = kbdi(df, key, date, keep=[n for n in names if n != "kbdi"], only=only, **kbdi_options)
    return df.select(key, date, *names)


def quantile_ladder(
    signals: DataFrame, names: Sequence[str], key: str = "cell", date: str = "d", rungs: int = LADDER_RUNGS, asked: dict[str, Column] | None = None
) -> DataFrame:
    """(signal, key, fortnight) -> exact equally spaced quantiles.

    All signals share one aggregate, and only the small ladder is unpivoted. A group holds at most 15 days per year. ``asked``
    names the days, in whole fortnights, whose quantiles of a signal will be read: others are not taken.
    """
    day = lambda n: F.when(asked[n], F.col(n)) if asked and n in asked else F.col(n)
    probs = F.array(*[F.lit(i / (rungs - 1)) for i in range(rungs)])
    wide = signals.groupBy(key, fortnight(F.col(date)).alias("fortnight")).agg(
        *[F.percentile(day(n), probs).alias(n) for n in names]
    )
    return wide.unpivot([key, "fortnight"], list(names), "signal", "q").filter(F.col("q").isNotNull())


def recent_ranks(
    signals: DataFrame, names: Sequence[str], days: DataFrame, since: Column, after: Column, key: str = "cell", date: str = "d", rungs: int = LADDER_RUNGS
) -> DataFrame:
    """(key, date, percentile per signal) of the days after a date, ranked in the ladder of the days from `since`, wide.

    One pass: a group of (key, fortnight) carries its ladder and the days to rank. `days` (one date column `day`) names the
    days that may be asked for; fortnights without one are dropped before any quantile is taken.
    """
    asked = days.select(fortnight(F.col("day")).alias("fortnight")).distinct()
    probs = F.array(*[F.lit(i / (rungs - 1)) for i in range(rungs)])
    rows = signals.withColumn("fortnight", fortnight(F.col(date))).join(F.broadcast(asked), "fortnight", "left_semi")  # 26 rows at most
    groups = rows.groupBy(key, "fortnight").agg(
        *[F.percentile(F.when(F.col(date) >= since, F.col(n)), probs).alias(f"_q_{n}") for n in names],
        F.collect_list(F.when(F.col(date) > after, F.struct(date, *names))).alias("_rows"),
    )
    ranked = groups.select(key, *[f"_q_{n}" for n in names], F.inline("_rows"))
    return ranked.select(key, date, *[ladder_rank(F.col(n), F.col(f"_q_{n}"), rungs).alias(n) for n in names])


def ladder_rank(value: Column, q: Column, rungs: int = LADDER_RUNGS) -> Column:
    """Percentile of a value in a ladder, interpolated between rungs; ties take the highest rung."""
    step = 1.0 / (rungs - 1)

    def at(k: Column) -> Column:
        lo_i = F.greatest(F.lit(1), F.least(F.lit(rungs - 1), k))
        lo, hi = F.element_at(q, lo_i), F.element_at(q, lo_i + 1)
        frac = F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(F.lit(1.0))
        between = (lo_i - 1) * F.lit(step) + clip(frac, 0.0, 1.0) * F.lit(step)
        return F.when(k == 0, F.lit(0.0)).when(k >= rungs, F.lit(1.0)).otherwise(between)

    # the rungs at or below the value are counted once and named; written out, they would be counted anew at each use
    rank = F.get(F.transform(F.array(F.size(F.filter(q, lambda x: x <= value))), at), 0)
    return F.when(value.isNotNull() & q.isNotNull(), rank)


def drought_panel(truth: DataFrame, spi: DataFrame) -> DataFrame:
    """Truth weeks with their indicator: graded severity and the D2 majority label."""
    joined = truth.join(spi.withColumnRenamed("cell", "fips"), ["fips", "d"])
    return joined.select(
        "fips",
        "d",
        F.col("d2").alias("d2_area"),
        ((F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4")) / 4.0).alias("severity"),
        F.when(F.col("d2") >= 50.0, 1).otherwise(0).alias("label"),
        *[f"spi{w}" for w in SPI_WINDOWS],
        "spi90_trend_8w",
    )
