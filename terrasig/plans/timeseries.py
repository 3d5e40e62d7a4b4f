"""Daily-series queries: spine, rolling totals, percentiles, indices, ladders, rivers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.functions.dates import season_key
from terrasig.operators import climate, quality, river, series
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables, keyed
from terrasig.plans.views import seasonal_sql, with_views


@query(
    "seasonal_extremes",
    with_views("rain", "SELECT cell, d, p3d, s3 AS pctl FROM rain WHERE rn > 30 AND s3 >= 95e-2"),
)
def seasonal_extremes(t: Tables) -> DataFrame:
    df = series.rolling_sums(t.daily.select("cell", "d", "precip"), "cell", "d", "precip", (3,), "p")
    df = series.with_position(df, "cell", "d")
    df = series.seasonal_percentiles(df, "cell", "d", {"p3d": "pctl"})
    return df.filter((F.col("rn") > 30) & (F.col("pctl") >= 0.95)).select("cell", "d", "p3d", "pctl")


@query("densify_calendar", with_views("daily", "SELECT cell, d, precip, tmax, rh, ws FROM daily"))
def densify_calendar(t: Tables) -> DataFrame:
    return t.daily


@query(
    "rolling_sum",
    with_views("roll", "SELECT cell, d, p1d, p3d, p7d, p14d, p30d, p90d, p180d, p365d FROM roll"),
)
def rolling_sum(t: Tables) -> DataFrame:
    return series.rolling_sums(
        t.daily.select("cell", "d", "precip"), "cell", "d", "precip", (1, 3, 7, 14, 30, 90, 180, 365), "p"
    ).drop("precip")


@query(
    "alltime_percentile",
    with_views(
        "daily",
        """SELECT cell, d, CASE WHEN precip IS NOT NULL THEN cume_dist() OVER (PARTITION BY cell, precip IS NULL ORDER BY precip) END AS rain_pctl,
           CASE WHEN tmax IS NULL THEN 0e0 ELSE cume_dist() OVER (PARTITION BY cell, tmax IS NULL ORDER BY tmax) END AS tmax_pctl
           FROM daily""",
    ),
)
def alltime_percentile(t: Tables) -> DataFrame:
    df = series.alltime_percentiles(t.daily.select("cell", "d", "precip", "tmax"), "cell", {"precip": "rain_pctl"})
    return series.alltime_percentiles(df, "cell", {"tmax": "tmax_pctl"}, missing_as=0.0).drop("precip", "tmax")


@query("seasonal_percentile", with_views("rain", "SELECT cell, d, s3, s30 FROM rain"))
def seasonal_percentile(t: Tables) -> DataFrame:
    return t.rain.select("cell", "d", "s3", "s30")


_RAIN = {f"p{w}d": f"s{w}" for w in climate.RAIN_WINDOWS}
RAIN_SQL = (
    ("rf_s", seasonal_sql("roll", _RAIN)),
    (
        "rf",
        "SELECT cell, d, "
        + ", ".join(
            f"p{w}d AS precip_{w}d, CASE WHEN p{w}d IS NOT NULL THEN cume_dist() OVER (PARTITION BY cell, p{w}d IS NULL "
            f"ORDER BY p{w}d) END AS precip_{w}d_pctl, s{w} AS precip_{w}d_pctl_seasonal"
            for w in climate.RAIN_WINDOWS
        )
        + ", p30d / AVG(p30d) OVER (PARTITION BY cell) AS precip_30d_over_climo_mean, rn FROM rf_s",
    ),
)


@query("rain_features", with_views("roll", "SELECT * EXCLUDE (rn) FROM rf WHERE rn > 30", *RAIN_SQL))
def rain_features(t: Tables) -> DataFrame:
    return climate.rain_features(t.daily)


@query(
    "rain_over_mean",
    with_views(
        "roll",
        "SELECT cell, d, p30d / AVG(p30d) OVER (PARTITION BY cell) AS over_mean FROM roll QUALIFY p30d IS NOT NULL",
    ),
)
def rain_over_mean(t: Tables) -> DataFrame:
    df = series.rolling_sums(t.daily.select("cell", "d", "precip"), "cell", "d", "precip", (30,), "p")
    mean = F.avg("p30d").over(Window.partitionBy("cell"))
    return df.withColumn("over_mean", F.col("p30d") / mean).filter(F.col("p30d").isNotNull()).select(
        "cell", "d", "over_mean"
    )


SPI_SQL = (
    ("spi_s", seasonal_sql("roll", {f"p{w}d": f"spi{w}" for w in climate.SPI_WINDOWS})),
    (
        "spi",
        """SELECT * FROM (SELECT cell, d, sk, spi30, spi90, spi180, spi365,
           COALESCE(spi90 - LAG(spi90, 56) OVER (PARTITION BY cell ORDER BY d), 0e0) AS spi90_trend_8w, rn FROM spi_s)
           WHERE rn > 365 AND spi30 IS NOT NULL AND spi90 IS NOT NULL AND spi180 IS NOT NULL AND spi365 IS NOT NULL""",
    ),
)


@query("spi_features", with_views("roll", "SELECT * EXCLUDE (rn, sk) FROM spi", *SPI_SQL))
def spi_features(t: Tables) -> DataFrame:
    return climate.spi_features(t.daily)


DSR_SQL = """SELECT cell, d, rn - COALESCE(MAX(CASE WHEN precip >= 25e-1 THEN rn END) OVER (PARTITION BY cell ORDER BY d), 0)
             AS days_since_rain FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY d) AS rn FROM daily)"""


@query("days_since_rain", with_views("daily", DSR_SQL))
def days_since_rain(t: Tables) -> DataFrame:
    return series.days_since(
        t.daily.select("cell", "d", "precip"), "cell", "d", F.col("precip") >= climate.WET_DAY_MM, "days_since_rain"
    ).drop("precip")


@query(
    "vpd",
    with_views(
        "daily",
        """SELECT cell, d, ROUND(6108e-4*exp(1727e-2*tmax/(tmax+2373e-1))*(1e0-GREATEST(0e0,LEAST(1e2,rh))/1e2), 9) AS vpd
           FROM daily""",
    ),
)
def vpd(t: Tables) -> DataFrame:
    return t.daily.select("cell", "d", F.round(climate.vpd_kpa(F.col("tmax"), F.col("rh")), 9).alias("vpd"))


KBDI_SQL = (
    (
        "kx",
        """SELECT cell, d, rn, COALESCE(tmax, 15e0)*9e0/5e0 + 32e0 AS tf, COALESCE(precip, 0e0)/254e-1 AS r,
           1e0 + 1088e-2*exp(-441e-4*(SUM(COALESCE(precip, 0e0)) OVER (PARTITION BY cell)/254e-1
             /GREATEST(1e0, COUNT(*) OVER (PARTITION BY cell)/36525e-2))) AS denom
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY d) AS rn FROM daily)""",
    ),
    (
        "ky",
        """SELECT rn, list(struct_pack(c := cell, dd := d, r := r, k := CASE WHEN tf > 5e1 THEN
           GREATEST(0e0, 968e-3*exp(486e-4*tf) - 83e-1)*1e-3/denom ELSE 0e0 END)) AS day FROM kx GROUP BY rn""",
    ),
    (
        "kz",
        """SELECT CAST(0 AS BIGINT) AS rn, cell, CAST(NULL AS DATE) AS d, 0e0 AS spell, 0e0 AS q FROM (SELECT DISTINCT cell FROM kx)
           UNION ALL SELECT /*rec*/ y.rn, z.cell, y.u.dd,
             CASE WHEN y.u.r > 0 THEN z.spell + y.u.r ELSE 0e0 END,
             LEAST(8e2, GREATEST(0e0, z.q - 1e2*CASE WHEN y.u.r <= 0 THEN 0e0 WHEN z.spell >= 2e-1 THEN y.u.r
                ELSE GREATEST(0e0, z.spell + y.u.r - 2e-1) END)
               + (8e2 - GREATEST(0e0, z.q - 1e2*CASE WHEN y.u.r <= 0 THEN 0e0 WHEN z.spell >= 2e-1 THEN y.u.r
                ELSE GREATEST(0e0, z.spell + y.u.r - 2e-1) END))*y.u.k)
           FROM kz z JOIN (SELECT rn, UNNEST(day) AS u FROM ky) y ON y.rn = z.rn + 1 AND y.u.c = z.cell""",
    ),
    ("kbdi", "SELECT cell, d, ROUND(q, 6) AS kbdi FROM kz WHERE rn > 0"),
)


@query("kbdi", with_views("daily", "SELECT cell, d, kbdi FROM kbdi", *KBDI_SQL))
def kbdi(t: Tables) -> DataFrame:
    return climate.kbdi(t.daily)


_FIRE = {"kbdi": "a1", "vpd": "a2", "tmax": "a3", "rh": "a4", "ws": "a5", "p30d": "a6", "p90d": "a7"}
FIRE_SQL = (
    *KBDI_SQL,
    ("dsr", DSR_SQL),
    (
        "fb",
        """SELECT r.cell, r.d, r.rn, r.sk, r.tmax, r.rh, r.ws, r.p30d, r.p90d, k.kbdi, s.days_since_rain,
           6108e-4*exp(1727e-2*tmax/(tmax+2373e-1))*(1e0-GREATEST(0e0,LEAST(1e2,rh))/1e2) AS vpd
           FROM roll r JOIN kbdi k ON k.cell = r.cell AND k.d = r.d JOIN dsr s ON s.cell = r.cell AND s.d = r.d""",
    ),
    ("fs", seasonal_sql("fb", _FIRE, missing="0e0")),
    (
        "fire",
        """SELECT cell, d, rn, kbdi, cume_dist() OVER (PARTITION BY cell ORDER BY kbdi) AS kbdi_pctl, a1 AS kbdi_pctl_seasonal,
           vpd AS vpd_kpa, a2 AS vpd_pctl_seasonal, tmax AS tmax_c, a3 AS tmax_pctl_seasonal, rh AS rh_pct,
           a4 AS rh_pctl_seasonal, ws AS ws_ms, a5 AS ws_pctl_seasonal, days_since_rain,
           a6 AS precip_30d_pctl_seasonal, a7 AS precip_90d_pctl_seasonal FROM fs""",
    ),
)


@query(
    "fire_features",
    with_views(
        "roll",
        """SELECT * EXCLUDE (rn) REPLACE (ROUND(vpd_kpa, 9) AS vpd_kpa) FROM fire WHERE rn > 365""",
        *FIRE_SQL,
    ),
)
def fire_features(t: Tables) -> DataFrame:
    return climate.fire_features(t.daily).withColumn("vpd_kpa", F.round("vpd_kpa", 9))


@query(
    "season_keys",
    with_views(
        "daily",
        "SELECT cell, d, month(d)*31 + day(d) AS sk, LEAST((dayofyear(d)-1)//14, 25) AS fortnight FROM daily",
    ),
)
def season_keys(t: Tables) -> DataFrame:
    from terrasig.functions.dates import fortnight

    return keyed(t.daily.select("cell", "d")).withColumn("fortnight", fortnight(F.col("d")))


WORLD_SQL = (
    *KBDI_SQL,
    (
        "sig",
        """SELECT r.cell, r.d, r.rn, LEAST((dayofyear(r.d)-1)//14, 25) AS fortnight, p3d AS rain3d, p30d AS rain30d,
           p90d AS spi90, p180d AS spi180, p365d AS spi365, k.kbdi,
           6108e-4*exp(1727e-2*tmax/(tmax+2373e-1))*(1e0-GREATEST(0e0,LEAST(1e2,rh))/1e2) AS vpd, tmax, ws
           FROM roll r JOIN kbdi k ON k.cell = r.cell AND k.d = r.d""",
    ),
    (
        "sigl",
        " UNION ALL ".join(
            f"SELECT cell, d, fortnight, '{s}' AS signal, CAST({s} AS DOUBLE) AS v FROM sig"
            for s in climate.LADDER_SIGNALS
        ),
    ),
    (
        "ladder",
        f"""SELECT signal, cell, fortnight, quantile_cont(v, {[i / 20 for i in range(21)]}::DOUBLE[]) AS q FROM sigl
            WHERE d >= DATE '1996-01-01' AND v IS NOT NULL GROUP BY 1, 2, 3""",
    ),
    (
        "wrank",
        """SELECT signal, cell, d, CASE WHEN k = 0 THEN 0e0 WHEN k >= 21 THEN 1e0 ELSE (kc-1)*5e-2 +
             CASE WHEN q[kc+1] > q[kc] THEN GREATEST(0e0, LEAST(1e0, (v-q[kc])/(q[kc+1]-q[kc]))) ELSE 1e0 END*5e-2 END AS pctl
           FROM (SELECT s.signal, s.cell, s.d, s.v, l.q, len(list_filter(l.q, lambda x: x <= s.v)) AS k,
                 GREATEST(1, LEAST(20, len(list_filter(l.q, lambda x: x <= s.v)))) AS kc
                 FROM sigl s JOIN ladder l ON l.signal = s.signal AND l.cell = s.cell AND l.fortnight = s.fortnight
                 WHERE s.d > DATE '2001-10-01' AND s.v IS NOT NULL)""",
    ),
)


def ladder_of(t: Tables, signals: DataFrame, asked: dict[str, Column] | None = None) -> DataFrame:
    clim = signals.filter(F.col("d") >= F.lit("1996-01-01").cast("date"))
    return climate.quantile_ladder(clim, climate.LADDER_SIGNALS, asked=asked)


@query(
    "quantile_ladder",
    with_views(
        "roll",
        "SELECT signal, cell, fortnight, u.i AS rung, ROUND(q[u.i], 9) AS v FROM ladder, (SELECT UNNEST(generate_series(1, 21)) AS i) u",
        *WORLD_SQL,
    ),
)
def quantile_ladder(t: Tables) -> DataFrame:
    lad = ladder_of(t, climate.world_signals(t.daily))
    return lad.select("signal", "cell", "fortnight", F.posexplode("q").alias("rung", "v")).select(
        "signal", "cell", "fortnight", (F.col("rung") + 1).alias("rung"), F.round("v", 9).alias("v")
    )


RANKED_AFTER = "2001-10-01"


def near_season(t: Tables, after: str) -> Column:
    """Whether a day lies in the season of a day after a date: no pool of such days holds another row."""
    first = F.date_add(F.lit(after).cast("date"), 1)
    days = t.spark.range(1).select(F.explode(F.sequence(first, F.greatest(first, t.span[1]))).alias("day"))
    k = season_key(F.col("day"))
    keys = days.select(F.explode(F.sequence(k - 15, k + 15)).alias("k")).agg(F.collect_set("k"))  # 402 at most
    return F.array_contains(keys.scalar(), season_key(F.col("d")))


def recent_ranks(t: Tables, names: Sequence[str] = climate.LADDER_SIGNALS, after: str = RANKED_AFTER) -> DataFrame:
    """(cell, d, percentile per signal) of the days after a date, ranked in the cell's own ladder; days without any are left out."""
    first = F.date_add(F.lit(after).cast("date"), 1)
    days = t.spark.range(1).select(F.explode(F.sequence(first, F.greatest(first, t.span[1]))).alias("day"))
    ranks = climate.recent_ranks(climate.world_signals(t.daily, names=names), names, days, F.lit("1996-01-01").cast("date"), F.lit(after).cast("date"))
    return ranks.filter(F.coalesce(*names).isNotNull())


def world_ranks(t: Tables, after: str = RANKED_AFTER) -> DataFrame:
    """The same, long: (signal, cell, d, pctl)."""
    ranks = recent_ranks(t, after=after).unpivot(["cell", "d"], list(climate.LADDER_SIGNALS), "signal", "pctl")
    return ranks.filter(F.col("pctl").isNotNull()).select("signal", "cell", "d", "pctl")


@query(
    "ladder_rank",
    with_views("roll", "SELECT signal, cell, d, ROUND(pctl, 9) AS pctl FROM wrank", *WORLD_SQL),
)
def ladder_rank(t: Tables) -> DataFrame:
    return world_ranks(t).withColumn("pctl", F.round("pctl", 9))


@query(
    "near_flags",
    with_views(
        "replay",
        """SELECT cell, d, event, event OR COALESCE(LAG(event) OVER w, FALSE) OR COALESCE(LEAD(event) OVER w, FALSE) AS near_event
           FROM replay WINDOW w AS (PARTITION BY cell ORDER BY d)""",
    ),
)
def near_flags(t: Tables) -> DataFrame:
    return series.near_flags(t.replay.select("cell", "d", "event"), "cell", "d", "event", "near_event")


@query(
    "last_valid",
    with_views(
        "daily",
        """SELECT cell, MAX(CASE WHEN tmax IS NOT NULL THEN d END) AS last_valid,
           CAST(DATE '2001-11-10' - MAX(CASE WHEN tmax IS NOT NULL THEN d END) AS BIGINT) AS staleness_days FROM daily GROUP BY 1""",
    ),
)
def last_valid(t: Tables) -> DataFrame:
    return series.last_valid(t.daily.select("cell", "d", "tmax"), "cell", "d", "tmax", F.lit("2001-11-10").cast("date"))


@query(
    "recent_total",
    with_views(
        "daily",
        """SELECT cell, SUM(COALESCE(precip, 0)) AS mm FROM daily WHERE d > DATE '2001-11-04' - 120 GROUP BY 1""",
    ),
)
def recent_total(t: Tables) -> DataFrame:
    return quality.recent_total(t.daily, "cell", "d", "precip", F.lit("2001-11-04").cast("date"), "mm")


@query(
    "every_nth",
    with_views(
        "roll", "SELECT cell, d, p3d FROM roll WHERE rn > 730 AND (rn - 1) % 7 = 0"
    ),
)
def every_nth(t: Tables) -> DataFrame:
    df = series.rolling_sums(t.daily.select("cell", "d", "precip"), "cell", "d", "precip", (3,), "p")
    df = series.with_position(df, "cell", "d")
    pos = F.col("rn") - 1
    return df.filter((pos >= 730) & (pos % 7 == 0)).select("cell", "d", "p3d")


# ---- rivers

RIVER_SQL = (
    ("rk", "SELECT *, month(d)*31 + day(d) AS sk FROM river_day"),
    ("rmed", "SELECT cell, i, j, median(m3s) AS med FROM river_day GROUP BY 1, 2, 3"),
)


@query("river_mask", with_views("river_day", "SELECT cell, i, j, med, med >= 5e0 AS is_river FROM rmed", *RIVER_SQL))
def river_mask(t: Tables) -> DataFrame:
    return river.cell_medians(t.river_day, ["cell", "i", "j"], "m3s")


@query(
    "channel_snap",
    with_views(
        "river_day place",
        """SELECT id, cell AS channel, med FROM (SELECT p.id, m.cell, m.med,
             ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY m.med DESC, m.i - p.id // 10, m.j - p.id % 10) AS rn
           FROM place p JOIN rmed m ON abs(m.i - p.id // 10) <= 2 AND abs(m.j - p.id % 10) <= 2 AND m.med >= 5e0) WHERE rn = 1""",
        *RIVER_SQL,
    ),
)
def channel_snap(t: Tables) -> DataFrame:
    medians = river.cell_medians(t.river_day, ["cell", "i", "j"], "m3s")
    at = t.place.select("id", F.floor(F.col("id") / 10).alias("pi"), (F.col("id") % 10).alias("pj"))
    return river.snap_channel(at, medians)


@query(
    "gauge_match",
    with_views(
        "river_day place",
        """SELECT id, cell AS matched, ROUND(err, 9) AS err FROM (SELECT p.id, m.cell, abs(log10(m.med) - log10(GREATEST(1e-1, abs(p.bal)/1e3))) AS err,
             ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY ROUND(abs(log10(m.med) - log10(GREATEST(1e-1, abs(p.bal)/1e3))), 9), m.i - p.id // 10, m.j - p.id % 10) AS rn
           FROM place p JOIN rmed m ON abs(m.i - p.id // 10) <= 2 AND abs(m.j - p.id % 10) <= 2 AND m.med >= 1e0) WHERE rn = 1""",
        *RIVER_SQL,
    ),
)
def gauge_match(t: Tables) -> DataFrame:
    medians = river.cell_medians(t.river_day, ["cell", "i", "j"], "m3s")
    at = t.place.select(
        "id",
        F.floor(F.col("id") / 10).alias("pi"),
        (F.col("id") % 10).alias("pj"),
        (F.abs("bal") / 1000.0).alias("gauge_median"),
    )
    return river.match_gauge(at, medians)


@query(
    "flow_percentile",
    with_views(
        "river_day",
        """SELECT cell, d, m3s, flow_pctl_seasonal, flow_pctl_alltime, median_here FROM (
             SELECT s.cell, s.d, s.m3s, s.flow_pctl_seasonal, c.flow_pctl_alltime, m.median_here
             FROM rs s JOIN (SELECT cell, d, cume_dist() OVER (PARTITION BY cell ORDER BY m3s) AS flow_pctl_alltime FROM river_day) c
               ON c.cell = s.cell AND c.d = s.d
             JOIN (SELECT a.cell, a.sk, median(b.m3s) AS median_here FROM (SELECT DISTINCT cell, sk, UNNEST(generate_series(sk-15, sk+15)) AS ok FROM rk) a
                   JOIN rk b ON b.cell = a.cell AND b.sk = a.ok GROUP BY 1, 2) m ON m.cell = s.cell AND m.sk = s.sk)""",
        *RIVER_SQL,
        ("rs", seasonal_sql("rk", {"m3s": "flow_pctl_seasonal"})),
    ),
)
def flow_percentile(t: Tables) -> DataFrame:
    return river.flow_percentiles(t.river_day.select("cell", "d", "m3s"), "cell", "d", "m3s")


FORECAST_SQL = (
    *RIVER_SQL,
    (
        "fpool",
        """SELECT f.cell, f.init, f.lead_h, f.init + CAST(f.lead_h // 24 AS INTEGER) AS valid, f.m3s, COUNT(*) AS n,
           SUM(CASE WHEN b.m3s <= f.m3s THEN 1 ELSE 0 END) AS k
           FROM forecast f JOIN rk b ON b.cell = f.cell
            AND abs(b.sk - (month(f.init + CAST(f.lead_h // 24 AS INTEGER))*31 + day(f.init + CAST(f.lead_h // 24 AS INTEGER)))) <= 15
           GROUP BY 1, 2, 3, 4, 5""",
    ),
    ("fo", "SELECT *, CAST(k AS DOUBLE)/n AS pctl FROM fpool WHERE n >= 30"),
)


@query(
    "forecast_outlook",
    with_views(
        "river_day forecast",
        """SELECT cell, init, arg_min(valid, lead_h) AS today_valid, arg_min(m3s, lead_h) AS today_m3s, arg_min(pctl, lead_h) AS today_pctl,
           MAX(pctl) AS week_max_pctl, MIN(CASE WHEN pctl = mx THEN valid END) AS week_max_valid
           FROM (SELECT *, MAX(pctl) OVER (PARTITION BY cell, init) AS mx FROM fo) GROUP BY 1, 2""",
        *FORECAST_SQL,
    ),
)
def forecast_outlook(t: Tables) -> DataFrame:
    return river.forecast_outlook(t.forecast, t.river_day.select("cell", "d", "m3s"), "cell", "d", "m3s")


# ---- two rain sources

AGREE_SQL = (
    ("ma", "SELECT cell, date_trunc('month', d)::DATE AS m, SUM(COALESCE(precip, 0)) AS a FROM daily GROUP BY 1, 2"),
    ("mb", "SELECT cell, date_trunc('month', d)::DATE AS m, SUM(COALESCE(precip2, 0)) AS b FROM rain2 GROUP BY 1, 2"),
    (
        "agree",
        """SELECT cell, COUNT(*) AS n_months, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) ELSE 0e0 END AS corr_monthly,
           SUM(a)/NULLIF(SUM(b), 0) AS ratio FROM ma JOIN mb USING (cell, m)
           WHERE m BETWEEN DATE '1996-01-01' AND DATE '2001-06-01' GROUP BY 1""",
    ),
    (
        "rec",
        """SELECT cell, COALESCE(a.mm, 0) AS a_mm, COALESCE(b.mm, 0) AS b_mm FROM
            (SELECT cell, SUM(COALESCE(precip, 0)) AS mm FROM daily WHERE d > DATE '2001-08-01' - 120 AND d <= DATE '2001-08-01' GROUP BY 1) a
            FULL JOIN (SELECT cell, SUM(COALESCE(precip2, 0)) AS mm FROM rain2 WHERE d > DATE '2001-08-01' - 120 AND d <= DATE '2001-08-01' GROUP BY 1) b USING (cell)""",
    ),
    (
        "sv",
        """SELECT *, CASE WHEN longrun = 'unverified' THEN 'unverified' WHEN corr_monthly < 6e-1 OR ratio NOT BETWEEN 25e-2 AND 4e0 OR abs(ln(rr/ratio)) > ln(22e-1)
             THEN 'disagree' ELSE 'ok' END AS combined FROM (
           SELECT cell, n_months, corr_monthly, ratio, a_mm, b_mm,
             CASE WHEN GREATEST(a_mm, b_mm) >= 3e1 THEN (a_mm+1e0)/(b_mm+1e0) END AS rr,
             CASE WHEN GREATEST(a_mm, b_mm) < 3e1 THEN 'ok' WHEN (a_mm+1e0)/(b_mm+1e0) BETWEEN 4e-1 AND 25e-1 THEN 'ok' ELSE 'disagree' END AS recent,
             CASE WHEN n_months < 48 OR ratio IS NULL THEN 'unverified'
               WHEN corr_monthly >= 6e-1 AND ratio BETWEEN 6e-1 AND 16e-1 THEN 'ok' ELSE 'disagree' END AS longrun
           FROM (SELECT cell, COALESCE(n_months, 0) AS n_months, corr_monthly, ratio, COALESCE(a_mm, 0) AS a_mm, COALESCE(b_mm, 0) AS b_mm FROM agree FULL JOIN rec USING (cell)))""",
    ),
)


@query("agg_monthly", with_views("daily", "SELECT cell, m, a AS mm FROM ma", AGREE_SQL[0]))
def agg_monthly(t: Tables) -> DataFrame:
    return quality.monthly_totals(t.daily, "cell", "d", "precip", "mm")


@query(
    "source_agreement",
    with_views("daily rain2", "SELECT cell, n_months, ROUND(corr_monthly, 6) AS corr_monthly, ROUND(ratio, 6) AS ratio FROM agree", *AGREE_SQL),
)
def source_agreement(t: Tables) -> DataFrame:
    a = agreement(t)
    return a.select(
        "cell", "n_months", F.round("corr_monthly", 6).alias("corr_monthly"), F.round("ratio", 6).alias("ratio")
    )


def agreement(t: Tables) -> DataFrame:
    return quality.agreement(
        quality.monthly_totals(t.daily, "cell", "d", "precip", "a"),
        quality.monthly_totals(t.rain2, "cell", "d", "precip2", "b"),
        "cell",
        F.lit("1996-01-01").cast("date"),
        F.lit("2001-06-01").cast("date"),
    )


def verdicts(t: Tables) -> DataFrame:
    end = F.lit("2001-08-01").cast("date")
    recent = quality.recent_total(t.daily.filter(F.col("d") <= end), "cell", "d", "precip", end, "a_mm").join(
        quality.recent_total(t.rain2.filter(F.col("d") <= end), "cell", "d", "precip2", end, "b_mm"), "cell", "full_outer"
    )
    return quality.verdicts(agreement(t), recent, "cell")


@query(
    "source_verdict",
    with_views(
        "daily rain2",
        """SELECT cell, longrun, recent, ROUND(rr, 6) AS recent_ratio, combined AS verdict,
           CASE WHEN longrun = 'unverified' THEN 'longrun unverified' ELSE
           concat_ws('; ', CASE WHEN corr_monthly < 6e-1 THEN 'pattern' END, CASE WHEN ratio NOT BETWEEN 25e-2 AND 4e0 THEN 'long-run ratio' END,
             CASE WHEN abs(ln(rr/ratio)) > ln(22e-1) THEN 'recent drift' END) END AS reasons FROM sv""",
        *AGREE_SQL,
    ),
)
def source_verdict(t: Tables) -> DataFrame:
    return verdicts(t).select(
        "cell", "longrun", "recent", F.round("recent_ratio", 6).alias("recent_ratio"), "verdict", "reasons"
    )


MERGE_SQL = (
    (
        "merged",
        """SELECT cell, d, precip2 AS precip FROM rain2 UNION ALL
           SELECT cell, d, precip FROM daily h WHERE d < DATE '2001-01-01' AND NOT EXISTS (SELECT 1 FROM rain2 t WHERE t.cell = h.cell AND t.d = h.d)""",
    ),
)


@query("merge_hist_tail", with_views("daily rain2", "SELECT cell, d, precip FROM merged", *MERGE_SQL))
def merge_hist_tail(t: Tables) -> DataFrame:
    return quality.merge_tail(
        t.daily.select("cell", "d", "precip"),
        t.rain2.select("cell", "d", F.col("precip2").alias("precip")),
        F.lit("2001-01-01").cast("date"),
    )


# the second source stalls on 2001-08-01; the first one bridges the gap
GAP_SQL = (
    ("gl", "SELECT cell, MAX(d) AS last FROM rain2 WHERE precip2 IS NOT NULL GROUP BY 1"),
    (
        "gc",
        """SELECT p.cell, COUNT(*) AS overlap, LEAST(4e0, GREATEST(25e-2, (SUM(p.precip2)+1e0)/(SUM(e.precip)+1e0))) AS corr
           FROM rain2 p JOIN daily e ON e.cell = p.cell AND e.d = p.d WHERE p.precip2 IS NOT NULL AND e.precip IS NOT NULL GROUP BY 1""",
    ),
    (
        "filled",
        """SELECT COALESCE(p.cell, e.cell) AS cell, COALESCE(p.d, e.d) AS d,
             CASE WHEN p.precip2 IS NOT NULL THEN p.precip2
               WHEN COALESCE(p.d, e.d) > l.last AND c.overlap >= 120 AND DATE '2001-11-04' - l.last > 5 THEN ROUND(e.precip*c.corr, 3) END AS v,
             p.cell IS NOT NULL AS had
           FROM rain2 p FULL JOIN daily e ON e.cell = p.cell AND e.d = p.d
           JOIN gl l ON l.cell = COALESCE(p.cell, e.cell) LEFT JOIN gc c ON c.cell = l.cell""",
    ),
)


@query(
    "gapfill_bias",
    with_views("daily rain2", "SELECT cell, d, v FROM filled WHERE had OR v IS NOT NULL", *GAP_SQL),
)
def gapfill_bias(t: Tables) -> DataFrame:
    return quality.fill_trailing_gap(
        t.rain2.select("cell", "d", F.col("precip2").alias("v")),
        t.daily.select("cell", "d", F.col("precip").alias("e")),
        "cell",
        "d",
        "v",
        "e",
        F.lit("2001-11-04").cast("date"),
        mode="ratio",
    )


@query(
    "join_two_series",
    with_views(
        "daily rain2",
        """SELECT a.cell, a.d, a.precip AS obs, b.precip2 AS sim FROM daily a JOIN rain2 b ON b.cell = a.cell AND b.d = a.d
           WHERE a.precip IS NOT NULL AND b.precip2 IS NOT NULL""",
    ),
)
def join_two_series(t: Tables) -> DataFrame:
    return (
        t.daily.select("cell", "d", F.col("precip").alias("obs"))
        .join(t.rain2.select("cell", "d", F.col("precip2").alias("sim")), ["cell", "d"])
        .dropna()
    )
