"""Status, tiers, verdicts and published records. All locations at once; no per-location loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.operators import ranking

# Fixed publication vocabulary.
STATUSES = ("red", "yellow", "green", "unknown")
BOARD_ORDER = {"red": 0, "yellow": 1, "unknown": 2, "green": 3}
PRECIP_FLAGS = ("extreme_rain", "drought_3mo", "drought_structural", "fire_weather")
STALE_AFTER_DAYS = 7

# Fixed texts of the published status.
RIVER_RED = "The river is exceptionally high for this time of year. Stay aware of water levels and local warnings."
SOURCES_DISAGREE = (
    "Rainfall sources disagree here right now, so rain-based scores are not trustworthy. Treat those as unknown and "
    "rely on local guidance."
)
RIVER_STILL_HIGH = " The river, measured independently, IS running high -- watch water levels."
SLOPE_RED = (
    "Rain here is extreme for this time of year and the slopes nearby are the kind that fail. Be careful on and below "
    "steep ground."
)
SLOPE_STALE = (
    "Rain was extreme for the season in the most recent data, which is ",
    " days old (upstream delay). Treat slopes with caution and check local warnings.",
)
FIRE_RED = "Fire weather is dangerous today: unusually hot, dry conditions. A fire that starts can spread fast."
WATCH = ("Worth watching: ", ". Not an alert, but conditions are unusual.")
WATCH_RAIN = "rain is unusually heavy for the season"
WATCH_RIVER = "the river is running high"
WATCH_FIRE = "fire weather is elevated"
WATCH_SPI90 = "the last three months have been exceptionally dry"
WATCH_SPI365 = "a long drought is in progress"
WATCH_FORECAST = "the river is forecast to run exceptionally high around "
NO_WEATHER = "No fresh weather available for this location."
ALL_NORMAL = "Nothing unusual for this location today."
LAYER_TEXT = {
    "red": "Rain here is well above normal for this time of year, and this is the kind of slope that fails. Take care "
    "on and below steep ground today.",
    "amber": "Rain here is above normal for this time of year. The ground here is less prone to sliding, but stay aware.",
    "green": "Rainfall here is normal for this time of year. Nothing unusual today.",
    "unknown": "Not enough data to score this location yet.",
}


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def status_counts(df: DataFrame) -> DataFrame:
    """All four statuses, zero included."""
    spine = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(n, "status", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def board_rank(status: Column) -> Column:
    rank = F.lit(None).cast("int")
    for s, r in BOARD_ORDER.items():
        rank = F.when(status == s, F.lit(r)).otherwise(rank)
    return rank


def two_layer_status(susc: Column, trig: Column, susc_thr: Column, trig_thr: Column) -> Column:
    """The time-varying layer gates the alert, the slope sets its severity."""
    return (
        F.when(susc.isNull() | trig.isNull(), "unknown")
        .when(trig < trig_thr, "green")
        .when(susc >= susc_thr, "red")
        .otherwise("amber")
    )


def layer_message(status: Column) -> Column:
    text = F.lit(None).cast("string")
    for s, words in LAYER_TEXT.items():
        text = F.when(status == s, F.lit(words)).otherwise(text)
    return text


def phrases(*parts: Column, sep: str = "; ") -> Column:
    return F.concat_ws(sep, F.array_compact(F.array(*parts)))


def compound_flags(df: DataFrame) -> DataFrame:
    """Which signals sit in their local tail."""
    flag = lambda cond, name: F.when(yes(cond), F.lit(name))
    return df.withColumn(
        "flags",
        phrases(
            flag(F.col("rain3d_pctl") >= 0.98, "rainfall_3d_extreme_for_season"),
            flag(F.col("kbdi_pctl") >= 0.95, "fuel_dryness_extreme_for_season"),
            flag(F.col("vpd_pctl") >= 0.95, "atmospheric_dryness_extreme_for_season"),
            flag(F.col("tmax_pctl") >= 0.98, "heat_extreme_for_season"),
            flag(F.col("spi90") <= 0.05, "3-month_precipitation_deficit_severe"),
            flag(F.col("spi180") <= 0.05, "6-month_precipitation_deficit_severe"),
            flag(F.col("flood_pctl") >= 0.98, "river_flow_extreme_for_season"),
            sep=",",
        ),
    )


def compose_status(df: DataFrame) -> DataFrame:
    """One status and one sentence per location-day; NULL inputs never count as an extreme.

    A river red stands even where rain sources disagree, because it does not come from them.
    """
    flood, rain = F.col("flood_pctl"), F.greatest("rain3d_pctl", "rain30d_pctl")
    river_red = yes(flood >= 0.98)
    disagree = yes(F.col("data_quality") == "disagree")
    slope = yes(rain >= 0.98) & yes(F.col("susceptibility_nearby_max") >= 0.30)
    stale = yes(F.col("staleness_days") > STALE_AFTER_DAYS)
    fire = yes(F.col("fire_alert"))
    watch = F.array_compact(
        F.array(
            F.when(yes(rain >= 0.95), WATCH_RAIN),
            F.when(yes(flood >= 0.95), WATCH_RIVER),
            F.when(yes(F.col("fire_watch")), WATCH_FIRE),
            F.when(yes(F.col("spi90") <= 0.05), WATCH_SPI90),
            F.when(yes(F.col("spi365") <= 0.05), WATCH_SPI365),
            F.when(
                yes(F.col("flood_week_max_pctl") >= 0.98),
                F.concat(
                    F.lit(WATCH_FORECAST),
                    F.coalesce(F.col("flood_week_max_date").cast("string"), F.lit("this week")),
                ),
            ),
        )
    )
    status = (
        F.when(river_red, "red")
        .when(disagree, "unknown")
        .when(slope & ~stale, "red")
        .when(slope, "yellow")
        .when(fire, "red")
        .when(F.size(watch) > 0, "yellow")
        .when(F.col("rain3d_pctl").isNull(), "unknown")
        .otherwise("green")
    )
    age = F.col("staleness_days").cast("string")
    message = (
        F.when(river_red, RIVER_RED)
        .when(
            disagree,
            F.concat(F.lit(SOURCES_DISAGREE), F.when(yes(flood >= 0.95), RIVER_STILL_HIGH).otherwise("")),
        )
        .when(slope & ~stale, SLOPE_RED)
        .when(slope, F.concat(F.lit(SLOPE_STALE[0]), age, F.lit(SLOPE_STALE[1])))
        .when(fire, FIRE_RED)
        .when(F.size(watch) > 0, F.concat(F.lit(WATCH[0]), F.concat_ws("; ", watch), F.lit(WATCH[1])))
        .when(F.col("rain3d_pctl").isNull(), NO_WEATHER)
        .otherwise(ALL_NORMAL)
    )
    return df.withColumns({"status": status, "message": message})


def verdict_bins(df: DataFrame) -> DataFrame:
    """Per-hazard card verdicts."""
    rain = F.greatest("rain3d_pctl", "rain30d_pctl")
    doubt = yes(F.col("data_quality") == "disagree")
    prone = yes(F.col("susceptibility_nearby_max") >= 0.30)
    spi, flood = F.col("spi90"), F.col("flood_pctl")
    return df.withColumns(
        {
            "landslide": F.when(rain.isNull(), "unknown")
            .when(doubt, "unknown")
            .when(prone & (rain >= 0.98), "red")
            .when(rain >= 0.95, "yellow")
            .otherwise("green"),
            "fire_card": F.when(F.col("fire_danger").isNull(), "unknown")
            .when(yes(F.col("fire_alert")), "red")
            .when(yes(F.col("fire_watch")), "yellow")
            .otherwise("green"),
            "drought_card": F.when(spi.isNull(), "no data")
            .when(doubt, "uncertain")
            .when(spi <= 0.02, "extreme")
            .when(spi <= 0.05, "severe")
            .when(spi <= 0.15, "much drier")
            .when(spi <= 0.35, "somewhat dry")
            .otherwise("none"),
            "river_card": F.when(flood.isNull(), "unknown")
            .when(flood >= 0.98, "red")
            .when(flood >= 0.95, "yellow")
            .otherwise("green"),
        }
    )


def route_tier(df: DataFrame) -> DataFrame:
    """A where a regional model covers the point, B elsewhere on land, C where an input is missing or not trusted. Trust is
    the long-run check of the rain sources, `rain_check`."""
    no_dem = F.col("slope_deg").isNull()
    no_rain = F.col("rain3d_pctl").isNull()
    doubt = yes(F.col("rain_check") == "disagree")
    tier = F.when(no_dem | no_rain | doubt, "C").when(F.col("region").isNotNull(), "A").otherwise("B")
    worst = F.greatest("rain3d_pctl", "rain30d_pctl")
    reasons = phrases(
        F.when(no_dem, "no terrain coverage"),
        F.when(~no_dem & F.col("region").isNotNull(), F.concat(F.lit("regional model: "), F.col("region"))),
        F.when(~no_dem & F.col("region").isNull(), "global floor ensemble"),
        F.when(no_rain, "no rainfall record"),
        F.when(~no_rain & doubt, "precipitation sources disagree"),
    )
    alert = F.when(
        worst.isNotNull() & F.col("susceptibility_nearby_max").isNotNull(),
        (worst >= 0.95) & (F.col("susceptibility_nearby_max") >= 0.3),
    )
    return df.withColumns({"tier": tier, "caveats": reasons, "alert": alert})


def ensemble_floor(df: DataFrame, reference: DataFrame, scores: dict[str, str], class_col: str) -> DataFrame:
    """Mean of the strictly-below percentiles of each score in a reference pool and of class/5, missing parts skipped.

    ``scores`` maps the column of ``df`` to the reference column. Percentiles are read by merging the points into the
    reference histogram and running its totals, so the pool may be of any size.
    """
    out = df
    parts = []
    for col, ref in scores.items():
        pool = reference.filter(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        asked = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
        merged = pool.unionByName(asked).groupBy("_v").agg(F.sum("_n").alias("_n"))
        cum = ranking.running_totals(merged, "_v", ["_n"])
        pct = cum.select(F.col("_v").alias(col), ((F.col("cum__n") - F.col("_n")) / F.col("tot__n")).alias(f"_p_{col}"))
        out = out.join(pct, col, "left")
        parts.append(F.col(f"_p_{col}"))
    parts.append(F.col(class_col) / 5.0)
    present = F.array_compact(F.array(*parts))
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("floor_score", F.when(F.size(present) > 0, total / F.size(present))).drop(
        *[f"_p_{c}" for c in scores]
    )


def hazard_blocks(df: DataFrame, fire_thr: float, watch_thr: float) -> DataFrame:
    """Thresholded fire, drought and flood fields of a location-day. Alerts ask for the combined verdict, the drought tier for
    the long-run check of the rain sources."""
    fresh = yes(F.col("staleness_days") <= STALE_AFTER_DAYS)
    trusted = ~yes(F.col("data_quality") == "disagree")
    checked = ~yes(F.col("rain_check") == "disagree")
    danger = F.col("fire_danger")
    return df.withColumns(
        {
            "fire_alert": yes(danger >= fire_thr) & trusted & fresh,
            "fire_watch": yes(danger >= watch_thr),
            "drought_tier": F.when(F.col("spi90").isNull() | ~checked, "C").otherwise("B"),
            "flood_alert": F.when(F.col("flood_pctl").isNotNull(), F.col("flood_pctl") >= 0.98),
        }
    )


#: Fixed texts of the hazard cards, as (text, level), in the order of their conditions.
CARDS = {
    "landslide": (("No fresh rain data", "unknown"), ("Data uncertain", "unknown"), ("Danger signs on slopes", "red"), ("Slopes worth watching", "yellow"), ("Rain unusually heavy", "yellow"), ("Nothing unusual", "green")),
    "fire": (("No data", "unknown"), ("Dangerous fire weather", "red"), ("Elevated", "yellow"), ("Normal", "green")),
    "drought": (("No data", "unknown"), ("Data uncertain", "unknown"), ("Extreme drought", "red"), ("Severe drought", "red"), ("Much drier than usual", "yellow"), ("Somewhat dry", "yellow"), ("No drought", "green")),
    "river": (("No river tracked here", "unknown"), ("Exceptionally high", "red"), ("Running high", "yellow"), ("Normal range", "green")),
}


def hazard_cards(df: DataFrame) -> DataFrame:
    """(.., hazard, text, level, value) rows: the four cards of a location-day. `value` is what the card shows; it is missing
    where the rain sources are not trusted."""
    rain, spi, flood = F.greatest("rain3d_pctl", "rain30d_pctl"), F.col("spi90"), F.col("flood_pctl")
    doubt = yes(F.col("data_quality") == "disagree")
    prone = yes(F.col("susceptibility_nearby_max") >= 0.30)
    conditions = {
        "landslide": (rain.isNull(), doubt, prone & (rain >= 0.98), prone & (rain >= 0.95), rain >= 0.95),
        "fire": (F.col("fire_danger").isNull(), yes(F.col("fire_alert")), yes(F.col("fire_watch"))),
        "drought": (spi.isNull(), doubt, spi <= 0.02, spi <= 0.05, spi <= 0.15, spi <= 0.35),
        "river": (flood.isNull(), flood >= 0.98, flood >= 0.95),
    }
    values = {"landslide": F.when(~doubt, rain), "fire": F.col("fire_danger"), "drought": F.when(~doubt, 1.0 - spi), "river": flood}
    cards = []
    for hazard, tests in conditions.items():
        picked = F.lit(len(tests))
        for i in reversed(range(len(tests))):
            picked = F.when(tests[i], i).otherwise(picked)
        texts, levels = (F.array(*[F.lit(c[k]) for c in CARDS[hazard]]) for k in (0, 1))
        cards.append(F.struct(F.lit(hazard).alias("hazard"), F.get(texts, picked).alias("text"), F.get(levels, picked).alias("level"), values[hazard].alias("value")))
    return df.select("*", F.inline(F.array(*cards)))


def watch_flags(df: DataFrame) -> DataFrame:
    """City flags; rain-derived flags are withheld where the sources disagree."""
    ok = F.col("rain3d").isNotNull()
    flag = lambda cond, name: F.when(yes(ok & cond), F.lit(name))
    raw = F.array_compact(
        F.array(
            flag((F.col("rain3d") >= 0.98) | yes(F.col("rain30d") >= 0.98), "extreme_rain"),
            flag((F.col("vpd") >= 0.95) & (F.col("kbdi") >= 0.90), "fire_weather"),
            flag(F.col("spi90") <= 0.05, "drought_3mo"),
            flag(F.col("spi365") <= 0.05, "drought_structural"),
            F.when(yes(F.col("flood_pctl") >= 0.98), "river_high"),
        )
    )
    precip = F.array(*[F.lit(p) for p in PRECIP_FLAGS])
    withhold = yes(F.col("verdict") == "disagree")
    df = df.withColumn("_raw", raw)
    return df.withColumns(
        {
            "flags": F.when(withhold, F.array_except("_raw", precip)).otherwise(F.col("_raw")),
            "unverified": F.when(withhold, F.array_intersect("_raw", precip)).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_raw")


def location_record(df: DataFrame) -> DataFrame:
    """One JSON document per location; missing weather fields are left out."""
    weather = ("rain3d_pctl", "rain30d_pctl", "spi90", "spi365", "fire_danger", "flood_pctl", "staleness_days")
    doc = F.struct("location_id", "status", "message", "as_of", F.struct(*weather).alias("weather"))
    return df.select("location_id", F.to_json(doc).alias("record"))


def register(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Append locations whose key is new; the first request of a key wins."""
    first = wanted.groupBy("geohash").agg(F.min_by(F.struct(*[c for c in wanted.columns if c != "geohash"]), "id").alias("_r"))
    new = first.select("geohash", "_r.*").join(existing.select("geohash"), "geohash", "left_anti")
    return existing.unionByName(new.select(existing.columns))


def case_table(cases: DataFrame, scores: DataFrame, keys: list[str], expectation: Column) -> DataFrame:
    """Case rows with their scores and whether the expectation was met; a case without scores keeps NULLs."""
    return cases.join(scores, keys, "left").withColumn("met", expectation)
