"""Aggregation, raster, terrain and world-field queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasig.operators import climate, metrics, raster, sampling, spatial, terrain, world
from terrasig.plans.basics import CLEAN_SQL, raw_catalog
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables
from terrasig.plans.timeseries import FIRE_SQL, RANKED_AFTER, SPI_SQL, WORLD_SQL, ladder_of, near_season, recent_ranks
from terrasig.plans.views import seasonal_sql, with_views
from terrasig.streaming.tables import written
from terrasig.sources import catalog


@query(
    "agg_value_counts",
    with_views(
        "",
        "SELECT COALESCE(NULLIF(country_name, ''), '(blank)') AS value, COUNT(*) AS n FROM cat GROUP BY 1 ORDER BY n DESC, value LIMIT 12",
        *CLEAN_SQL,
    ),
)
def agg_value_counts(t: Tables) -> DataFrame:
    c = catalog.clean_catalog(raw_catalog(t))
    named = F.coalesce(F.nullif(F.col("country_name"), F.lit("")), F.lit("(blank)"))
    return c.groupBy(named.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(12)


@query(
    "agg_catalog_profile",
    with_views(
        "",
        """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)) AS n_geo,
           COUNT(DISTINCT event_date_iso) AS distinct_dates, MIN(event_date_iso) AS first_date, MAX(event_date_iso) AS last_date,
           COUNT(DISTINCT NULLIF(country_name, '')) AS countries FROM cat""",
        *CLEAN_SQL,
    ),
)
def agg_catalog_profile(t: Tables) -> DataFrame:
    return catalog.profile(catalog.clean_catalog(raw_catalog(t)))


@query("agg_year_hist", with_views("event", "SELECT year(d) AS year, COUNT(*) AS n FROM event GROUP BY 1"))
def agg_year_hist(t: Tables) -> DataFrame:
    return t.event.groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"))


DENSITY_SQL = (
    ("dp", "SELECT CAST(floor((lat+9e1)/4e0) AS BIGINT) AS i, CAST(floor((lon+18e1)/4e0) AS BIGINT) AS j, id % 97 AS d FROM point"),
    (
        "dw",
        """SELECT a.i AS ai, a.j AS aj, COUNT(*) AS events, COUNT(DISTINCT p.d) AS dates, COUNT(DISTINCT p.i*100000 + p.j) AS occupied
           FROM (SELECT DISTINCT i, j FROM dp) a JOIN dp p ON p.i BETWEEN a.i AND a.i + 7 AND p.j BETWEEN a.j AND a.j + 7 GROUP BY 1, 2""",
    ),
)


def density(t: Tables) -> DataFrame:
    pts = t.point.select("lat", "lon", (F.col("id") % 97).alias("d"))
    return spatial.density_windows(pts, deg=4.0)


@query("density_windows", with_views("point", "SELECT ai, aj, events, dates, occupied FROM dw", *DENSITY_SQL))
def density_windows(t: Tables) -> DataFrame:
    return density(t).select("ai", "aj", "events", "dates", "occupied")


@query("density_pick")
def density_pick(t: Tables) -> DataFrame:
    return spatial.pick_windows(density(t), 8, "events")


@query(
    "agg_distribution",
    """SELECT l_returnflag AS grp, AVG(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 5e-1::DOUBLE) AS median, quantile_cont(l_extendedprice, 25e-2::DOUBLE) AS q25,
       quantile_cont(l_extendedprice, 75e-2::DOUBLE) AS q75, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1""".replace(
        "AVG(l_extendedprice)", "ROUND(AVG(l_extendedprice), 4)"
    ).replace("stddev_pop(l_extendedprice)", "ROUND(stddev_pop(l_extendedprice), 4)"),
)
def agg_distribution(t: Tables) -> DataFrame:
    from terrasig.operators import ranking

    li = t.read("lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    q = ranking.exact_quantiles(li, "l_extendedprice", (0.25, 0.5, 0.75), ["grp"])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    wide = q.groupBy("grp").agg(at(0.5).alias("median"), at(0.25).alias("q25"), at(0.75).alias("q75"))
    base = li.groupBy("grp").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("sd")
    )
    return base.join(wide, "grp")


@query(
    "agg_extent",
    with_views(
        "point",
        """SELECT segment, ROUND(quantile_cont(lon, 5e-3::DOUBLE) - 15e-2, 6) AS x0, ROUND(quantile_cont(lat, 5e-3::DOUBLE) - 15e-2, 6) AS y0,
           ROUND(quantile_cont(lon, 995e-3::DOUBLE) + 15e-2, 6) AS x1, ROUND(quantile_cont(lat, 995e-3::DOUBLE) + 15e-2, 6) AS y1 FROM point GROUP BY 1""",
    ),
)
def agg_extent(t: Tables) -> DataFrame:
    from terrasig.operators import ranking

    def edge(c: str, lo: str, hi: str) -> DataFrame:
        q = ranking.exact_quantiles(t.point.select("segment", c), c, (0.005, 0.995), ["segment"])
        low, high = F.min("quantile") - 0.15, F.max("quantile") + 0.15
        return q.groupBy("segment").agg(F.round(low, 6).alias(lo), F.round(high, 6).alias(hi))

    return edge("lon", "x0", "x1").join(edge("lat", "y0", "y1"), "segment")


@query(
    "zonal_sum",
    with_views(
        "point",
        """SELECT GREATEST(0, LEAST(360, CAST(floor((lat+9e1+25e-2)/5e-1) AS BIGINT))) AS world_i,
           CAST(floor((lon+18e1+3125e-4)/625e-3) AS BIGINT) % 576 AS world_j, ROUND(SUM(people), 2) AS people FROM point GROUP BY 1, 2""",
    ),
)
def zonal_sum(t: Tables) -> DataFrame:
    return spatial.zonal_sum(t.point, "people").withColumn("people", F.round("people", 2))


# ---- soil rasters

SOIL_SQL = (
    (
        "px",
        """SELECT CAST(floor(la/2e0)*2 AS BIGINT) AS tile_lat, CAST(floor(lo/2e0)*2 AS BIGINT) AS tile_lon,
             GREATEST(0, LEAST(7, CAST(floor((floor(la/2e0)*2e0 + 2e0 - la)/25e-2) AS INTEGER))) AS row,
             GREATEST(0, LEAST(7, CAST(floor((lo - floor(lo/2e0)*2e0)/25e-2) AS INTEGER))) AS col, prop, depth, MAX(v) AS value
           FROM (SELECT ((l_partkey*7919) % 11000)/1e2 - 55e0 AS la, ((l_partkey*104729) % 36000)/1e2 - 180e0 AS lo,
             ['clay', 'sand', 'bdod', 'cfvo'][CAST(l_suppkey % 4 + 1 AS BIGINT)] AS prop, ['0-5cm', '5-15cm', '15-30cm'][CAST(l_orderkey % 3 + 1 AS BIGINT)] AS depth,
             CASE WHEN l_quantity > 3 THEN l_quantity*4e0 - 12e0 ELSE 0e0 END AS v FROM lineitem) GROUP BY 1, 2, 3, 4, 5, 6""",
    ),
    (
        "dm",
        "SELECT tile_lat, tile_lon, row, col, "
        + ", ".join(
            f"SUM(CASE WHEN prop = '{p}' THEN value*w END)/SUM(CASE WHEN prop = '{p}' THEN w END)/{int(d)}e0 AS {p}"
            for p, d in raster.UNIT_DIVISOR.items()
        )
        + " FROM (SELECT *, CASE depth WHEN '0-5cm' THEN 5e0 WHEN '5-15cm' THEN 10e0 ELSE 15e0 END AS w FROM px) GROUP BY 1, 2, 3, 4",
    ),
)


def soil_pixels(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    raw = t.read("lineitem").select(
        (((k * 7919) % 11000) / 100.0 - 55.0).alias("lat"),
        (((k * 104729) % 36000) / 100.0 - 180.0).alias("lon"),
        pick(("clay", "sand", "bdod", "cfvo"), F.col("l_suppkey") % 4).alias("prop"),
        pick(("0-5cm", "5-15cm", "15-30cm"), F.col("l_orderkey") % 3).alias("depth"),
        F.when(F.col("l_quantity") > 3, F.col("l_quantity") * 4.0 - 12.0).otherwise(0.0).alias("v"),
    )
    keyed = raw.withColumns(raster.pixel_of(F.col("lat"), F.col("lon"), 8))
    return keyed.groupBy("tile_lat", "tile_lon", "row", "col", "prop", "depth").agg(F.max("v").alias("value"))


_PX = ["tile_lat", "tile_lon", "row", "col"]


@query(
    "weighted_mean",
    with_views("", "SELECT tile_lat, tile_lon, row, col, ROUND(clay, 9) AS clay, ROUND(sand, 9) AS sand, ROUND(bdod, 9) AS bdod, ROUND(cfvo, 9) AS cfvo FROM dm", *SOIL_SQL),
)
def weighted_mean(t: Tables) -> DataFrame:
    m = raster.depth_mean(soil_pixels(t), _PX)
    return m.withColumns({p: F.round(p, 9) for p in raster.UNIT_DIVISOR})


@query(
    "raster_sample",
    with_views(
        "point",
        """SELECT p.id, CASE WHEN clay > 0 AND sand > 0 THEN ROUND(clay, 9) END AS clay_pct, CASE WHEN clay > 0 AND sand > 0 THEN ROUND(1e2 - clay - sand, 9) END AS silt_pct,
           CASE WHEN clay > 0 AND sand > 0 THEN ROUND(cfvo, 9) END AS cfvo_pct FROM point p LEFT JOIN dm ON tile_lat = CAST(floor(lat/2e0)*2 AS BIGINT) AND tile_lon = CAST(floor(lon/2e0)*2 AS BIGINT)
             AND row = GREATEST(0, LEAST(7, CAST(floor((floor(lat/2e0)*2e0 + 2e0 - lat)/25e-2) AS INTEGER))) AND col = GREATEST(0, LEAST(7, CAST(floor((lon - floor(lon/2e0)*2e0)/25e-2) AS INTEGER)))""",
        *SOIL_SQL,
    ),
)
def raster_sample(t: Tables) -> DataFrame:
    soil = raster.soil_features(raster.depth_mean(soil_pixels(t), _PX))
    s = raster.sample(t.point.select("id", "lat", "lon"), soil, 8)
    return s.select("id", *[F.round(c, 9).alias(c) for c in ("clay_pct", "silt_pct", "cfvo_pct")])


# ---- terrain


def patches(t: Tables) -> DataFrame:
    """Patches with holes at pseudo-random pixels and a latitude."""
    holed = F.transform("z", lambda x, i: F.when((F.col("id") + i) % 37 != 0, x))
    return t.patch.select(
        "id", "region", (((F.col("id") * 7919) % 11000) / 100.0 - 55.0).alias("lat"), holed.alias("z")
    )


def terrain_table(t: Tables) -> DataFrame:
    df = terrain.derive(patches(t), 8, 8, arcsec=1.0).drop("z")
    return df.withColumn("label", F.when(F.col("id") % 3 == 0, 1).otherwise(0))


_C = {(a, b): f"COALESCE(z[{(3 + a) * 8 + 3 + b + 1}], med)" for a in range(3) for b in range(3)}
TERRAIN_SQL = (
    (
        "tz",
        """SELECT id, region, ((id*7919) % 11000)/1e2 - 55e0 AS lat, list_transform(z, lambda x, i: CASE WHEN (id + i - 1) % 37 <> 0 THEN x END) AS z FROM patch""",
    ),
    (
        "ty",
        """SELECT *, list_aggregate(ok, 'median') AS med, list_avg(ok) AS mean, 11132e1/36e2 AS dy, 11132e1/36e2*cos(radians(lat)) AS dx
           FROM (SELECT *, list_filter(z, lambda x: x IS NOT NULL) AS ok FROM tz)""",
    ),
    (
        "tx",
        f"""SELECT *, (({_C[0, 2]} + 2*{_C[1, 2]} + {_C[2, 2]}) - ({_C[0, 0]} + 2*{_C[1, 0]} + {_C[2, 0]}))/(8*dx) AS gx,
            (({_C[2, 0]} + 2*{_C[2, 1]} + {_C[2, 2]}) - ({_C[0, 0]} + 2*{_C[0, 1]} + {_C[0, 2]}))/(8*dy) AS gy FROM ty""",
    ),
    (
        "ter",
        f"""SELECT id, region, lat, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS label, {_C[1, 1]} AS elev_m, degrees(atan(sqrt(gx*gx + gy*gy))) AS slope_deg, sin(atan2(gy, -gx)) AS aspect_sin, cos(atan2(gy, -gx)) AS aspect_cos,
            (({_C[1, 0]} - 2*{_C[1, 1]} + {_C[1, 2]})/(dx*dx) + ({_C[0, 1]} - 2*{_C[1, 1]} + {_C[2, 1]})/(dy*dy))*1e4 AS curvature,
            ({' + '.join(f'abs({v} - {_C[1, 1]})' for v in _C.values())})/9e0 AS tri, list_aggregate(ok, 'stddev_pop') AS roughness_std,
            list_max(ok) - list_min(ok) AS relief_range, {_C[1, 1]} - mean AS tpi FROM tx WHERE len(ok) >= 32""",
    ),
)


def rounded(df: DataFrame, cols, n: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def round_sql(cols, n: int) -> str:
    return ", ".join(f"ROUND({c}, {n}) AS {c}" for c in cols)


@query("terrain_derive", with_views("patch", f"SELECT id, {round_sql(terrain.FEATURES, 6)} FROM ter", *TERRAIN_SQL))
def terrain_derive(t: Tables) -> DataFrame:
    return rounded(terrain_table(t), terrain.FEATURES, 6).select("id", *terrain.FEATURES)


@query(
    "flt_land",
    with_views("patch", "SELECT id FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 0e0 ELSE elev_m END AS elev_m, CASE WHEN id % 8 = 0 THEN 5e-2 ELSE roughness_std END AS roughness_std FROM ter) WHERE NOT (elev_m <= 5e-1 AND roughness_std < 1e-1)", *TERRAIN_SQL),
)
def flt_land(t: Tables) -> DataFrame:
    flat = terrain_table(t).withColumns(
        {
            "elev_m": F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("elev_m")),
            "roughness_std": F.when(F.col("id") % 8 == 0, 0.05).otherwise(F.col("roughness_std")),
        }
    )
    return terrain.on_land(flat).select("id")


@query(
    "band_enrichment",
    with_views(
        "patch",
        """SELECT band, n_pos, n_bg, ROUND(CAST(n_pos AS DOUBLE)/SUM(n_pos) OVER (), 9) AS share_pos, ROUND(CAST(n_bg AS DOUBLE)/SUM(n_bg) OVER (), 9) AS share_bg,
             ROUND((CAST(n_pos AS DOUBLE)/SUM(n_pos) OVER ())/NULLIF(CAST(n_bg AS DOUBLE)/SUM(n_bg) OVER (), 0), 6) AS enrichment FROM (
           SELECT CAST(floor(slope_deg/5e0) AS BIGINT) AS band, COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_bg FROM ter GROUP BY 1)""",
        *TERRAIN_SQL,
    ),
)
def band_enrichment(t: Tables) -> DataFrame:
    df = terrain_table(t).groupBy(F.floor(F.col("slope_deg") / 5.0).alias("band")).agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_bg")
    )
    every = Window.partitionBy()
    pos, bg = F.col("n_pos") / F.sum("n_pos").over(every), F.col("n_bg") / F.sum("n_bg").over(every)
    return df.select(
        "band",
        "n_pos",
        "n_bg",
        F.round(pos, 9).alias("share_pos"),
        F.round(bg, 9).alias("share_bg"),
        F.round(pos / F.nullif(bg, F.lit(0.0)), 6).alias("enrichment"),
    )


@query(
    "covariate_shift",
    with_views(
        "patch",
        " UNION ALL ".join(
            f"""SELECT '{f}' AS feature, ROUND((SELECT AVG({f}) FROM ter WHERE region < 'r5'), 6) AS train_mean, ROUND(AVG({f}), 6) AS test_mean,
            ROUND(AVG(CASE WHEN {f} < (SELECT quantile_cont({f}, 5e-2::DOUBLE) FROM ter WHERE region < 'r5') OR {f} > (SELECT quantile_cont({f}, 95e-2::DOUBLE) FROM ter WHERE region < 'r5') THEN 1e0 ELSE 0e0 END), 6) AS outside_5_95
            FROM ter WHERE region >= 'r5'"""
            for f in ("elev_m", "slope_deg", "tri")
        ),
        *TERRAIN_SQL,
    ),
)
def covariate_shift(t: Tables) -> DataFrame:
    df = terrain_table(t)
    out = metrics.covariate_shift(df.filter(F.col("region") < "r5"), df.filter(F.col("region") >= "r5"), ["elev_m", "slope_deg", "tri"])
    return rounded(out, ("train_mean", "test_mean", "outside_5_95"), 6)


@query(
    "unseen_class_mass",
    """SELECT AVG(CASE WHEN p_size % 16 IN (SELECT p_size % 16 FROM part WHERE p_brand <> 'Brand#1' AND p_size % 16 < 12) THEN 0e0 ELSE 1e0 END) AS unseen_mass FROM part WHERE p_brand = 'Brand#1'""",
)
def unseen_class_mass(t: Tables) -> DataFrame:
    p = t.read("part").select("p_brand", (F.col("p_size") % 16).alias("code"))
    seen = p.filter((F.col("p_brand") != "Brand#1") & (F.col("code") < 12)).select("code").distinct()
    test = p.filter(F.col("p_brand") == "Brand#1")
    known = test.join(seen.withColumn("k", F.lit(1)), "code", "left")
    return known.agg(F.avg(F.when(F.col("k").isNull(), 1.0).otherwise(0.0)).alias("unseen_mass"))


@query(
    "missingness_confound",
    """SELECT * FROM (SELECT AVG(m) AS missing_rate, AVG(CASE WHEN y = 1 THEN m END) AS missing_rate_positives, AVG(CASE WHEN y = 0 THEN m END) AS missing_rate_background,
       ROUND(AVG(CASE WHEN m = 1 THEN e END), 4) AS mean_cov_missing, ROUND(AVG(CASE WHEN m = 0 THEN e END), 4) AS mean_cov_present FROM (
       SELECT CASE WHEN l_tax = 0 THEN 1e0 ELSE 0e0 END AS m, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS e FROM lineitem)),
       (SELECT CAST(SUM(CASE WHEN p.m > q.m THEN p.n*q.n*1e0 WHEN p.m = q.m THEN p.n*q.n*5e-1 ELSE 0e0 END)/SUM(p.n*q.n) AS DOUBLE) AS roc_of_missingness FROM
         (SELECT CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS m, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) p,
         (SELECT CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS m, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) q)""",
)
def missingness_confound(t: Tables) -> DataFrame:
    df = t.read("lineitem").select(
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("clay"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_extendedprice").alias("elev"),
    )
    out = metrics.missingness(df, "clay", "label", "elev")
    return rounded(out, ("mean_cov_missing", "mean_cov_present"), 4)


@query(
    "feature_coverage",
    with_views(
        "daily",
        " UNION ALL ".join(
            f"SELECT cell, '{c}' AS feature, CAST(COUNT({c}) AS DOUBLE)/COUNT(*) AS coverage FROM daily GROUP BY 1"
            for c in ("precip", "tmax", "rh", "ws")
        ),
    ),
)
def feature_coverage(t: Tables) -> DataFrame:
    return metrics.feature_coverage(t.daily, ["precip", "tmax", "rh", "ws"], ["cell"])


@query(
    "dedupe_cell",
    with_views("point", "SELECT id, segment FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY floor(lat/5e0), floor(lon/5e0) ORDER BY id) AS rn FROM point) WHERE rn = 1"),
)
def dedupe_cell(t: Tables) -> DataFrame:
    return sampling.dedupe_locations(t.point, F.col("id"), deg=5.0).select("id", "segment")


@query(
    "rank_pct_avg",
    """SELECT id, grp, (rk + (c - 1)/2e0)/n AS pct FROM (SELECT c_custkey AS id, c_nationkey AS grp, RANK() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal/1e2)) AS rk,
       COUNT(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal/1e2)) AS c, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""",
)
def rank_pct_avg(t: Tables) -> DataFrame:
    c = t.read("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), F.floor(F.col("c_acctbal") / 100.0).alias("v")
    )
    return metrics.rank_pct(c, "v", "pct", ["grp"]).select("id", "grp", "pct")


# ---- events, panels, status


@query(
    "event_days",
    with_views(
        "daily event_day",
        """SELECT d.cell, COUNT(*) AS cell_days, COUNT(e.cell) AS event_days, CAST(COUNT(e.cell) AS DOUBLE)/COUNT(*) AS base_rate
           FROM daily d LEFT JOIN event_day e ON e.cell = d.cell AND e.d = d.d GROUP BY 1""",
    ),
)
def event_days(t: Tables) -> DataFrame:
    hit = t.event_day.withColumn("hit", F.lit(1))
    return t.daily.select("cell", "d").join(hit, ["cell", "d"], "left").groupBy("cell").agg(
        F.count(F.lit(1)).alias("cell_days"),
        F.count("hit").alias("event_days"),
        (F.count("hit") / F.count(F.lit(1))).alias("base_rate"),
    )


PANEL_SQL = (
    *SPI_SQL,
    (
        "panel",
        """SELECT t.fips, t.d, t.d2 AS d2_area, (t.d1 + t.d2 + t.d3 + t.d4)/4e0 AS severity, CASE WHEN t.d2 >= 5e1 THEN 1 ELSE 0 END AS label,
           s.spi30, s.spi90, s.spi180, s.spi365, s.spi90_trend_8w FROM truth t JOIN spi s ON s.cell = t.fips AND s.d = t.d""",
    ),
)


def panel(t: Tables) -> DataFrame:
    return climate.drought_panel(t.truth, climate.spi_features(t.daily, every=7))  # the weeks of the truth


@query(
    "drought_panel",
    with_views("roll truth", "SELECT * REPLACE (ROUND(severity, 6) AS severity) FROM panel", *PANEL_SQL),
)
def drought_panel(t: Tables) -> DataFrame:
    return rounded(panel(t), ["severity"], 6)


@query(
    "status_counts",
    """SELECT s.status, COUNT(o.o_orderkey) AS n FROM (SELECT UNNEST(['red', 'yellow', 'green', 'unknown']) AS status) s
       LEFT JOIN orders o ON CASE o.o_orderstatus WHEN 'F' THEN 'red' WHEN 'O' THEN 'green' ELSE 'unknown' END = s.status GROUP BY 1""",
)
def status_counts(t: Tables) -> DataFrame:
    from terrasig.operators import serving

    status = F.when(F.col("o_orderstatus") == "F", "red").when(F.col("o_orderstatus") == "O", "green").otherwise("unknown")
    return serving.status_counts(t.read("orders").select(status.alias("status")))


# ---- world fields


EXPOSURE_SQL = (
    *WORLD_SQL,
    (
        "wp",
        """SELECT cell, d, MAX(CASE WHEN signal='rain3d' THEN pctl END) AS rain3d, MAX(CASE WHEN signal='rain30d' THEN pctl END) AS rain30d, MAX(CASE WHEN signal='vpd' THEN pctl END) AS vpd,
           MAX(CASE WHEN signal='kbdi' THEN pctl END) AS kbdi, MAX(CASE WHEN signal='spi90' THEN pctl END) AS spi90 FROM wrank GROUP BY 1, 2""",
    ),
    (
        "wa",
        """SELECT cell, d, rain3d, rain30d, vpd, kbdi, spi90, COALESCE(rain3d >= 98e-2, FALSE) OR COALESCE(rain30d >= 98e-2, FALSE) AS landslide_rain,
           COALESCE(vpd >= 95e-2 AND kbdi >= 90e-2, FALSE) AS fire, COALESCE(spi90 <= 5e-2, FALSE) AS drought FROM wp""",
    ),
    (
        "wl",
        """SELECT cell, d, 'landslide_rain' AS alert, landslide_rain AS flag, rain3d AS extreme FROM wa UNION ALL SELECT cell, d, 'fire', fire, vpd FROM wa
           UNION ALL SELECT cell, d, 'drought', drought, -spi90 FROM wa""",
    ),
)


def world_alerts(t: Tables) -> DataFrame:
    return world.alerts(recent_ranks(t, ["rain3d", "rain30d", "vpd", "kbdi", "spi90"]))


@query(
    "world_score",
    with_views("roll", f"SELECT cell, d, landslide_rain, fire, drought, {round_sql(('rain3d', 'rain30d', 'vpd', 'kbdi', 'spi90'), 9)} FROM wa", *EXPOSURE_SQL),
    once=True,
)
def world_score(t: Tables) -> DataFrame:
    return rounded(world_alerts(t), ("rain3d", "rain30d", "vpd", "kbdi", "spi90"), 9).select(
        "cell", "d", "landslide_rain", "fire", "drought", "rain3d", "rain30d", "vpd", "kbdi", "spi90"
    )


@query(
    "alert_exposure",
    with_views(
        "roll place",
        """SELECT d, alert, COUNT(*) FILTER (WHERE flag) AS cells, CAST(ROUND(SUM(CASE WHEN flag THEN p.people ELSE 0 END)) AS BIGINT) AS people,
             COALESCE(arg_max(w.cell, ROUND(extreme, 9)*1e6 - w.cell/1e6) FILTER (WHERE flag AND p.people > 1000), arg_max(w.cell, ROUND(extreme, 9)*1e6 - w.cell/1e6) FILTER (WHERE flag)) AS extreme_cell
           FROM wl w JOIN (SELECT id AS cell, GREATEST(0e0, bal) AS people FROM place) p USING (cell) GROUP BY 1, 2""",
        *EXPOSURE_SQL,
    ),
)
def alert_exposure(t: Tables) -> DataFrame:
    people = t.place.select(F.col("id").alias("cell"), F.greatest(F.lit(0.0), "bal").alias("people"))
    return world.exposure(world_alerts(t), people)


PARITY_SQL = (
    *WORLD_SQL,
    *[c for c in FIRE_SQL if c[0] not in {n for n, _ in WORLD_SQL}],
    ("pr_s", seasonal_sql("roll", {"p3d": "rain3d", "p30d": "rain30d", "p90d": "spi90"})),
    (
        "ppoint",
        """SELECT cell, d, 'rain3d' AS signal, rain3d AS point FROM pr_s UNION ALL SELECT cell, d, 'rain30d', rain30d FROM pr_s UNION ALL SELECT cell, d, 'spi90', spi90 FROM pr_s
           UNION ALL SELECT cell, d, 'kbdi', kbdi_pctl_seasonal FROM fire UNION ALL SELECT cell, d, 'vpd', vpd_pctl_seasonal FROM fire""",
    ),
)


@query(
    "parity_report",
    with_views(
        "roll",
        """SELECT signal, COUNT(*) AS n, ROUND(AVG(abs(w.pctl - p.point)), 6) AS mean_abs_diff, AVG(abs(w.pctl - p.point)) <= 1e-1 AS pass FROM wrank w JOIN ppoint p USING (signal, cell, d)
           WHERE p.point IS NOT NULL GROUP BY 1""",
        *PARITY_SQL,
    ),
    days=True,
)
def parity_report(t: Tables) -> DataFrame:
    from terrasig.operators import series

    signals = ["rain3d", "rain30d", "spi90", "kbdi", "vpd"]
    recent = F.col("d") > F.lit(RANKED_AFTER).cast("date")  # the days that the ladder ranks
    rows = climate.world_signals(t.daily, names=signals, only=near_season(t, RANKED_AFTER))
    ranked = series.pooled_percentiles(rows, "cell", "d", {s: f"_{s}" for s in signals}, missing_as={"kbdi": 0.0, "vpd": 0.0}, only=recent)
    spun_up = F.col("d") >= F.date_add(t.span[0], climate.YEAR_SPINUP)  # the series begin on one day and have no gaps
    point = ranked.select("cell", "d", *[(F.when(spun_up, F.col(f"_{s}")) if s in ("kbdi", "vpd") else F.col(f"_{s}")).alias(s) for s in signals])
    return world.parity(recent_ranks(t, signals), point, signals).withColumn(
        "mean_abs_diff", F.round("mean_abs_diff", 6)
    )


SEED_SQL = (
    *WORLD_SQL,
    (
        "seed",
        """SELECT cell, MAX(CASE WHEN signal = 'kbdi' AND fortnight = (LEAST((dayofyear(DATE '2001-11-04')-1)//14, 25) - 401//14 + 52) % 26 THEN q[11] END) AS q0,
           AVG(CASE WHEN signal = 'spi365' THEN q[11] END) AS r_annual FROM ladder GROUP BY 1""",
    ),
    (
        "vx",
        """SELECT d.cell, d.d, ROW_NUMBER() OVER (PARTITION BY d.cell ORDER BY d.d) AS rn, COALESCE(tmax, 15e0)*9e0/5e0 + 32e0 AS tf, COALESCE(precip, 0e0)/254e-1 AS r,
           1e0 + 1088e-2*exp(-441e-4*s.r_annual/254e-1) AS denom, s.q0 FROM daily d JOIN seed s ON s.cell = d.cell WHERE d.d BETWEEN DATE '2001-11-04' - 400 AND DATE '2001-11-04'""",
    ),
    (
        "vz",
        """SELECT CAST(0 AS BIGINT) AS rn, cell, 0e0 AS spell, COALESCE(q0, 0e0) AS q FROM (SELECT DISTINCT cell, q0 FROM vx)
           UNION ALL SELECT /*rec*/ y.rn, y.cell, CASE WHEN y.r > 0 THEN z.spell + y.r ELSE 0e0 END,
             LEAST(8e2, GREATEST(0e0, z.q - 1e2*CASE WHEN y.r <= 0 THEN 0e0 WHEN z.spell >= 2e-1 THEN y.r ELSE GREATEST(0e0, z.spell + y.r - 2e-1) END)
               + (8e2 - GREATEST(0e0, z.q - 1e2*CASE WHEN y.r <= 0 THEN 0e0 WHEN z.spell >= 2e-1 THEN y.r ELSE GREATEST(0e0, z.spell + y.r - 2e-1) END))
               * CASE WHEN y.tf > 5e1 THEN GREATEST(0e0, 968e-3*exp(486e-4*y.tf) - 83e-1)*1e-3/y.denom ELSE 0e0 END)
           FROM vz z JOIN vx y ON y.rn = z.rn + 1 AND y.cell = z.cell""",
    ),
    (
        "vs",
        """SELECT s.cell, s.d, s.signal, CASE WHEN s.signal = 'kbdi' THEN ROUND(z.q, 6) ELSE s.v END AS v, s.fortnight FROM sigl s LEFT JOIN vz z ON z.cell = s.cell AND z.rn = 401
           WHERE s.d = DATE '2001-11-04' AND (s.v IS NOT NULL OR s.signal = 'kbdi')""",
    ),
    (
        "vr",
        """SELECT signal, cell, d, CASE WHEN k = 0 THEN 0e0 WHEN k >= 21 THEN 1e0 ELSE (kc-1)*5e-2 + CASE WHEN q[kc+1] > q[kc] THEN GREATEST(0e0, LEAST(1e0, (v-q[kc])/(q[kc+1]-q[kc]))) ELSE 1e0 END*5e-2 END AS pctl
           FROM (SELECT s.signal, s.cell, s.d, s.v, l.q, len(list_filter(l.q, lambda x: x <= s.v)) AS k, GREATEST(1, LEAST(20, len(list_filter(l.q, lambda x: x <= s.v)))) AS kc
                 FROM vs s JOIN ladder l ON l.signal = s.signal AND l.cell = s.cell AND l.fortnight = s.fortnight)""",
    ),
)


@query("world_window", with_views("roll", "SELECT signal, cell, d, ROUND(pctl, 6) AS pctl FROM vr", *SEED_SQL), once=True)
def world_window(t: Tables) -> DataFrame:
    """The day's percentiles from the ladder, of which only what the window reads is taken and written, once."""
    day = F.lit("2001-11-04").cast("date")
    ladder = written(ladder_of(t, climate.world_signals(t.daily), world.read_by_window(F.col("d"), day)), "ladder")
    out = world.score_window(t.daily, ladder, day)
    return rounded(out, ["pctl"], 6)


@query(
    "case_studies",
    with_views(
        "event rain",
        """SELECT e.event_id, e.hazard, r.s3, r.s30, CASE e.hazard WHEN 'landslide' THEN GREATEST(r.s3, r.s30) >= 95e-2 WHEN 'fire' THEN r.s30 <= 20e-2 ELSE r.s30 <= 5e-2 END AS met
           FROM (SELECT *, ['landslide', 'fire', 'drought'][CAST(event_id % 3 + 1 AS BIGINT)] AS hazard FROM event) e LEFT JOIN rain r ON r.cell = e.cell AND r.d = e.d""",
    ),
)
def case_studies(t: Tables) -> DataFrame:
    """Expectations fixed before scoring, joined with the scores; misses stay in the table."""
    from terrasig.operators import serving

    hazard = F.element_at(F.array(F.lit("landslide"), F.lit("fire"), F.lit("drought")), (F.col("event_id") % 3 + 1).cast("int"))
    cases = t.event.withColumn("hazard", hazard)
    expect = (
        F.when(F.col("hazard") == "landslide", F.greatest("s3", "s30") >= 0.95)
        .when(F.col("hazard") == "fire", F.col("s30") <= 0.20)
        .otherwise(F.col("s30") <= 0.05)
    )
    return serving.case_table(cases, t.rain.select("cell", "d", "s3", "s30"), ["cell", "d"], expect).select(
        "event_id", "hazard", "s3", "s30", "met"
    )
