"""Scans, payload decoding, keys, filters, scalar families, set operations and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.functions import dates, geo, grids
from terrasig.operators import sampling
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables
from terrasig.plans.views import with_views
from terrasig.sources import catalog, payloads, sinks


def raw_catalog(t: Tables) -> DataFrame:
    """Catalogue text as it lands: bad numbers, (0, 0), impossible dates, blank countries."""
    k = F.col("c_custkey")
    lat = (((k * 7919) % 11000) / 100.0 - 55.0).cast("string")
    lon = (((k * 104729) % 36000) / 100.0 - 180.0).cast("string")
    seg = F.col("c_mktsegment")
    return t.read("customer").select(
        k.cast("string").alias("event_id"),
        F.when(k % 50 == 0, "n/a").when(k % 51 == 0, "0").otherwise(lat).alias("latitude"),
        F.when(k % 51 == 0, "0").otherwise(lon).alias("longitude"),
        F.when(k % 40 == 0, "253402300800000")
        .when(k % 41 == 0, "unknown")
        .otherwise((F.lit(820454400000) + k * 86400000 + 3600000).cast("string"))
        .alias("event_date"),
        F.when(k % 4 == 0, " exact").when(k % 4 == 1, "1km").when(k % 4 == 2, "5km").otherwise("25km").alias(
            "location_accuracy"
        ),
        F.when(k % 30 == 0, "").otherwise(seg).alias("country_name"),
    )


RAW_SQL = (
    "rawc",
    """SELECT CAST(c_custkey AS VARCHAR) AS event_id, CASE WHEN c_custkey % 50 = 0 THEN 'n/a' WHEN c_custkey % 51 = 0 THEN '0'
         ELSE CAST(((c_custkey*7919) % 11000)/1e2 - 55e0 AS VARCHAR) END AS latitude,
       CASE WHEN c_custkey % 51 = 0 THEN '0' ELSE CAST(((c_custkey*104729) % 36000)/1e2 - 180e0 AS VARCHAR) END AS longitude,
       CASE WHEN c_custkey % 40 = 0 THEN '253402300800000' WHEN c_custkey % 41 = 0 THEN 'unknown'
         ELSE CAST(820454400000 + c_custkey*86400000 + 3600000 AS VARCHAR) END AS event_date,
       CASE c_custkey % 4 WHEN 0 THEN ' exact' WHEN 1 THEN '1km' WHEN 2 THEN '5km' ELSE '25km' END AS location_accuracy,
       CASE WHEN c_custkey % 30 = 0 THEN '' ELSE c_mktsegment END AS country_name FROM customer""",
)
CLEAN_SQL = (
    RAW_SQL,
    (
        "cat",
        """SELECT *, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS lon,
             CASE WHEN TRY_CAST(event_date AS BIGINT) BETWEEN -2208988800000 AND 4133980799999
               THEN CAST(epoch_ms(TRY_CAST(event_date AS BIGINT)) AS DATE) END AS event_date_iso, trim(location_accuracy) AS accuracy FROM rawc""",
    ),
)


@query(
    "src_catalog_clean",
    with_views("", "SELECT event_id, lat, lon, event_date, event_date_iso, accuracy, country_name FROM cat", *CLEAN_SQL),
)
def src_catalog_clean(t: Tables) -> DataFrame:
    return catalog.clean_catalog(raw_catalog(t)).select(
        "event_id", "lat", "lon", "event_date", "event_date_iso", "accuracy", "country_name"
    )


@query(
    "src_epoch_date",
    with_views(
        "",
        """SELECT COUNT(*) AS n, COUNT(event_date_iso) AS n_dated,
           COUNT(*) FILTER (WHERE event_date IS NOT NULL AND event_date_iso IS NULL) AS n_unparseable FROM cat""",
        *CLEAN_SQL,
    ),
)
def src_epoch_date(t: Tables) -> DataFrame:
    return catalog.date_quality(catalog.clean_catalog(raw_catalog(t)))


def raw_fires(t: Tables) -> DataFrame:
    """Fire records with four date spellings and sizes on both sides of the cut."""
    k, d = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 3650)
    iso, us = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy")
    jd = (F.datediff(d, F.lit("1858-11-17").cast("date")) + 2400001).cast("string")
    return t.read("orders").select(
        k.alias("id"),
        (((k * 7919) % 11000) / 100.0 - 55.0).alias("lat"),
        (((k * 104729) % 36000) / 100.0 - 180.0).alias("lon"),
        (F.col("o_totalprice") / 1000.0).alias("size_acres"),
        F.year(d).alias("yr"),
        F.dayofyear(d).alias("doy"),
        F.when(k % 4 == 0, iso).when(k % 4 == 1, us).when(k % 4 == 2, jd).alias("ddate"),
        (F.col("o_totalprice") / 1000.0).cast("string").alias("size_ha"),
        F.when(k % 4 == 0, iso).when(k % 4 == 1, us).alias("rep_date"),
    )


FIRES_SQL = (
    "fires",
    """SELECT o_orderkey AS id, ((o_orderkey*7919) % 11000)/1e2 - 55e0 AS lat, ((o_orderkey*104729) % 36000)/1e2 - 180e0 AS lon,
       o_totalprice/1e3 AS size_acres, CAST(o_orderdate AS DATE) + 3650 AS date FROM orders""",
)


@query("src_mixed_dates", with_views("", "SELECT id, date FROM fires", FIRES_SQL))
def src_mixed_dates(t: Tables) -> DataFrame:
    f = raw_fires(t)
    return f.select("id", dates.mixed_date(F.col("ddate"), F.col("yr"), F.col("doy")).alias("date"))


@query(
    "src_fire_filter",
    with_views(
        "",
        """SELECT id, date, lat, lon, 'us' AS domain FROM fires WHERE size_acres >= 1e2 AND date BETWEEN DATE '2005-01-01' AND DATE '2010-12-31'
             AND NOT (abs(lat) < 1 AND abs(lon) < 1)
           UNION ALL SELECT id, date, lat, lon, 'canada' FROM fires WHERE size_acres >= 1e2 AND date BETWEEN DATE '2005-01-01' AND DATE '2010-12-31'
             AND id % 4 = 0 AND NOT (abs(lat) < 1 AND abs(lon) < 1)""",
        FIRES_SQL,
    ),
)
def src_fire_filter(t: Tables) -> DataFrame:
    until = F.lit("2010-12-31").cast("date")
    f = raw_fires(t)
    cols = ["id", "date", "lat", "lon"]
    us = catalog.us_fires(f, until).select(*cols, F.lit("us").alias("domain"))
    ca = catalog.canada_fires(f, until).select(*cols, F.lit("canada").alias("domain"))
    return us.unionByName(ca)


def payload(t: Tables) -> DataFrame:
    """One landed document per cell: parallel arrays and a date map, fill value -999 on some days."""
    v = F.when(F.col("n") % 3 == 0, F.lit(-999.0)).otherwise(F.col("qty"))
    days = F.array_sort(F.collect_list(F.struct(F.date_format("d", "yyyy-MM-dd").alias("k"), v.alias("v"))))
    doc = t.cell_day.groupBy("cell").agg(days.alias("days"))
    compact = F.transform("days", lambda x: F.struct(F.replace(x.k, F.lit("-"), F.lit("")).alias("k"), x.v.alias("v")))
    return doc.select(
        "cell",
        F.col("days.k").alias("time"),
        F.col("days.v").alias("precip"),
        F.to_json(F.map_from_entries(compact)).alias("parameter"),
    )


@query(
    "src_arrays_to_long",
    with_views("cell_day", "SELECT cell, d, CASE WHEN n % 3 <> 0 THEN qty END AS precip FROM cell_day"),
)
def src_arrays_to_long(t: Tables) -> DataFrame:
    return payloads.arrays_to_long(payload(t), ["cell"], "time", ["precip"])


@query(
    "src_map_explode",
    with_views("cell_day", "SELECT cell, d, CASE WHEN n % 3 <> 0 THEN qty END AS v FROM cell_day"),
)
def src_map_explode(t: Tables) -> DataFrame:
    return payloads.map_to_rows(payload(t), ["cell"], "parameter", "v")


@query(
    "src_union_years",
    with_views(
        "river_day", "SELECT cell, d, m3s, CASE WHEN year(d) >= 1998 THEN 'v5' END AS version FROM river_day"
    ),
)
def src_union_years(t: Tables) -> DataFrame:
    flow = t.river_day.select("cell", "d", "m3s")
    old = flow.filter(F.year("d") < 1998)
    new = flow.filter(F.year("d") >= 1998).withColumn("version", F.lit("v5"))
    return payloads.union_all([old, new])


@query(
    "src_nested_explode",
    """SELECT l_orderkey AS way, ((l_partkey*7919) % 11000)/1e2 - 55e0 AS lat, ((l_suppkey*104729) % 36000)/1e2 - 180e0 AS lon FROM lineitem""",
)
def src_nested_explode(t: Tables) -> DataFrame:
    vertex = F.struct(
        (((F.col("l_partkey") * 7919) % 11000) / 100.0 - 55.0).alias("lat"),
        (((F.col("l_suppkey") * 104729) % 36000) / 100.0 - 180.0).alias("lon"),
    )
    doc = t.read("lineitem").select(
        F.col("l_orderkey").alias("way"), F.array(F.struct(F.array(vertex).alias("geometry"))).alias("elements")
    )
    return payloads.nested_vertices(doc, ["way"], "elements")


@query(
    "pop_pixel_clean",
    "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0e0 END AS people FROM customer",
)
def pop_pixel_clean(t: Tables) -> DataFrame:
    px = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("people"))
    return payloads.clean_pixels(px, "people")


@query(
    "panel_min_weeks",
    """SELECT s_suppkey AS fips, CAST(l_shipdate AS DATE) AS d, l_quantity AS d2 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
       WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING COUNT(*) >= 600)""",
)
def panel_min_weeks(t: Tables) -> DataFrame:
    li = t.read("lineitem").select(F.col("l_suppkey").alias("fips"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("d2"))
    return sampling.keys_with_at_least(li, ["fips"], 600)


# ---- predicates and keys


@query(
    "flt_valid_coord",
    with_views(
        "",
        """SELECT event_id, lat, lon FROM cat WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)""",
        *CLEAN_SQL,
    ),
)
def flt_valid_coord(t: Tables) -> DataFrame:
    return catalog.usable(catalog.clean_catalog(raw_catalog(t))).select("event_id", "lat", "lon")


@query(
    "flt_null_island",
    with_views(
        "point",
        """SELECT segment, COUNT(*) FILTER (WHERE NOT (abs(lat) < 1 AND abs(lon) < 1)) AS kept,
           COUNT(*) FILTER (WHERE abs(lat) < 1 AND abs(lon) < 1) AS dropped FROM point GROUP BY 1""",
    ),
)
def flt_null_island(t: Tables) -> DataFrame:
    near = geo.near_null_island(F.col("lat"), F.col("lon"))
    return t.point.groupBy("segment").agg(F.count_if(~near).alias("kept"), F.count_if(near).alias("dropped"))


@query(
    "flt_bbox",
    with_views("point", "SELECT id, lat, lon FROM point WHERE lon BETWEEN -125 AND 20 AND lat BETWEEN -20 AND 50"),
)
def flt_bbox(t: Tables) -> DataFrame:
    return t.point.filter(F.col("lon").between(-125, 20) & F.col("lat").between(-20, 50)).select("id", "lat", "lon")


@query(
    "flt_accuracy",
    with_views("", "SELECT event_id, accuracy FROM cat WHERE accuracy IN ('exact', '1km')", *CLEAN_SQL),
)
def flt_accuracy(t: Tables) -> DataFrame:
    c = catalog.clean_catalog(raw_catalog(t))
    return c.filter(F.col("accuracy").isin(*catalog.TRUSTED_TERRAIN)).select("event_id", "accuracy")


@query(
    "cell_assign",
    with_views(
        "point",
        """SELECT id, CAST(floor(lat/1e-2) AS BIGINT) AS snap_i, CAST(floor(lon/1e-2) AS BIGINT) AS snap_j,
           CAST(floor((lat+9e1)/25e-2) AS BIGINT) AS off_i, CAST(floor((lon+18e1)/25e-2) AS BIGINT) AS off_j,
           ROUND(round_even(lat/5e-1, 0)*5e-1, 2) AS wx_lat, ROUND(round_even(lon/5e-1, 0)*5e-1, 2) AS wx_lon,
           GREATEST(0, LEAST(360, CAST(floor((lat+9e1+25e-2)/5e-1) AS BIGINT))) AS world_i,
           CAST(floor((lon+18e1+3125e-4)/625e-3) AS BIGINT) % 576 AS world_j,
           CAST(floor(lat/6e0)*6 AS BIGINT) AS tile_lat, CAST(floor(lon/6e0)*6 AS BIGINT) AS tile_lon FROM point""",
    ),
)
def cell_assign(t: Tables) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    off, world = grids.offset_cell(lat, lon, 0.25), grids.world_cell(lat, lon)
    return t.point.select(
        "id",
        grids.snap(lat, 0.01).alias("snap_i"),
        grids.snap(lon, 0.01).alias("snap_j"),
        off[0].alias("off_i"),
        off[1].alias("off_j"),
        grids.weather_cell(lat, 0.5).alias("wx_lat"),
        grids.weather_cell(lon, 0.5).alias("wx_lon"),
        world[0].alias("world_i"),
        world[1].alias("world_j"),
        grids.tile(lat, 6.0).alias("tile_lat"),
        grids.tile(lon, 6.0).alias("tile_lon"),
    )


@query(
    "spatial_block",
    with_views(
        "point",
        "SELECT id, CAST(floor(lat/25e-2) AS BIGINT) || '_' || CAST(floor(lon/25e-2) AS BIGINT) AS block_id FROM point",
    ),
)
def spatial_block(t: Tables) -> DataFrame:
    return t.point.select("id", grids.block_id(F.col("lat"), F.col("lon")).alias("block_id"))


@query(
    "stratum_key",
    with_views(
        "event point",
        """SELECT e.event_id, printf('%.4f_%.4f_', p.lat, p.lon) || CAST(e.d AS VARCHAR) AS stratum FROM event e JOIN point p ON p.id = e.cell""",
    ),
)
def stratum_key(t: Tables) -> DataFrame:
    e = t.event.join(t.point.select(F.col("id").alias("cell"), "lat", "lon"), "cell")
    return e.select("event_id", sampling.stratum_id(F.col("lat"), F.col("lon"), F.col("d")).alias("stratum"))


def geohash_sql() -> str:
    return with_views(
        "place",
        "SELECT id, "
        + " || ".join(
            "substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + "
            + " + ".join(
                f"((({'x' if (5 * c + b) % 2 == 0 else 'y'} >> {(17 if (5 * c + b) % 2 == 0 else 16) - (5 * c + b) // 2}) & 1) * {1 << (4 - b)})"
                for b in range(5)
            )
            + " AS BIGINT), 1)"
            for c in range(7)
        )
        + """ AS geohash FROM (SELECT id, CAST(floor((lon+18e1)/36e1*262144) AS BIGINT) AS x, CAST(floor((lat+9e1)/18e1*131072) AS BIGINT) AS y FROM place)""",
    )


@query("geohash_key", geohash_sql())
def geohash_key(t: Tables) -> DataFrame:
    return t.place.select("id", grids.geohash7(F.col("lat"), F.col("lon")).alias("geohash"))


@query(
    "prune_features",
    """SELECT f AS feature, n, n_distinct FROM (
       SELECT 'l_quantity' AS f, COUNT(l_quantity) AS n, COUNT(DISTINCT l_quantity) AS n_distinct FROM lineitem
       UNION ALL SELECT 'l_tax', COUNT(l_tax), COUNT(DISTINCT l_tax) FROM lineitem
       UNION ALL SELECT 'l_discount', COUNT(l_discount), COUNT(DISTINCT l_discount) FROM lineitem) WHERE n_distinct > 1""",
)
def prune_features(t: Tables) -> DataFrame:
    li = t.read("lineitem").withColumn("constant", F.lit(1.0)).withColumn("empty", F.lit(None).cast("double"))
    return sampling.informative_features(li, ["l_quantity", "l_tax", "l_discount", "constant", "empty"])


@query(
    "unit_convert",
    with_views(
        "daily",
        """SELECT cell, d, tmax*9e0/5e0 + 32e0 AS tmax_f, precip/254e-1 AS rain_in, ws*28316846592e-12 AS m3s,
           rh/1e1 AS clay_pct, ws/1e1 AS sand_pct, 1e2 - rh/1e1 - ws/1e1 AS silt_pct FROM daily""",
    ),
)
def unit_convert(t: Tables) -> DataFrame:
    return t.daily.select(
        "cell",
        "d",
        (F.col("tmax") * 9.0 / 5.0 + 32.0).alias("tmax_f"),
        (F.col("precip") / 25.4).alias("rain_in"),
        (F.col("ws") * 0.028316846592).alias("m3s"),
        (F.col("rh") / 10.0).alias("clay_pct"),
        (F.col("ws") / 10.0).alias("sand_pct"),
        (100.0 - F.col("rh") / 10.0 - F.col("ws") / 10.0).alias("silt_pct"),
    )


@query(
    "lon_normalise",
    with_views(
        "point",
        """SELECT id, ROUND(CASE WHEN lon < 0 THEN lon + 36e1 ELSE lon END, 6) AS lon360, ROUND(lon, 6) AS lon180 FROM point""",
    ),
)
def lon_normalise(t: Tables) -> DataFrame:
    east = grids.lon360(F.col("lon"))
    return t.point.select("id", F.round(east, 6).alias("lon360"), F.round(grids.lon180(east), 6).alias("lon180"))


# ---- scalar families


@query(
    "haversine",
    with_views(
        "place",
        """SELECT id, ROUND(2*6371000e0*asin(sqrt(pow(sin(radians(lat-1e1)/2),2)+cos(radians(lat))*cos(radians(1e1))*pow(sin(radians(lon-2e1)/2),2))), 3) AS metres,
           ROUND(2*63710088e-4*asin(sqrt(pow(sin(radians(lat-1e1)/2),2)+cos(radians(lat))*cos(radians(1e1))*pow(sin(radians(lon-179e0)/2),2))), 6) AS km FROM place""",
    ),
)
def haversine(t: Tables) -> DataFrame:
    lat, lon, c = F.col("lat"), F.col("lon"), F.lit
    return t.place.select(
        "id",
        F.round(geo.haversine_m(lat, lon, c(10.0), c(20.0)), 3).alias("metres"),
        F.round(geo.haversine_km(lat, lon, c(10.0), c(179.0)), 6).alias("km"),
    )


@query(
    "date_functions",
    with_views(
        "event",
        """SELECT event_id, d + 45 AS plus45, dayofyear(d) AS doy, date_trunc('month', d)::DATE AS month,
           CAST(d - DATE '1996-01-01' AS BIGINT) AS days, make_date(2001, month(d), CASE WHEN month(d) = 2 AND day(d) = 29 THEN 28 ELSE day(d) END) AS in_2001
           FROM event""",
    ),
)
def date_functions(t: Tables) -> DataFrame:
    return t.event.select(
        "event_id",
        F.date_add("d", 45).alias("plus45"),
        F.dayofyear("d").alias("doy"),
        F.trunc("d", "month").alias("month"),
        F.datediff("d", F.lit("1996-01-01").cast("date")).alias("days"),
        dates.same_day_in_year(F.col("d"), F.lit(2001)).alias("in_2001"),
    )


@query(
    "math_functions",
    """SELECT l_orderkey AS k, l_linenumber AS n, ROUND(exp(-l_discount), 9) AS e, ROUND(ln(l_extendedprice), 9) AS ln, ROUND(log10(l_extendedprice), 9) AS lg,
       ROUND(atan2(l_discount, l_tax + 1e-2), 9) AS at, ROUND(sqrt(l_tax*l_tax + l_discount*l_discount), 9) AS hyp, LEAST(4e1, GREATEST(5e0, l_quantity)) AS clip,
       l_quantity / NULLIF(l_tax, 0) AS safe FROM lineitem""",
)
def math_functions(t: Tables) -> DataFrame:
    c = F.col
    return t.read("lineitem").select(
        c("l_orderkey").alias("k"),
        c("l_linenumber").alias("n"),
        F.round(F.exp(-c("l_discount")), 9).alias("e"),
        F.round(F.log("l_extendedprice"), 9).alias("ln"),
        F.round(F.log10("l_extendedprice"), 9).alias("lg"),
        F.round(F.atan2(c("l_discount"), c("l_tax") + 0.01), 9).alias("at"),
        F.round(F.hypot("l_tax", "l_discount"), 9).alias("hyp"),
        F.least(F.lit(40.0), F.greatest(F.lit(5.0), c("l_quantity"))).alias("clip"),
        (c("l_quantity") / F.nullif(c("l_tax"), F.lit(0.0))).alias("safe"),
    )


@query(
    "string_functions",
    """SELECT c_custkey AS id, trim('  ' || c_name || ' ') AS trimmed, left(c_name, 8) AS head, printf('%.2f', c_acctbal) AS formatted,
       regexp_matches(c_name, '[0-9]{4}1') AS hit, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'debt' END, lower(c_mktsegment)) AS phrase FROM customer""",
)
def string_functions(t: Tables) -> DataFrame:
    return t.read("customer").select(
        F.col("c_custkey").alias("id"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
        F.substring("c_name", 1, 8).alias("head"),
        F.format_string("%.2f", "c_acctbal").alias("formatted"),
        F.col("c_name").rlike("[0-9]{4}1").alias("hit"),
        F.concat_ws("; ", F.when(F.col("c_acctbal") < 0, "debt"), F.lower("c_mktsegment")).alias("phrase"),
    )


@query(
    "array_functions",
    with_views(
        "patch",
        """SELECT id, list_max(z) AS zmax, list_min(z) AS zmin, ROUND(list_avg(z), 6) AS zmean, len(list_filter(z, lambda x: x > 500)) AS n_high,
           z[37] AS centre, list_sort(z)[1] AS lowest FROM patch""",
    ),
)
def array_functions(t: Tables) -> DataFrame:
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return t.patch.select(
        "id",
        F.array_max("z").alias("zmax"),
        F.array_min("z").alias("zmin"),
        F.round(total / F.size("z"), 6).alias("zmean"),
        F.size(F.filter("z", lambda x: x > 500.0)).alias("n_high"),
        F.element_at("z", 37).alias("centre"),
        F.element_at(F.sort_array("z"), 1).alias("lowest"),
    )


@query(
    "json_functions",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS v,
       CASE WHEN user_id % 2 = 0 THEN '{"event_type":"' || event_type || '","user_id":' || user_id || '}' ELSE '{"event_type":"' || event_type || '"}' END AS doc FROM events""",
)
def json_functions(t: Tables) -> DataFrame:
    sparse = F.struct("event_type", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user_id"))
    return t.read("events").select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.get_json_object(F.to_json(F.struct("value")), "$.value").cast("double").alias("v"),
        F.to_json(sparse).alias("doc"),
    )


@query(
    "rounding",
    """SELECT o_orderkey AS id, CAST(ROUND(o_totalprice) AS BIGINT) AS people, ROUND(o_totalprice/1e6, 3) AS r3, round_even(o_custkey/4e0, 0) AS half_even FROM orders""",
)
def rounding(t: Tables) -> DataFrame:
    return t.read("orders").select(
        F.col("o_orderkey").alias("id"),
        F.round("o_totalprice").cast("bigint").alias("people"),
        F.round(F.col("o_totalprice") / 1e6, 3).alias("r3"),
        F.bround(F.col("o_custkey") / 4.0, 0).alias("half_even"),
    )


@query(
    "dim_decode",
    """SELECT p_partkey AS id, p_size % 16 + 1 AS code, CASE p_size % 16 + 1 WHEN 1 THEN 'unconsolidated sediments' WHEN 2 THEN 'basic volcanic rocks'
       WHEN 3 THEN 'siliciclastic sedimentary rocks' WHEN 4 THEN 'basic plutonic rocks' WHEN 5 THEN 'mixed sedimentary rocks'
       WHEN 6 THEN 'carbonate sedimentary rocks' WHEN 7 THEN 'acid volcanic rocks' WHEN 8 THEN 'metamorphic rocks' WHEN 9 THEN 'acid plutonic rocks'
       WHEN 10 THEN 'intermediate volcanic rocks' WHEN 11 THEN 'water bodies' WHEN 12 THEN 'pyroclastics' WHEN 13 THEN 'intermediate plutonic rocks'
       WHEN 14 THEN 'evaporites' WHEN 15 THEN 'no data' WHEN 16 THEN 'ice and glaciers' END AS lith FROM part""",
)
def dim_decode(t: Tables) -> DataFrame:
    from terrasig.operators.raster import lithology

    parts = t.read("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 16 + 1).alias("code"))
    # the dimension is sixteen fixed rows
    return parts.join(F.broadcast(lithology(t.spark)), "code", "left").select("id", "code", F.col("name").alias("lith"))


# ---- sets and samples


@query(
    "set_union",
    with_views("point place", "SELECT id, lat, lon, people, 'point' AS kind FROM point UNION ALL SELECT id, lat, lon, NULL, 'place' FROM place"),
)
def set_union(t: Tables) -> DataFrame:
    a = t.point.select("id", "lat", "lon", "people", F.lit("point").alias("kind"))
    b = t.place.select("id", "lat", "lon", F.lit("place").alias("kind"))
    return payloads.union_all([a, b])


@query(
    "set_intersect",
    """SELECT date_trunc('month', l_shipdate)::DATE AS m FROM lineitem INTERSECT SELECT date_trunc('month', o_orderdate)::DATE FROM orders""",
)
def set_intersect(t: Tables) -> DataFrame:
    a = t.read("lineitem").select(F.trunc(F.to_date("l_shipdate"), "month").alias("m"))
    return a.intersect(t.read("orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("m")))


@query(
    "set_except",
    with_views(
        "point place",
        """SELECT CAST(floor(lat/6e0)*6 AS BIGINT) AS tile_lat, CAST(floor(lon/6e0)*6 AS BIGINT) AS tile_lon FROM point
           EXCEPT SELECT CAST(floor(lat/6e0)*6 AS BIGINT), CAST(floor(lon/6e0)*6 AS BIGINT) FROM place""",
    ),
)
def set_except(t: Tables) -> DataFrame:
    return sinks.still_to_do(tiles(t.point), tiles(t.place), ["tile_lat", "tile_lon"])


def tiles(df: DataFrame) -> DataFrame:
    return df.select(
        grids.tile(F.col("lat"), 6.0).alias("tile_lat"), grids.tile(F.col("lon"), 6.0).alias("tile_lon")
    ).distinct()


@query(
    "set_distinct_tiles",
    with_views("point", "SELECT DISTINCT CAST(floor(lat/6e0)*6 AS BIGINT) AS tile_lat, CAST(floor(lon/6e0)*6 AS BIGINT) AS tile_lon FROM point"),
)
def set_distinct_tiles(t: Tables) -> DataFrame:
    return tiles(t.point)


@query(
    "leave_one_out",
    with_views(
        "scored",
        """SELECT h.lang AS hold, COUNT(*) AS n_train, SUM(s.label) AS n_pos FROM (SELECT DISTINCT lang FROM scored) h JOIN scored s ON s.lang <> h.lang GROUP BY 1""",
    ),
)
def leave_one_out(t: Tables) -> DataFrame:
    """Additive statistics of "all but one" are the totals minus the group's own: no union per hold-out."""
    per = t.scored.groupBy(F.col("lang").alias("hold")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    every = Window.partitionBy()
    return per.select(
        "hold",
        (F.sum("n").over(every) - F.col("n")).alias("n_train"),
        (F.sum("p").over(every) - F.col("p")).alias("n_pos"),
    )


@query(
    "hash_sample_k",
    """SELECT c_nationkey AS grp, LEAST(COUNT(*), 5) AS n_kept, TRUE AS all_members FROM customer GROUP BY 1""",
)
def hash_sample_k(t: Tables) -> DataFrame:
    src = t.read("customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"))
    kept = sampling.sample_k(src, ["grp"], ["id"], 5, seed=17)
    home = src.select(F.col("id"), F.col("grp").alias("home"))
    checked = kept.join(home, "id", "left")
    return checked.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_kept"), F.every(F.col("home") == F.col("grp")).alias("all_members")
    )


@query(
    "cap_per_label",
    """SELECT id, label FROM (SELECT doc_id AS id, quality AS label, ROW_NUMBER() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM labels)
       WHERE rn <= CASE label WHEN 1 THEN 120 ELSE 30 END""",
)
def cap_per_label(t: Tables) -> DataFrame:
    lab = t.read("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return sampling.cap_per_label(lab, "label", F.col("id"), {0: 30, 1: 120})


@query(
    "topk_cells",
    with_views(
        "point",
        """SELECT world_i, world_j, people FROM (SELECT GREATEST(0, LEAST(360, CAST(floor((lat+9e1+25e-2)/5e-1) AS BIGINT))) AS world_i,
             CAST(floor((lon+18e1+3125e-4)/625e-3) AS BIGINT) % 576 AS world_j, ROUND(SUM(people), 2) AS people FROM point GROUP BY 1, 2)
           ORDER BY people DESC, world_i, world_j LIMIT 20""",
    ),
)
def topk_cells(t: Tables) -> DataFrame:
    from terrasig.operators.spatial import zonal_sum

    g = zonal_sum(t.point, "people").withColumn("people", F.round("people", 2))
    return g.orderBy(F.col("people").desc(), "world_i", "world_j").limit(20)


# ---- sinks as table functions


def history_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.read("orders").select(
        (F.col("o_custkey") % 10).alias("location_id"),
        F.to_date("o_orderdate").alias("as_of"),
        F.col("o_orderkey").alias("run"),
        F.col("o_totalprice").alias("rain3d_pctl"),
    )
    old = o.groupBy("location_id", "as_of").agg(F.max_by(F.struct("run", "rain3d_pctl"), "run").alias("r"))
    old = old.select("location_id", "as_of", F.col("r.run").alias("run"), F.col("r.rain3d_pctl").alias("rain3d_pctl"))
    new = old.filter(F.col("as_of") >= F.lit("2001-01-01").cast("date")).withColumn("rain3d_pctl", F.col("rain3d_pctl") + 1.0)
    return old, new


HISTORY_SQL = (
    (
        "ho",
        """SELECT o_custkey % 10 AS location_id, CAST(o_orderdate AS DATE) AS as_of, MAX(o_orderkey) AS run, arg_max(o_totalprice, o_orderkey) AS rain3d_pctl FROM orders GROUP BY 1, 2""",
    ),
    (
        "hn",
        """SELECT * FROM (SELECT location_id, as_of, run, rain3d_pctl + CASE WHEN as_of >= DATE '2001-01-01' THEN 1e0 ELSE 0e0 END AS rain3d_pctl,
             ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY as_of DESC) AS rn FROM ho) WHERE rn <= 180""",
    ),
)


@query("history_upsert", with_views("", "SELECT location_id, as_of, run, rain3d_pctl FROM hn", *HISTORY_SQL))
def history_upsert(t: Tables) -> DataFrame:
    old, new = history_rows(t)
    return sinks.upsert_history(old, new)


@query(
    "history_trend",
    with_views("", "SELECT location_id, as_of, rain3d_pctl, 181 - rn - (180 - n) AS pos FROM (SELECT *, COUNT(*) OVER (PARTITION BY location_id) AS n FROM hn)", *HISTORY_SQL),
)
def history_trend(t: Tables) -> DataFrame:
    h = sinks.upsert_history(*history_rows(t))
    w = Window.partitionBy("location_id").orderBy("as_of")
    return h.select("location_id", "as_of", "rain3d_pctl", F.row_number().over(w).alias("pos"))


@query(
    "thresholds_merge",
    """SELECT COALESCE(n.hazard, o.hazard) AS hazard, COALESCE(n.budget, o.budget) AS budget, COALESCE(n.threshold, o.threshold) AS threshold FROM
       (SELECT o_orderpriority AS hazard, CAST(o_custkey % 3 AS INTEGER) AS budget, MAX(o_totalprice) AS threshold FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) o
       FULL JOIN (SELECT o_orderpriority AS hazard, CAST(o_custkey % 5 AS INTEGER) AS budget, MIN(o_totalprice) AS threshold FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) n
       ON n.hazard = o.hazard AND n.budget = o.budget""",
)
def thresholds_merge(t: Tables) -> DataFrame:
    o = t.read("orders")

    def block(status: str, m: int, agg: Column) -> DataFrame:
        keys = [F.col("o_orderpriority").alias("hazard"), (F.col("o_custkey") % m).cast("int").alias("budget")]
        return o.filter(F.col("o_orderstatus") == status).groupBy(*keys).agg(agg.alias("threshold"))

    return sinks.merge_thresholds(block("F", 3, F.max("o_totalprice")), block("O", 5, F.min("o_totalprice")))


@query(
    "manifest_rollup",
    """SELECT CAST(SUM(n_rows) AS BIGINT) AS n_rows, CAST(SUM(n_pos) AS BIGINT) AS n_pos, CAST(SUM(n_pos) AS DOUBLE)/SUM(n_rows) AS base_rate, 'elev,rain,rh,slope,tmax' AS features FROM (
       SELECT COUNT(*) AS n_rows, SUM(quality) AS n_pos FROM labels UNION ALL SELECT COUNT(*), SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FROM lineitem)""",
)
def manifest_rollup(t: Tables) -> DataFrame:
    a = t.read("labels").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("quality").alias("n_pos"))
    b = t.read("lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_returnflag") == "R").alias("n_pos"))
    names = lambda *f: F.array(*[F.lit(x) for x in f])
    layers = a.withColumn("features", names("slope", "elev", "rain")).unionByName(
        b.withColumn("features", names("rain", "tmax", "rh"))
    )
    return sinks.manifest(layers)


@query(
    "incremental_todo",
    with_views(
        "point place",
        """SELECT wx_lat, wx_lon, span FROM (SELECT DISTINCT ROUND(round_even(lat/5e-1, 0)*5e-1, 2) AS wx_lat, ROUND(round_even(lon/5e-1, 0)*5e-1, 2) AS wx_lon, '2004..2024' AS span FROM point) w
           WHERE NOT EXISTS (SELECT 1 FROM (SELECT ROUND(round_even(lat/5e-1, 0)*5e-1, 2) AS a, ROUND(round_even(lon/5e-1, 0)*5e-1, 2) AS b,
             CASE WHEN id % 2 = 0 THEN '2004..2024' ELSE '2004..2023' END AS s FROM place) p WHERE p.a = wx_lat AND p.b = wx_lon AND p.s = span)""",
    ),
)
def incremental_todo(t: Tables) -> DataFrame:
    cell = lambda df, span: df.select(
        grids.weather_cell(F.col("lat"), 0.5).alias("wx_lat"), grids.weather_cell(F.col("lon"), 0.5).alias("wx_lon"), span.alias("span")
    ).distinct()
    wanted = cell(t.point, F.lit("2004..2024"))
    done = cell(t.place, F.when(F.col("id") % 2 == 0, "2004..2024").otherwise("2004..2023"))
    return sinks.still_to_do(wanted, done, ["wx_lat", "wx_lon", "span"])
