"""Hand-computed cases for the rules that are easy to get wrong."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasig.functions import dates, geo, grids
from terrasig.operators import climate, metrics, quality, ranking, sampling, series, serving, terrain
from terrasig.sources import catalog, payloads, weather

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_season_key_does_not_wrap(spark):
    df = spark.createDataFrame([(D(2001, 12, 31),), (D(2001, 1, 1),), (D(2001, 2, 28),), (D(2001, 3, 1),)], "d date")
    assert [r[0] for r in df.select(dates.season_key(F.col("d"))).collect()] == [403, 32, 90, 94]


def test_seasonal_percentile_is_inclusive_and_needs_thirty(spark):
    values = [(1, D(1990 + y, 1, 1 + k), float(k)) for y in range(3) for k in range(10)]
    df = spark.createDataFrame(values, "cell int, d date, v double")
    got = series.seasonal_percentiles(df, "cell", "d", {"v": "p"}).collect()
    assert len(got) == 30 and all(r["p"] == pytest.approx((r["v"] + 1) / 10) for r in got)
    short = series.seasonal_percentiles(df.filter(F.col("d") != D(1990, 1, 1)), "cell", "d", {"v": "p"})
    assert {r["p"] for r in short.collect()} == {None}


def test_missing_value_scores_null_or_zero(spark):
    values = [(1, d, None if i == 5 else float(i)) for i, d in enumerate(days(D(2000, 1, 1), 32))]
    df = spark.createDataFrame(values, "cell int, d date, v double")
    kept = {r["d"]: r["p"] for r in series.seasonal_percentiles(df, "cell", "d", {"v": "p"}).collect()}
    assert kept[D(2000, 1, 6)] is None
    zero = series.seasonal_percentiles(df, "cell", "d", {"v": "p"}, min_n=1, missing_as=0.0).collect()
    assert {r["d"]: r["p"] for r in zero}[D(2000, 1, 6)] == 0.0
    every = series.alltime_percentiles(df, "cell", {"v": "p"}, missing_as=0.0).collect()
    assert {r["d"]: r["p"] for r in every}[D(2000, 1, 6)] == 0.0


def test_seasonal_percentile_equals_numpy(spark):
    rng = np.random.default_rng(3)
    all_days = days(D(1999, 1, 1), 1500)
    vals = np.round(rng.gamma(0.4, 5, 1500), 1)
    vals[rng.random(1500) < 0.05] = np.nan
    data = [(7, d, None if np.isnan(v) else float(v)) for d, v in zip(all_days, vals, strict=True)]
    df = spark.createDataFrame(data, "cell int, d date, v double")
    got = {r["d"]: r["p"] for r in series.seasonal_percentiles(df, "cell", "d", {"v": "p"}).collect()}
    key = np.array([d.month * 31 + d.day for d in all_days])
    for i in range(0, 1500, 13):
        pool = vals[(np.abs(key - key[i]) <= 15) & ~np.isnan(vals)]
        want = None if np.isnan(vals[i]) or len(pool) < 30 else (pool <= vals[i]).mean()
        assert got[all_days[i]] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_rolling_sum_counts_rows_and_missing_as_zero(spark):
    df = spark.createDataFrame([(1, d, v) for d, v in zip(days(D(2000, 1, 1), 4), [1.0, None, 2.0, 4.0])], "cell int, d date, v double")
    got = [r["s3d"] for r in series.rolling_sums(df, "cell", "d", "v", (3,), "s").orderBy("d").collect()]
    assert got == [None, None, 3.0, 6.0]


def test_densify_fills_both_ends_and_the_middle(spark):
    df = spark.createDataFrame([(1, D(2000, 1, 2), 5.0), (1, D(2000, 1, 4), 6.0), (2, D(2000, 1, 9), 1.0)], "cell int, d date, v double")
    lo, hi = F.lit(D(2000, 1, 1)), F.lit(D(2000, 1, 5))
    got = rows(series.densify(df, "cell", "d", lo, hi), "cell", "d", "v")
    assert got == [(1, D(2000, 1, i), v) for i, v in zip(range(1, 6), [None, 5.0, None, 6.0, None])]


def test_days_since_rain_counts_null_as_dry(spark):
    df = spark.createDataFrame([(1, d, v) for d, v in zip(days(D(2000, 1, 1), 5), [0.0, 3.0, None, 2.4, 2.5])], "cell int, d date, v double")
    got = series.days_since(df, "cell", "d", F.col("v") >= 2.5, "n").orderBy("d")
    assert [r["n"] for r in got.collect()] == [1, 0, 1, 2, 0]


def test_kbdi_first_fifth_of_an_inch_is_free(spark):
    cold = np.array([0.0, 0.0, 0.0])
    q, spell = climate.kbdi_fold(cold, np.array([2.54, 2.54, 2.54]), q0=100.0, r_annual_mm=500.0)
    assert q.tolist() == pytest.approx([100.0, 100.0, 90.0]) and spell == pytest.approx(0.3)
    q, _ = climate.kbdi_fold(cold, np.array([12.7, 0.0, 12.7]), q0=100.0, r_annual_mm=500.0)
    assert q.tolist() == pytest.approx([70.0, 70.0, 40.0])
    q, _ = climate.kbdi_fold(np.array([40.0] * 400), np.zeros(400), r_annual_mm=1000.0)
    assert np.all(np.diff(q) >= 0) and q[-1] <= 800.0


def test_kbdi_split_in_two_equals_whole():
    rng = np.random.default_rng(1)
    t, r = rng.normal(25, 8, 300), np.where(rng.random(300) < 0.3, rng.gamma(1, 9, 300), 0)
    whole, _ = climate.kbdi_fold(t, r, r_annual_mm=800.0)
    a, spell = climate.kbdi_fold(t[:137], r[:137], r_annual_mm=800.0)
    b, _ = climate.kbdi_fold(t[137:], r[137:], q0=a[-1], r_annual_mm=800.0, spell0=spell)
    assert np.allclose(np.concatenate([a, b]), whole)


def test_ladder_rank_edges(spark):
    ladder = [float(i) for i in range(21)]
    df = spark.createDataFrame([(-1.0, ladder), (0.0, ladder), (0.5, ladder), (19.99, ladder), (20.0, ladder), (3.0, [3.0] * 21), (2.0, [3.0] * 21), (None, ladder)], "v double, q array<double>")
    got = [r[0] for r in df.select(climate.ladder_rank(F.col("v"), F.col("q"))).collect()]
    assert got[:7] == pytest.approx([0.0, 0.0, 0.025, 0.9995, 1.0, 1.0, 0.0]) and got[7] is None


def test_weather_cell_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (-0.25,), (1.25,)], "x double")
    assert [r[0] for r in df.select(grids.weather_cell(F.col("x"), 0.5)).collect()] == [0.0, 1.0, 0.0, 1.0]


def test_world_cell_wraps_and_clips(spark):
    df = spark.createDataFrame([(90.0, 180.0), (-90.0, -180.0), (0.0, 179.9)], "lat double, lon double")
    i, j = grids.world_cell(F.col("lat"), F.col("lon"))
    assert rows(df.select(i.alias("i"), j.alias("j")), "i", "j") == [(0, 0), (180, 0), (360, 0)]


def test_geohash_known_values(spark):
    df = spark.createDataFrame([(57.64911, 10.40744), (90.0, 180.0), (-90.0, -180.0)], "lat double, lon double")
    got = [r[0] for r in df.select(grids.geohash7(F.col("lat"), F.col("lon"))).collect()]
    assert got == ["u4pruyd", "zzzzzzz", "0000000"]


def test_null_island_and_valid_coord(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (0.0, 5.0), (91.0, 0.0), (None, 1.0)], "lat double, lon double")
    ok = [r[0] for r in df.select(geo.valid_coord(F.col("lat"), F.col("lon"))).collect()]
    assert ok == [False, True, True, False, False]
    assert [r[0] for r in df.select(geo.near_null_island(F.col("lat"), F.col("lon"))).collect()][:3] == [True, True, False]


def test_pixel_metres(spark):
    dx, dy = geo.pixel_metres(F.lit(60.0))
    r = spark.range(1).select(dx.alias("dx"), dy.alias("dy")).first()
    assert r["dy"] == pytest.approx(30.9222, abs=1e-3) and r["dx"] == pytest.approx(r["dy"] / 2)


def test_epoch_dates_outside_the_range_are_null(spark):
    df = spark.createDataFrame([(0,), (-2208988800001,), (253402300800000,), (86399999,), (-1,)], "ms bigint")
    got = [r[0] for r in df.select(dates.epoch_ms_date(F.col("ms"))).collect()]
    assert got == [D(1970, 1, 1), None, None, D(1970, 1, 1), D(1969, 12, 31)]


def test_mixed_dates(spark):
    data = [("2010-05-06T00:00", 1, 1), ("05/06/2010", 1, 1), ("2455322.5", 1, 1), (None, 2010, 126), ("??", 2010, 126)]
    df = spark.createDataFrame(data, "raw string, y int, doy int")
    got = [r[0] for r in df.select(dates.mixed_date(F.col("raw"), F.col("y"), F.col("doy"))).collect()]
    assert got == [D(2010, 5, 6)] * 5


def test_leap_day_moves_to_the_28th(spark):
    df = spark.createDataFrame([(D(2000, 2, 29), 2001), (D(2000, 2, 29), 2004), (D(2001, 2, 28), 2004)], "d date, y int")
    got = [r[0] for r in df.select(dates.same_day_in_year(F.col("d"), F.col("y"))).collect()]
    assert got == [D(2001, 2, 28), D(2004, 2, 29), D(2004, 2, 28)]


def test_fill_values_become_null(spark):
    df = spark.createDataFrame([(1, ["2000-01-01", "2000-01-02", "2000-01-03"], [1.0, -999.0])], "cell int, time array<string>, v array<double>")
    got = rows(payloads.arrays_to_long(df, ["cell"], "time", ["v"]).orderBy("d"), "d")
    assert len(got) == 3
    vals = [r["v"] for r in payloads.arrays_to_long(df, ["cell"], "time", ["v"]).orderBy("d").collect()]
    assert vals == [1.0, None, None]
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "x double").select(payloads.unfill(F.col("x")))
    assert [r[0] for r in nan.collect()] == [None, 2.0]


def test_catalog_read_keeps_bad_rows(spark, out_dir):
    path = f"{out_dir}/c.csv"
    with open(path, "w") as f:
        f.write("event_id,latitude,longitude,event_date,location_accuracy,country_name,landslide_category,landslide_size,landslide_trigger\n")
        f.write("1,10.5,20.5,0, exact ,X,a,b,c\n2,oops,20,253402300800000,25km,,a,b,c\n3,0,0,86400000,1km,Y,a,b,c\n")
    df = catalog.clean_catalog(catalog.read_catalog(spark, path))
    assert rows(df, "event_id") == [("1",), ("2",), ("3",)]
    assert {r["event_id"]: (r["lat"], r["accuracy"], r["event_date_iso"]) for r in df.collect()} == {
        "1": (10.5, "exact", D(1970, 1, 1)), "2": (None, "25km", None), "3": (0.0, "1km", D(1970, 1, 2)),
    }
    assert [r["event_id"] for r in catalog.usable(df).collect()] == ["1"]


def test_fire_size_and_null_island(spark):
    df = spark.createDataFrame(
        [(45.0, -120.0, 99.9, 2010, 5, "2010-01-05"), (45.0, -120.0, 100.0, 2010, 5, "2010-01-05"), (0.2, 0.3, 500.0, 2010, 5, None), (45.0, -120.0, 500.0, 2004, 5, None)],
        "lat double, lon double, size_acres double, yr int, doy int, ddate string",
    )
    got = catalog.us_fires(df, F.lit("2020-12-31").cast("date"))
    assert rows(got, "size_acres") == [(100.0,)]
    ca = spark.createDataFrame([(50.0, -100.0, "100", "2011-02-03 00:00"), (50.0, -100.0, "n/a", "2011-02-03"), (50.0, -100.0, "200", "bad")], "lat double, lon double, size_ha string, rep_date string")
    assert rows(catalog.canada_fires(ca, F.lit("2020-12-31").cast("date")), "date") == [(D(2011, 2, 3),)]


def test_terrain_plane_flat_and_holes(spark):
    plane = [float(10 * c) for r in range(7) for c in range(7)]
    flat = [5.0] * 49
    hole = [5.0] * 24 + [None] + [5.0] * 24
    broken = [None] * 25 + [5.0] * 24
    df = spark.createDataFrame([(1, 0.0, plane), (2, 0.0, flat), (3, 0.0, hole), (4, 0.0, broken)], "id int, lat double, z array<double>")
    got = {r["id"]: r for r in terrain.derive(df, 7, 7).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["slope_deg"] == pytest.approx(np.degrees(np.arctan(10 / (111320 / 3600))))
    assert got[1]["relief_range"] == 60.0 and got[1]["tri"] == pytest.approx(60 / 9) and got[1]["tpi"] == pytest.approx(0)
    assert got[2]["slope_deg"] == 0.0 and got[2]["roughness_std"] == 0.0
    assert got[3]["elev_m"] == 5.0
    assert terrain.derive(df, 4, 4).count() == 0


def test_tie_safe_threshold_does_not_overspend(spark):
    df = spark.createDataFrame([(i, 0.9 if i < 30 else i / 1000) for i in range(100)], "id int, s double")
    got = {r["budget"]: r for r in metrics.tie_safe_thresholds(df, "s", (0.05, 0.30, 0.5)).collect()}
    assert got[0.05]["threshold"] == 0.9 and got[0.05]["achieved_alarm_rate"] == 0.3
    assert got[0.3]["threshold"] == 0.9
    assert got[0.5]["achieved_alarm_rate"] <= 0.5
    assert got[0.05]["naive_quantile"] == pytest.approx(0.9)


def test_reliability_edges_and_metrics_without_positives(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 0, 1.0), ("a", 1, 0.0), ("b", 0, 0.5), ("b", 0, 0.6)], "g string, y int, p double")
    bins = {r["bin"]: r["n"] for r in metrics.reliability(df, "p", "y").collect()}
    # the edges are multiples of 0.1: the third is 0.30000000000000004 and the sixth 0.6000000000000001
    assert bins == {0: 1, 2: 1, 9: 1, 5: 2}
    got = {r["g"]: (r["pr_auc"], r["roc_auc"]) for r in metrics.fold_metrics(df, "p", "y", ["g"]).collect()}
    assert got["b"] == (None, None)
    assert got["a"][1] == pytest.approx(0.0)


def test_single_fold_sd_is_zero(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.1)], "fold int, y int, p double")
    assert metrics.summarise_folds(df, "p", "y", "fold").first()["pr_auc_sd"] == 0.0


def test_gapfill_leaves_the_middle_alone(spark):
    d = days(D(2000, 1, 1), 200)
    prim = [(1, x, None if i == 50 else 2.0) for i, x in enumerate(d[:180])]
    other = [(1, x, 1.0) for x in d]
    p = spark.createDataFrame(prim, "cell int, d date, v double")
    e = spark.createDataFrame(other, "cell int, d date, e double")
    got = {r["d"]: r["v"] for r in quality.fill_trailing_gap(p, e, "cell", "d", "v", "e", F.lit(d[-1])).collect()}
    assert got[d[50]] is None
    assert got[d[180]] == pytest.approx(round((179 * 2 + 1) / (179 + 1), 3))
    assert len(got) == 200
    fresh = quality.fill_trailing_gap(p, e, "cell", "d", "v", "e", F.lit(d[183])).collect()
    assert len(fresh) == 180
    offset = quality.fill_trailing_gap(p, e, "cell", "d", "v", "e", F.lit(d[-1]), mode="offset", limits=(-10.0, 10.0), clamp=(1.0, 100.0))
    assert {r["d"]: r["v"] for r in offset.collect()}[d[180]] == 2.0


def test_compose_order_of_precedence(spark):
    base = dict(rain3d_pctl=0.5, rain30d_pctl=0.5, spi90=0.5, spi365=0.5, flood_pctl=None, data_quality="ok", susceptibility_nearby_max=0.5, staleness_days=1, fire_alert=False, fire_watch=False, flood_week_max_pctl=None, flood_week_max_date=None)
    cases = [
        ({}, "green"),
        ({"flood_pctl": 0.98, "data_quality": "disagree"}, "red"),
        ({"rain3d_pctl": 0.99, "data_quality": "disagree"}, "unknown"),
        ({"rain3d_pctl": 0.98}, "red"),
        ({"rain3d_pctl": 0.98, "staleness_days": 8}, "yellow"),
        ({"rain3d_pctl": 0.98, "susceptibility_nearby_max": 0.2}, "yellow"),
        ({"fire_alert": True}, "red"),
        ({"spi90": 0.0}, "yellow"),
        ({"rain3d_pctl": None, "rain30d_pctl": None}, "unknown"),
        ({"flood_week_max_pctl": 0.99, "flood_week_max_date": D(2001, 1, 5)}, "yellow"),
    ]
    schema = "id int, rain3d_pctl double, rain30d_pctl double, spi90 double, spi365 double, flood_pctl double, data_quality string, susceptibility_nearby_max double, staleness_days int, fire_alert boolean, fire_watch boolean, flood_week_max_pctl double, flood_week_max_date date"
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    got = {r["id"]: r["status"] for r in serving.compose_status(df).collect()}
    assert [got[i] for i in range(len(cases))] == [s for _, s in cases]


def test_strata_with_a_repeated_case_use_one_year(spark):
    df = spark.createDataFrame(
        [("a", D(1998, 1, 1), 1), ("a", D(1998, 1, 1), 1), ("a", D(1997, 1, 1), 0), ("b", D(2002, 1, 1), 1), ("b", D(1997, 1, 1), 0), ("c", D(1998, 1, 1), 1), ("c", D(2003, 1, 1), 0)],
        "stratum string, d date, label int",
    )
    assert {r["stratum"] for r in sampling.temporal_freeze(df, 1999).collect()} == {"a"}


def test_weather_source_must_match():
    assert weather.scoring_source("half_degree", "half_degree").deg == 0.5
    with pytest.raises(ValueError):
        weather.scoring_source("half_degree", "tenth_degree")


def test_average_ranks_three_ways(spark):
    df = spark.createDataFrame([("g", v) for v in [1.0, 2.0, 2.0, 5.0, None]], "g string, v double")
    want = [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 4.0)]
    for kw in ({}, {"small": 0}, {"bounded": True}):
        got = ranking.average_ranks(df, "v", "r", ["g"], **kw).filter(F.col("v").isNotNull())
        assert rows(got, "v", "r") == want


def test_gapfill_of_all_fields_in_one_pass(spark):
    d = days(D(2000, 1, 1), 200)
    p = spark.createDataFrame([(1, x, 2.0, 20.0, 50.0, 1.0) for x in d[:180]], "cell int, d date, precip double, tmax double, rh double, ws double")
    e = spark.createDataFrame([(1, x, 1.0, 25.0, None if i == 190 else 45.0, 10.0) for i, x in enumerate(d)], "cell int, d date, e1 double, e2 double, e3 double, e4 double")
    fields = {f: (s, *quality.CORRECTIONS[f]) for f, s in zip(("precip", "tmax", "rh", "ws"), ("e1", "e2", "e3", "e4"))}
    got = {r["d"]: r for r in quality.fill_trailing_gaps(p, e, "cell", "d", fields, F.lit(d[-1])).collect()}
    last = got[d[199]]
    assert (last["precip"], last["tmax"], last["rh"]) == (pytest.approx(1.994), 20.0, 50.0)
    assert last["ws"] == pytest.approx(1.005)
    assert got[d[190]]["rh"] is None and got[d[190]]["tmax"] == 20.0


def test_missing_inputs_never_become_a_bound(spark):
    r = spark.range(1).select(
        climate.vpd_kpa(F.lit(30.0), F.lit(None).cast("double")).alias("vpd"),
        geo.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("m"),
        grids.world_cell(F.lit(None).cast("double"), F.lit(0.0))[0].alias("i"),
        grids.geohash7(F.lit(None).cast("double"), F.lit(0.0)).alias("g"),
        climate.vpd_kpa(F.lit(30.0), F.lit(140.0)).alias("wet"),
    ).first()
    assert (r["vpd"], r["m"], r["i"], r["g"]) == (None, None, None, None) and r["wet"] == 0.0
