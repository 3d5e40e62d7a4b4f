"""Two ways to the same answer: ranges vs one window, cubes vs brute force, streams vs batch, skewed vs even input."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasig.operators import descent, metrics, ranking, spatial
from terrasig.plans import streams
from terrasig.plans.tables import Tables
from terrasig.streaming import tables, windows

SF = "/root/testdata/sf0.001"


def scores(spark, n=4000):
    rng = np.random.default_rng(5)
    s = np.where(rng.random(n) < 0.35, 0.25, np.round(rng.random(n), 3))
    y = (rng.random(n) < 0.2 + 0.5 * s).astype(int)
    return spark.createDataFrame([(int(i), f"g{i % 3}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id int, g string, y int, s double")


def test_running_totals_in_ranges_equal_one_window(spark):
    hist = ranking.score_histogram(scores(spark), "s", "y", ["g"])
    for desc in (False, True):
        a = ranking.running_totals(hist, "score", ["n", "pos"], ["g"], descending=desc)
        b = ranking.running_totals(hist, "score", ["n", "pos"], ["g"], descending=desc, small=0)
        cols = ["g", "score", "cum_n", "cum_pos", "tot_n", "tot_pos"]
        assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_exact_quantiles_equal_numpy(spark):
    df = scores(spark)
    v = np.array([r["s"] for r in df.collect()])
    probs = [0.0, 0.013, 0.5, 0.9, 0.9995, 1.0]
    for small in (0, 10**9):
        got = {r["prob"]: r["quantile"] for r in ranking.exact_quantiles(df, "s", probs, small=small).collect()}
        assert [got[p] for p in probs] == pytest.approx(np.quantile(v, probs).tolist())


def test_auc_and_average_precision_against_brute_force(spark):
    df = scores(spark, 600)
    pdf = df.toPandas()
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    auc = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(auc)
    ap = sum(((pdf.s == t) & (pdf.y == 1)).sum() * pdf.y[pdf.s >= t].mean() for t in pdf.s.unique()) / pdf.y.sum()
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap)


def test_recall_threshold_against_a_sort(spark):
    df = scores(spark, 500)
    p = df.toPandas().sort_values(["s", "id"], ascending=[False, True])
    tp = p.y.cumsum() / p.y.sum()
    k = int((tp >= 0.8).to_numpy().argmax()) + 1
    got = metrics.threshold_for_recall(df, "s", "y", "id").first()
    assert got["threshold"] == p.s.iloc[k - 1] and got["alarm_rate"] == pytest.approx(k / len(p))
    assert got["precision"] == pytest.approx(p.y.iloc[:k].mean())


def test_fold_order_paths_cover_every_group_once(spark):
    df = spark.createDataFrame([(f"b{i}", j) for i in range(40) for j in range(1 + i % 4)], "block string, j int")
    folds = metrics.fold_ids(df, "block", 5)
    assert folds.count() == 40 and folds.groupBy("fold").count().count() == 5
    sizes = df.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    pos = sorted(r["_pos"] for r in metrics._rank_groups(sizes, "block").collect())
    assert pos == list(range(1, 41))
    rows = df.join(folds, "block").groupBy("fold").count().collect()
    assert max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 4
    with pytest.raises(ValueError):
        metrics.fold_ids(df.filter(F.col("block") == "b1"), "block", 5)


def hav(a, b, r=6371000.0):
    (la1, lo1), (la2, lo2) = a, b
    p1, p2 = math.radians(la1), math.radians(la2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lo2 - lo1) / 2) ** 2
    return 2 * r * math.asin(min(1.0, math.sqrt(h)))


def clouds(spark):
    """Points on the poles, both sides of the date line and a crowded spot that holds a third of the rows."""
    rng = np.random.default_rng(9)
    pts = [(88.0 + 2 * rng.random(), 360 * rng.random() - 180) for _ in range(40)]
    pts += [(20 * rng.random(), 179.9 + 0.2 * rng.random()) for _ in range(40)]
    pts += [(10.0 + 0.01 * rng.random(), 20.0 + 0.01 * rng.random()) for _ in range(60)]
    pts += [(-80 + 160 * rng.random(), 360 * rng.random() - 180) for _ in range(40)]
    pts = [(la, lo if lo <= 180 else lo - 360) for la, lo in pts]
    qs = pts[::7] + [(-90.0, 0.0), (90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (10.005, 20.005)]
    a = spark.createDataFrame([(i, *p, float(i % 5 + 1)) for i, p in enumerate(pts)], "id int, lat double, lon double, people double")
    b = spark.createDataFrame([(i, *q) for i, q in enumerate(qs)], "id int, lat double, lon double")
    return pts, qs, a, b


@pytest.mark.parametrize("km", [1.0, 25.0, 700.0])
def test_radius_sum_equals_brute_force(spark, km):
    pts, qs, a, b = clouds(spark)
    got = {r["id"]: r["n"] for r in descent.radius_sum(b, a, km, "people", "n").collect()}
    for i, q in enumerate(qs):
        assert got[i] == pytest.approx(sum(k % 5 + 1 for k, p in enumerate(pts) if hav(q, p, 6371008.8) <= km * 1000))


def test_nearest_equals_brute_force(spark):
    pts, qs, a, b = clouds(spark)
    for opened in (1, 32):
        got = {r["id"]: r["metres"] for r in descent.nearest(b, a, opened).collect()}
        assert len(got) == len(qs)
        for i, q in enumerate(qs):
            assert got[i] == pytest.approx(min(hav(q, p) for p in pts), abs=1e-3)


@pytest.mark.parametrize("m", [300.0, 5000.0])
def test_exclusion_equals_brute_force_at_any_latitude(spark, m):
    pts, qs, a, b = clouds(spark)
    got = {r["id"] for r in spatial.without_neighbours(b, a, "id", m).collect()}
    assert got == {i for i, q in enumerate(qs) if all(hav(q, p) >= m for p in pts)}


def test_density_windows_and_greedy_pick(spark):
    df = spark.createDataFrame([(0.1, 0.1, 1)] * 5 + [(1.1, 1.1, 2), (40.0, 40.0, 3), (40.3, 40.3, None)], "lat double, lon double, d int")
    dens = spatial.density_windows(df)
    top = spatial.pick_windows(dens, 8, "events").orderBy("rank").collect()
    assert (top[0]["events"], top[0]["dates"], top[0]["occupied"]) == (6, 2, 2)
    assert len(top) == 2 and top[1]["events"] == 2


def test_window_totals_stream_equals_batch(spark, out_dir):
    t = Tables(spark, SF)
    e = streams.events(t).select("event_id", "ts", "event_type", "value")
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    schema = streams.land(e.withColumn("part", part), f"{out_dir}/in", "part", [0, 1, 2])
    flush = e.limit(1).withColumn("ts", F.lit("2024-06-01").cast("timestamp"))
    flush.write.parquet(f"{out_dir}/in/900")
    for name, make in (
        ("day", lambda df: windows.tumbling(df, "ts", ["event_type"], "value")),
        ("slide", lambda df: windows.sliding(df, "ts", ["event_type"], "value", "3 days", "1 day")),
        ("spell", lambda df: windows.sessions(df, "ts", ["event_type"], "value", "2 hours")),
    ):
        stream = make(tables.read_files(spark, f"{out_dir}/in", schema, per_trigger=1))
        log = f"{out_dir}/{name}/log"
        flat = stream.select("event_type", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n", F.round("total", 4).alias("total"))
        tables.run_available(flat, tables.log_sink(log), f"{out_dir}/{name}/cp")
        got = spark.read.parquet(log).select("event_type", "s", "e", "n", "total").filter(F.col("s") < "2024-05-01")
        want = make(e).select("event_type", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n", F.round("total", 4).alias("total"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name


def test_replayed_batch_does_not_double(spark, out_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink = tables.log_sink(f"{out_dir}/log")
    sink(df, 0)
    sink(df.withColumn("v", F.lit("z")), 1)
    sink(df.withColumn("v", F.lit("z")), 1)
    got = tables.current(spark, f"{out_dir}/log", ["k"], df.schema).collect()
    assert sorted(map(tuple, got)) == [(1, "z"), (2, "z")]


def test_one_cell_with_a_third_of_all_rows_changes_nothing(spark):
    """Rows of a hot cell are combined before the shuffle; every result equals the one computed from reduced rows."""
    from terrasig.operators import climate, series

    hot = spark.range(60_000).select(F.lit(1).alias("cell"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 500).cast("int")).alias("d"), F.lit(0.5).alias("v"))
    rest = spark.range(120_000).select((2 + F.col("id") % 40).cast("int").alias("cell"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 499).cast("int")).alias("d"), F.lit(0.25).alias("v"))
    raw = hot.unionByName(rest)
    reduced = raw.groupBy("cell", "d").agg(F.sum("v").alias("precip"))
    lo, hi = F.lit("2000-01-01").cast("date"), F.lit("2001-05-14").cast("date")
    dense = series.densify(reduced, "cell", "d", lo, hi)
    assert dense.groupBy("cell").count().agg(F.min("count"), F.max("count")).first() == (500, 500)
    assert dense.agg(F.sum("precip")).first()[0] == raw.agg(F.sum("v")).first()[0]
    got = climate.rain_features(dense).filter("cell = 1").agg(F.min("precip_3d"), F.max("precip_3d")).first()
    assert got == (180.0, 180.0)


def test_crowded_spot_keeps_every_pixel(spark):
    """A third of the pixels share one fine cell; sums stay whole and exclusion emits one row per candidate."""
    crowd = spark.range(20_000).select(F.col("id"), (10 + F.col("id") * 1e-8).alias("lat"), F.lit(20.0).alias("lon"), F.lit(1.0).alias("people"))
    far = spark.range(40_000).select((F.col("id") + 20_000).alias("id"), (-60 + F.col("id") * 1e-3).alias("lat"), F.lit(-90.0).alias("lon"), F.lit(1.0).alias("people"))
    pixels = crowd.unionByName(far)
    places = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.05, 20.0)], "id int, lat double, lon double")
    got = {r["id"]: r["n"] for r in descent.radius_sum(places, pixels, 10.0, "people", "n").collect()}
    assert got == {1: 20_000.0, 2: 20_000.0}
    clear = spatial.without_neighbours(pixels, places, "id", 500.0)
    assert clear.count() == 40_000


def test_merge_keeps_tail_days_before_the_cut(spark):
    import datetime

    from pyspark.sql import functions as F

    from terrasig.operators import quality

    def rows(*pairs):
        return spark.createDataFrame([(1, datetime.date(2001, 1, d), v) for d, v in pairs], "cell long, d date, v double")

    history, tail = rows((1, 1.0), (2, 2.0), (6, 6.0)), rows((2, None), (3, 30.0), (5, 50.0))
    got = quality.merge_tail(history, tail, F.lit("2001-01-05").cast("date")).orderBy("d").collect()
    assert [(r["d"].day, r["v"]) for r in got] == [(1, 1.0), (2, None), (3, 30.0), (5, 50.0)]
