"""What a larger table must not change: rows that a plan multiplies, broadcasts chosen from estimates, bounded steps."""

from __future__ import annotations

import datetime
import random
import re

from pyspark.sql import functions as F

from terrasig.operators import climate, descent, sampling, series, spatial
from terrasig.plans import load, matrices
from terrasig.plans.joins import cases
from terrasig.plans.tables import Tables

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_near_events_are_not_multiplied_or_broadcast(spark):
    for name in ("bg_target_group", "bg_uniform", "anti_proximity"):
        text = plan(QUERIES[name](spark, SF))
        assert "SortMergeJoin [cx" in text and "BroadcastHashJoin [cx" not in text, name
    points = spark.range(50).select("id", (F.col("id") * 1.0).alias("lat"), (F.col("id") * 2.0).alias("lon"))
    cells = spatial._occupied(spatial._with_cells(points, 1e-4))
    met = spatial._reach(spatial._with_cells(points, 1e-4), cells, 1e-4)
    assert met.count() == 50  # each point meets its own cell only, once


def test_points_with_terrain_and_named_vertices_are_not_broadcast(spark):
    t = Tables(spark, SF)
    pos = matrices.positives(t)
    bg = sampling.background_near(pos, 8, matrices.BBOX, 17, radius_m=12_000.0, min_m=500.0)
    text = plan(matrices.terrain_of(t, pos.unionByName(bg.drop("anchor"))))
    assert "SortMergeJoin [_tile" in text and "BroadcastHashJoin [_tile" not in text
    places = t.place.select("id", "lat", "lon")
    text = plan(descent.nearest(places.withColumn("lat", F.col("lat") + 0.3), places))
    assert "SortMergeJoin [level" in text and "BroadcastHashJoin [level" not in text


def test_rain_of_cases_is_not_broadcast(spark, monkeypatch):
    """Controls, and the features of gap-free series, are far more than their estimates, which are those of the sparse rows."""
    t = Tables(spark, SF)
    cut = []
    monkeypatch.setattr(matrices, "cut_lineage", lambda df, f=matrices.cut_lineage: cut.append(plan(df)) or f(df))
    text = plan(matrices.trigger(t))
    assert "SortMergeJoin [cell" in cut[0] and "BroadcastHashJoin [stratum" not in "".join(cut)
    assert "SortMergeJoin [cell" in text and "BroadcastHashJoin [cell" not in text
    assert text.count("FlatMapGroupsInArrow") == 1  # strata are completed before a feature is derived
    some = F.col("d").between("1997-01-01", "1997-02-15") & (F.col("cell") % 2 == 0)
    whole, few = climate.rain_features(t.daily).filter(some), climate.rain_features(t.daily, only=some)
    assert few.columns == whole.columns and few.count() == whole.count() > 0 and few.exceptAll(whole).count() == 0


def test_places_and_what_is_near_them_are_not_broadcast(spark, monkeypatch):
    cut = []
    monkeypatch.setattr(descent, "cut_lineage", lambda df, f=descent.cut_lineage: cut.append(plan(df)) or f(df))
    text = plan(QUERIES["watchlist_rank"](spark, SF))
    assert any("SortMergeJoin [v_cx" in x for x in cut) and not any("BroadcastHashJoin" in x for x in cut)
    assert not re.findall(r"BroadcastHashJoin \[(?:id|cell)#\d+L?\]", text)


def test_control_candidates_are_not_shuffled(spark):
    t = Tables(spark, SF)
    text = plan(QUERIES["control_candidates"](spark, SF))
    # the days are exploded above the last exchange: cases are shuffled, candidates are not
    assert text.index("Generate explode") < text.index("Exchange") and "LeftAnti" not in text
    events = t.event.unionByName(t.event.limit(20).withColumn("d", F.lit(None).cast("date")))
    cand = sampling.control_candidates(cases(t), events, 1996, 2001)
    for n in (1, 4, 2000):  # 2000: more than a case has
        got = sampling.draw_controls(cases(t), events, 1996, 2001, n, 17).collect()
        assert sorted(got) == sorted(sampling.controls(cand, n, 17).collect())


def test_candidates_equal_a_plain_search(spark):
    day = datetime.date
    ev = [("a", day(2000, 2, 29)), ("a", day(1996, 1, 3)), ("a", day(2001, 12, 30)), (None, day(1999, 5, 5)), ("b", None)]
    cs = [(1, "a", day(2000, 2, 29)), (2, "a", day(1999, 12, 31)), (3, None, day(1999, 5, 5)), (4, "c", day(1998, 7, 1)), (5, "b", day(1996, 1, 1))]
    c, e = spark.createDataFrame(cs, "stratum int, cell string, d date"), spark.createDataFrame(ev, "cell string, d date")
    want = set()
    for s, cell, d in cs:
        for y in (y for y in range(1996, 2002) if y != d.year):
            a = day(y, 2, 28) if (d.month, d.day) == (2, 29) and y % 4 else d.replace(year=y)
            for at in (a + datetime.timedelta(k) for k in range(-45, 46)):
                banned = any(x == cell and cell is not None and b is not None and abs((at - b).days) <= 7 for x, b in ev)
                if 1996 <= at.year <= 2001 and not banned:
                    want.add((s, cell, at))
    got = [tuple(r) for r in sampling.control_candidates(c, e, 1996, 2001).collect()]
    assert len(got) == len(want) and set(got) == want


def test_boxes_behind_one_that_holds_the_tile_are_not_tested(spark):
    # names in no order of place; many boxes hold the tile of every point, and some end on a tile's border
    r = random.Random(5)
    bs = []
    for k in range(400):
        x, y = r.uniform(-60, 60), r.uniform(-40, 40)
        bs.append((f"n{r.randrange(10**6):06d}-{k}", x - 15.0, y - 12.0, x + 15.0, y + 12.0))
    bs += [("a", 10.0, 0.0, 20.0, 10.0), ("b", -70.0, -50.0, -60.0, -40.0), (None, -90.0, -90.0, 90.0, 90.0)]
    ps = [(k, r.uniform(-55, 55), r.uniform(-80, 80)) for k in range(300)] + [(300, 10.0, 20.0), (301, 0.0, 10.0), (302, -45.0, -60.0), (303, None, 1.0), (304, 9.999999999999999, 15.0)]
    boxes = spark.createDataFrame(bs, "region string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame(ps, "id int, lat double, lon double")
    want = {}
    for i, lat, lon in ps:
        held = [n for n, x0, y0, x1, y1 in bs if n is not None and lat is not None and x0 <= lon <= x1 and y0 <= lat <= y1]
        want[i] = min(held, default=None)
    for tile in (10.0, 3.0):
        assert {row["id"]: row["region"] for row in spatial.first_box(points, boxes, tile).collect()} == want
    more = boxes.unionByName(boxes.withColumn("region", F.concat(F.lit("z"), "region")))
    covered = lambda b: (x := spatial._boxes_by_tile(b, 3.0)).filter("not _whole").join(x.filter("_whole").select("_ti", "_tj"), ["_ti", "_tj"]).count()
    assert 0 < covered(more) == covered(boxes)


def test_recent_ranks_take_one_pass_over_the_signals(spark):
    for name, folds in (("world_score", 1), ("alert_exposure", 1), ("parity_report", 2)):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("FlatMapGroupsInArrow") == folds and "Expand" not in text, name
    assert "Expand" not in plan(QUERIES["watchlist_rank"](spark, SF)).split("FlatMapGroupsInArrow")[0]


def test_a_season_is_ranked_in_one_batch_of_its_key(spark):
    t = Tables(spark, SF)
    for name in ("spi_features", "rain_features", "replay_grid", "yearly_skill"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("FlatMapGroupsInArrow") == 1 and "array_position" not in text and "sort_array" not in text, name
    assert plan(climate.rain_features(t.daily)).count("Exchange hashpartitioning") == 2


def test_ranks_equal_a_plain_count(spark):
    r, day = random.Random(9), datetime.date
    odd = [None, float("nan"), float("-inf"), -0.0, 0.0, 1.5, 2.5, float("inf")]
    # a leap day, a day that comes twice, days without a date, and gaps
    ds = [day(y, m, k) for y in (1999, 2000, 2001) for m in (1, 2, 12) for k in range(1, 29)] + [day(2000, 2, 29), day(2000, 2, 29), None, None]
    rows = [("a" if i % 5 else None, d, r.choice(odd)) for i, d in enumerate(ds)] + [("b", day(2000, 5, 5), None)]
    df = spark.createDataFrame(rows, "k string, d date, v double").withColumn("i", F.monotonically_increasing_id())
    rank = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731  not-a-number is the highest value
    sk = lambda d: None if d is None else d.month * 31 + d.day
    near = lambda a, b: a == b if a is None or b is None else abs(a - b) <= 3
    data = {x["i"]: (x["k"], x["d"], x["v"]) for x in df.collect()}
    want = {}
    for i, (k, d, v) in data.items():
        every = [w for key, _, w in data.values() if key == k and w is not None]
        pool = [w for key, e, w in data.values() if key == k and w is not None and near(sk(d), sk(e))]
        share = lambda p: None if v is None else sum(rank(w) <= rank(v) for w in p) / len(p)  # noqa: B023, E731
        want[i] = (share(pool) if len(pool) >= 4 else None, share(every) if every else None)
    got = series.seasonal_percentiles(df, "k", "d", {"v": "s"}, halfwidth=3, min_n=4, alltime={"v": "a"}).collect()
    assert {x["i"]: (x["s"], x["a"]) for x in got} == want
    some = series.seasonal_percentiles(df, "k", "d", {"v": "s"}, halfwidth=3, min_n=4, only=F.col("v") > 1, drop=["v"])
    assert some.columns == ["k", "d", "i", "s"]
    assert {x["i"]: x["s"] for x in some.collect()} == {i: want[i][0] for i, x in data.items() if x[2] is not None and rank(x[2]) > (False, 1.0)}

    # a few rows, counted in the record instead of ranked with it
    for missing in (None, 0.0):
        few, only = F.col("i") % 7 == 0, {"v": "s"}
        whole = series.seasonal_percentiles(df, "k", "d", only, halfwidth=3, min_n=4, missing_as=missing, only=few)
        counted = series.asked_percentiles(df, "k", "d", only, few, halfwidth=3, min_n=4, missing_as=missing)
        assert counted.columns == whole.columns and sorted(map(repr, counted.collect())) == sorted(map(repr, whole.collect()))


def test_the_nightly_job_ranks_its_few_rows_without_python(spark):
    """The drought index is not published and the ranked days are few: no cell's record goes through Python, and none is pooled."""
    text = plan(QUERIES["nightly_update"](spark, SF))
    assert "InArrow" not in text and "RangeFrame" not in text


def test_a_history_that_bridges_itself_is_read_once(spark):
    """The same as with its own rows as a second source: rain behind the cut, a tail that stalls, days that both lack."""
    from terrasig.operators import jobs

    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n)
    df = spark.range(900).select((F.col("id") % 2).alias("cell"), day(F.floor(F.col("id") / 2).cast("int")).alias("d"), F.when(F.col("id") % 11 > 0, F.col("id") % 7 + 0.5).alias("precip"))
    tail = df.filter("d < date '2001-01-20' and cell = 0 or d < date '2000-12-01'").select("cell", "d", (F.col("precip") * 2).alias("precip"))
    cut, now = F.lit("2000-11-01").cast("date"), F.lit("2001-03-25").cast("date")
    own = jobs.fill(df, tail.filter("d >= date '2000-06-01'"), None, cut, now)
    both = jobs.fill(df, tail.filter("d >= date '2000-06-01'"), df.withColumnRenamed("precip", "other"), cut, now)
    want = {(r["cell"], r["d"]): r["precip"] for r in both.collect()}
    assert {(r["cell"], r["d"]): r["precip"] for r in own.collect()} == want and len(want) == 900
    last = max(d for _, d in want)
    assert want[0, last] > 2.5  # the history's rain, raised by the correction


def test_a_stream_derives_its_table_once(spark, monkeypatch):
    from terrasig.plans import streams

    made = []
    monkeypatch.setattr(streams.tables, "written", lambda df, name, by=(), f=streams.tables.written: made.append(by) or f(df, name, by))
    t = Tables(spark, SF)
    streams.stream_session_spell(t)
    streams.stateful_kbdi(t)
    assert made == [["part"], ["part"]]


def written_by(monkeypatch, name, spark):
    """The tables that a query writes before it reads them, and its plan."""
    from terrasig.plans import tables

    made = []
    monkeypatch.setattr(tables, "written", lambda df, name, f=tables.written: made.append(name) or f(df, name))
    return made, plan(QUERIES[name](spark, SF))


def test_parity_writes_cell_days_and_deals_only_the_seasons_that_are_ranked(spark, monkeypatch):
    from terrasig.plans.timeseries import near_season

    made, _ = written_by(monkeypatch, "parity_report", spark)
    assert made == ["cell_day"]
    t, after = Tables(spark, SF), F.col("d") > F.lit("2001-10-01").cast("date")
    whole = climate.world_signals(t.daily).cache()
    part = climate.world_signals(t.daily, only=near_season(t, "2001-10-01")).cache()
    assert part.count() < whole.count() / 3 and part.exceptAll(whole).count() == 0
    rank = lambda df: series.pooled_percentiles(df, "cell", "d", {"rain3d": "a", "vpd": "b"}, missing_as={"vpd": 0.0}, only=after)
    got = rank(part)
    assert got.count() > 0 and got.exceptAll(rank(whole)).count() == 0 == rank(whole).exceptAll(got).count()
    gone = part.withColumns({"rain3d": F.lit(None).cast("double"), "vpd": F.when(~after, F.col("vpd"))})
    assert {(r["a"], r["b"]) for r in rank(gone).collect()} == {(None, 0.0)}


def test_compound_flags_rank_the_fire_of_their_days_only(spark, monkeypatch):
    from terrasig.plans.timeseries import near_season

    made, text = written_by(monkeypatch, "compound_flags", spark)
    assert made == ["cell_day"] and "days_since_rain" not in text
    t, after = Tables(spark, SF), F.col("d") > F.lit("2001-10-01").cast("date")
    few = climate.fire_percentiles(t.daily, after, near_season(t, "2001-10-01"))
    whole = climate.fire_features(t.daily).filter(after).select("cell", "d", *[F.col(f"{n}_pctl_seasonal").alias(f"{n}_pctl") for n in ("kbdi", "vpd", "tmax")])
    assert few.columns == whole.columns and few.count() == whole.count() > 0 and few.exceptAll(whole).count() == 0


def test_a_streamed_day_is_ranked_once_and_merged_by_hashing(spark, out_dir):
    from terrasig.streaming import tables

    df = spark.createDataFrame([(v, [1.0, 2.0, 2.0, 5.0, 9.0]) for v in (0.5, 1.0, 2.0, 4.0, 9.0, None)] + [(1.0, None)], "v double, q array<double>")
    ranked = df.withColumn("p", climate.ladder_rank(F.col("v"), F.col("q"), 5))
    assert plan(ranked).count("filter(") == 1
    assert [r["p"] for r in ranked.collect()] == [0.0, 0.0, 0.5, 0.5 + 2.0 / 3.0 * 0.25, 1.0, None, None]
    days = "k int, v double"
    for batch, rows in enumerate(([(1, 1.0), (2, 2.0)], [(2, None), (3, 3.0)])):
        tables.log_sink(f"{out_dir}/log")(spark.createDataFrame(rows, days), batch)
    newest = tables.current(spark, f"{out_dir}/log", ["k"], spark.createDataFrame([], days).schema)
    assert "SortAggregate" not in plan(newest)
    assert sorted(tuple(r) for r in newest.collect()) == [(1, 1.0), (2, None), (3, 3.0)]


def test_the_window_reads_what_is_taken_of_the_ladder(spark):
    from terrasig.operators import world

    day = F.lit("2001-11-04").cast("date")
    signals = climate.world_signals(Tables(spark, SF).daily).filter("cell <= 2").cache()
    whole = climate.quantile_ladder(signals, climate.LADDER_SIGNALS)
    part = climate.quantile_ladder(signals, climate.LADDER_SIGNALS, asked=world.read_by_window(F.col("d"), day))
    rows = {(r["signal"], r["cell"], r["fortnight"]): r["q"] for r in part.collect()}
    assert {r["fortnight"] for r in whole.collect()} == {f for s, _, f in rows if s == "spi365"}
    assert {f for s, _, f in rows if s == "vpd"} == {21} and {f for s, _, f in rows if s == "kbdi"} == {21, 19}
    assert rows.items() <= {(r["signal"], r["cell"], r["fortnight"]): r["q"] for r in whole.collect()}.items()
    assert world.seeds(part, climate.fortnight(day), 401).exceptAll(world.seeds(whole, climate.fortnight(day), 401)).count() == 0
