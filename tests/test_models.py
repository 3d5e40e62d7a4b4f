"""Saved layers, the search frame and the subsets of the ablation."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from terrasig.operators import isotonic, ml, modelstore, sampling
from terrasig.plans import learning
from terrasig.plans.tables import Tables

QUICK = {"maxIter": 3, "maxDepth": 2}
DAY = datetime.date(2001, 11, 10)


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda k: sampling.unit_random(k, "id")
    df = spark.range(800).select("id", (F.col("id") % 16).cast("string").alias("block"), u(1).alias("x"), u(2).alias("noise"), F.lit(1.0).alias("flat"))
    return df.withColumn("label", (F.col("x") + 0.3 * F.col("noise") > 0.9).cast("int"))


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    made = modelstore.ModelStore(spark, str(tmp_path_factory.mktemp("models")))
    made.memory = modelstore.train(made, rows, ["x", "noise", "flat"], "label", "block", "id", "slope", "a", DAY, k=4, params=QUICK)
    return made


def test_a_loaded_layer_scores_like_the_one_in_memory(rows, store):
    loaded = modelstore.ModelStore(store.spark, store.root).load("slope")
    assert loaded.features == ["x", "noise"] and list(loaded.run["dropped"]) == ["flat"]
    a, b = ({r["id"]: r["p"] for r in layer.score(rows, "p").select("id", "p").collect()} for layer in (store.memory, loaded))
    assert a == b and all(0 <= p <= 1 for p in a.values())
    blank = rows.withColumns({f: F.lit(None).cast("double") for f in ("x", "noise")})
    assert loaded.score(blank).filter("p is not null").count() == 0


def test_the_run_record_says_what_was_done(store):
    run = store.latest("slope")
    assert (run["name"], run["status"], run["n_rows"], run["n_groups"], run["n_splits"], run["tuned"]) == ("slope-baseline", "complete", 800, 16, 4, False)
    assert len(run["folds"]) == 4 and run["roc_auc_mean"] > 0.9 and run["ece_after"] <= run["ece_before"] + 1e-9
    assert sum(i["gain_pct"] for i in run["importance"]) == pytest.approx(100) and run["importance"][0]["feature"] == "x"


def test_importance_fits_one_model_and_gives_the_record_of_the_trained_layer(spark, rows, monkeypatch):
    made = rows.select("id", "label", F.col("block").alias("block_id"), "x", *[sampling.unit_random(k, "id").alias(f) for k, f in enumerate(learning.FEATURES[1:], 3)])
    made, folded = made.withColumnRenamed("x", learning.FEATURES[0]), []
    for name, value in (("matrix", lambda t: made), ("PARAMS", QUICK), ("_STORES", {}), ("_GAINS", {})):
        monkeypatch.setattr(learning, name, value)
    whole = ml.out_of_fold
    monkeypatch.setattr(ml, "out_of_fold", lambda *a, **k: folded.append(a) or whole(*a, **k))
    t = Tables(spark, "none")
    alone, family = ({r[0]: r[1] for r in q(t).collect()} for q in (learning.importance, learning.importance_family))
    assert not folded and set(alone) == set(learning.FEATURES) and sum(family.values()) == pytest.approx(100)
    learning.store(t)
    assert folded and {r[0]: r[1] for r in learning.importance(t).collect()} == pytest.approx(alone)


def test_the_freshest_complete_version_is_found(spark, rows, store):
    record = store.latest("slope").asDict(recursive=True)
    fields = spark.createDataFrame([], modelstore.RUN).columns
    fresh = [record | {"version": v, "trained_at": d, "status": s, "layer": "other"} for v, d, s in (("1", DAY, "complete"), ("3", DAY, "complete"), ("2", DAY, "complete"), ("9", DAY + datetime.timedelta(9), "failed"))]
    for r in fresh:
        spark.createDataFrame([tuple(r[f] if f not in ("importance", "folds") else [tuple(x.values()) for x in r[f]] for f in fields)], modelstore.RUN).write.mode("append").json(f"{store.root}/runs")
    assert store.latest("other")["version"] == "3"
    assert store.latest("other", DAY - datetime.timedelta(1)) is None and store.load("none") is None


def test_operating_point_prefers_the_priced_threshold(spark, store):
    priced = spark.createDataFrame([("slope", 0.7), ("fire", 0.2)], "hazard string, threshold double")
    assert store.operating_point("slope", 0.5, priced) == 0.7
    assert store.operating_point("slope", 0.5, priced.filter("hazard = 'fire'")) == store.latest("slope")["recall_threshold"]
    assert store.operating_point("none", 0.5) == 0.5


def test_a_search_goes_on_where_it_stopped(rows, out_dir, monkeypatch):
    fits = []
    monkeypatch.setattr(ml, "SPACE", {"maxDepth": (1, 2, 3), "maxIter": (2, 3)})
    def factory(features, label, params):
        fits.append(params)
        return ml.gbt(features, label, params)

    draws = ml.draw_params(3)
    assert draws[:2] == ml.draw_params(2)
    log = f"{out_dir}/log"
    first = ml.search(rows, ["x", "noise"], "label", "block", 2, draws[:2], log, factory)
    assert first.count() == 4 and len(fits) == 4
    whole = ml.search(rows, ["x", "noise"], "label", "block", 2, draws, log, factory)
    assert whole.count() == 6 and len(fits) == 6 and whole.select("draw").distinct().count() == 3
    params, pr = ml.best_draw(whole)
    assert params in draws and pr == pytest.approx(whole.groupBy("draw").agg(F.avg("pr_auc").alias("p")).agg(F.max("p")).first()[0])


def test_folds_without_positives_are_left_out(spark, rows):
    df = rows.withColumn("fold", (F.col("id") % 4).cast("int")).withColumn("label", F.when(F.col("fold") == 2, 0).otherwise(F.col("label")))
    assert ml.usable_folds(df, "label", "fold") == [0, 1, 3]
    oof = ml.out_of_fold(df, ["x"], "label", "fold", QUICK)
    assert oof.filter("fold = 2").count() == 0 and oof.count() == df.filter("fold <> 2").count()
    assert ml.out_of_fold(df.filter("fold = 2"), ["x"], "label", "fold", QUICK).count() == 0


def test_no_two_subsets_are_equal(rows):
    for tags, without in ((learning.TAGS, learning.WITHOUT), (learning.RAIN_TAGS, learning.RAIN_WITHOUT)):
        sets = ml.feature_sets(tags, without)
        assert len({tuple(s) for s in sets.values()}) == len(sets) and all(sets.values())
    assert "road_dist_m" in ml.feature_sets(learning.TAGS, learning.WITHOUT)["shape_plus_road"]
    with pytest.raises(ValueError):
        ml.ablation(rows, {"a": ["x", "noise"], "b": ["noise", "x"]}, "label", "block", 2, QUICK)


def test_a_calibrator_keeps_its_knots(spark, out_dir):
    cal = isotonic.Calibrator.fit(spark.createDataFrame([(0.1, 0), (0.4, 1), (0.5, 0), (0.9, 1)], "s double, y int"), "s", "y")
    cal.knots.write.parquet(f"{out_dir}/k")
    again = isotonic.Calibrator(spark.read.parquet(f"{out_dir}/k"))
    assert (again.x, again.value) == (cal.x, cal.value)


def test_transfer_shows_a_planted_shift(rows):
    """In the region held out the relation is the other way round: the frozen model fails, the local one does not."""
    here, there = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1").withColumn("label", 1 - F.col("label"))
    got = {r["predictor"]: r for r in ml.transfer(here, there, ["x", "noise"], "label", "id", "block", 3, QUICK, "x", {"noise_only": ["noise"]}).collect()}
    assert got["frozen"]["roc_auc"] < 0.2 and got["local"]["roc_auc"] > 0.85 and got["floor"]["roc_auc"] < 0.2
    assert set(got) == {"frozen", "noise_only", "local", "floor"} and all(r["pr_auc"] is not None for r in got.values())


def test_held_out_regions_side_by_side(rows):
    df = rows.withColumns({"region": F.concat(F.lit("r"), F.col("id") % 2), "cls": F.when(F.col("id") % 2 == 0, F.floor(F.col("x") * 4))})
    got = {r["region"]: r for r in ml.leave_one_region_out(df, ["x", "noise"], "label", "region", "noise", QUICK, "id", "block", 2, "cls").collect()}
    assert all(r["loro_roc"] > 0.9 and r["local_roc"] > 0.85 and r["loro_pr"] > r["floor_pr"] for r in got.values())
    assert got["r0"]["class_roc"] > 0.8 and got["r1"]["class_roc"] is None and got["r1"]["wins"]
