"""Invariants of the random designs, sinks and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrasig.functions import geo
from terrasig.operators import jobs, ml, sampling, serving
from terrasig.plans import matrices
from terrasig.plans.joins import cases
from terrasig.plans.serving import nightly
from terrasig.plans.tables import Tables
from terrasig.sources import sinks

SF = "/root/testdata/sf0.001"


def test_controls_keep_their_distance_and_are_repeatable(spark):
    t = Tables(spark, SF)
    cand = sampling.control_candidates(cases(t), t.event_day, 1996, 2001)
    a, b = (sampling.controls(cand, 4, 17).collect() for _ in range(2))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a
    other = sampling.controls(cand, 4, 18).collect()
    assert sorted(map(tuple, a)) != sorted(map(tuple, other))
    drawn = sampling.controls(cand, 4, 17)
    near = drawn.join(t.event_day, "cell").filter(F.abs(F.datediff("control", "d")) <= 7)
    assert near.count() == 0
    own = drawn.join(cases(t), ["stratum", "cell"])
    assert own.filter(F.year("control").between(1996, 2001)).count() == own.count()
    assert drawn.groupBy("stratum").count().agg(F.max("count")).first()[0] <= 4


def test_background_is_inside_clear_and_repeatable(spark):
    t = Tables(spark, SF)
    pos = matrices.positives(t)
    box = (-100.0, -40.0, 100.0, 40.0)
    bg = sampling.background_near(pos, 5, box, 17, 12_000.0, 500.0)
    again = sampling.background_near(pos, 5, box, 17, 12_000.0, 500.0)
    assert sorted(map(tuple, bg.collect())) == sorted(map(tuple, again.collect()))
    assert bg.filter(~(F.col("lon").between(-100, 100) & F.col("lat").between(-40, 40))).count() == 0
    p = pos.select(F.col("lat").alias("pla"), F.col("lon").alias("plo"), F.col("id").alias("anchor"))
    m = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("pla"), F.col("plo"))
    assert bg.join(p, F.abs(F.col("lat") - F.col("pla")) < 1).filter(m < 500).count() == 0
    assert bg.join(p, "anchor").filter(m > 12_100).count() == 0
    uni = sampling.background_uniform(pos, 500, box, 17, 500.0)
    assert 0 < uni.count() <= 500 and uni.filter(~F.col("lat").between(-40, 40)).count() == 0


def test_susceptibility_respects_caps(spark):
    t = Tables(spark, SF)
    df = matrices.susceptibility(t)
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    assert n[0] <= matrices.BACKGROUND_RATIO * n[1]


def test_sample_k_is_whole_for_small_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1)], "g string, id int")
    got = {r["g"]: r["count"] for r in sampling.sample_k(df, ["g"], ["id"], 5, 1).groupBy("g").count().collect()}
    assert got == {"a": 5, "b": 1}


def test_matrix_writer_replaces_only_its_partitions(spark, out_dir):
    path = f"{out_dir}/m"
    sinks.write_matrix(spark.createDataFrame([(1, "a"), (2, "b")], "v int, region string"), path, ["region"])
    sinks.write_matrix(spark.createDataFrame([(9, "b")], "v int, region string"), path, ["region"])
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "region").collect())) == [(1, "a"), (9, "b")]


def test_history_is_idempotent_and_capped(spark):
    old = spark.createDataFrame([("x", f"2001-{m:02d}-{d:02d}", "green") for m in range(1, 8) for d in range(1, 29)], "location_id string, as_of string, status string")
    old = old.withColumn("as_of", F.col("as_of").cast("date"))
    new = spark.createDataFrame([("x", "2001-07-28", "red"), ("y", "2001-07-28", "red")], old.schema.simpleString()[7:-1].replace("as_of:date", "as_of:string")).withColumn("as_of", F.col("as_of").cast("date"))
    once = sinks.upsert_history(old, new)
    twice = sinks.upsert_history(once, new)
    assert once.filter("location_id = 'x'").count() == 180
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.filter("location_id = 'x' and as_of = '2001-07-28'").first()["status"] == "red"


def test_records_drop_missing_fields_and_partition_by_key(spark, out_dir):
    df = spark.createDataFrame([("a", "red", None), ("b", "green", 0.5)], "location_id string, status string, spi90 double")
    rec = sinks.json_records(df, "location_id", ["status", "spi90"])
    assert dict(map(tuple, rec.collect())) == {"a": '{"status":"red"}', "b": '{"status":"green","spi90":0.5}'}
    sinks.write_records(rec, "location_id", f"{out_dir}/r")
    assert spark.read.text(f"{out_dir}/r").count() == 2


def test_nightly_job_is_repeatable_and_publishes(spark):
    t = Tables(spark, SF)
    rows = nightly(t)
    a, b = (sorted(map(str, nightly(t).select("location_id", "as_of", "status", "message").collect())) for _ in range(2))
    assert a == b and len(a) == t.place.count()
    old = rows.select("location_id", F.date_sub("as_of", 1).alias("as_of"), "status", "rain3d_pctl", "rain30d_pctl", "spi90", "fire_danger", "flood_pctl")
    records, index, history = jobs.publish(rows, old)
    assert records.count() == index.count() == len(a) and history.count() == 2 * len(a)


def test_register_keeps_the_first_request(spark):
    old = spark.createDataFrame([("aaa", 1, "seed")], "geohash string, id int, origin string")
    new = spark.createDataFrame([("aaa", 7, "r"), ("bbb", 9, "r"), ("bbb", 3, "r")], "geohash string, id int, origin string")
    got = serving.register(old, new)
    assert sorted(map(tuple, got.collect())) == [("aaa", 1, "seed"), ("bbb", 3, "r")]
    assert serving.register(got, new).count() == 2


def test_model_finds_a_planted_signal(spark):
    df = spark.range(600).select(
        "id",
        (F.col("id") % 20).cast("string").alias("block"),
        sampling.unit_random(1, "id").alias("x"),
        F.when(F.col("id") % 9 != 0, sampling.unit_random(2, "id")).alias("noise"),
    )
    df = df.withColumn("label", (F.col("x") > 0.7).cast("int"))
    df, feats = ml.with_indicators(df, ["x", "noise"])
    assert feats == ["x", "noise", "noise_missing"]
    quick = {"maxIter": 3, "maxDepth": 2}
    oof, summary = ml.cross_validate(df, feats, "label", "block", 3, quick)
    assert oof.count() == 600 and summary.first()["roc_auc_mean"] > 0.95
    cal = ml.calibrate(oof, "oof", "label")
    fitted = [r["p"] for r in cal.transform(oof.select(F.col("oof").alias("raw")).distinct()).orderBy("raw").collect()]
    assert fitted == sorted(fitted)
    imp = ml.importance(ml.gbt(feats, "label", quick).fit(df), feats, df).first()
    assert imp["feature"] == "x"
    assert len(ml.draw_params(5)) == 5 and ml.draw_params(5) == ml.draw_params(5)


def test_fire_cells_per_domain(spark):
    from terrasig.plans import matrices

    got = matrices.fire_cells(spark.range(1000).withColumnRenamed("id", "cell")).groupBy("domain").count().collect()
    assert {r["domain"]: r["count"] for r in got} == {"us": 320, "canada": 220}
