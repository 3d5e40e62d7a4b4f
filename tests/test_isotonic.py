"""Isotonic regression in ordered ranges, and capping by histogram."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasig.operators import isotonic, sampling


def one_task(x, y):
    """The fit of all rows by one pass over distinct scores."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    lo, hi, n, total = isotonic.pool(x, x, np.ones(len(x)), y)
    return x, np.repeat(total / n, n.astype(int))


def test_pool_gives_ascending_means_of_least_squares():
    lo, hi, n, total = isotonic.pool(np.arange(6.0), np.arange(6.0), np.ones(6), np.array([0.0, 3, 1, 2, 5, 4]))
    assert (total / n).tolist() == [0.0, 2.0, 4.5] and lo.tolist() == [0.0, 1.0, 4.0] and hi.tolist() == [0.0, 3.0, 5.0]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "steps"])
def test_ranges_equal_one_task(spark, shape):
    n = 30_000
    rng = np.random.default_rng(3)
    x = np.arange(n) / n
    y = {"noise": (rng.random(n) < x).astype(float), "falling": 1 - x, "rising": x**2, "steps": ((np.arange(n) // 700) % 2).astype(float)}[shape]
    df = spark.createDataFrame(__import__("pandas").DataFrame({"s": x, "y": y}).sample(frac=1, random_state=1)).repartition(8)
    got = isotonic.fitted(df, "s", "y", blocks=1_000).toPandas().sort_values("x")
    want_x, want = one_task(x, y)
    assert len(got) == n and np.allclose(got["x"], want_x) and np.allclose(got["fitted"], want, atol=1e-9)


def test_a_million_distinct_scores(spark):
    df = spark.range(1_000_000).select(
        (F.col("id") / 1e6).alias("s"), (sampling.unit_random(1, "id") < 0.2 + 0.5 * F.col("id") / 1e6 + 0.2 * F.sin(F.col("id") / 3e4)).cast("int").alias("y")
    )
    got = isotonic.fitted(df, "s", "y", blocks=20_000).toPandas().sort_values("x")
    rows = df.toPandas()
    _, want = one_task(rows["s"].to_numpy(), rows["y"].to_numpy(float))
    assert len(got) == 1_000_000 and np.allclose(got["fitted"], want, atol=1e-9)


def test_calibrator_is_linear_between_knots_and_flat_beyond(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.6, 1), (0.8, 1), (None, 1)], "s double, y int")
    cal = isotonic.Calibrator.fit(df, "s", "y")
    assert list(zip(cal.x, cal.value, strict=True)) == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.6, 1.0), (0.8, 1.0)]
    asked = spark.createDataFrame([(v,) for v in (-1.0, 0.1, 0.15, 0.25, 0.45, 0.7, 9.0, None)], "raw double")
    got = [r["p"] for r in cal.transform(asked).orderBy(F.asc_nulls_last("raw")).collect()]
    assert got[:7] == pytest.approx([0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0]) and got[7] is None
    assert isotonic.Calibrator.fit(df.limit(0), "s", "y").transform(asked).filter("p is not null").count() == 0


@pytest.mark.parametrize("cap", [1, 999, 250_000, 10_000_000])
def test_cap_of_one_hot_label_equals_the_exact_rank(spark, cap):
    df = spark.range(400_000).select("id", F.lit(1).alias("label")).unionByName(spark.range(400_000, 401_000).select("id", F.lit(0).alias("label")))
    order = F.xxhash64(F.lit(5), "id")
    got = sampling.cap_per_label(df, "label", order, {1: cap, 0: 10})
    rows = df.select("id", "label", order.alias("o")).toPandas().sort_values("o")
    want = set(rows[rows.label == 1].head(cap)["id"]) | set(rows[rows.label == 0].head(10)["id"])
    ids = [r["id"] for r in got.collect()]
    assert len(ids) == len(want) and set(ids) == want
    _, ranked = sampling._cap_parts(df, "label", order, {1: cap, 0: 10}, 4096)
    assert ranked.count() <= 401_000 // 1000  # one bucket a label, of 4096


def test_cap_of_ties_missing_orders_and_unknown_labels(spark):
    df = spark.createDataFrame([(i, 1 if i < 6 else None if i < 8 else 2, None if i == 0 else 7) for i in range(10)], "id int, label int, o int")
    got = {r["id"] for r in sampling.cap_per_label(df, "label", F.col("o"), {1: 3}).collect()}
    assert len(got) == 3 and 0 in got and max(got) < 6
    assert sampling.cap_per_label(df.limit(0), "label", F.col("o"), {1: 3}).count() == 0
