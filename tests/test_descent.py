"""Proximity by descent: crowded cells and lone points, with the number of opened pairs bounded."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasig.operators import descent, sampling

EARTH = 6371000.0


def hav(la, lo, lats, lons, radius=EARTH):
    la, lo, lats, lons = np.radians(la), np.radians(lo), np.radians(lats), np.radians(lons)
    a = np.sin((lats - la) / 2) ** 2 + np.cos(la) * np.cos(lats) * np.sin((lons - lo) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1, a)))


def crowd(spark, n: int, lat: float, lon: float, deg: float, key: str):
    """n rows inside one small square."""
    u = lambda k: sampling.unit_random(k, "id")
    return spark.range(n).select(F.col("id").alias(key), (lat + deg * u(1)).alias("lat"), (lon + deg * u(2)).alias("lon"))


def lone(spark, n: int):
    """n rows all over the globe."""
    u = lambda k: sampling.unit_random(k, "id")
    return spark.range(n).select("id", F.degrees(F.asin(2 * u(3) - 1)).alias("lat"), (360 * u(4) - 180).alias("lon"))


def test_a_crowd_of_vertices_costs_lone_points_nothing(spark):
    ways, at = crowd(spark, 100_000, 47.0, 8.0, 0.01, "vertex"), lone(spark, 10_000)
    pairs = descent.nearest_candidates(at, ways)
    assert pairs.count() <= descent.OPEN * 10_000
    got = {r["id"]: r["metres"] for r in descent.nearest(at, ways.withColumnRenamed("vertex", "id")).collect()}
    assert len(got) == 10_000
    v = ways.toPandas()
    for r in at.filter("id % 97 = 0").collect():
        assert got[r["id"]] == pytest.approx(hav(r["lat"], r["lon"], v["lat"].to_numpy(), v["lon"].to_numpy()).min(), abs=1e-3)


def test_a_crowd_of_points_shares_its_search(spark):
    ways, at = lone(spark, 5_000).withColumnRenamed("id", "vertex"), crowd(spark, 50_000, -30.0, 140.0, 0.02, "id")
    ways = ways.unionByName(crowd(spark, 2_000, -30.0, 140.0, 0.02, "vertex").withColumn("vertex", F.col("vertex") + 10_000))
    assert descent.nearest_candidates(at, ways).count() <= descent.OPEN * 50_000
    got = {r["id"]: r["metres"] for r in descent.nearest(at, ways.withColumnRenamed("vertex", "id")).filter("id % 199 = 0").collect()}
    v = ways.toPandas()
    for r in at.filter("id % 199 = 0").collect():
        assert got[r["id"]] == pytest.approx(hav(r["lat"], r["lon"], v["lat"].to_numpy(), v["lon"].to_numpy()).min(), abs=1e-3)


def test_nearest_takes_the_lower_vertex_and_skips_missing_coordinates(spark):
    ways = spark.createDataFrame([(5, 1.0, 1.0), (3, 1.0, 1.0), (9, None, 1.0)], "id int, lat double, lon double")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, None, None)], "id int, lat double, lon double")
    assert sorted(map(tuple, descent.nearest(at, ways).collect())) == [(1, 3, 0.0), (2, 3, 0.0)]
    assert descent.nearest(at, ways.limit(0)).count() == 0 and descent.nearest(at.limit(0), ways).count() == 0


@pytest.mark.parametrize("km", [10.0, 0.5])
def test_radius_opens_only_the_rim(spark, km):
    """100,000 pixels on 2 km, of which the rim of ten kilometres cuts through some and that of 500 metres all."""
    pixels = crowd(spark, 100_000, 10.0, 20.0, 0.02, "id").withColumn("v", (F.col("id") % 7 + 1).cast("double"))
    at = spark.createDataFrame([(i, 10.0 + 0.0011 * i, 20.0 + 0.0007 * i) for i in range(100)], "id int, lat double, lon double")
    _, pairs = descent.radius_parts(at, pixels.select("lat", "lon", "v"), km)
    assert pairs.count() <= 100 * 100_000 // 10
    got = {r["id"]: r["s"] for r in descent.radius_sum(at, pixels, km, "v", "s").collect()}
    p = pixels.toPandas()
    for r in at.collect():
        near = hav(r["lat"], r["lon"], p["lat"].to_numpy(), p["lon"].to_numpy(), 6371008.8) <= km * 1000
        assert got[r["id"]] == pytest.approx(p["v"].to_numpy()[near].sum())


def test_radius_rim_grows_like_the_root_of_the_pixels(spark):
    at = spark.createDataFrame([(1, 10.005, 20.005)], "id int, lat double, lon double")
    opened = [descent.radius_parts(at, crowd(spark, n, 10.0, 20.0, 0.02, "v").select("lat", "lon", F.lit(1.0).alias("v")), 0.5)[1].count() for n in (25_000, 400_000)]
    assert opened[1] <= 6 * opened[0]  # sixteen times the pixels
