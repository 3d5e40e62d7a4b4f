"""Physical plans: exchanges, pushdown and the absence of nested loops."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from terrasig.operators import climate, descent, sampling, spatial
from terrasig.plans import load
from terrasig.plans.tables import Tables

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_rain_features_add_no_exchange_to_the_dense_series(spark):
    t = Tables(spark, SF)
    assert exchanges(climate.rain_features(t.daily)) == exchanges(t.daily) == 2


def test_fire_features_exchange_once_after_the_fold(spark):
    t = Tables(spark, SF)
    assert exchanges(climate.fire_features(t.daily)) <= exchanges(t.daily) + 2


def test_no_nested_loops_in_spatial_joins(spark):
    t = Tables(spark, SF)
    for df in (
        descent.radius_sum(t.place, t.point, 100.0, "people", "people"),
        spatial.without_neighbours(t.point, t.place, "id", 500.0),
        spatial.first_box(t.point, t.place.select(F.col("name").alias("region"), (F.col("lon") - 1).alias("x0"), (F.col("lat") - 1).alias("y0"), (F.col("lon") + 1).alias("x1"), (F.col("lat") + 1).alias("y1"))),
        spatial.node_representatives(t.point, -50.0, -170.0, 25, 85, 4.0),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_no_query_needs_a_product(spark):
    for name in ("join_case_features", "anti_banned_dates", "control_candidates", "asof_latest", "channel_snap", "gauge_match", "ring_neighbourhood", "status_compose", "watchlist"):
        text = plan(QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_scans_are_pruned_and_filtered(spark):
    t = Tables(spark, SF)
    text = plan(t.event)
    assert "props" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "EqualTo(event_type,error)" in plan(t.event.filter("kind = 'error'"))
    text = plan(t.cell_day.select("cell", "d", "qty"))
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "l_extendedprice" not in schema and "l_quantity" in schema


def test_group_samples_are_limited_before_the_shuffle(spark):
    t = Tables(spark, SF)
    text = plan(sampling.sample_k(t.read("customer"), ["c_nationkey"], ["c_custkey"], 5, 1))
    assert text.count("WindowGroupLimit") == 2


def test_wide_jobs_scan_the_raw_rows_once(spark):
    """The daily series is written before it is read: what is left of the plan has no scan of the raw rows."""
    for name in ("nightly_update", "watchlist", "compound_flags", "world_score", "parity_report", "hazard_blocks"):
        assert plan(QUERIES[name](spark, SF)).count("lineitem.parquet") == 0, name


def test_only_the_years_asked_for_are_read(spark, out_dir):
    from terrasig.plans.landing import land_years
    from terrasig.sources import payloads

    land_years(Tables(spark, SF), f"{out_dir}/y")
    text = plan(payloads.read_years(spark, f"{out_dir}/y", "cell bigint, d date, m3s double, version string", 1997, 1999))
    assert "PartitionFilters: [isnotnull(year" in text and "PushedFilters: []" in text
