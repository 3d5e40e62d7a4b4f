"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "seasonal_extremes",
    "rain_features",
    "spi_features",
    "kbdi",
    "fire_features",
    "quantile_ladder",
    "world_score",
    "flow_percentile",
    "forecast_outlook",
    "gapfill_bias",
    "source_verdict",
    "control_candidates",
    "radius_sum",
    "nearest_neighbour",
    "anti_proximity",
    "density_windows",
    "terrain_derive",
    "metric_spearman",
    "tie_safe_threshold",
    "alarm_sweep",
    "drought_skill",
    "watchlist",
    "nightly_update",
)


def main() -> None:
    from terrasig.plans import load
    from terrasig.session import build

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="bench", memory="16g")
    queries, _ = load()
    picked = sys.argv[1:] or HEADLINE
    # a first small job keeps JVM start-up out of the timings
    queries["agg_year_hist"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in picked:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
