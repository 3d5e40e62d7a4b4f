"""Case-control design: strata, control dates, background points, caps and hash samples.

Random draws are replaced by an ordering on xxhash64(seed, key): the same seed gives the same design on any cluster
size and a retried task draws the same rows.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.functions import grids
from terrasig.functions.dates import same_day_in_year
from terrasig.operators import ranking, spatial

SEASON_WINDOW = 45
METRES_PER_DEGREE = 111_320.0


def unit_random(seed: int, *keys: Column | str) -> Column:
    """Deterministic uniform number in [0, 1) from a seed and key columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / float(1 << 52)


def stratum_id(lat: Column, lon: Column, d: Column) -> Column:
    return F.format_string("%.4f_%.4f_%s", lat, lon, d.cast("string"))


def keys_with_at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of keys that carry at least n rows; only the per-key counts meet the join."""
    dense = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(*keys)
    return df.join(dense, keys, "left_semi")


def complete_strata(df: DataFrame, stratum: str = "stratum", label: str = "label") -> DataFrame:
    """Strata that kept a case and a control. There are nearly as many as rows, so they are not broadcast from an estimate."""
    ok = df.groupBy(stratum).agg(F.max(label).alias("_hi"), F.min(label).alias("_lo"))
    return df.hint("merge").join(ok.filter((F.col("_hi") == 1) & (F.col("_lo") == 0)), stratum, "left_semi")


def sample_k(df: DataFrame, group: list[str], key: list[str], k: int, seed: int) -> DataFrame:
    """k rows per group by hash order. The rank filter is applied per partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), *key), *key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _cap_parts(df: DataFrame, label: str, order: Column, caps: dict[int, int], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are in for certain, and those of the one bucket per label that its cap cuts, with `_need` of them wanted.

    Buckets follow the order's own quantiles; any monotone bucket is right, so doubles do for them.
    """
    keyed = df.withColumn("_o", order).withColumn("_x", F.coalesce(F.col("_o").cast("double"), F.lit(-float("inf"))))
    cuts = keyed.agg(F.percentile_approx("_x", [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0] or []
    splits = [-float("inf"), *sorted({c for c in cuts if abs(c) != float("inf")}), float("inf")]
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket", handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn("_bucket", F.lit(0.0))
    cap = F.lit(0)
    for value, n in caps.items():
        cap = F.when(F.col(label) == value, F.lit(n)).otherwise(cap)
    counts = keyed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # `buckets` rows a label
    need = (cap - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_need")
    wanted = counts.select(F.col(label).alias("_label"), F.col("_bucket").alias("_b"), "_n", need).filter("_need > 0")
    met = keyed.join(wanted, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b")))
    return met.filter("_n <= _need").select(*df.columns), met.filter("_n > _need").select(*df.columns, "_o", "_bucket", "_need")


def cap_per_label(df: DataFrame, label: str, order: Column, caps: dict[int, int], buckets: int = 4096) -> DataFrame:
    """First cap(label) rows per label by a numeric order, missing first.

    A histogram of (label, bucket of the order) says which buckets are in as a whole; only the rows of the bucket that a cap
    cuts are ranked, so no task sorts a label.
    """
    whole, cut = _cap_parts(df, label, order, caps, buckets)
    w = Window.partitionBy(label, "_bucket").orderBy("_o")
    return whole.unionByName(cut.withColumn("_r", F.row_number().over(w)).filter("_r <= _need").select(*df.columns))


def informative_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n, n_distinct) of the columns that are neither empty nor constant."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], list(features), "feature", "v")
    return (
        long.groupBy("feature")
        .agg(F.count("v").alias("n"), F.count_distinct("v").alias("n_distinct"))
        .filter(F.col("n_distinct") > 1)
    )


def dedupe_locations(df: DataFrame, order: Column, deg: float = 0.00083) -> DataFrame:
    """First point per ~90 m cell in input order, as a partial aggregate."""
    cells = df.withColumns({"_i": grids.snap(F.col("lat"), deg), "_j": grids.snap(F.col("lon"), deg)})
    cells = cells.withColumn("_o", order)
    return ranking.first_by(cells, ["_i", "_j"], [F.col("_o")], df.columns).drop("_i", "_j")


def _with_banned(cases: DataFrame, events: DataFrame, lo: datetime.date, hi: datetime.date, exclusion_days: int) -> DataFrame:
    """Cases with `_banned`: one bit a day from `lo` to `hi`, set within the exclusion of an event of the case's cell."""
    at = F.datediff("d", F.lit(lo))
    first, last = at - exclusion_days, at + exclusion_days
    ones = F.lit(-1).cast("bigint")
    words = []
    for start in range(0, (hi - lo).days + 1, 64):
        up = F.call_function("shiftleft", ones, F.greatest(F.lit(0), first - start))
        down = F.call_function("shiftrightunsigned", ones, 63 - F.least(F.lit(63), last - start))
        words.append(F.coalesce(F.bit_or(F.when((first <= start + 63) & (last >= start), up.bitwiseAND(down))), F.lit(0).cast("bigint")))
    banned = events.groupBy("cell").agg(F.array(*words).alias("_bits"))
    # the partition count is pinned: the rows multiply after this exchange, and adaptive coalescing sees them before
    parts = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.array(*[F.lit(0).cast("bigint")] * len(words))
    return cases.repartition(parts, "cell").join(banned, "cell", "left").withColumn("_banned", F.coalesce("_bits", none)).drop("_bits")


def _season(d: Column, year: Column, lo: datetime.date, hi: datetime.date) -> Column:
    """Day numbers around the date's day in another year, from `lo` to `hi`."""
    a = F.unix_date(same_day_in_year(d, year))
    first, last = F.unix_date(F.lit(lo)), F.unix_date(F.lit(hi))
    return F.sequence(F.greatest(first, a - SEASON_WINDOW), F.least(last, a + SEASON_WINDOW))


def _is_free(day: Column, banned: Column, lo: datetime.date) -> Column:
    at = day - (lo - datetime.date(1970, 1, 1)).days
    return F.getbit(F.get(banned, F.shiftright(at, 6)), at.bitwiseAND(63)) == 0


def control_candidates(
    cases: DataFrame, events: DataFrame, year_min: int, year_max: int, exclusion_days: int = 7
) -> DataFrame:
    """Every admissible control date of a case: other years, same day +-45, clear of the cell's own events.

    ``cases(stratum, cell, d)``; ``events(cell, d)``. Each cell's banned days are a bitmap that its cases take along, so
    cases are shuffled and their hundreds of candidates are not.
    """
    lo, hi = datetime.date(year_min, 1, 1), datetime.date(year_max, 12, 31)
    years = F.explode(F.sequence(F.lit(year_min), F.lit(year_max)))
    other = _with_banned(cases, events, lo, hi, exclusion_days).withColumn("_y", years).filter(F.col("_y") != F.year("d"))
    cand = other.select("stratum", "cell", "_banned", F.explode(_season(F.col("d"), F.col("_y"), lo, hi)).alias("_day"))
    free = cand.filter(_is_free(F.col("_day"), F.col("_banned"), lo))
    return free.select("stratum", "cell", F.date_from_unix_date("_day").alias("control"))


def controls(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    return sample_k(candidates, ["stratum"], ["stratum", "control"], n, seed)


def draw_controls(
    cases: DataFrame, events: DataFrame, year_min: int, year_max: int, n: int, seed: int, exclusion_days: int = 7
) -> DataFrame:
    """`controls` of the `control_candidates`: each case picks its own n first, and only those are ranked by stratum."""
    lo, hi = datetime.date(year_min, 1, 1), datetime.date(year_max, 12, 31)

    order = lambda day: F.xxhash64(F.lit(seed), "stratum", day)  # a day number and its date have one hash
    years = F.filter(F.sequence(F.lit(year_min), F.lit(year_max)), lambda y: y != F.year("d"))

    def free(low: int | None = None) -> Column:
        ok = lambda day: _is_free(day, F.col("_banned"), lo)
        test = ok if low is None else lambda day: (order(day) <= low) & ok(day)
        return F.flatten(F.transform(years, lambda y: F.filter(_season(F.col("d"), y, lo, hi), test)))

    # about eight times as many days as are wanted have an order this low; a case that finds fewer than n there looks at all
    share = min(1.0, 8 * n / ((2 * SEASON_WINDOW + 1) * max(1, year_max - year_min)))
    own = _with_banned(cases, events, lo, hi, exclusion_days).withColumn("_low", free(min(2**63 - 1, int(share * 2**64) - 2**63)))
    own = own.select("stratum", "cell", F.when(F.size("_low") >= n, F.col("_low")).otherwise(free()).alias("_days"))
    # the n-th order (none where there are fewer) is taken before the days are exploded, once a case
    own = own.withColumn("_last", F.get(F.sort_array(F.transform("_days", order)), F.lit(n - 1)))
    picked = own.select("stratum", "cell", "_last", F.explode("_days").alias("_day"))
    picked = picked.filter(F.col("_last").isNull() | (order(F.col("_day")) <= F.col("_last")))
    picked = picked.select("stratum", "cell", F.date_from_unix_date("_day").alias("control"))
    return sample_k(picked, ["stratum"], ["stratum", "control"], n, seed)


def case_control_rows(cases: DataFrame, drawn: DataFrame) -> DataFrame:
    """Cases (label 1) and their drawn controls (label 0) in one table."""
    one = cases.select("stratum", "cell", "d", F.lit(1).alias("label"))
    return one.unionByName(drawn.select("stratum", "cell", F.col("control").alias("d"), F.lit(0).alias("label")))


def temporal_freeze(df: DataFrame, split_year: int) -> DataFrame:
    """Rows dated up to the split whose stratum's case is too and that keeps a control.

    A stratum may repeat its case; one case year per stratum decides.
    """
    case_year = df.filter(F.col("label") == 1).groupBy("stratum").agg(F.min(F.year("d")).alias("_cy"))
    early = df.filter(F.year("d") <= split_year)
    kept = early.join(case_year.filter(F.col("_cy") <= split_year), "stratum", "left_semi")
    return complete_strata(kept)


def _clear_of(cand: DataFrame, positives: DataFrame, min_m: float) -> DataFrame:
    return spatial.without_neighbours(cand, positives, "id", min_m)


def background_near(
    positives: DataFrame, n_per_positive: int, bbox: tuple[float, float, float, float], seed: int, radius_m: float, min_m: float
) -> DataFrame:
    """Target-group background: points uniform in a disc around real events, inside the box, clear of every event.

    Each event emits the same number of candidates, so the anchors follow the reporting density and no global draw is
    needed.
    """
    x0, y0, x1, y1 = bbox
    cand = positives.select("id", F.col("lat").alias("_la"), F.col("lon").alias("_lo")).withColumn(
        "_n", F.explode(F.sequence(F.lit(1), F.lit(n_per_positive)))
    )
    r = F.lit(radius_m) * F.sqrt(unit_random(seed, "id", "_n", F.lit("r")))
    th = unit_random(seed, "id", "_n", F.lit("t")) * (2 * math.pi)
    cand = cand.select(
        F.col("id").alias("anchor"),
        F.xxhash64("id", "_n").alias("id"),
        (F.col("_la") + r * F.cos(th) / METRES_PER_DEGREE).alias("lat"),
        (F.col("_lo") + r * F.sin(th) / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians("_la")), F.lit(1e-6)))).alias("lon"),
    )
    inside = cand.filter(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
    return _clear_of(inside, positives, min_m)


def background_uniform(
    positives: DataFrame, n: int, bbox: tuple[float, float, float, float], seed: int, min_m: float
) -> DataFrame:
    """Equal-area uniform background in the box, clear of every event."""
    x0, y0, x1, y1 = bbox
    s0, s1 = math.sin(math.radians(y0)), math.sin(math.radians(y1))
    cand = positives.sparkSession.range(n).select(
        "id",
        F.degrees(F.asin(F.lit(s0) + unit_random(seed, "id", F.lit("y")) * (s1 - s0))).alias("lat"),
        (F.lit(x0) + unit_random(seed, "id", F.lit("x")) * (x1 - x0)).alias("lon"),
    )
    return _clear_of(cand, positives, min_m)
