"""Global orderings without a single-task sort.

Metrics such as average precision, mid-rank AUC and exact quantiles need running totals over all scores. Ties are
collapsed by a partial aggregate first. A small result is then summed in one window; a large one is cut into value
ranges at sampled quantiles, summed inside each range in parallel, and shifted by the totals of the ranges below it,
of which there are at most ``RANGES``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.session import cut_lineage

RANGES = 256
SMALL = 200_000


def _cuts(hist: DataFrame, value: str, small: int) -> list[float]:
    probs = [i / RANGES for i in range(1, RANGES)]
    n, cuts = hist.agg(
        F.count(F.lit(1)), F.percentile_approx(value, probs, 4096)
    ).first()
    return sorted(set(cuts)) if n > small else []


def running_totals(
    hist: DataFrame,
    value: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
    small: int = SMALL,
    bounded: bool = False,
) -> DataFrame:
    """Inclusive running totals ``cum_<c>`` and group totals ``tot_<c>`` of a tie-free histogram.

    ``bounded`` says that a key's rows are limited by construction (a cell's calendar, a county's weeks), so one window
    per key is enough. Otherwise the histogram is written once and its size decides.
    """
    keys = list(keys)
    order = F.col(value).desc() if descending else F.col(value).asc()
    if bounded and not keys:
        raise ValueError("a bounded ordering needs keys")
    if not bounded:
        hist = cut_lineage(hist)
    cuts = [] if bounded else _cuts(hist, value, small)
    if not cuts:
        w = Window.partitionBy(*keys)
        run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return hist.withColumns(
            {f"cum_{c}": F.sum(c).over(run) for c in sums} | {f"tot_{c}": F.sum(c).over(w) for c in sums}
        )
    edges = F.array(*[F.lit(float(c)) for c in cuts])
    part = F.size(F.filter(edges, lambda e: e < F.col(value)))
    hist = hist.withColumn("_part", part)
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = hist.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums})
    porder = F.col("_part").desc() if descending else F.col("_part").asc()
    w = Window.partitionBy(*keys)
    ahead = w.orderBy(porder).rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(w).alias(f"tot_{c}") for c in sums],
    )
    joined = local.join(offsets, [*keys, "_part"])
    return joined.withColumns({f"cum_{c}": F.col(f"_in_{c}") + F.col(f"_off_{c}") for c in sums}).drop(
        "_part", *[f"_in_{c}" for c in sums], *[f"_off_{c}" for c in sums]
    )


def average_ranks(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = (), small: int = SMALL, bounded: bool = False
) -> DataFrame:
    """Mid-rank of every row (ties share the average); NULL values get NULL. ``<out>_n`` is the group size."""
    keys = list(keys)
    if bounded:
        present = F.col(value).isNotNull()
        w = Window.partitionBy(*keys)
        ties = F.count(value).over(w.orderBy(F.col(value).asc_nulls_last()).rangeBetween(Window.currentRow, Window.currentRow))
        below = F.count(value).over(w.orderBy(F.col(value).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumns(
            {out: F.when(present, below - (ties - 1) / 2.0), f"{out}_n": F.when(present, F.count(value).over(w))}
        )
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(hist, value, ["_c"], keys, small=small)
    ranks = cum.select(
        *keys,
        value,
        (F.col("cum__c") - (F.col("_c") - 1) / 2.0).alias(out),
        F.col("tot__c").alias(f"{out}_n"),
    )
    return df.join(ranks, [*keys, value], "left")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), small: int = SMALL
) -> DataFrame:
    """Linearly interpolated quantiles over all rows: one output row per (keys, prob)."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return histogram_quantiles(running_totals(hist, value, ["n"], keys, small=small), value, probs, keys)


def histogram_quantiles(
    cum: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Quantiles read from running totals of counts ``n``."""
    keys = list(keys)
    at = cum.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_h", (F.col("tot_n") - 1) * F.col("prob")
    )
    end = F.col("tot_n") - F.col("cum_n") + F.col("n") if descending else F.col("cum_n")
    first = end - F.col("n")
    lo, hi = F.floor("_h"), F.ceil("_h")
    holds = lambda pos: (first <= pos) & (pos < end)
    picked = at.filter(holds(lo) | holds(hi))
    return (
        picked.groupBy(*keys, "prob")
        .agg(
            F.max(F.when(holds(lo), F.col(value))).alias("_lo"),
            F.max(F.when(holds(hi), F.col(value))).alias("_hi"),
            F.max(F.col("_h") - F.floor("_h")).alias("_f"),
        )
        .select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))
    )


def score_histogram(df: DataFrame, score: str, label: str | None, keys: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if label:
        aggs.append(F.sum(F.col(label).cast("bigint")).alias("pos"))
    return df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(*aggs)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """First row per key by an ordering, as an aggregate: partial results are merged before the shuffle."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")
