"""Skill metrics, alarm thresholds and verification tables as DataFrame aggregates.

Everything works from score histograms (ties collapsed) and ``ranking.running_totals``; no metric sorts all rows in one
task. Each takes optional group keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasig.operators import isotonic, ranking, series
from terrasig.session import cut_lineage

DAYS_PER_YEAR = 365.25
SWEEP_POINTS = 40
SWEEP_FROM, SWEEP_TO = 0.80, 0.9995


def average_precision(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-sum average precision with tied scores taken together; NULL without positives."""
    hist = ranking.score_histogram(df, score, label, keys)
    cum = ranking.running_totals(hist, "score", ["n", "pos"], keys, descending=True)
    step = F.col("pos") * (F.col("cum_pos") / F.col("cum_n"))
    return cum.groupBy(*keys).agg(
        F.when(F.max("tot_pos") > 0, F.sum(step) / F.max("tot_pos")).alias("pr_auc")
    )


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Mann-Whitney AUC with mid-ranks; NULL when a class is missing."""
    hist = ranking.score_histogram(df, score, label, keys)
    hist = hist.withColumn("neg", F.col("n") - F.col("pos"))
    cum = ranking.running_totals(hist, "score", ["pos", "neg"], keys, bounded=bounded)
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)
    pairs = (F.max("tot_pos") * F.max("tot_neg")).cast("double")
    return cum.groupBy(*keys).agg(F.when(pairs > 0, F.sum(won) / pairs).alias("roc_auc"))


def base_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    err = F.pow(F.col(score) - F.col(label), F.lit(2.0))
    return df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("n_pos"),
        F.avg(label).alias("base_rate"),
        F.avg(err).alias("brier"),
    )


def _join(parts: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put one-row-per-key results side by side."""
    out = parts[0]
    if keys:
        for p in parts[1:]:
            out = out.join(p, list(keys))
        return out
    out = out.withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def fold_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """PR-AUC, ROC-AUC, Brier, ECE, lift, size and base rate per key."""
    df = cut_lineage(df.select(*keys, score, label))
    parts = [
        base_metrics(df, score, label, keys),
        average_precision(df, score, label, keys),
        roc_auc(df, score, label, keys),
        calibration_error(df, score, label, keys),
    ]
    out = _join(parts, keys)
    return out.withColumn("lift", F.when(F.col("base_rate") > 0, F.col("pr_auc") / F.col("base_rate")))


def _bin(p: Column, n_bins: int) -> Column:
    """Equal-width bin by comparison with literal edges; the last bin is closed."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(n_bins)])
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= p)) - 1)


def reliability(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), n_bins: int = 10) -> DataFrame:
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, _bin(F.col(score), n_bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"), F.avg(label).alias("obs_rate"))
    )


def calibration_error(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), n_bins: int = 10
) -> DataFrame:
    rel = reliability(df, score, label, keys, n_bins)
    gap = F.col("n") * F.abs(F.col("mean_pred") - F.col("obs_rate"))
    return rel.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def threshold_for_recall(df: DataFrame, score: str, label: str, key: str, target: float = 0.80) -> DataFrame:
    """Lowest-alarm cut that reaches the target recall, with its precision and alarm rate.

    Rows are ordered by score descending and key ascending. The score where the recall is reached comes from the
    histogram; only the rows tied at that one score are ordered by key.
    """
    hist = ranking.score_histogram(df, score, label)
    cum = ranking.running_totals(hist, "score", ["n", "pos"], descending=True)
    hit = (
        cum.filter((F.col("tot_pos") > 0) & (F.col("cum_pos") / F.col("tot_pos") >= target))
        .groupBy()
        .agg(
            F.max_by(
                F.struct(
                    "score",
                    (F.col("cum_n") - F.col("n")).alias("n_above"),
                    (F.col("cum_pos") - F.col("pos")).alias("pos_above"),
                    "tot_n",
                    "tot_pos",
                ),
                "score",
            ).alias("_h")
        )
        .select("_h.*")
    )
    tied = df.select(F.col(key).alias("_key"), F.col(score).alias("score"), F.col(label).alias("_label")).join(hit, "score")
    run = ranking.running_totals(
        tied.select("_key", "n_above", "pos_above", "tot_n", "tot_pos", "score", F.lit(1).alias("n"), F.col("_label").cast("bigint").alias("pos"))
        .withColumnsRenamed({"tot_n": "all_n", "tot_pos": "all_pos"}),
        "_key",
        ["n", "pos"],
    )
    tp, k = F.col("pos_above") + F.col("cum_pos"), F.col("n_above") + F.col("cum_n")
    reached = run.filter(tp / F.col("all_pos") >= target)
    return reached.groupBy().agg(
        F.min_by(
            F.struct(
                F.lit(target).alias("target_recall"),
                F.col("score").alias("threshold"),
                (tp / F.col("all_pos")).alias("achieved_recall"),
                (tp / k).alias("precision"),
                (k / F.col("all_n")).alias("alarm_rate"),
            ),
            k,
        ).alias("_r")
    ).select("_r.*")


def tie_safe_thresholds(df: DataFrame, score: str, budgets: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Smallest distinct score whose served alarm rate (score >= threshold) fits the budget, else the largest score.

    The uncorrected quantile is reported beside it. Both read the same running totals.
    """
    keys = list(keys)
    hist = ranking.score_histogram(df, score, None, keys)
    cum = ranking.running_totals(hist, "score", ["n"], keys, descending=True)
    rate = F.col("cum_n") / F.col("tot_n")
    at = cum.withColumn("rate", rate).withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    best = at.groupBy(*keys, "budget").agg(
        F.min(F.when(F.col("rate") <= F.col("budget"), F.struct("score", "rate"))).alias("_fit"),
        F.max(F.struct("score", "rate")).alias("_top"),
    )
    naive = ranking.histogram_quantiles(cum, "score", [1 - b for b in budgets], keys, descending=True)
    naive = naive.select(*keys, F.round(1 - F.col("prob"), 9).alias("budget"), F.col("quantile").alias("naive_quantile"))
    pick = F.coalesce("_fit", "_top")
    return best.join(naive, [*keys, "budget"]).select(
        *keys,
        "budget",
        pick["score"].alias("threshold"),
        pick["rate"].alias("achieved_alarm_rate"),
        F.round(pick["rate"] * DAYS_PER_YEAR, 1).alias("alarm_days_per_cell_year"),
        "naive_quantile",
    )


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Rank correlation with average ranks over rows where both values exist."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = ranking.average_ranks(both, a, "_ra", keys, bounded=bounded)
    ranked = ranking.average_ranks(ranked, b, "_rb", keys, bounded=bounded)
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"))


def rank_pct(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank as a share of the group size."""
    ranked = ranking.average_ranks(df, value, "_r", keys)
    return ranked.withColumn(out, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def rank_pct_many(df: DataFrame, key: str, values: Sequence[str], group: str) -> DataFrame:
    """Average-tie rank shares of several columns within a group, all in one ordering of the unpivoted values."""
    long = df.select(key, group, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        [key, group], list(values), "_name", "_v"
    )
    ranked = rank_pct(long, "_v", "_p", [group, "_name"])
    back = ranked.groupBy(key).agg(*[F.max(F.when(F.col("_name") == v, F.col("_p"))).alias(v) for v in values])
    return df.drop(*values).join(back, key)


# ---- alarms on a replayed grid of cell-days


def with_alarm_flags(grid: DataFrame, alarm: Column, key: str | Sequence[str] = "cell", date: str = "d") -> DataFrame:
    """Alarm flag plus the +-1 row neighbourhood flags of events and alarms."""
    df = grid.withColumn("alarm", F.coalesce(alarm, F.lit(False)))
    df = series.near_flags(df, key, date, "event", "near_event")
    return series.near_flags(df, key, date, "alarm", "near_alarm")


def alarm_table(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """POD, FAR and alarm rate, strict and with one day of tolerance."""
    both = lambda a, b: F.count_if(F.col(a) & F.col(b))
    ev, al = F.count_if(F.col("event")), F.count_if(F.col("alarm"))
    some = lambda x, n: F.when(n > 0, x)
    return flagged.groupBy(*keys).agg(
        ev.alias("n_event_days"),
        al.alias("n_alarm_days"),
        (al / F.count(F.lit(1))).alias("alarm_rate"),
        some(both("event", "alarm") / F.nullif(ev, F.lit(0)), ev).alias("pod_strict"),
        some(both("event", "near_alarm") / F.nullif(ev, F.lit(0)), ev).alias("pod_1d"),
        some(1 - both("alarm", "event") / F.nullif(al, F.lit(0)), al).alias("far_strict"),
        some(1 - both("alarm", "near_event") / F.nullif(al, F.lit(0)), al).alias("far_1d"),
    )


def sweep_levels(n: int = SWEEP_POINTS) -> list[float]:
    return [SWEEP_FROM + (SWEEP_TO - SWEEP_FROM) * i / (n - 1) for i in range(n)]


def alarm_sweep(grid: DataFrame, score: str, key: str = "cell", date: str = "d", n: int = SWEEP_POINTS) -> DataFrame:
    """Alarm metrics at every distinct sweep quantile of the score.

    An alarm at threshold t is ``score >= t``, a near alarm ``max(neighbour scores) >= t``. So each row is reduced to
    three numbers once and histogrammed by how many thresholds they reach: the grid is scanned once, not n times. Only
    the at most n thresholds come to the driver.
    """
    grid = cut_lineage(grid.select(key, date, score, "event"))
    cuts = sorted({r[0] for r in ranking.exact_quantiles(grid, score, sweep_levels(n)).select("quantile").collect()})
    edges = F.array(*[F.lit(c) for c in cuts])
    w = Window.partitionBy(key).orderBy(date)
    s = F.col(score)
    around = F.greatest(s, F.lag(score).over(w), F.lead(score).over(w))
    rows = grid.withColumn("_near", around)
    rows = series.near_flags(rows, key, date, "event", "near_event")
    # index of the highest threshold a score reaches; 0 reaches none
    reach = lambda c: F.size(F.filter(edges, lambda e: e <= c))
    counts = (
        rows.select(
            F.when(s.isNull(), 0).otherwise(reach(s)).alias("ri"),
            F.when(F.col("_near").isNull(), 0).otherwise(reach(F.col("_near"))).alias("rn"),
            "event",
            "near_event",
        )
        .groupBy("ri", "rn", "event", "near_event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit, near = F.col("ri") >= F.col("k"), F.col("rn") >= F.col("k")
    # at most (n+1)^2*4 histogram rows meet n thresholds
    table = counts.select("*", F.posexplode(edges).alias("_k", "threshold")).withColumn("k", F.col("_k") + 1)
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    ev, al, all_n = total(F.col("event")), total(hit), F.sum("n")
    return table.groupBy("threshold").agg(
        ev.alias("n_event_days"),
        al.alias("n_alarm_days"),
        (al / all_n).alias("alarm_rate"),
        (total(F.col("event") & hit) / F.nullif(ev, F.lit(0))).alias("pod_strict"),
        (total(F.col("event") & near) / F.nullif(ev, F.lit(0))).alias("pod_1d"),
        (1 - total(F.col("event") & hit) / F.nullif(al, F.lit(0))).alias("far_strict"),
        (1 - total(F.col("near_event") & hit) / F.nullif(al, F.lit(0))).alias("far_1d"),
    )


def matched_rate(curves: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Per curve and target alarm rate, the sweep point whose rate is nearest (lowest threshold on ties)."""
    t = curves.withColumn("target", F.explode(F.array(*[F.lit(float(x)) for x in targets])))
    gap = F.abs(F.col("alarm_rate") - F.col("target"))
    best = t.groupBy("curve", "target").agg(
        F.min_by(F.struct("pod_1d", "alarm_rate"), F.struct(gap, "threshold")).alias("_b")
    )
    return best.select("curve", "target", "_b.pod_1d", "_b.alarm_rate")


def isotonic_fit(df: DataFrame, score: str, label: str) -> DataFrame:
    """Isotonic calibration value of every distinct score."""
    return isotonic.fitted(df, score, label)


def covariate_shift(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of test values outside the train 5-95 % band, per feature."""
    long = lambda df: df.unpivot([], list(features), "feature", "v").filter(F.col("v").isNotNull())
    tr, te = long(train.select(*features)), long(test.select(*features))
    q = ranking.exact_quantiles(tr, "v", (0.05, 0.95), ["feature"])
    band = q.groupBy("feature").agg(F.min("quantile").alias("lo"), F.max("quantile").alias("hi"))
    mean = tr.groupBy("feature").agg(F.avg("v").alias("train_mean"))
    out = te.join(band, "feature").groupBy("feature").agg(
        F.avg("v").alias("test_mean"),
        F.avg(((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).cast("double")).alias("outside_5_95"),
    )
    return out.join(mean, "feature")


def fold_ids(df: DataFrame, group: str, k: int) -> DataFrame:
    """Fold per group: groups by size descending, dealt in serpentine order, so folds are balanced and none is split.

    Groups are counted first and ordered by size, then by a hash of their name: the same order for few groups and for many.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.count()
    if total < k:
        raise ValueError(f"only {total} groups for {k} folds")
    ranked = _rank_groups(sizes, group)
    pos = F.col("_pos") - 1
    lap, step = F.floor(pos / k), pos % k
    fold = F.when(lap % 2 == 0, step).otherwise(k - 1 - step)
    return ranked.select(group, fold.cast("int").alias("fold"))


def _rank_groups(sizes: DataFrame, group: str) -> DataFrame:
    """Position of each group by size; groups of equal size are ordered by hash bucket and then by name."""
    classes = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_m"))
    cum = ranking.running_totals(classes, "_n", ["_m"], descending=True)
    ahead = cum.select("_n", (F.col("cum__m") - F.col("_m")).alias("_ahead"))
    buckets = sizes.withColumn("_b", F.substring(F.md5(F.col(group).cast("string")), 1, 3))
    counts = buckets.groupBy("_n", "_b").agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy("_n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_n", "_b", F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_n", "_b").orderBy(group))
    placed = buckets.withColumn("_i", inside).join(before, ["_n", "_b"]).join(ahead, "_n")
    return placed.withColumn("_pos", F.col("_ahead") + F.col("_before") + F.col("_i"))


def missingness(df: DataFrame, feature: str, label: str, covariate: str) -> DataFrame:
    """Does a feature's absence predict the label? Rates by class, covariate means and the AUC of absence alone."""
    m = F.col(feature).isNull().cast("double")
    rates = df.groupBy().agg(
        F.avg(m).alias("missing_rate"),
        F.avg(F.when(F.col(label) == 1, m)).alias("missing_rate_positives"),
        F.avg(F.when(F.col(label) == 0, m)).alias("missing_rate_background"),
        F.avg(F.when(m == 1, F.col(covariate))).alias("mean_cov_missing"),
        F.avg(F.when(m == 0, F.col(covariate))).alias("mean_cov_present"),
    )
    auc = roc_auc(df.select(m.alias("m"), label), "m", label).withColumnRenamed("roc_auc", "roc_of_missingness")
    return _join([rates, auc], [])


def feature_coverage(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    wide = df.groupBy(*keys).agg(*[(F.count(f) / F.count(F.lit(1))).alias(f) for f in features])
    return wide.unpivot(list(keys), list(features), "feature", "coverage")


def summarise_folds(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """Mean and population sd over the folds that have both classes, with the pooled value beside them."""
    per = fold_metrics(df, score, label, [fold]).filter(F.col("pr_auc").isNotNull())
    agg = per.groupBy().agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("pr_auc").alias("pr_auc_mean"),
        F.stddev_pop("pr_auc").alias("pr_auc_sd"),
        F.avg("roc_auc").alias("roc_auc_mean"),
        F.avg("brier").alias("brier_mean"),
    )
    return _join([agg, average_precision(df, score, label).withColumnRenamed("pr_auc", "pooled_pr_auc")], [])


def yearly_skill(flagged: DataFrame) -> DataFrame:
    ev = F.count_if(F.col("event"))
    return flagged.groupBy("year").agg(
        ev.alias("events"),
        (F.count_if(F.col("event") & F.col("near_alarm")) / F.nullif(ev, F.lit(0))).alias("pod_1d"),
        (F.count_if(F.col("alarm")) / F.count_distinct("cell")).alias("alarms_per_cell"),
    )


def scoped_skill(flagged: DataFrame) -> DataFrame:
    """Yearly skill for all domains together and for each one, in one pass.

    Rows are reduced to (domain, year, cell) first, so the grouping sets expand cells and not cell-days.
    """
    cells = flagged.groupBy("domain", "year", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event")).alias("ev"),
        F.count_if(F.col("alarm")).alias("al"),
        F.count_if(F.col("event") & F.col("near_alarm")).alias("hit"),
    )
    sets = cells.groupingSets([["year"], ["domain", "year"]], "domain", "year")
    return sets.agg(
        F.count_distinct("cell").alias("cells"),
        F.sum("n").alias("cell_days"),
        F.sum("ev").alias("events"),
        (F.sum("al") / F.sum("n")).alias("alarm_rate"),
        (F.sum("hit") / F.nullif(F.sum("ev"), F.lit(0))).alias("pod_1d"),
    ).withColumn("scope", F.coalesce("domain", F.lit("all"))).drop("domain")


def budgets_by_domain(grid: DataFrame, score: str, budgets: Sequence[float]) -> DataFrame:
    """What one pooled threshold and what the domain's own threshold deliver in each domain, per alarm budget."""
    probs = [1 - b for b in budgets]
    grid = cut_lineage(grid.select("cell", "d", "domain", score, "event"))
    own = ranking.exact_quantiles(grid, score, probs, ["domain"]).withColumn("kind", F.lit("own"))
    pooled = ranking.exact_quantiles(grid, score, probs).withColumn("kind", F.lit("pooled"))
    pooled = own.select("domain", "prob").join(pooled, "prob")
    cuts = own.unionByName(pooled).select(
        "domain", "kind", F.round(1 - F.col("prob"), 6).alias("budget"), F.col("quantile").alias("threshold")
    )
    w = Window.partitionBy("cell").orderBy("d")
    s = F.col(score)
    around = grid.withColumn("_near", F.greatest(s, F.lag(score).over(w), F.lead(score).over(w)))
    hist = around.groupBy("domain", s.alias("s"), "_near", "event").agg(F.count(F.lit(1)).alias("n"))
    at = hist.join(cuts, "domain")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    ev = total(F.col("event"))
    return at.groupBy("domain", "budget", "kind", "threshold").agg(
        ev.alias("n_event_days"),
        (total(F.col("s") >= F.col("threshold")) / F.sum("n")).alias("alarm_rate"),
        (total(F.col("event") & (F.col("_near") >= F.col("threshold"))) / F.nullif(ev, F.lit(0))).alias("pod_1d"),
    )


def external_benchmark(df: DataFrame, ours: str, external: str, label: str) -> DataFrame:
    """Both scores on the rows where both exist, with their rank correlation."""
    both = df.filter(F.col(ours).isNotNull() & F.col(external).isNotNull())
    rho = spearman(both, ours, external)
    parts = []
    for name, c in (("ours", ours), ("external", external)):
        row = _join([average_precision(both, c, label), roc_auc(both, c, label), rho], [])
        parts.append(row.withColumn("source", F.lit(name)))
    return parts[0].unionByName(parts[1])


def ensemble_by_region(df: DataFrame, parts: Sequence[str], label: str, region: str) -> DataFrame:
    """Equal-weight mean of within-region percentiles, judged by AUC per region with the mean and the worst."""
    for p in parts:
        df = rank_pct(df, p, f"_pct_{p}", [region])
    total = sum((F.col(f"_pct_{p}") for p in parts), F.lit(0.0))
    scored = df.withColumn("_e", F.round(total / len(parts), 9))
    per = roc_auc(scored, "_e", label, [region])
    every = Window.partitionBy()
    return per.select(
        region,
        F.round("roc_auc", 9).alias("roc_auc"),
        F.round(F.avg("roc_auc").over(every), 9).alias("mean_roc"),
        F.round(F.min("roc_auc").over(every), 9).alias("worst_roc"),
    )


def gauge_skill(both: DataFrame, key: str, date: str) -> DataFrame:
    """Raw correlation, rank correlation of seasonal percentiles and the hit rate on flood days, per gauge."""
    p = series.seasonal_percentiles(both, key, date, {"obs": "po", "sim": "ps"})
    ranked = F.col("po").isNotNull() & F.col("ps").isNotNull()
    flood = F.col("ps").isNotNull() & (F.col("po") >= 0.98)
    base = p.groupBy(key).agg(
        F.count_if(ranked).alias("n_days"),
        F.corr("obs", "sim").alias("pearson"),
        F.count_if(flood).alias("n_flood_days"),
        (F.count_if(flood & (F.col("ps") >= 0.95)) / F.nullif(F.count_if(flood), F.lit(0))).alias("hit_rate"),
    )
    return base.join(spearman(p, "po", "ps", [key], bounded=True), key, "left")


def drought_skill(panel: DataFrame, min_weeks: int) -> DataFrame:
    """Per county: AUC of dryness against the D2 label and rank correlation with severity; NULL with one class.

    A county's weeks are bounded by the calendar. The panel is written once because three statistics read it.
    """
    panel = cut_lineage(panel.select("fips", "label", "severity", "spi90"))
    per = panel.groupBy("fips").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.sum("label").cast("bigint").alias("d2_weeks")
    ).filter(F.col("n_weeks") >= min_weeks)
    df = panel.select("fips", "label", "severity", (F.lit(1.0) - F.col("spi90")).alias("dry"), (-F.col("spi90")).alias("neg"))
    out = per.join(roc_auc(df, "dry", "label", ["fips"], bounded=True), "fips", "left").join(
        spearman(df, "severity", "neg", ["fips"], bounded=True), "fips", "left"
    )
    mixed = (F.col("d2_weeks") > 0) & (F.col("d2_weeks") < F.col("n_weeks"))
    return out.select(
        "fips",
        "n_weeks",
        "d2_weeks",
        F.when(mixed, F.col("roc_auc")).alias("auc_spi90"),
        F.when(mixed, F.col("spearman")).alias("spearman_sev_spi90"),
    )
