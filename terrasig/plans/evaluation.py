"""Skill metrics, thresholds, calibration and replay verification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.operators import isotonic, metrics
from terrasig.plans.aggregates import PANEL_SQL, TERRAIN_SQL, panel, rounded, terrain_table
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables
from terrasig.plans.views import seasonal_sql, with_views


def pr_sql(src: str, score: str = "score", label: str = "label", keys: str = "") -> str:
    """Average precision and mid-rank AUC per key, written with windows over distinct scores."""
    g, p = (f"{keys}, " if keys else ""), (f"PARTITION BY {keys} " if keys else "")
    return f"""SELECT {g} CASE WHEN MAX(tp) > 0 THEN SUM(pos*cp/cn)/MAX(tp) END AS pr_auc,
        CASE WHEN MAX(tp)*MAX(tn - tp) > 0 THEN SUM(pos*((tn - tp) - (cn - cp) + (n - pos)/2e0))/(MAX(tp)*MAX(tn - tp)) END AS roc_auc FROM (
        SELECT {g} n, pos, CAST(SUM(n) OVER w AS DOUBLE) AS cn, CAST(SUM(pos) OVER w AS DOUBLE) AS cp,
          CAST(SUM(n) OVER ({p}) AS DOUBLE) AS tn, CAST(SUM(pos) OVER ({p}) AS DOUBLE) AS tp
        FROM (SELECT {g} {score} AS s, COUNT(*) AS n, SUM({label}) AS pos FROM {src} WHERE {score} IS NOT NULL GROUP BY {g} {score})
        WINDOW w AS ({p} ORDER BY s DESC)) {('GROUP BY ' + keys) if keys else ''}"""


@query("metric_pr_auc", with_views("scored", f"SELECT lang, ROUND(pr_auc, 9) AS pr_auc FROM ({pr_sql('scored', keys='lang')})"))
def metric_pr_auc(t: Tables) -> DataFrame:
    return rounded(metrics.average_precision(t.scored, "score", "label", ["lang"]), ["pr_auc"], 9)


@query("metric_roc_auc", with_views("scored", f"SELECT lang, ROUND(roc_auc, 9) AS roc_auc FROM ({pr_sql('scored', keys='lang')})"))
def metric_roc_auc(t: Tables) -> DataFrame:
    return rounded(metrics.roc_auc(t.scored, "score", "label", ["lang"]), ["roc_auc"], 9)


@query(
    "metric_brier_lift",
    with_views(
        "scored",
        f"""SELECT s.grp, s.n, s.n_pos, ROUND(s.base_rate, 9) AS base_rate, ROUND(s.brier, 9) AS brier, ROUND(p.pr_auc/NULLIF(s.base_rate, 0), 9) AS lift FROM
            (SELECT grp, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS n_pos, AVG(label) AS base_rate, AVG(pow(score - label, 2)) AS brier FROM scored GROUP BY 1) s
            JOIN ({pr_sql('scored', keys='grp')}) p ON p.grp = s.grp""",
    ),
)
def metric_brier_lift(t: Tables) -> DataFrame:
    m = metrics.fold_metrics(t.scored, "score", "label", ["grp"])
    return rounded(m, ["base_rate", "brier", "lift"], 9).select("grp", "n", "n_pos", "base_rate", "brier", "lift")


SPEARMAN = """SELECT {g} corr(ra, rb) AS spearman FROM (SELECT {g} RANK() OVER ({p} ORDER BY {a}) + (COUNT(*) OVER ({pa}{a}) - 1)/2e0 AS ra,
    RANK() OVER ({p} ORDER BY {b}) + (COUNT(*) OVER ({pa}{b}) - 1)/2e0 AS rb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) {gb}"""


def spearman_sql(src: str, a: str, b: str, key: str = "") -> str:
    return SPEARMAN.format(
        src=src, a=a, b=b, g=f"{key}, " if key else "", p=f"PARTITION BY {key}" if key else "",
        pa=f"PARTITION BY {key}, " if key else "PARTITION BY ", gb=f"GROUP BY {key}" if key else "",
    )


@query(
    "metric_spearman",
    f"SELECT grp, ROUND(spearman, 9) AS spearman FROM ({spearman_sql('(SELECT l_returnflag AS grp, l_quantity AS qa, l_extendedprice AS qb FROM lineitem)', 'qa', 'qb', 'grp')})",
)
def metric_spearman(t: Tables) -> DataFrame:
    li = t.read("lineitem").select(F.col("l_returnflag").alias("grp"), "l_quantity", "l_extendedprice")
    return rounded(metrics.spearman(li, "l_quantity", "l_extendedprice", ["grp"]), ["spearman"], 9)


@query(
    "metric_reliability",
    with_views(
        "scored",
        """SELECT GREATEST(0, LEAST(9, (SELECT COUNT(*) FROM (SELECT UNNEST(generate_series(0, 9)) AS i) WHERE i*(1e0/10) <= score) - 1)) AS bin, COUNT(*) AS n,
           ROUND(AVG(score), 9) AS mean_pred, ROUND(AVG(label), 9) AS obs_rate FROM scored GROUP BY 1""",
    ),
)
def metric_reliability(t: Tables) -> DataFrame:
    return rounded(metrics.reliability(t.scored, "score", "label"), ["mean_pred", "obs_rate"], 9)


@query(
    "metric_ece",
    with_views(
        "scored",
        """SELECT lang, ROUND(SUM(n*abs(mp - ob))/SUM(n), 9) AS ece FROM (SELECT lang, GREATEST(0, LEAST(9, (SELECT COUNT(*) FROM (SELECT UNNEST(generate_series(0, 9)) AS i) WHERE i*(1e0/10) <= score) - 1)) AS bin,
             COUNT(*) AS n, AVG(score) AS mp, AVG(label) AS ob FROM scored GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def metric_ece(t: Tables) -> DataFrame:
    return rounded(metrics.calibration_error(t.scored, "score", "label", ["lang"]), ["ece"], 9)


@query(
    "threshold_for_recall",
    with_views(
        "scored",
        """SELECT CAST(8e-1 AS DOUBLE) AS target_recall, score AS threshold, tp/tot AS achieved_recall, tp/k AS precision, k/n AS alarm_rate FROM (
           SELECT score, CAST(ROW_NUMBER() OVER w AS DOUBLE) AS k, CAST(SUM(label) OVER w AS DOUBLE) AS tp, CAST(SUM(label) OVER () AS DOUBLE) AS tot, CAST(COUNT(*) OVER () AS DOUBLE) AS n
           FROM scored WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)) WHERE tp/tot >= 8e-1 ORDER BY k LIMIT 1""",
    ),
)
def threshold_for_recall(t: Tables) -> DataFrame:
    return metrics.threshold_for_recall(t.scored, "score", "label", "id")


@query(
    "tie_safe_threshold",
    with_views(
        "replay",
        """SELECT domain, budget, COALESCE(MIN(CASE WHEN rate <= budget THEN s END), MAX(s)) AS threshold, COALESCE(arg_min(rate, s) FILTER (WHERE rate <= budget), arg_max(rate, s)) AS achieved_alarm_rate,
             ROUND(COALESCE(arg_min(rate, s) FILTER (WHERE rate <= budget), arg_max(rate, s))*36525e-2, 1) AS alarm_days_per_cell_year, MAX(naive) AS naive_quantile FROM (
           SELECT r.domain, r.s, r.rate, b.budget, q.naive FROM (SELECT domain, s, CAST(SUM(n) OVER (PARTITION BY domain ORDER BY s DESC) AS DOUBLE)/SUM(n) OVER (PARTITION BY domain) AS rate
             FROM (SELECT domain, p AS s, COUNT(*) AS n FROM replay GROUP BY 1, 2)) r, (SELECT UNNEST([2e-2, 5e-2, 1e-1]) AS budget) b
           JOIN (SELECT domain, b, quantile_cont(p, 1e0 - b) AS naive FROM replay, (SELECT 2e-2 AS b) GROUP BY 1, 2 UNION ALL SELECT domain, 5e-2, quantile_cont(p, 95e-2::DOUBLE) FROM replay GROUP BY 1
                 UNION ALL SELECT domain, 1e-1, quantile_cont(p, 9e-1::DOUBLE) FROM replay GROUP BY 1) q ON q.domain = r.domain AND q.b = b.budget) GROUP BY 1, 2""".replace(
            "quantile_cont(p, 1e0 - b) AS naive FROM replay, (SELECT 2e-2 AS b) GROUP BY 1, 2", "quantile_cont(p, 98e-2::DOUBLE) AS naive FROM replay, (SELECT 2e-2 AS b) GROUP BY 1, 2"
        ),
    ),
)
def tie_safe_threshold(t: Tables) -> DataFrame:
    return metrics.tie_safe_thresholds(t.replay.select("domain", "p"), "p", (0.02, 0.05, 0.10), ["domain"])


@query(
    "isotonic_binned",
    with_views(
        "scored",
        """SELECT x, ROUND(MAX(lo), 9) AS fitted FROM (SELECT a.s AS a, i.s AS x, MIN(m.v) AS lo FROM h a JOIN h i ON i.s >= a.s
             JOIN (SELECT a.s AS a, b.s AS b, CAST(SUM(c.pos) AS DOUBLE)/SUM(c.n) AS v FROM h a JOIN h b ON b.s >= a.s JOIN h c ON c.s BETWEEN a.s AND b.s GROUP BY 1, 2) m
             ON m.a = a.s AND m.b >= i.s GROUP BY 1, 2) GROUP BY 1""",
        ("h", "SELECT score AS s, COUNT(*) AS n, SUM(label) AS pos FROM scored GROUP BY 1"),
    ),
)
def isotonic_binned(t: Tables) -> DataFrame:
    return rounded(metrics.isotonic_fit(t.scored, "score", "label"), ["fitted"], 9)


@query(
    "isotonic_ranges",
    """WITH h AS (SELECT FLOOR(l_extendedprice/5e1) AS x, COUNT(*) AS n, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pos FROM lineitem GROUP BY 1),
       c AS (SELECT x, n, pos, ROW_NUMBER() OVER (ORDER BY x) AS i, SUM(n) OVER (ORDER BY x) AS cn, SUM(pos) OVER (ORDER BY x) AS cp FROM h),
       g AS (SELECT a.i AS a, b.i AS b, CAST(b.cp - a.cp + a.pos AS DOUBLE)/CAST(b.cn - a.cn + a.n AS DOUBLE) AS v FROM c a JOIN c b ON b.i >= a.i),
       m AS (SELECT a, b, MIN(v) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS low FROM g)
       SELECT c.x, ROUND(MAX(low), 9) AS fitted FROM m JOIN c ON c.i = m.b GROUP BY c.x""",
)
def isotonic_ranges(t: Tables) -> DataFrame:
    """Return rate as an ascending function of the price, pooled in ranges of 200 prices."""
    li = t.read("lineitem").select(F.floor(F.col("l_extendedprice") / 50.0).alias("price"), (F.col("l_returnflag") == "R").cast("int").alias("back"))
    return rounded(isotonic.fitted(li, "price", "back", blocks=200), ["fitted"], 9)


# ---- folds

FOLD_SQL = (
    "fold",
    """SELECT grp, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM (
       SELECT grp, ROW_NUMBER() OVER (ORDER BY n DESC, substr(md5(CAST(grp AS VARCHAR)), 1, 3), grp) - 1 AS p FROM (SELECT grp, COUNT(*) AS n FROM scored GROUP BY 1))""",
)


@query("group_kfold", with_views("scored", "SELECT grp, fold FROM fold", FOLD_SQL))
def group_kfold(t: Tables) -> DataFrame:
    return metrics.fold_ids(t.scored, "grp", 5)


@query(
    "fold_summary",
    with_views(
        "scored",
        f"""SELECT COUNT(*) AS n_folds, ROUND(AVG(pr_auc), 9) AS pr_auc_mean, ROUND(stddev_pop(pr_auc), 9) AS pr_auc_sd, ROUND(AVG(roc_auc), 9) AS roc_auc_mean, ROUND(AVG(brier), 9) AS brier_mean,
            ROUND((SELECT pr_auc FROM ({pr_sql('scored')})), 9) AS pooled_pr_auc
            FROM ({pr_sql('fs', keys='fold')}) a JOIN (SELECT fold, AVG(pow(score - label, 2)) AS brier FROM fs GROUP BY 1) b USING (fold)""",
        FOLD_SQL,
        ("fs", "SELECT s.*, f.fold FROM scored s JOIN fold f ON f.grp = s.grp"),
    ),
)
def fold_summary(t: Tables) -> DataFrame:
    s = t.scored.join(metrics.fold_ids(t.scored, "grp", 5), "grp")
    out = metrics.summarise_folds(s, "score", "label", "fold")
    return rounded(out, ["pr_auc_mean", "pr_auc_sd", "roc_auc_mean", "brier_mean", "pooled_pr_auc"], 9)


# ---- replayed alarms


ALARM_AGG = """COUNT(*) FILTER (WHERE event) AS n_event_days, COUNT(*) FILTER (WHERE alarm) AS n_alarm_days, CAST(COUNT(*) FILTER (WHERE alarm) AS DOUBLE)/COUNT(*) AS alarm_rate,
    CAST(COUNT(*) FILTER (WHERE event AND alarm) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE event), 0) AS pod_strict, CAST(COUNT(*) FILTER (WHERE event AND near_alarm) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE event), 0) AS pod_1d,
    1 - CAST(COUNT(*) FILTER (WHERE event AND alarm) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE alarm), 0) AS far_strict, 1 - CAST(COUNT(*) FILTER (WHERE alarm AND near_event) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE alarm), 0) AS far_1d"""


def flags_sql(alarm: str, part: str = "cell", src: str = "replay", extra: str = "") -> str:
    return f"""SELECT cell, d, domain, event, alarm {extra}, event OR COALESCE(LAG(event) OVER w, FALSE) OR COALESCE(LEAD(event) OVER w, FALSE) AS near_event,
        alarm OR COALESCE(LAG(alarm) OVER w, FALSE) OR COALESCE(LEAD(alarm) OVER w, FALSE) AS near_alarm FROM (SELECT *, {alarm} AS alarm FROM {src}) WINDOW w AS (PARTITION BY {part} ORDER BY d)"""


@query("replay_grid", with_views("replay", "SELECT cell, d, domain, p, rule, event FROM replay"))
def replay_grid(t: Tables) -> DataFrame:
    return t.replay


@query("pod_far", with_views("replay", f"SELECT {ALARM_AGG} FROM fl", ("fl", flags_sql("p >= 9e-1"))))
def pod_far(t: Tables) -> DataFrame:
    return metrics.alarm_table(metrics.with_alarm_flags(t.replay, F.col("p") >= 0.9))


SWEEP_LIST = str(metrics.sweep_levels())


def sweep_sql(score: str) -> str:
    flags = flags_sql(f"{score} >= threshold", part="threshold, cell", src="(SELECT r.*, q.threshold FROM replay r, q)", extra=", threshold")
    return f"""WITH q AS (SELECT DISTINCT UNNEST(quantile_cont({score}, {SWEEP_LIST}::DOUBLE[])) AS threshold FROM replay)
        SELECT threshold, {ALARM_AGG} FROM ({flags}) GROUP BY 1"""


@query("alarm_sweep", with_views("replay", "SELECT * FROM sw", ("sw", sweep_sql("p"))))
def alarm_sweep(t: Tables) -> DataFrame:
    return metrics.alarm_sweep(t.replay, "p")


@query(
    "matched_rate",
    with_views(
        "replay",
        """SELECT curve, target, arg_min(pod_1d, r) AS pod_1d, arg_min(alarm_rate, r) AS alarm_rate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY curve, target ORDER BY abs(alarm_rate - target), threshold) AS r FROM
             (SELECT 'model' AS curve, * FROM swp UNION ALL SELECT 'rule', * FROM swr), (SELECT UNNEST([1e-2, 2e-2, 5e-2, 1e-1]) AS target)) GROUP BY 1, 2""",
        ("swp", sweep_sql("p")),
        ("swr", sweep_sql("rule")),
    ),
)
def matched_rate(t: Tables) -> DataFrame:
    a = metrics.alarm_sweep(t.replay, "p").withColumn("curve", F.lit("model"))
    b = metrics.alarm_sweep(t.replay, "rule").withColumn("curve", F.lit("rule"))
    return metrics.matched_rate(a.unionByName(b), (0.01, 0.02, 0.05, 0.10))


@query(
    "yearly_skill",
    with_views(
        "replay",
        "SELECT year(d) AS year, COUNT(*) FILTER (WHERE event) AS events, CAST(COUNT(*) FILTER (WHERE event AND near_alarm) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE event), 0) AS pod_1d, CAST(COUNT(*) FILTER (WHERE alarm) AS DOUBLE)/COUNT(DISTINCT cell) AS alarms_per_cell FROM fl GROUP BY 1",
        ("fl", flags_sql("p >= 9e-1", part="cell, year(d)")),
    ),
)
def yearly_skill(t: Tables) -> DataFrame:
    grid = t.replay.withColumn("year", F.year("d"))
    flagged = metrics.with_alarm_flags(grid, F.col("p") >= 0.9, ["cell", "year"])
    return metrics.yearly_skill(flagged)


@query(
    "grouping_sets_scope",
    with_views(
        "replay",
        """SELECT COALESCE(domain, 'all') AS scope, year(d) AS year, COUNT(DISTINCT cell) AS cells, COUNT(*) AS cell_days, COUNT(*) FILTER (WHERE event) AS events, CAST(COUNT(*) FILTER (WHERE alarm) AS DOUBLE)/COUNT(*) AS alarm_rate,
           CAST(COUNT(*) FILTER (WHERE event AND near_alarm) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE event), 0) AS pod_1d FROM fl GROUP BY GROUPING SETS ((year(d)), (domain, year(d)))""",
        ("fl", flags_sql("p >= 9e-1", part="cell, year(d)")),
    ),
)
def grouping_sets_scope(t: Tables) -> DataFrame:
    grid = t.replay.withColumn("year", F.year("d"))
    return metrics.scoped_skill(metrics.with_alarm_flags(grid, F.col("p") >= 0.9, ["cell", "year"]))


@query(
    "budget_by_domain",
    with_views(
        "replay",
        f"""SELECT f.domain, f.budget, f.kind, f.threshold, COUNT(*) FILTER (WHERE event) AS n_event_days, CAST(COUNT(*) FILTER (WHERE alarm) AS DOUBLE)/COUNT(*) AS alarm_rate,
            CAST(COUNT(*) FILTER (WHERE event AND near_alarm) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE event), 0) AS pod_1d FROM
            ({flags_sql('p >= threshold', part='cell, budget, kind', src='(SELECT r.*, q.budget, q.kind, q.threshold FROM replay r JOIN bt q ON q.domain = r.domain)', extra=', budget, kind, threshold')}) f GROUP BY 1, 2, 3, 4""",
        (
            "bt",
            " UNION ALL ".join(
                f"""SELECT domain, {b} AS budget, 'own' AS kind, quantile_cont(p, ({q})::DOUBLE) AS threshold FROM replay GROUP BY 1
                    UNION ALL SELECT x.domain, {b}, 'pooled', (SELECT quantile_cont(p, ({q})::DOUBLE) FROM replay) FROM (SELECT DISTINCT domain FROM replay) x"""
                for b, q in (("2e-2", "98e-2"), ("5e-2", "95e-2"), ("1e-1", "9e-1"))
            ),
        ),
    ),
)
def budget_by_domain(t: Tables) -> DataFrame:
    return metrics.budgets_by_domain(t.replay, "p", (0.02, 0.05, 0.10))


# ---- external and cross-region comparisons


@query(
    "score_by_class",
    with_views(
        "scored",
        "SELECT CAST(id % 7 AS BIGINT) AS class, COUNT(*) AS n, ROUND(AVG(score), 9) AS mean_score FROM scored GROUP BY 1 HAVING COUNT(*) >= 20",
    ),
)
def score_by_class(t: Tables) -> DataFrame:
    out = t.scored.groupBy((F.col("id") % 7).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 9).alias("mean_score")
    )
    return out.filter(F.col("n") >= 20)


@query(
    "external_benchmark",
    with_views(
        "scored",
        f"""SELECT 'ours' AS source, ROUND(pr_auc, 9) AS pr_auc, ROUND(roc_auc, 9) AS roc_auc, ROUND((SELECT spearman FROM ({spearman_sql('ext', 'score', 'cls')})), 9) AS spearman FROM ({pr_sql('ext')})
            UNION ALL SELECT 'external', ROUND(pr_auc, 9), ROUND(roc_auc, 9), ROUND((SELECT spearman FROM ({spearman_sql('ext', 'score', 'cls')})), 9) FROM ({pr_sql('ext', score='cls')})""",
        ("ext", "SELECT id, label, score, CAST((id*13 + toxic) % 6 AS DOUBLE) AS cls FROM scored WHERE lang <> 'es'"),
    ),
)
def external_benchmark(t: Tables) -> DataFrame:
    cls = F.when(F.col("lang") != "es", ((F.col("id") * 13 + F.col("toxic")) % 6).cast("double"))
    return rounded(metrics.external_benchmark(t.scored.withColumn("cls", cls), "score", "cls", "label"), ["pr_auc", "roc_auc", "spearman"], 9)


@query(
    "univariate_floor",
    with_views("patch", f"SELECT region, ROUND(roc_auc, 9) AS slope_roc, ROUND(pr_auc, 9) AS slope_pr FROM ({pr_sql('ter', score='ROUND(slope_deg, 6)', keys='region')})", *TERRAIN_SQL),
)
def univariate_floor(t: Tables) -> DataFrame:
    df = terrain_table(t).withColumn("slope_deg", F.round("slope_deg", 6))
    roc = metrics.roc_auc(df, "slope_deg", "label", ["region"]).withColumnRenamed("roc_auc", "slope_roc")
    pr = metrics.average_precision(df, "slope_deg", "label", ["region"]).withColumnRenamed("pr_auc", "slope_pr")
    return rounded(roc.join(pr, "region"), ["slope_roc", "slope_pr"], 9)


@query(
    "ensemble_eval",
    with_views(
        "patch",
        f"""SELECT region, ROUND(roc_auc, 9) AS roc_auc, ROUND(AVG(roc_auc) OVER (), 9) AS mean_roc, ROUND(MIN(roc_auc) OVER (), 9) AS worst_roc FROM ({pr_sql('ens', score='e', keys='region')})""",
        *TERRAIN_SQL,
        (
            "ens",
            """SELECT id, region, label, ROUND((a.pa + a.pb + a.pc)/3e0, 9) AS e FROM (SELECT id, region, label,
               (RANK() OVER (PARTITION BY region ORDER BY ROUND(tri, 6)) + (COUNT(*) OVER (PARTITION BY region, ROUND(tri, 6)) - 1)/2e0)/COUNT(*) OVER (PARTITION BY region) AS pa,
               (RANK() OVER (PARTITION BY region ORDER BY ROUND(slope_deg, 6)) + (COUNT(*) OVER (PARTITION BY region, ROUND(slope_deg, 6)) - 1)/2e0)/COUNT(*) OVER (PARTITION BY region) AS pb,
               (RANK() OVER (PARTITION BY region ORDER BY id % 6) + (COUNT(*) OVER (PARTITION BY region, id % 6) - 1)/2e0)/COUNT(*) OVER (PARTITION BY region) AS pc FROM ter) a""",
        ),
    ),
)
def ensemble_eval(t: Tables) -> DataFrame:
    df = rounded(terrain_table(t), ["tri", "slope_deg"], 6).withColumn("cls", F.col("id") % 6)
    return metrics.ensemble_by_region(df.select("id", "region", "label", "tri", "slope_deg", "cls"), ["tri", "slope_deg", "cls"], "label", "region")


GAUGE_SQL = (
    (
        "both_",
        """SELECT a.cell, a.d, month(a.d)*31 + day(a.d) AS sk, a.precip AS obs, b.precip2 AS sim FROM daily a JOIN rain2 b ON b.cell = a.cell AND b.d = a.d
           WHERE a.precip IS NOT NULL AND b.precip2 IS NOT NULL""",
    ),
    ("gs", seasonal_sql("both_", {"obs": "po", "sim": "ps"})),
)


@query(
    "gauge_skill",
    with_views(
        "daily rain2",
        f"""SELECT g.cell, g.n_days, ROUND(g.pearson, 6) AS pearson, ROUND(s.spearman, 6) AS spearman, g.n_flood_days, g.hit_rate FROM (
            SELECT cell, COUNT(*) FILTER (WHERE po IS NOT NULL AND ps IS NOT NULL) AS n_days, corr(obs, sim) AS pearson, COUNT(*) FILTER (WHERE po >= 98e-2 AND ps IS NOT NULL) AS n_flood_days,
              CAST(COUNT(*) FILTER (WHERE po >= 98e-2 AND ps >= 95e-2) AS DOUBLE)/NULLIF(COUNT(*) FILTER (WHERE po >= 98e-2 AND ps IS NOT NULL), 0) AS hit_rate FROM gs GROUP BY 1) g
            LEFT JOIN ({spearman_sql('gs', 'po', 'ps', 'cell')}) s ON s.cell = g.cell""",
        *GAUGE_SQL,
    ),
)
def gauge_skill(t: Tables) -> DataFrame:
    both = (
        t.daily.select("cell", "d", F.col("precip").alias("obs"))
        .join(t.rain2.select("cell", "d", F.col("precip2").alias("sim")), ["cell", "d"])
        .dropna()
    )
    return rounded(metrics.gauge_skill(both, "cell", "d"), ["pearson", "spearman"], 6)


@query(
    "drought_skill",
    with_views(
        "roll truth",
        f"""SELECT c.fips, c.n_weeks, c.d2_weeks, CASE WHEN c.d2_weeks > 0 AND c.d2_weeks < c.n_weeks THEN ROUND(a.roc_auc, 6) END AS auc_spi90,
            CASE WHEN c.d2_weeks > 0 AND c.d2_weeks < c.n_weeks THEN ROUND(s.spearman, 6) END AS spearman_sev_spi90
            FROM (SELECT fips, COUNT(*) AS n_weeks, CAST(SUM(label) AS BIGINT) AS d2_weeks FROM panel GROUP BY 1 HAVING COUNT(*) >= 200) c
            LEFT JOIN ({pr_sql('panel', score='(1e0 - spi90)', keys='fips')}) a ON a.fips = c.fips
            LEFT JOIN ({spearman_sql('(SELECT fips, severity, -spi90 AS ms FROM panel)', 'severity', 'ms', 'fips')}) s ON s.fips = c.fips""",
        *PANEL_SQL,
    ),
)
def drought_skill(t: Tables) -> DataFrame:
    return rounded(metrics.drought_skill(panel(t), 200), ["auc_spi90", "spearman_sev_spi90"], 6)


