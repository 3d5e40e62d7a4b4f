"""Trained layers on disk: versions of model, calibrator and run record, and the freshest complete one.

A version is a folder of Spark ML's own files and a table of calibration knots. Its run record is appended to the store's run
table last, so a version that a lost driver left half written is never found.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terrasig.operators import metrics, ml, sampling
from terrasig.operators.isotonic import Calibrator
from terrasig.session import cut_lineage

RUN = (
    "version string, name string, layer string, model string, status string, trained_at date, n_rows bigint, n_pos bigint, base_rate double, "
    "n_groups bigint, scheme string, n_splits int, tuned boolean, n_draws int, params string, features array<string>, dropped array<string>, "
    "importance array<struct<feature:string,gain_pct:double>>, "
    "folds array<struct<fold:int,n:bigint,n_pos:bigint,pr_auc:double,roc_auc:double,brier:double>>, "
    "pr_auc_mean double, pr_auc_sd double, roc_auc_mean double, brier_mean double, ece_before double, ece_after double, recall_threshold double"
)


@dataclass
class Layer:
    """A trained layer: what scoring needs, and its record."""

    model: PipelineModel
    calibrator: Calibrator
    features: list[str]
    run: Row

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Calibrated score; NULL where every input is missing."""
        return ml.batch_score(self.model, self.calibrator, df, self.features, out)


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], RUN).write.mode("append").json(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN).json(f"{self.root}/runs")

    def latest(self, layer: str, on: datetime.date | None = None) -> Row | None:
        """Record of the freshest complete run of a layer, of the later version among those of one day."""
        rows = self.runs().filter((F.col("layer") == layer) & (F.col("status") == "complete"))
        if on is not None:
            rows = rows.filter(F.col("trained_at") <= F.lit(on))
        return rows.orderBy(F.desc("trained_at"), F.desc("version")).first()

    def save(self, model: PipelineModel, calibrator: Calibrator, run: dict) -> None:
        folder = f"{self.root}/{run['layer']}/{run['version']}"
        model.write().overwrite().save(f"{folder}/model")
        calibrator.knots.coalesce(1).write.mode("overwrite").parquet(f"{folder}/knots")
        fields = self.spark.createDataFrame([], RUN).columns
        self.spark.createDataFrame([tuple(run[f] for f in fields)], RUN).coalesce(1).write.mode("append").json(f"{self.root}/runs")

    def load(self, layer: str, on: datetime.date | None = None) -> Layer | None:
        """The freshest complete version of a layer, None if there is none: scoring then goes on without it."""
        run = self.latest(layer, on)
        if run is None:
            return None
        folder = f"{self.root}/{layer}/{run['version']}"
        knots = self.spark.read.schema("x double, value double").parquet(f"{folder}/knots")
        return Layer(PipelineModel.load(f"{folder}/model"), Calibrator(knots), list(run["features"]), run)

    def operating_point(self, layer: str, default: float, thresholds: DataFrame | None = None) -> float:
        """Deployment threshold of a layer: the priced one of `thresholds` (hazard, threshold) if it has the layer, else the
        recall threshold of the freshest complete run, else the default."""
        if thresholds is not None:
            row = thresholds.filter((F.col("hazard") == layer) & F.col("threshold").isNotNull()).agg(F.max("threshold")).first()
            if row[0] is not None:
                return float(row[0])
        run = self.latest(layer)
        return float(run["recall_threshold"]) if run is not None and run["recall_threshold"] is not None else default


def informative(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The features that a training keeps: those that are neither empty nor constant."""
    known = {r["feature"] for r in sampling.informative_features(df, features).collect()}  # one row a feature
    return [f for f in features if f in known]


def gains(df: DataFrame, features: Sequence[str], label: str, params: dict | None = None) -> DataFrame:
    """(feature, gain_pct) that `train` without a search would record. Only the model on all rows is fitted: folds, calibration
    and skill have no part in it."""
    df = cut_lineage(df)
    kept = informative(df, features)
    return ml.importance(ml.gbt(kept, label, dict(params or ml.BASE_PARAMS)).fit(df), kept, df)


def train(
    store: ModelStore,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    group: str,
    key: str,
    layer: str,
    version: str,
    trained_at: datetime.date,
    k: int = 5,
    n_draws: int = 0,
    params: dict | None = None,
) -> Layer:
    """Prune, search, cross-validate, calibrate on out-of-fold scores, fit on all rows, and save with its record."""
    spark = store.spark
    df = cut_lineage(df)
    kept = informative(df, features)
    params = dict(params or ml.BASE_PARAMS)
    if n_draws:
        found = ml.search(df, kept, label, group, k, ml.draw_params(n_draws), f"{store.root}/{layer}/{version}/search")
        params, _ = ml.best_draw(found)
    folded = cut_lineage(df.join(metrics.fold_ids(df, group, k), group))
    oof = cut_lineage(ml.out_of_fold(folded, kept, label, "fold", params))
    per = metrics.fold_metrics(oof, "oof", label, ["fold"]).orderBy("fold").collect()  # one row a fold
    summary = metrics.summarise_folds(oof, "oof", label, "fold").first()
    calibrator = ml.calibrate(oof, "oof", label)
    after = calibrator.transform(oof, "oof", "p")
    ece = [metrics.calibration_error(d, c, label).first()["ece"] for d, c in ((oof, "oof"), (after, "p"))]
    recall = metrics.threshold_for_recall(oof, "oof", label, key).first()
    model = ml.gbt(kept, label, params).fit(df)
    gains = ml.importance(model, kept, df).collect()  # one row a feature
    n, pos, groups = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("bigint")), F.count_distinct(group)).first()
    run = {
        "version": version, "name": f"{layer}-{'tuned' if n_draws else 'baseline'}", "layer": layer, "model": "gradient-boosted trees",
        "status": "complete", "trained_at": trained_at, "n_rows": n, "n_pos": pos, "base_rate": pos / n, "n_groups": groups,
        "scheme": f"grouped folds on {group}", "n_splits": k, "tuned": bool(n_draws), "n_draws": n_draws,
        "params": ml.json.dumps(params, sort_keys=True), "features": kept, "dropped": sorted(set(features) - set(kept)),
        "importance": [(r["feature"], r["gain_pct"]) for r in gains],
        "folds": [(r["fold"], r["n"], r["n_pos"], r["pr_auc"], r["roc_auc"], r["brier"]) for r in per],
        "pr_auc_mean": summary["pr_auc_mean"], "pr_auc_sd": summary["pr_auc_sd"], "roc_auc_mean": summary["roc_auc_mean"],
        "brier_mean": summary["brier_mean"], "ece_before": ece[0], "ece_after": ece[1], "recall_threshold": recall["threshold"] if recall else None,
    }
    store.save(model, calibrator, run)
    return Layer(model, calibrator, kept, spark.createDataFrame([tuple(run[f] for f in spark.createDataFrame([], RUN).columns)], RUN).first())
