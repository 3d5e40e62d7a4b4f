"""Writers and the table merges behind them. Every merge is a function of (old, new) so a retry gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_KEEP = 180


def write_matrix(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Partitioned feature matrix; only the partitions present in ``df`` are replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def json_records(df: DataFrame, key: str, columns: list[str | Column]) -> DataFrame:
    """One JSON document per row; NULL fields are left out."""
    return df.select(F.col(key), F.to_json(F.struct(*columns)).alias("record"))


def write_records(records: DataFrame, key: str, path: str) -> None:
    records.select(key, F.col("record").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def upsert_history(old: DataFrame, new: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """Replace rows of the same (location, day) by the new ones and keep the newest ``keep`` days per location.

    The replace is an aggregate; the cap is a row_number filter, which Spark applies per partition before the shuffle.
    """
    cols = [c for c in old.columns if c not in ("location_id", "as_of")]
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    latest = (
        both.groupBy("location_id", "as_of")
        .agg(F.max_by(F.struct(*cols), "_gen").alias("_r"))
        .select("location_id", "as_of", "_r.*")
    )
    w = Window.partitionBy("location_id").orderBy(F.col("as_of").desc())
    return latest.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep).drop("_rank")


def merge_thresholds(old: DataFrame, new: DataFrame) -> DataFrame:
    """New (hazard, budget) rows win; rows of other hazards stay."""
    keys = ["hazard", "budget"]
    values = [c for c in new.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [*keys], "full_outer")
    return joined.select(*keys, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values])


def manifest(layers: DataFrame) -> DataFrame:
    """Totals over feature layers: rows, positives, base rate and the distinct features."""
    return layers.agg(
        F.sum("n_rows").cast("bigint").alias("n_rows"),
        F.sum("n_pos").cast("bigint").alias("n_pos"),
        (F.sum("n_pos") / F.sum("n_rows")).alias("base_rate"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("features"))))).alias("features"),
    )


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose recorded span is missing or differs from the wanted one."""
    return wanted.join(done, keys, "left_anti")
