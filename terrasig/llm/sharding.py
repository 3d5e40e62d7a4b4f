"""Sharding by rendezvous hashing over weighted shards, native.

Every shard draws a score for a record key, -ln(u) / weight with u from md5(key|shard); the lowest score wins. A shard's
share is its weight's share, and a further shard only wins records for itself: nothing moves between the old ones.

Defined cases: a null key is a key of its own; a null text has size 1 and the checksum of the empty text; equal keys share a
shard and get different slots; an empty table gives no rows; columns of the input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasig.llm.order import bucket_of, running_totals

#: A null key's stand-in; no integer key prints like it.
NULL_KEY = "null"


def record_key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NULL_KEY))


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """Each shard's (score, shard) for a key; 52 bits of md5 make a number strictly between 0 and 1."""
    out = []
    for i, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError("weights must be positive")
        digits = F.substring(F.md5(F.concat(key, F.lit(f"|{i}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
        out.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(i).alias("shard")))
    return out


def winner(candidates: list[Column]) -> Column:
    return (F.least(*candidates) if len(candidates) > 1 else candidates[0])["shard"]


def assign(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, name: str = "shard") -> DataFrame:
    """Add the shard of each row's key; no shuffle."""
    return df.withColumn(name, winner(scores(record_key(F.col(key)), weights)))


def layout(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0) -> DataFrame:
    """One row per row of df: key, size, text_crc32, shard, slot (0, 1, ... in each shard, in hash order), and the shard
    after one more shard of `grown_weight` is added. Only these narrow columns are shuffled."""
    all_scores = scores(F.col("__key"), [*weights, grown_weight])
    # the scores are drawn once: both winners are read from one array
    keyed = (
        df.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
        .withColumn("__key", record_key(F.col("__id")))
        .withColumn("__order", F.md5(F.concat(F.lit("slot|"), F.col("__key"))))
        .withColumn("__bucket", bucket_of(F.col("__order")))
        .withColumn("__scores", F.array(*all_scores))
        .withColumn("__shard", F.array_min(F.slice("__scores", 1, len(weights)))["shard"])
        .withColumn("__grown", F.array_min("__scores")["shard"])
    )
    body = F.coalesce(F.col("__text"), F.lit(""))
    rows = keyed.select("__id", "__order", "__bucket", "__shard", "__grown", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    placed = running_totals(rows, keyed.select("__shard", "__bucket"), ["__shard"], [F.col("__order"), F.col("__id"), F.col("text_crc32"), F.col("size")], F.lit(1), "slot")
    return placed.select(F.col("__id").alias(key), "size", "text_crc32", F.col("__shard").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("__grown").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 16, files_per_shard: int = 8) -> None:
    """Write one folder per shard (shard=0, ...), each in several files so that no shard is one task."""
    part = F.pmod(F.xxhash64(record_key(F.col(key))), F.lit(files_per_shard))
    assigned = assign(df, key, weights)
    assigned.repartition(len(weights) * files_per_shard, "shard", part).write.partitionBy("shard").parquet(path)
