"""From raw documents to shards of training text: five stages, each a call of one operator of `terrasig.llm`.

`run` writes every stage's result as Parquet to the shared folder and reads it back as the next stage's documents. Stages
return the columns of documents they were given; the last adds `shard` (a column of that name is replaced).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasig.llm import decontamination, jaccard, mixing, sharding, toxicity
from terrasig.llm.store import keep

#: The mix takes this share of the tokens that reach it, each document at most once.
MIX_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or of their sentences calls toxic go; the model learns from the labelled documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=toxicity.learnable())
    return toxicity.score(docs, model, name="__toxic").where(f"__toxic < {toxicity.THRESHOLD}").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays."""
    return jaccard.drop_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their share of the target weights: documents whose place in their leaf's order is within its
    budget stay, whole."""
    chosen = mixing.plan(docs, mixing.source_levels(), mixing.source_weights(), share=MIX_SHARE, epochs=1)
    return mixing.select(docs, chosen)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard of sixteen by rendezvous hashing of its key."""
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The toxicity scores and the groups of near copies are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
