"""Nested payloads to long rows. Fill values become NULL here and never travel further as numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILL = -900.0


def unfill(x: Column) -> Column:
    return F.when((x > FILL) & ~F.isnan(x), x)


def arrays_to_long(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Parallel arrays to one row per day; a short or null element gives NULL."""
    zipped = df.select(*keys, F.inline(F.arrays_zip(time, *values)))
    return zipped.filter(F.col(time).isNotNull()).select(
        *keys, F.to_date(time).alias("d"), *[unfill(F.col(v).cast("double")).alias(v) for v in values]
    )


def map_to_rows(df: DataFrame, keys: list[str], payload: str, out: str) -> DataFrame:
    """A JSON object of yyyymmdd keys to one row per day."""
    parsed = df.select(*keys, F.explode(F.from_json(payload, "map<string,double>")).alias("_k", "_v"))
    return parsed.select(*keys, F.to_date("_k", "yyyyMMdd").alias("d"), unfill(F.col("_v")).alias(out))


def nested_vertices(df: DataFrame, keys: list[str], elements: str) -> DataFrame:
    """elements[].geometry[] to one row per vertex."""
    ways = df.select(*keys, F.explode(elements).alias("_e"))
    return ways.select(*keys, F.inline("_e.geometry")).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def read_array_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of documents each, also compressed."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.txt*").json(path)


def read_years(spark: SparkSession, root: str, schema: str, first: int, last: int) -> DataFrame:
    """Folders ``year=<y>`` as one table; only the years asked for are listed and read, and columns that only some years carry
    are NULL elsewhere."""
    return spark.read.schema(f"{schema}, year int").parquet(root).filter(F.col("year").between(first, last))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clean_pixels(df: DataFrame, value: str) -> DataFrame:
    """Negative or missing population counts are fill and count as nobody."""
    return df.withColumn(value, F.when(F.col(value) > 0, F.col(value)).otherwise(F.lit(0.0)))
