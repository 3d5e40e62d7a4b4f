"""Positions in a hash order without sorting a whole group in one task.

A row's place among its group's rows is the number of rows in lower hash buckets plus its rank inside its own bucket, so
a group of any size is split over `BUCKETS` windows and only one number per bucket is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows that one group is split into: three hexadecimal digits of the order key.
BUCKETS = 4096


def bucket_of(key: Column) -> Column:
    """The bucket of a hexadecimal order key."""
    return F.substring(key, 1, 3)


def running_totals(rows: DataFrame, totals: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over all rows of the group that come earlier.

    `rows` and `totals` both have the group columns and `__bucket`; `totals` may be a cheaper projection of the same rows
    and needs only those and what `value` reads. Rows of one bucket are ordered by `order`; full ties are equal rows.
    """
    small = totals.groupBy(*group, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*group, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = ranked.join(small, [*group, "__bucket"])
    return joined.withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")
