"""The table with a frozen history: revisions, repeated batches, compaction."""

from __future__ import annotations

import datetime
import glob

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StructField, StructType

from terrasig.streaming import tables

SCHEMA = StructType([StructField("cell", IntegerType()), StructField("d", DateType()), StructField("v", DoubleType())])


def day(k: int) -> datetime.date:
    return datetime.date(2001, 1, k)


def made(spark, root):
    table = tables.FrozenTable(spark, root, ["cell", "d"], "d", F.lit("2001-01-10").cast("date"), SCHEMA)
    table.load(spark.createDataFrame([(1, day(k), float(k)) for k in range(1, 13)], SCHEMA))
    return table


def test_days_before_the_cut_never_change(spark, out_dir):
    table = made(spark, f"{out_dir}/t")
    write = table.sink(every=100)
    batch = spark.createDataFrame([(1, day(9), -1.0), (1, day(10), -2.0), (1, day(13), -3.0), (2, day(3), -4.0)], SCHEMA)
    write(batch, 0)
    got = {(r["cell"], r["d"].day): r["v"] for r in table.read().collect()}
    assert got == {(1, k): float(k) for k in range(1, 13)} | {(1, 10): -2.0, (1, 13): -3.0}


def test_a_repeated_batch_and_a_compaction_leave_the_table_as_it_is(spark, out_dir):
    table = made(spark, f"{out_dir}/t")
    write = table.sink(every=100)
    for b in range(3):
        write(spark.createDataFrame([(1, day(11), float(-b))], SCHEMA), b)
    write(spark.createDataFrame([(1, day(11), -2.0)], SCHEMA), 2)
    before = sorted(map(tuple, table.read().collect()))
    table.compact()
    table.compact()
    assert sorted(map(tuple, table.read().collect())) == before and (1, day(11), -2.0) in before


def test_files_stay_bounded(spark, out_dir):
    root = f"{out_dir}/t"
    table = made(spark, root)
    write = table.sink(every=2)
    for b in range(12):
        write(spark.createDataFrame([(1, day(12), float(b)), (b, day(20), 1.0)], SCHEMA), b)
        assert len(glob.glob(f"{root}/log/batch_id=*")) <= 5 and len(glob.glob(f"{root}/snapshot-*")) <= 2
    rows = table.read()
    assert rows.filter("d = '2001-01-12'").first()["v"] == 11.0 and rows.filter("d = '2001-01-20'").count() == 12
