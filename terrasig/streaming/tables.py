"""Streamed tables: ordered file sources and a log that a restarted batch rewrites instead of repeating."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder; a local one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    base = shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The table as files of the shared folder, read back; they are deleted when the session ends. `by`: columns that part the
    files, so that a filter on them reads its own files only."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream with a fixed schema, oldest file first."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false").option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has landed, then stop."""
    q: StreamingQuery = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    q.awaitTermination()


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder; a replayed batch id replaces the same folder, so no row counts twice."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id:08d}")

    return write


class FrozenTable:
    """A keyed table with a frozen history: rows of days before the cut never change, later days may be revised.

    Batches are folders of a log; `compact` folds snapshot and log into a new snapshot and then moves one pointer file, in one
    rename, so a reader sees the table before or after and never between. What a snapshot has taken in is removed by the next
    compaction, so the number of files stays bounded however long the stream runs.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], date: str, cut: Column, schema: StructType):
        self.spark, self.root, self.keys, self.date, self.cut, self.schema = spark, root, keys, date, cut, schema

    def _files(self) -> tuple:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        base = hadoop.Path(self.root)
        return hadoop, base.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointer(self) -> tuple[str, int]:
        """Folder of the snapshot in force, and the last batch it holds."""
        name, batch = self.spark.read.text(f"{self.root}/CURRENT").first()[0].split(" ")
        return f"{self.root}/{name}", int(batch)

    def _point(self, name: str, batch: int) -> None:
        hadoop, fs = self._files()
        new = hadoop.Path(f"{self.root}/CURRENT-{name}")
        stream = fs.create(new, True)
        stream.writeBytes(f"{name} {batch}")
        stream.close()
        context = hadoop.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        context.rename(new, hadoop.Path(f"{self.root}/CURRENT"), over)

    def _log(self) -> list[tuple[int, str]]:
        hadoop, fs = self._files()
        place = hadoop.Path(f"{self.root}/log")
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return sorted((int(n.split("=")[1]), f"{self.root}/log/{n}") for n in names if n.startswith("batch_id="))

    def load(self, history: DataFrame) -> None:
        """The history up to the cut, and what is known of the days after it."""
        history.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/snapshot-0")
        self._point("snapshot-0", -1)

    def sink(self, every: int = 4) -> Callable[[DataFrame, int], None]:
        """A batch writer that compacts after every so many batches. Frozen days are left out here, before they are written."""
        write = log_sink(f"{self.root}/log")

        def run(df: DataFrame, batch_id: int) -> None:
            write(df.filter(F.col(self.date) >= self.cut), batch_id)
            if batch_id - self._pointer()[1] >= every:
                self.compact()

        return run

    def read(self) -> DataFrame:
        """The latest version of every key: the snapshot, and the batches behind it."""
        snapshot, last = self._pointer()
        return self._fold(snapshot, last, None)

    def _fold(self, snapshot: str, last: int, upto: int | None) -> DataFrame:
        df = self.spark.read.schema(self.schema).parquet(snapshot).withColumn("batch_id", F.lit(-1))
        fresh = [(b, path) for b, path in self._log() if b > last and (upto is None or b <= upto)]
        if fresh:
            full = StructType([*self.schema.fields, StructField("batch_id", IntegerType())])
            df = df.unionByName(self.spark.read.schema(full).option("basePath", f"{self.root}/log").parquet(*[path for _, path in fresh]))
        values = [n for n in self.schema.names if n not in self.keys]
        newest = df.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_r"))
        return newest.select(*self.keys, "_r.*").select(*self.schema.names)

    def compact(self) -> None:
        hadoop, fs = self._files()
        snapshot, last = self._pointer()
        log = self._log()
        if not log or log[-1][0] <= last:
            return
        upto = log[-1][0]
        name = f"snapshot-{upto + 1}"
        self._fold(snapshot, last, upto).write.mode("overwrite").parquet(f"{self.root}/{name}")
        self._point(name, upto)
        # readers of the snapshot before may still be at work: only what that one had taken in goes
        for b, path in log:
            if b <= last:
                fs.delete(hadoop.Path(path), True)
        for f in fs.listStatus(hadoop.Path(self.root)):
            n = f.getPath().getName()
            if n.startswith("snapshot-") and n not in (name, snapshot.rsplit("/", 1)[1]):
                fs.delete(f.getPath(), True)


def current(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """Latest version of each key over the log; the merge is an aggregate at read time."""
    full = StructType([*schema.fields, StructField("batch_id", IntegerType())])
    log = spark.read.schema(full).option("basePath", path).parquet(path)
    values = [f.name for f in schema.fields if f.name not in keys]
    if not values:
        return log.select(*keys).distinct()
    if len(values) == 1:  # without a struct, which Spark would aggregate by sorting the log
        return log.groupBy(*keys).agg(F.max_by(values[0], "batch_id").alias(values[0]))
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_r"))
    return newest.select(*keys, "_r.*")
