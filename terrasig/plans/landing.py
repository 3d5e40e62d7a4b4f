"""Readers on landed files: the given tables are written as the files a source would deliver, with what goes wrong in them, and
read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasig.plans.basics import CLEAN_SQL, payload, raw_catalog
from terrasig.plans.registry import query
from terrasig.plans.tables import Tables
from terrasig.plans.views import with_views
from terrasig.sources import catalog, payloads
from terrasig.streaming.tables import scratch

_COLUMNS = ("event_id", "lat", "lon", "event_date", "event_date_iso", "accuracy", "country_name")
_CLEAN = with_views("", f"SELECT {', '.join(_COLUMNS)} FROM cat", *CLEAN_SQL)


def strings(t: Tables) -> DataFrame:
    """The raw catalogue as a source writes it: text only."""
    raw = raw_catalog(t)
    return raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if c != "_corrupt_record"])


@query("read_catalog_ndjson", _CLEAN)
def read_catalog_ndjson(t: Tables) -> DataFrame:
    """NDJSON with cut-off records among the whole ones."""
    root = scratch(t.spark, "ndjson")
    rows = strings(t).select("event_id", F.to_json(F.struct("*")).alias("line"))
    broken = rows.filter(F.col("event_id").cast("bigint") % 50 == 0).select(F.expr("substr(line, 1, length(line) - 3)").alias("value"))
    rows.select(F.col("line").alias("value")).unionByName(broken).write.text(root)
    whole, _ = catalog.split_corrupt(catalog.read_catalog(t.spark, root, "json"))
    return catalog.clean_catalog(whole).select(*_COLUMNS)


@query(
    "read_catalog_quarantine",
    with_views("", "SELECT COUNT(*) FILTER (WHERE CAST(event_id AS BIGINT) % 50 = 0) AS n_corrupt, COUNT(*) AS n_whole FROM cat", *CLEAN_SQL),
)
def read_catalog_quarantine(t: Tables) -> DataFrame:
    """How many records of a CSV file are kept aside: those with more fields than there are columns."""
    root = scratch(t.spark, "csv")
    raw = strings(t)
    names = [c for c in catalog.CATALOG_COLUMNS if c in raw.columns]
    others = [c for c in catalog.CATALOG_COLUMNS if c not in raw.columns]
    rows = raw.select("event_id", F.to_csv(F.struct(*names, *[F.lit(None).cast("string").alias(c) for c in others])).alias("line"))
    broken = rows.filter(F.col("event_id").cast("bigint") % 50 == 0).select(F.concat("line", F.lit(",one,too,many")).alias("value"))
    rows.select(F.col("line").alias("value")).unionByName(broken).write.text(root)
    found = catalog.read_catalog(t.spark, root, "csv", header=False, columns=(*names, *others))
    # one pass over the files: the kept-aside text and the fields are read together
    return found.agg(
        F.count(F.when(F.col("_corrupt_record").isNotNull(), F.col("event_id"))).alias("n_corrupt"),
        F.count(F.when(F.col("_corrupt_record").isNull(), F.col("event_id"))).alias("n_whole"),
    )


@query("read_arrays_gzip", with_views("cell_day", "SELECT cell, d, CASE WHEN n % 3 <> 0 THEN qty END AS precip FROM cell_day"))
def read_arrays_gzip(t: Tables) -> DataFrame:
    """Gzip files, each a JSON array of documents with parallel arrays."""
    root = scratch(t.spark, "arrays")
    # a file holds the documents of 64 cells, as a source pages them
    docs = payload(t).select(F.floor(F.col("cell") / 64).alias("page"), F.to_json(F.struct("cell", "time", "precip")).alias("doc"))
    files = docs.groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ",\n"), F.lit("]")).alias("value"))
    files.write.option("compression", "gzip").partitionBy("page").text(root)
    found = payloads.read_array_files(t.spark, root, "cell bigint, time array<string>, precip array<double>")
    return payloads.arrays_to_long(found, ["cell"], "time", ["precip"])


def land_years(t: Tables, root: str) -> None:
    """Discharge as one folder a year; from 1998 on the files have a column more."""
    flow = t.river_day.select("cell", "d", "m3s", F.year("d").alias("year"))
    flow.filter("year < 1998").write.partitionBy("year").mode("append").parquet(root)
    flow.filter("year >= 1998").withColumn("version", F.lit("v5")).write.partitionBy("year").mode("append").parquet(root)


@query(
    "read_years_pruned",
    with_views("river_day", "SELECT cell, d, m3s, CASE WHEN year(d) >= 1998 THEN 'v5' END AS version FROM river_day WHERE year(d) BETWEEN 1997 AND 1999"),
)
def read_years_pruned(t: Tables) -> DataFrame:
    """Three years out of folders by year; only their folders are read."""
    root = scratch(t.spark, "years")
    land_years(t, root)
    return payloads.read_years(t.spark, root, "cell bigint, d date, m3s double, version string", 1997, 1999).drop("year")


@query(
    "read_ways_nested",
    """SELECT l_orderkey AS way, ((l_partkey*7919) % 11000)/1e2 - 55e0 AS lat, ((l_suppkey*104729) % 36000)/1e2 - 180e0 AS lon FROM lineitem""",
)
def read_ways_nested(t: Tables) -> DataFrame:
    """Ways of several elements with several vertices each, out of landed JSON."""
    root = scratch(t.spark, "ways")
    vertex = F.struct((((F.col("l_partkey") * 7919) % 11000) / 100.0 - 55.0).alias("lat"), (((F.col("l_suppkey") * 104729) % 36000) / 100.0 - 180.0).alias("lon"))
    part = t.read("lineitem").groupBy(F.col("l_orderkey").alias("way"), (F.col("l_linenumber") % 2).alias("_part")).agg(F.collect_list(vertex).alias("geometry"))
    part.groupBy("way").agg(F.collect_list(F.struct("geometry")).alias("elements")).write.json(root)
    schema = "way bigint, elements array<struct<geometry:array<struct<lat:double,lon:double>>>>"
    return payloads.nested_vertices(t.spark.read.schema(schema).json(root), ["way"], "elements")
