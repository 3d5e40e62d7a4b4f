"""Event catalogues and fire catalogues: landed files to typed rows, raw text kept beside the typed value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasig.functions.dates import epoch_ms_date, mixed_date
from terrasig.functions.geo import near_null_island, valid_coord

CATALOG_SCHEMA = (
    "event_id string, latitude string, longitude string, event_date string, location_accuracy string, "
    "country_name string, landslide_category string, landslide_size string, landslide_trigger string, "
    "_corrupt_record string"
)
TRUSTED_TERRAIN = ("exact", "1km")
TRUSTED_WEATHER = ("exact", "1km", "5km", "10km")
MIN_FIRE_SIZE = 100.0
FIRE_FROM = "2005-01-01"


CATALOG_COLUMNS = tuple(f.split()[0] for f in CATALOG_SCHEMA.split(", ") if not f.startswith("_"))


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv", header: bool = True, columns: Sequence[str] = CATALOG_COLUMNS) -> DataFrame:
    """CSV or NDJSON with a fixed all-string schema; malformed records are kept in ``_corrupt_record``. `columns` is the order
    of the fields of a CSV file."""
    schema = ", ".join([*(f"{c} string" for c in columns), "_corrupt_record string"])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    # a pruned parser would not see that a record has too many fields
    reader = reader.option("columnPruning", False)
    return reader.option("header", header).csv(path) if fmt == "csv" else reader.json(path)


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole records, and those to be kept aside with their text."""
    return raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), raw.filter(F.col("_corrupt_record").isNotNull())


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Typed coordinates and date next to the raw strings; an unparseable value becomes NULL."""
    return raw.withColumns(
        {
            "lat": F.col("latitude").try_cast("double"),
            "lon": F.col("longitude").try_cast("double"),
            "event_date_iso": epoch_ms_date(F.col("event_date").try_cast("bigint")),
            "accuracy": F.trim(F.coalesce("location_accuracy", F.lit(""))),
        }
    )


def usable(df: DataFrame) -> DataFrame:
    return df.filter(valid_coord(F.col("lat"), F.col("lon")))


def date_quality(df: DataFrame) -> DataFrame:
    """Counts of parsed and unparseable dates."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("event_date_iso").alias("n_dated"),
        F.count_if(F.col("event_date").isNotNull() & F.col("event_date_iso").isNull()).alias("n_unparseable"),
    )


def us_fires(df: DataFrame, until: Column) -> DataFrame:
    """Fires of at least 100 acres from 2005 on with a resolvable date and real coordinates."""
    dated = df.filter(F.col("size_acres") >= MIN_FIRE_SIZE).withColumn(
        "date", mixed_date(F.col("ddate"), F.col("yr"), F.col("doy"))
    )
    return _fire_rows(dated, until)


def canada_fires(df: DataFrame, until: Column) -> DataFrame:
    """Fires of at least 100 hectares; size and report date arrive as text."""
    dated = df.filter(F.col("size_ha").try_cast("double") >= MIN_FIRE_SIZE).withColumn(
        "date",
        F.when(F.col("rep_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring("rep_date", 1, 10), "yyyy-MM-dd")),
    )
    return _fire_rows(dated, until)


def _fire_rows(df: DataFrame, until: Column) -> DataFrame:
    ok = df.filter(F.col("date").between(F.lit(FIRE_FROM).cast("date"), until))
    return ok.filter(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~near_null_island(F.col("lat"), F.col("lon"))
    )


def profile(df: DataFrame) -> DataFrame:
    """Rows, rows with valid coordinates, distinct dates, date span and country count of a catalogue."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(valid_coord(F.col("lat"), F.col("lon"))).alias("n_geo"),
        F.count_distinct("event_date_iso").alias("distinct_dates"),
        F.min("event_date_iso").alias("first_date"),
        F.max("event_date_iso").alias("last_date"),
        F.count_distinct(F.expr("nullif(country_name, '')")).alias("countries"),
    )
