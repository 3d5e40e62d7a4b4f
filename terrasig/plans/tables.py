"""Derived inputs of the registered queries: the domain tables computed by Spark from the given Parquet tables.

Each property is lazy and is derived from whole tables. The same derivations are written as SQL in ``views.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasig.functions.dates import season_key
from terrasig.operators import series
from terrasig.streaming.tables import written


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_cells(self) -> Column:
        return self.read("supplier").agg(F.count(F.lit(1))).scalar()

    @cached_property
    def span(self) -> tuple[Column, Column]:
        days = self.read("lineitem").select(F.to_date("l_shipdate").alias("d"))
        return days.agg(F.min("d")).scalar(), days.agg(F.max("d")).scalar()

    @cached_property
    def cell_day(self) -> DataFrame:
        """Observed cell-days: additive parts only, so the raw rows combine before the shuffle."""
        return (
            self.read("lineitem")
            .groupBy(F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("d"))
            .agg(
                F.sum("l_quantity").alias("qty"),
                F.sum(cents("l_extendedprice")).alias("ext"),
                F.sum(cents("l_discount")).alias("disc"),
                F.sum(cents("l_tax")).alias("tax"),
                F.count(F.lit(1)).alias("n"),
                F.sum(F.when(F.col("l_partkey") % 4 < 1 + F.col("l_suppkey") % 4, F.col("l_quantity")).otherwise(0.0)).alias("shared"),
            )
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Gap-free daily weather per cell with some missing rain and temperature values."""
        lo, hi = self.span
        dense = series.densify(self.cell_day, "cell", "d", lo, hi, clip=False)
        cell, doy = F.col("cell"), F.dayofyear("d")
        rain_gone = (cell * 7 + doy) % 97 == 0
        temp_gone = (cell * 5 + doy) % 89 == 0
        warm = (20000 + 150 * (183 - F.abs(183 - doy))).cast("double")
        return dense.select(
            "cell",
            "d",
            F.when(~rain_gone, F.coalesce("qty", F.lit(0.0)) / 2.0).alias("precip"),
            F.when(
                ~temp_gone, F.coalesce(F.col("ext").cast("double") / F.col("n") / 100.0, warm) / 2500.0
            ).alias("tmax"),
            F.coalesce(
                F.col("disc").cast("double") / F.col("n") * 9.0, (30 + (cell * 13 + doy * 7) % 50).cast("double")
            ).alias("rh"),
            F.coalesce(F.col("tax").cast("double") / F.col("n"), ((cell * 3 + doy) % 9).cast("double")).alias("ws"),
        )

    @cached_property
    def rain2(self) -> DataFrame:
        """A second rain source that shares part of the first one's record and stops 95 days before it."""
        known = self.cell_day.filter(F.col("d") <= F.lit("2001-08-01").cast("date"))
        return known.select("cell", "d", (F.col("shared") / 2.0).alias("precip2"))

    @cached_property
    def event(self) -> DataFrame:
        """Reported events of every kind; several reports may fall on one cell-day."""
        return self.read("events").select(
            "event_id",
            F.pmod(F.col("event_id"), self.n_cells).alias("cell"),
            F.date_add(
                F.lit("1996-03-01").cast("date"), ((F.col("event_id") * 37 + F.col("user_id") * 13) % 1990).cast("int")
            ).alias("d"),
            F.col("event_type").alias("kind"),
        )

    @cached_property
    def event_day(self) -> DataFrame:
        return self.event.select("cell", "d").distinct()

    def _located(self, table: str, key: str, *extra: Column) -> DataFrame:
        k = F.col(key)
        return self.read(table).select(
            k.alias("id"),
            (((k * 7919) % 11000) / 100.0 - 55.0).alias("lat"),
            (((k * 104729) % 36000) / 100.0 - 180.0).alias("lon"),
            *extra,
        )

    @cached_property
    def point(self) -> DataFrame:
        """Catalogue points and population pixels."""
        return self._located(
            "customer",
            "c_custkey",
            F.abs("c_acctbal").alias("people"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
        )

    @cached_property
    def place(self) -> DataFrame:
        """Registered locations; the location's weather cell is its id."""
        return self._located(
            "supplier", "s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation")
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Out-of-fold scores with many ties."""
        j = self.read("labels").join(self.read("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        return j.select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("grp"),
            F.col("lang"),
            F.col("quality").alias("label"),
            F.col("toxic"),
            F.round(F.least(F.lit(1.0), F.log(1.0 + F.col("n_chars")) / 12.0), 2).alias("score"),
        )

    @cached_property
    def patch(self) -> DataFrame:
        """8x8 elevation patches: a value per (row, col) in row-major order."""
        e = F.transform("embedding", lambda x: x.cast("double") * 100.0 + 500.0)
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"), F.concat(F.lit("r"), F.col("label")).alias("region"), e.alias("z")
        )

    @cached_property
    def river_day(self) -> DataFrame:
        """Daily discharge of each grid cell (i, j); ``cell`` is the grid cell's key."""
        lo, hi = self.span
        dense = series.densify(self.cell_day.select("cell", "d", "ext"), "cell", "d", lo, hi, clip=False)
        return dense.select(
            "cell",
            F.floor(F.col("cell") / 10).alias("i"),
            (F.col("cell") % 10).alias("j"),
            "d",
            F.greatest(
                F.lit(1.0), F.coalesce("ext", F.lit(0)).cast("double") / 500000.0 + (F.col("cell") % 7).cast("double")
            ).alias("m3s"),
        )

    @cached_property
    def forecast(self) -> DataFrame:
        """Seven leads per grid cell from one initial date."""
        base = self.cell_day.filter(F.col("d").isNotNull()).select("cell").distinct()
        return base.select(
            "cell",
            F.lit("2001-06-26").cast("date").alias("init"),
            F.explode(F.sequence(F.lit(24), F.lit(168), F.lit(24))).alias("lead_h"),
        ).withColumn("m3s", ((F.col("cell") * 31 + F.col("lead_h") * 7) % 900) / 10.0)

    @cached_property
    def run(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_orderpriority").alias("name"),
            F.col("o_orderstatus").alias("layer"),
            F.to_date("o_orderdate").alias("trained_at"),
            F.col("o_totalprice").alias("score"),
            F.when(F.col("o_custkey") % 5 == 0, "failed").otherwise("complete").alias("status"),
        )

    @cached_property
    def truth(self) -> DataFrame:
        """Weekly drought panel per county (= cell): four nested severity areas in percent."""
        df = series.with_position(self.daily.select("cell", "d", "precip"), "cell", "d")
        dry = F.when(F.coalesce("precip", F.lit(0.0)) == 0.0, 1.0).otherwise(0.0)
        df = series.rolling_sums(df.withColumn("_dry", dry), "cell", "d", "_dry", (180,), "dry")
        share = F.col("dry180d") / 180.0
        area = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(100.0), (share - edge) * 1000.0))
        return df.filter((F.col("rn") % 7 == 0) & (F.col("rn") > 180)).select(
            F.col("cell").alias("fips"),
            "d",
            *[F.round(area(e), 6).alias(n) for n, e in (("d1", 0.75), ("d2", 0.78), ("d3", 0.81), ("d4", 0.84))],
        )

    def season_rain(self, only: Column | None = None) -> DataFrame:
        """Three-day and thirty-day totals with their season percentiles, for the days asked for."""
        df = series.rolling_sums(self.daily.select("cell", "d", "precip"), "cell", "d", "precip", (3, 30), "p")
        df = series.with_position(df, "cell", "d")
        return series.seasonal_percentiles(df, "cell", "d", {"p3d": "s3", "p30d": "s30"}, only=only)

    @cached_property
    def rain(self) -> DataFrame:
        return self.season_rain()

    @cached_property
    def replay(self) -> DataFrame:
        """Cell-days after the split with the alarm score, the one-feature rule and the event flag."""
        ranked = self.season_rain(F.col("d") > F.lit("1998-12-31").cast("date"))
        after = ranked.select("cell", "d", "s3", "s30").filter(F.col("s3").isNotNull() & F.col("s30").isNotNull())
        ev = self.event_day.withColumn("event", F.lit(True))
        return after.join(ev, ["cell", "d"], "left").select(
            "cell",
            "d",
            F.when(F.col("cell") % 2 == 0, "us").otherwise("canada").alias("domain"),
            F.round(0.7 * F.col("s3") + 0.3 * F.col("s30") + 1e-7, 2).alias("p"),
            F.col("s3").alias("rule"),
            F.coalesce("event", F.lit(False)).alias("event"),
        )


class DayTables(Tables):
    """The same tables for jobs that scan the raw rows many times: cell-days are written once to the shared folder. The gap-free
    series is made of them where it is read, so that only cell-days are shuffled for it."""

    @cached_property
    def cell_day(self) -> DataFrame:
        return written(Tables.cell_day.func(self), "cell_day")

    @cached_property
    def span(self) -> tuple[Column, Column]:
        return self.cell_day.agg(F.min("d")).scalar(), self.cell_day.agg(F.max("d")).scalar()


class OnceTables(DayTables):
    """The same tables for jobs that read the daily series many times: cell-days and the gap-free series are written once to
    the shared folder, so the raw rows are scanned once however many signals a job derives."""

    @cached_property
    def daily(self) -> DataFrame:
        return written(Tables.daily.func(self), "daily")


def keyed(df: DataFrame, date: str = "d", name: str = "sk") -> DataFrame:
    return df.withColumn(name, season_key(F.col(date)))
