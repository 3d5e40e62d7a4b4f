"""Streaming queries: batch twins of the windows, and streams run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrasig.functions.dates import fortnight
from terrasig.operators import climate
from terrasig.plans.registry import CHECKS, query
from terrasig.plans.tables import Tables
from terrasig.plans.timeseries import DSR_SQL, KBDI_SQL
from terrasig.plans.views import with_views
from terrasig.streaming import stateful, tables, windows


def events(t: Tables) -> DataFrame:
    return t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "tumbling_daily",
    "SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2",
)
def tumbling_daily(t: Tables) -> DataFrame:
    w = windows.tumbling(events(t), "ts", ["event_type"], "value")
    return w.select("event_type", windows.window_start().alias("day"), "n", F.round("total", 4).alias("total"))


@query(
    "sliding_30d",
    """SELECT event_type, CAST(ts AS DATE) + 1 - k AS until, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM (SELECT *, UNNEST(generate_series(-29, 0))::INTEGER AS k FROM events) GROUP BY 1, 2""",
)
def sliding_30d(t: Tables) -> DataFrame:
    """Trailing 30-day totals; events are first reduced to days so each day, not each event, enters thirty windows."""
    days = events(t).groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")
    )
    w = F.window("ts", "30 days", "1 day")
    out = days.groupBy("event_type", w.alias("w")).agg(F.sum("n").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.to_date("w.end").alias("until"), "n", F.round("total", 4).alias("total"))


@query(
    "session_spell",
    with_views(
        "daily",
        """SELECT cell, MIN(d) AS start, COUNT(*) AS n, SUM(precip) AS total FROM (SELECT cell, d, precip, d - CAST(ROW_NUMBER() OVER (PARTITION BY cell ORDER BY d) AS INTEGER) AS island FROM daily WHERE precip > 0) GROUP BY cell, island""",
    ),
)
def session_spell(t: Tables) -> DataFrame:
    wet = t.daily.filter(F.col("precip") > 0).withColumn("ts", F.col("d").cast("timestamp"))
    s = windows.sessions(wet, "ts", ["cell"], "precip", "86401 seconds")
    return s.select("cell", windows.window_start().alias("start"), "n", "total")


def land(df: DataFrame, path: str, part: str, values: list) -> StructType:
    """Land a table as ordered files, one folder per value of ``part``, and return its schema."""
    files = df.sparkSession.sparkContext.defaultParallelism
    for i, v in enumerate(values):
        df.filter(F.col(part) == v).drop(part).coalesce(files).write.parquet(f"{path}/{i:03d}")
    return df.drop(part).schema


def arrivals(t: Tables, root: str, df: DataFrame, part: str, values: list, job, sink=None) -> None:
    """Land one part after the other and let the restarted stream process each: one micro-batch per arrival. The table is
    derived once, for all parts."""
    df = tables.written(df, "arrivals", [part])
    sink = sink or tables.log_sink(f"{root}/log")
    files = t.spark.sparkContext.defaultParallelism
    body = df.drop(part)
    with state_settings(t):
        for i, v in enumerate(values):
            df.filter(F.col(part) == v).drop(part).coalesce(files).write.parquet(f"{root}/in/{i:03d}")
            tables.run_available(job(tables.read_files(t.spark, f"{root}/in", body.schema)), sink, f"{root}/cp")


#: A key of rows that only move the watermark on, so that the last windows close.
FLUSH = "~"


def unordered(t: Tables) -> DataFrame:
    """Events as they may arrive, in six parts: every third one a day late, copies that come twenty days too late in the last
    but one, and rows that close all windows at the end."""
    e = events(t).select("event_id", "event_type", "ts", "value")
    delay = F.when(F.xxhash64("event_id") % 3 == 0, 1).otherwise(0)
    part = lambda day: F.least(F.lit(5), F.floor((day - 1) / 5)).cast("int")
    told = e.withColumn("part", part(F.dayofmonth("ts") + delay))
    too_late = e.filter(F.dayofmonth("ts") <= 5).withColumns({"event_id": -F.col("event_id") - 1, "value": F.lit(1e6), "part": F.lit(6)})
    # only rows of long closed days are late beyond the watermark
    end = closing(e.agg(F.max("event_id").alias("event_id"), F.lit(FLUSH).alias("event_type"), F.max("ts").alias("ts"), F.lit(0.0).alias("value")), 7)
    return told.unionByName(too_late).unionByName(end)


def closing(row: DataFrame, part: int) -> DataFrame:
    """The row three times, 60 days apart, as three arrivals: the first moves the watermark, the next let each of two states in
    a row emit what it has closed."""
    df = row.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return df.withColumns({"ts": F.col("ts") + F.col("_k") * F.expr("INTERVAL 60 DAYS") + F.expr("INTERVAL 60 DAYS"), "part": F.lit(part) + F.col("_k")}).drop("_k")


def windowed(t: Tables, name: str, df: DataFrame, parts: int, job, out: str, keys: list[str]) -> DataFrame:
    """Run a windowed job over arrivals in parts and read what it has emitted. The closing rows go here: as a filter of the
    stream it would be pushed below the watermark, which then would not move."""
    root = tables.scratch(t.spark, name)
    arrivals(t, root, df, "part", list(range(parts)), job)
    return tables.current(t.spark, f"{root}/log", keys, StructType.fromDDL(out))


@query("stream_tumbling_daily", CHECKS["tumbling_daily"])
def stream_tumbling_daily(t: Tables) -> DataFrame:
    """Daily totals of a stream whose rows come unordered and late."""

    def job(df: DataFrame) -> DataFrame:
        w = windows.tumbling(df, "ts", ["event_type"], "value")
        return w.select("event_type", windows.window_start().alias("day"), "n", F.round("total", 4).alias("total"))

    return windowed(t, "tumbling", unordered(t), 10, job, "event_type string, day date, n bigint, total double", ["event_type", "day"]).filter(F.col("event_type") != FLUSH)


@query("stream_sliding_30d", CHECKS["sliding_30d"])
def stream_sliding_30d(t: Tables) -> DataFrame:
    """Trailing 30-day totals of the same stream: days are a state, and windows over them another."""

    def job(df: DataFrame) -> DataFrame:
        w = windows.sliding_of_days(df, "ts", ["event_type"], "value", 30)
        return w.select("event_type", F.to_date("w.end").alias("until"), "n", F.round("total", 4).alias("total"))

    return windowed(t, "sliding", unordered(t), 10, job, "event_type string, until date, n bigint, total double", ["event_type", "until"]).filter(F.col("event_type") != FLUSH)


@query("stream_session_spell", CHECKS["session_spell"])
def stream_session_spell(t: Tables) -> DataFrame:
    """Wet spells of streamed days: sessions that grow, merge across arrivals and close behind the watermark."""
    wet = t.daily.filter(F.col("precip") > 0).select("cell", F.col("d").cast("timestamp").alias("ts"), "precip")
    shifted = F.date_add(F.to_date("ts"), F.when(F.xxhash64("cell", "ts") % 3 == 0, 3).otherwise(0))
    part = F.when(shifted < F.lit("1997-06-01").cast("date"), 0).when(shifted < F.lit("1999-12-15").cast("date"), 1).otherwise(2)
    end = closing(wet.agg(F.lit(-1).cast("bigint").alias("cell"), F.max("ts").alias("ts"), F.lit(0.0).alias("precip")), 3)

    def job(df: DataFrame) -> DataFrame:
        s = windows.sessions(df, "ts", ["cell"], "precip", "86401 seconds", late="10 days")
        return s.select("cell", windows.window_start().alias("start"), "n", "total")

    return windowed(t, "spells", wet.withColumn("part", part).unionByName(end), 6, job, "cell bigint, start date, n bigint, total double", ["cell", "start"]).filter(F.col("cell") >= 0)


@query("stream_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest(t: Tables) -> DataFrame:
    root = tables.scratch(t.spark, "ingest")
    schema = t.read("events").schema
    stream = tables.read_files(t.spark, f"{t.dir}/events.parquet", schema)
    tables.run_available(stream, tables.log_sink(f"{root}/log"), f"{root}/cp")
    out = tables.current(t.spark, f"{root}/log", ["event_id"], schema)
    return out.select("event_id", "user_id", "event_type", "value")


@query(
    "late_data",
    """SELECT event_id, CASE WHEN day(ts) = 5 THEN value + 1 ELSE value END AS value FROM events""",
)
def late_data(t: Tables) -> DataFrame:
    """Three ordered files, then a revised copy of one day: the revision replaces, nothing is counted twice."""
    root = tables.scratch(t.spark, "late")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    e = events(t).select("event_id", "ts", "value")
    revised = e.filter(F.dayofmonth("ts") == 5).withColumns({"value": F.col("value") + 1, "part": F.lit(3)})
    arrivals(t, root, e.withColumn("part", third).unionByName(revised), "part", [0, 1, 2, 3], lambda df: df)
    return tables.current(t.spark, f"{root}/log", ["event_id"], e.schema).select("event_id", "value")


@query(
    "frozen_history",
    """SELECT event_id, CASE WHEN day(ts) = 15 THEN value + 1 ELSE value END AS value FROM events""",
)
def frozen_history(t: Tables) -> DataFrame:
    """History up to the tenth is frozen: a revised fifth changes nothing, a revised fifteenth counts, and the log is folded
    into a snapshot every two batches."""
    root = tables.scratch(t.spark, "frozen")
    e = events(t).select("event_id", "ts", "value")
    day = F.dayofmonth("ts")
    cut = F.date_trunc("month", e.agg(F.min("ts")).scalar()) + F.expr("INTERVAL 10 DAYS")
    table = tables.FrozenTable(t.spark, f"{root}/table", ["event_id"], "ts", cut, e.schema)
    table.load(e.filter(day <= 10))
    told = e.filter(day > 10).withColumn("part", F.when(day <= 20, 0).otherwise(1))
    again = lambda d, part: e.filter(day == d).withColumns({"value": F.col("value") + 1, "part": F.lit(part)})
    arrivals(t, root, told.unionByName(again(5, 2)).unionByName(again(15, 3)), "part", [0, 1, 2, 3], lambda df: df, table.sink(every=2))
    return table.read().select("event_id", "value")


def parted(d: DataFrame) -> DataFrame:
    """Days in three consecutive parts."""
    part = F.when(F.col("d") < F.lit("1997-06-01").cast("date"), 0).when(F.col("d") < F.lit("1999-12-15").cast("date"), 1)
    return d.withColumn("part", part.otherwise(2))


def parted_daily(t: Tables) -> DataFrame:
    """Daily weather with the climatological rain of the cell, in three consecutive parts."""
    d = t.daily.select("cell", "d", "tmax", "precip")
    rain = d.groupBy("cell").agg(
        (F.sum(F.coalesce("precip", F.lit(0.0))) / F.greatest(F.lit(1.0), F.count(F.lit(1)) / 365.25)).alias("r_annual")
    )
    return parted(d.join(rain, "cell"))


@query(
    "stateful_kbdi",
    with_views(
        "daily",
        "SELECT k.cell, k.d, k.kbdi, s.days_since_rain FROM kbdi k JOIN dsr s ON s.cell = k.cell AND s.d = k.d",
        *KBDI_SQL,
        ("dsr", DSR_SQL),
    ),
)
def stateful_kbdi(t: Tables) -> DataFrame:
    root = tables.scratch(t.spark, "kbdi")
    arrivals(t, root, parted_daily(t), "part", [0, 1, 2], stateful.live_fire)
    out = tables.current(t.spark, f"{root}/log", ["cell", "d"], StructType.fromDDL(stateful.KBDI_OUT))
    return out.select("cell", "d", "kbdi", "days_since_rain")


class state_settings:
    """Settings of a stateful stream, put back afterwards.

    Timers and typed state need the RocksDB store. The number of state partitions is fixed for the life of a checkpoint,
    so it follows the cluster's cores and not the batch shuffle setting.
    """

    def __init__(self, t: Tables):
        self.spark = t.spark
        cores = 2 * t.spark.sparkContext.defaultParallelism
        parts = min(cores, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
        self.wanted = {
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.shuffle.partitions": str(parts),
        }

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.wanted}
        for k, v in self.wanted.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


@query(
    "stream_rank",
    with_views(
        "daily",
        """SELECT cell, d, ROUND(CASE WHEN k = 0 THEN 0e0 WHEN k >= 21 THEN 1e0 ELSE (kc-1)*5e-2 + CASE WHEN q[kc+1] > q[kc] THEN GREATEST(0e0, LEAST(1e0, (v-q[kc])/(q[kc+1]-q[kc]))) ELSE 1e0 END*5e-2 END, 9) AS pctl FROM (
           SELECT s.cell, s.d, s.tmax AS v, l.q, len(list_filter(l.q, lambda x: x <= s.tmax)) AS k, GREATEST(1, LEAST(20, len(list_filter(l.q, lambda x: x <= s.tmax)))) AS kc FROM daily s
           JOIN tl l ON l.cell = s.cell AND l.f = LEAST((dayofyear(s.d)-1)//14, 25) WHERE s.tmax IS NOT NULL)""",
        ("tl", f"SELECT cell, LEAST((dayofyear(d)-1)//14, 25) AS f, quantile_cont(tmax, {[i / 20 for i in range(21)]}::DOUBLE[]) AS q FROM daily WHERE tmax IS NOT NULL GROUP BY 1, 2"),
    ),
)
def stream_rank(t: Tables) -> DataFrame:
    """Streamed days ranked against the static ladder."""
    root = tables.scratch(t.spark, "rank")
    ladder = climate.quantile_ladder(t.daily.select("cell", "d", "tmax"), ["tmax"]).drop("signal")
    ladder.write.parquet(f"{root}/ladder")
    ladder = t.spark.read.parquet(f"{root}/ladder")

    def rank(df: DataFrame) -> DataFrame:
        keyed = df.filter(F.col("tmax").isNotNull()).withColumn("fortnight", fortnight(F.col("d")))
        pctl = F.round(climate.ladder_rank(F.col("tmax"), F.col("q")), 9).alias("pctl")
        return keyed.join(ladder, ["cell", "fortnight"]).select("cell", "d", pctl)

    arrivals(t, root, parted(t.daily.select("cell", "d", "tmax")), "part", [0, 1, 2], rank)
    return tables.current(t.spark, f"{root}/log", ["cell", "d"], StructType.fromDDL("cell bigint, d date, pctl double"))


@query("stale_timer")
def stale_timer(t: Tables) -> DataFrame:
    """Users that fall silent for one and two days, raised by event-time timers."""
    root = tables.scratch(t.spark, "stale")
    e = events(t).select("user_id", "ts").withColumn("part", F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5)).cast("int"))
    job = lambda df: stateful.stale_alerts(df, "user_id", "1 hour", stateful.StaleTimerOneDay())
    arrivals(t, root, e, "part", [0, 1, 2, 3, 4, 5], job)
    return tables.current(t.spark, f"{root}/log", ["key", "last_seen", "level"], StructType.fromDDL(stateful.STALE_OUT))


@query(
    "stream_publish",
    "SELECT user_id AS location_id, CAST(ts AS DATE) AS as_of, arg_max(event_type, event_id) AS status FROM events GROUP BY 1, 2",
)
def stream_publish(t: Tables) -> DataFrame:
    """Publish the day's last status per location; a batch delivered twice leaves the table unchanged."""
    root = tables.scratch(t.spark, "publish")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    e = events(t).select("event_id", "user_id", "ts", "event_type").withColumn("part", third)
    write = tables.log_sink(f"{root}/log")

    def publish(df: DataFrame, batch_id: int) -> None:
        day = df.groupBy(F.col("user_id").alias("location_id"), F.to_date("ts").alias("as_of")).agg(
            F.max_by("event_type", "event_id").alias("status")
        )
        write(day, batch_id)
        write(day, batch_id)

    arrivals(t, root, e, "part", [0, 1, 2], lambda df: df, publish)
    out = StructType.fromDDL("location_id bigint, as_of date, status string")
    return tables.current(t.spark, f"{root}/log", ["location_id", "as_of"], out)
