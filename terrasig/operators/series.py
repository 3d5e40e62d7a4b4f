"""Per-cell daily series: calendar spine, rolling totals, runs, percentiles against the cell's own record.

Every function here partitions by the cell key alone. After ``densify`` a cell holds exactly one row per calendar day,
so the partition is bounded by the length of the calendar whatever the raw input's skew was; the raw rows are reduced
to cell-days by a partial aggregate before they reach this exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrasig.functions.dates import season_key


def densify(df: DataFrame, key: str, date: str, lo: Column, hi: Column, clip: bool = True) -> DataFrame:
    """One row per (key, day) in [lo, hi]; value columns are NULL on the days that were absent.

    Each present row emits the absent days up to the next present row, so no spine join is needed and the exchange by
    key is the only one. Its partition count is pinned: the rows multiply after the exchange, where adaptive coalescing
    would have seen only the sparse input. Input must hold at most one row per (key, date).
    """
    w = Window.partitionBy(key).orderBy(date)
    values = [c for c in df.columns if c not in (key, date)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (
        (df.filter(F.col(date).between(lo, hi)) if clip else df)
        .repartition(parts, key)
        .withColumn("_next", F.lead(date).over(w))
        .withColumn("_first", F.lag(date).over(w).isNull())
        .withColumn("_from", F.when(F.col("_first"), lo).otherwise(F.col(date)))
        .withColumn("_to", F.coalesce(F.date_sub("_next", 1), hi))
        .withColumn("_day", F.explode(F.sequence("_from", "_to")))
    )
    present = F.col("_day") == F.col(date)
    return spread.select(
        key, *[F.when(present, F.col(v)).alias(v) for v in values], F.col("_day").alias(date)
    ).select(df.columns)


def with_position(df: DataFrame, key: str, date: str, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(date)))


def rolling_sums(
    df: DataFrame, key: str, date: str, value: str, windows: Sequence[int], prefix: str, suffix: str = "d"
) -> DataFrame:
    """Trailing w-row totals, missing counted as 0, NULL for the first w-1 rows.

    A running total and its lag give every width in constant time per row; a sliding frame would re-add w values.
    """
    w = Window.partitionBy(key).orderBy(date)
    df = df.withColumn("_cum", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_pos", F.row_number().over(w))
    total = {
        f"{prefix}{n}{suffix}": F.when(
            F.col("_pos") >= n, F.col("_cum") - F.coalesce(F.lag("_cum", n).over(w), F.lit(0.0))
        )
        for n in windows
    }
    return df.withColumns(total).drop("_cum", "_pos")


def days_since(df: DataFrame, key: str, date: str, hit: Column, name: str) -> DataFrame:
    """Rows since the last hit, 0 on a hit; before the first hit it counts from the series start."""
    w = Window.partitionBy(key).orderBy(date)
    rn = F.row_number().over(w)
    df = df.withColumn("_rn", rn).withColumn("_hit", F.when(F.coalesce(hit, F.lit(False)), F.col("_rn")))
    last = F.max("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.col("_rn") - F.coalesce(last, F.lit(0))).drop("_rn", "_hit")


def alltime_percentiles(
    df: DataFrame, key: str, columns: dict[str, str], missing_as: float | None = None
) -> DataFrame:
    """Inclusive share of the key's whole record at or below the value: ``{value column: output column}``."""
    whole = Window.partitionBy(key)
    df = df.withColumns({f"_n_{v}": F.count(v).over(whole) for v in columns})
    for value, out in columns.items():
        below = F.count(value).over(whole.orderBy(value))
        n = F.col(f"_n_{value}")
        pctl = F.when(F.col(value).isNotNull(), below.cast("double") / n)
        if missing_as is not None:
            pctl = F.when(F.col(value).isNull() & (n > 0), F.lit(missing_as)).otherwise(pctl)
        df = df.withColumn(out, pctl)
    return df.drop(*[f"_n_{v}" for v in columns])


def _at_or_below(pool_desc: Column, value: Column) -> Column:
    """Members of a descending pool that do not exceed a value the pool contains."""
    return F.size(pool_desc) - F.array_position(pool_desc, value) + 1


def season_pools(df: DataFrame, key: str, sk: str, values: Sequence[str], halfwidth: int = 15) -> DataFrame:
    """(key, season key) -> descending pool per value from every year within +-halfwidth key units."""
    day = df.groupBy(key, sk).agg(*[F.collect_list(v).alias(f"_day_{v}") for v in values])
    near = Window.partitionBy(key).orderBy(sk).rangeBetween(-halfwidth, halfwidth)
    return day.select(
        key,
        sk,
        *[
            F.sort_array(F.flatten(F.collect_list(f"_day_{v}").over(near)), asc=False).alias(f"pool_{v}")
            for v in values
        ],
    )


def season_counts(codes: np.ndarray, sk: np.ndarray, halfwidth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the members of its season's pool that do not exceed it, and all members.

    ``codes`` are ordinal numbers of the values, -1 where missing. Values stand in a grid of season keys by their rows; the grid,
    shifted by each offset of the season, is compared with itself.
    """
    order = np.argsort(sk, kind="stable")
    at = sk[order] - sk[order[0]]
    per = np.bincount(at)
    slot = np.arange(len(at)) - (np.cumsum(per) - per)[at]
    span, width = len(per), int(per.max())
    none = codes.max(initial=0) + 1  # exceeds every value
    grid = np.full((width, span + 2 * halfwidth), none, np.int16 if none < 2**15 else np.int32)
    grid[slot, at + halfwidth] = np.where(codes[order] < 0, none, codes[order])
    here = grid[:, halfwidth : halfwidth + span]
    below = np.empty((width, span), np.int64)
    step = max(1, 2**20 // (width * span))  # bounds the memory where a day has many rows
    for k in range(0, width, step):
        met = np.zeros((width, len(here[k : k + step]), span), np.uint16)
        for o in range(2 * halfwidth + 1):
            met += grid[:, None, o : o + span] <= here[None, k : k + step]
        below[k : k + step] = met.sum(axis=0, dtype=np.int64)
    known = np.concatenate([[0], np.cumsum((grid < none).sum(axis=0))])
    members = known[2 * halfwidth + 1 :] - known[: span]
    out = np.empty((2, len(at)), np.int64)
    out[0, order], out[1, order] = below[slot, at], members[at]
    return out[0], out[1]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Ordinal number of each value among the distinct ones, -1 where missing; not-a-number is the highest value."""
    out = np.full(len(column), -1, np.int64)
    out[column.is_valid().to_numpy()] = np.unique(column.drop_null().to_numpy(), return_inverse=True)[1]
    return out


def _share(below: np.ndarray, n: np.ndarray, codes: np.ndarray, least: int, missing_as: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(percentile, where it is missing): pools of fewer than `least` give none."""
    share = np.where(codes < 0, np.nan if missing_as is None else missing_as, below / np.maximum(n, 1))
    return share, (n < least) | ((codes < 0) & (missing_as is None))


def seasonal_percentiles(
    df: DataFrame,
    key: str,
    date: str,
    columns: dict[str, str],
    halfwidth: int = 15,
    min_n: int = 30,
    missing_as: float | None = None,
    only: Column | None = None,
    alltime: dict[str, str] | None = None,
    change: dict[str, tuple[str, int]] | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Inclusive percentile within the key's own same-season record: ``{value column: output column}``.

    A key's rows are ranked in one Arrow batch, every column at once; a key holds no more rows than its calendar. ``only``
    keeps the rows to be ranked; the pools still hold every row. Fewer than min_n pool members gives NULL; a missing value
    gives NULL, or ``missing_as`` where the pool is large enough. ``alltime`` adds percentiles in the key's whole record
    (`alltime_percentiles`), and ``change`` ``{output: (percentile column, n)}`` the difference to the percentile n rows before in
    order of date, 0 where there is none. Columns in ``drop`` are ranked but not returned.
    """
    alltime, change = alltime or {}, change or {}
    keep, some = [c for c in df.columns if c not in drop], only is not None
    if some:
        df = df.withColumn("_asked", F.coalesce(only, F.lit(False)))
    ranked = dict.fromkeys([key, date, *keep, *alltime, *columns, *(["_asked"] if some else [])])
    kinds = df.schema
    df = df.select(*ranked, season_key(F.col(date)).alias("_sk"))
    names = [*alltime.values(), *columns.values(), *change]
    schema = StructType([*[kinds[c] for c in keep], *[StructField(c, DoubleType()) for c in names]])

    def run(rows: pa.Table) -> pa.Table:
        if change:
            rows = rows.sort_by(date)
        sk = rows.column("_sk").fill_null(-2 * halfwidth - 1).to_numpy()  # days without a date are a season of their own
        asked = rows.column("_asked") if some else None
        codes = {c: _codes(rows.column(c)) for c in {**alltime, **columns}}
        made = {}
        for c, out in alltime.items():
            n = np.bincount(codes[c][codes[c] >= 0], minlength=1)
            made[out] = _share(np.cumsum(n)[codes[c]], np.full(len(rows), n.sum()), codes[c], 1, missing_as)
        for c, out in columns.items():
            made[out] = _share(*season_counts(codes[c], sk, halfwidth), codes[c], min_n, missing_as)
        for out, (c, n) in change.items():
            value, gone = made[c]
            first = np.ones(min(n, len(rows)), bool)
            before, none = np.concatenate([np.zeros(len(first)), value[:-n]]), np.concatenate([first, gone[:-n]])
            made[out] = np.where(none, 0.0, value - before), ~none & gone
        rows = rows.select(keep)
        for c in names:
            rows = rows.append_column(c, pa.array(made[c][0], mask=made[c][1]))
        return rows.filter(asked) if some else rows  # ranked by all, returned as asked

    return df.groupBy(key).applyInArrow(run, schema)


def pooled_percentiles(
    df: DataFrame,
    key: str,
    date: str,
    columns: dict[str, str],
    halfwidth: int = 15,
    min_n: int = 30,
    missing_as: float | dict[str, float] | None = None,
    only: Column | None = None,
) -> DataFrame:
    """`seasonal_percentiles` without a pass through Python, for a few days of a long record.

    Rows are folded to one per (key, season key); a RANGE window over the season key then gathers the +-halfwidth pool
    once per season key, not once per row. A row's rank is its position in the descending pool, so the scan stays in
    generated code. ``only`` keeps the rows to be ranked; the pools still hold every row, but only the pools those rows
    need are built. Fewer than min_n pool members gives NULL; a missing value gives NULL, or ``missing_as`` (for all columns, or
    by value column) where the pool is large enough.
    """
    keep = df.columns
    sk = "_sk"
    row = F.struct(*[c for c in keep if c != key])
    folded = (
        df.withColumn(sk, season_key(F.col(date)))
        .groupBy(key, sk)
        .agg(
            F.collect_list(row if only is None else F.when(only, row)).alias("_rows"),
            *[F.collect_list(v).alias(f"_day_{v}") for v in columns],
        )
    )
    near = Window.partitionBy(key).orderBy(sk).rangeBetween(-halfwidth, halfwidth)
    pooled = folded.select(
        key,
        "_rows",
        *[
            F.sort_array(F.flatten(F.collect_list(f"_day_{v}").over(near)), asc=False).alias(f"_pool_{v}")
            for v in columns
        ],
    )
    rows = pooled.select(key, *[f"_pool_{v}" for v in columns], F.inline("_rows"))
    out = []
    for v, name in columns.items():
        pool = F.col(f"_pool_{v}")
        enough = F.size(pool) >= min_n
        pctl = F.when(
            enough & F.col(v).isNotNull(), _at_or_below(pool, F.col(v)).cast("double") / F.size(pool)
        )
        missing = missing_as.get(v) if isinstance(missing_as, dict) else missing_as
        if missing is not None:
            pctl = F.when(enough & F.col(v).isNull(), F.lit(missing)).otherwise(pctl)
        out.append(pctl.alias(name))
    return rows.select(*keep, *out)


def asked_percentiles(
    df: DataFrame,
    key: str,
    date: str,
    columns: dict[str, str],
    only: Column,
    halfwidth: int = 15,
    min_n: int = 30,
    missing_as: float | None = None,
) -> DataFrame:
    """`seasonal_percentiles` of the rows named by ``only``, where they are few in each key's record.

    A key's asked rows are laid beside its record, and each row of the record is counted in the seasons it falls into, so no pool
    is built or sorted. The work grows with the record times the asked rows of a key.
    """
    day = F.coalesce(season_key(F.col(date)), F.lit(-2 * halfwidth - 1))  # days without a date are a season of their own
    keyed = df.withColumn("_sk", day)
    asked = F.collect_list(F.when(only, F.struct(*df.columns, "_sk"))).over(Window.partitionBy(key))
    beside = keyed.select(key, F.col("_sk").alias("_day"), *[F.col(v).alias(f"_v_{v}") for v in columns], asked.alias("_asked"))
    met = beside.select("*", F.posexplode("_asked").alias("_i", "_r")).drop("_asked").filter(F.abs(F.col("_day") - F.col("_r._sk")) <= halfwidth)
    counts = [x for v in columns for x in (F.count(f"_v_{v}").alias(f"_n_{v}"), F.count_if(F.col(f"_v_{v}") > F.col(f"_r.{v}")).alias(f"_above_{v}"))]
    counted = met.groupBy(key, "_i").agg(F.first("_r").alias("_r"), *counts)
    out = []
    for v, name in columns.items():
        n, value = F.col(f"_n_{v}"), F.col(f"_r.{v}")
        pctl = F.when(value.isNotNull(), (n - F.col(f"_above_{v}")).cast("double") / n)
        out.append(F.when(n >= min_n, pctl if missing_as is None else F.coalesce(pctl, F.lit(missing_as))).alias(name))
    return counted.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns], *out)


def rank_in_pool_member(pool_desc: Column, value: Column, min_n: int = 30) -> Column:
    """Inclusive percentile of a value that is itself in the descending pool."""
    n = F.size(pool_desc)
    return F.when((n >= min_n) & value.isNotNull(), _at_or_below(pool_desc, value).cast("double") / n)


def rank_in_pool(pool_desc: Column, value: Column, min_n: int = 30) -> Column:
    """Inclusive percentile of an outside value (a forecast, a streamed day) in a descending pool."""
    with_value = F.sort_array(F.array_append(pool_desc, value), asc=False)
    n = F.size(pool_desc)
    at_or_below = n - F.array_position(with_value, value) + 1
    return F.when((n >= min_n) & value.isNotNull(), at_or_below.cast("double") / n)


def last_valid(df: DataFrame, key: str, date: str, value: str, as_of: Column) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.when(F.col(value).isNotNull(), F.col(date))).alias("last_valid")).withColumn(
        "staleness_days", F.datediff(as_of, F.col("last_valid"))
    )


def near_flags(df: DataFrame, key: str | Sequence[str], date: str, flag: str, out: str) -> DataFrame:
    """True where the flag holds on the row or on a neighbouring row of the same key."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(date)
    return df.withColumn(
        out, F.lag(flag, 1, False).over(w) | F.col(flag) | F.lead(flag, 1, False).over(w)
    )
