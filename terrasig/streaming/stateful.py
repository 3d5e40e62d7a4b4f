"""Per-cell state: the drought-index recursion, the dry run and the staleness timer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terrasig.operators.climate import WET_DAY_MM, kbdi_fold

KBDI_OUT = "cell bigint, d date, kbdi double, days_since_rain bigint"
STALE_OUT = "key bigint, last_seen timestamp, level string"


class FireState(StatefulProcessor):
    """Carries deficiency, wet-spell total and dry run of a cell from one micro-batch to the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fire", "q double, spell double, run bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("d")
        q, spell, run = self.state.get() if self.state.exists() else (0.0, 0.0, 0)
        values, spell = kbdi_fold(
            pdf["tmax"].to_numpy("float64"),
            pdf["precip"].to_numpy("float64"),
            q0=q,
            r_annual_mm=float(pdf["r_annual"].iloc[0]),
            spell0=spell,
        )
        wet = np.nan_to_num(pdf["precip"].to_numpy("float64"), nan=0.0) >= WET_DAY_MM
        pos = np.arange(1, len(wet) + 1)
        last = np.maximum.accumulate(np.where(wet, pos, 0))
        since = np.where(last > 0, pos - last, pos + run)
        self.state.update((float(values[-1]), float(spell), int(since[-1])))
        yield pd.DataFrame({"cell": key[0], "d": pdf["d"], "kbdi": np.round(values, 6), "days_since_rain": since})

    def close(self) -> None:
        pass


class StaleTimer(StatefulProcessor):
    """Event-time alarm when a key falls silent: ``fill`` after five days, ``degrade`` after seven."""

    fill_ms = 5 * 86_400_000
    degrade_ms = 7 * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(int(p["ts"].max().timestamp() * 1000) for p in rows)
        before = self.seen.get()[0] if self.seen.exists() else None
        if before is None or newest > before:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.seen.update((newest,))
            self.handle.registerTimer(newest + self.fill_ms)
            self.handle.registerTimer(newest + self.degrade_ms)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "last_seen": pd.Series(dtype="datetime64[ns]"), "level": pd.Series(dtype="object")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        level = "degrade" if expiredTimerInfo.getExpiryTimeInMs() - last >= self.degrade_ms else "fill"
        yield pd.DataFrame({"key": [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")], "level": [level]})

    def close(self) -> None:
        pass


class StaleTimerOneDay(StaleTimer):
    """The same alarm for feeds that report many times a day."""

    fill_ms = 86_400_000
    degrade_ms = 2 * 86_400_000


def live_fire(daily: DataFrame) -> DataFrame:
    """Stateful KBDI and dry run of a stream (cell, d, tmax, precip, r_annual) whose days arrive in order."""
    return daily.groupBy("cell").transformWithStateInPandas(
        statefulProcessor=FireState(), outputStructType=KBDI_OUT, outputMode="append", timeMode="none"
    )


def stale_alerts(events: DataFrame, key: str, late: str, processor: StatefulProcessor) -> DataFrame:
    stream = events.withWatermark("ts", late)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=STALE_OUT, outputMode="append", timeMode="eventTime"
    )
