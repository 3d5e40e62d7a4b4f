"""The named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasig.plans.tables import DayTables, OnceTables, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, once: bool = False, days: bool = False) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the derived tables under a query name, with its check SQL where SQL can express it. `once`: the
    daily series is written before it is read, for jobs that read it many times; `days`: only its cell-days are, where files and
    shuffles of the gap-free series would take more room than deriving it again takes time."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn((OnceTables if once else DayTables if days else Tables)(spark, sf_dir))
        if sql:
            CHECKS[name] = sql
        return fn

    return wrap
