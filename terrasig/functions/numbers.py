"""Numeric helpers that keep NULL a NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]. ``greatest`` and ``least`` skip NULL, so a bare pair would turn a missing value into a bound."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
