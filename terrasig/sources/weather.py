"""Interchangeable daily weather sources: each has its own grid, and a model must be scored on the one it was fitted on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasig.functions.grids import weather_cell


@dataclass(frozen=True)
class WeatherSource:
    name: str
    deg: float
    digits: int

    def cell(self, lat: Column, lon: Column) -> Column:
        """Cell id of the source's own grid."""
        a, b = weather_cell(lat, self.deg, self.digits), weather_cell(lon, self.deg, self.digits)
        return F.concat_ws("_", a.cast("string"), b.cast("string"))


# Fixed grids of the two supported daily products.
SOURCES = {s.name: s for s in (WeatherSource("half_degree", 0.5, 2), WeatherSource("tenth_degree", 0.1, 1))}


def scoring_source(recorded: str | None, requested: str) -> WeatherSource:
    """The source to score with; a model recorded on another source is refused."""
    if recorded is not None and recorded != requested:
        raise ValueError(f"model was fitted on {recorded}, not on {requested}")
    return SOURCES[requested]
