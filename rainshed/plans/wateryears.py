"""Precipitation by water year and by calendar year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import units
from ..operators import reduce, running


def _series(grid: DataFrame, keys: Sequence[str], value: str, time: str) -> DataFrame:
    return reduce.add_water_year(reduce.basin_sum(grid, [*keys, time], value, "__v"), time)


def totals(grid: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str = "total_m") -> DataFrame:
    """Metres per water year. The day level is skipped: sums of sums are one aggregate."""
    rows = reduce.water_year_total(reduce.add_water_year(grid, time), keys, value, out)
    return rows.withColumn(out, units.divided(out, 1000))


def accumulated(grid: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str = "cum_m") -> DataFrame:
    """Running total that starts again each October, in metres."""
    rows = running.water_year_running(_series(grid, keys, value, time), keys, "__v", time, out).drop("__v")
    return rows.withColumn(out, units.divided(out, 1000))


def peaks(grid: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str = "peak_m") -> DataFrame:
    """Highest running total of each water year."""
    return reduce.water_year_peak(accumulated(grid, keys, value, time, "__c"), keys, "__c", out)


def by_day_of_year(grid: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str = "cum_m") -> DataFrame:
    """Running total of each calendar year against the day of the year, in metres."""
    days = reduce.basin_sum(reduce.add_calendar(grid, time), [*keys, "year", "doy"], value, "__v")
    rows = running.running_total(days, [*keys, "year"], "__v", "doy", out).drop("__v")
    return rows.withColumn(out, units.divided(out, 1000))
