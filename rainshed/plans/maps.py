"""Storm maps and point series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing, units
from ..sources import catalog
from ..operators import geo, reduce, select


def storm_map(
    grid: DataFrame, dates: tuple[str, str], value: str, how: str, keys: Sequence[str] = ("y", "x"),
    time: str = "time", positive_only: bool = False, out: str = "value",
) -> DataFrame:
    """Daily value of each cell over a range of days."""
    daily = reduce.to_days(select.time_slice(grid, *dates, time=time), keys, value, how, time, out)
    return daily.withColumn(out, missing.positive(out)) if positive_only else daily


def with_range(maps: DataFrame, value: str = "value") -> DataFrame:
    """Each row of a map with its colour limits, a one-row aggregate used as a scalar."""
    limits = reduce.value_range(maps, [], value).select(F.struct("low", "high")).scalar()
    return maps.withColumns({"low": limits.getField("low"), "high": limits.getField("high")})


def point_series(
    grid: DataFrame, cells: DataFrame, points: Sequence[tuple[str, float, float]], key: Sequence[str] = ("y", "x"),
    kelvin: str | None = "t", time: str = "time",
) -> DataFrame:
    """Time series of the cell nearest to each place, with degrees Celsius. Order it at the sink."""
    nearest = F.broadcast(geo.nearest_cells(cells, points, key))  # one row per place of the request
    rows = grid.join(nearest.select("point", *key), list(key))
    return rows.withColumn("t_c", units.kelvin_to_celsius(kelvin)) if kelvin else rows


def stored_point_series(
    store: DataFrame, cells: DataFrame, points: Sequence[tuple[str, float, float]], key: Sequence[str] = ("y", "x"), kelvin: str | None = "t"
) -> DataFrame:
    """The same from a store written ``by_cell``: only the pages of the places' cells are read."""
    nearest = geo.nearest_cells(cells, points, key)
    rows = catalog.cells_of(store, nearest, key).join(F.broadcast(nearest.select("point", *key)), list(key))
    return rows.withColumn("t_c", units.kelvin_to_celsius(kelvin)) if kelvin else rows
