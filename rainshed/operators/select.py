"""Variable selection, renames, drops and time or position picks."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

log = logging.getLogger(__name__)

# Names that differ between products, mapped to the cube's names.
AXIS_NAMES = {
    "south_north": "y", "west_east": "x", "Time": "time", "datetime": "time",
    "XLAT": "lat", "XLONG": "lon", "CLAT": "lat", "CLONG": "lon", "latitude": "lat", "longitude": "lon",
    "HGT": "hgt", "LANDMASK": "landmask",
}


def choose_variables(
    request: str | Iterable[str], allowed: Sequence[str], defaults: Sequence[str] | None = None
) -> tuple[list[str], list[str]]:
    """Split a request (comma list or names) into known and unknown names.

    An empty request means the defaults. Unknown names are reported and left out; the rest goes on.
    """
    names = request.split(",") if isinstance(request, str) else list(request)
    names = [n.strip() for n in names if n.strip()]
    if not names:
        return list(defaults if defaults is not None else allowed), []
    unknown = [n for n in names if n not in allowed]
    for name in unknown:
        log.warning("%s is not a known variable; skipped", name)
    return [n for n in names if n in allowed], unknown


def select_variables(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The key columns and those variables that the table has."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *[n for n in names if n in have and n not in keys]]])


def select_long(df: DataFrame, names: Sequence[str], column: str = "variable") -> DataFrame:
    """The same for a table with one row per variable."""
    return df.filter(F.col(column).isin(list(names)))


def rename_axes(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(AXIS_NAMES if names is None else names)


def drop_variables(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Names that are not there are no error."""
    return df.drop(*names)


def time_slice(df: DataFrame, start: str | dt.date, end: str | dt.date, time: str = "time") -> DataFrame:
    """Both end days included, the last one up to midnight. The bounds reach the file scan."""
    return df.filter(times.within_days(df, time, start, end))


def hour_range(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """Times from ``start`` to ``end``, both included to the second (no whole last day)."""
    low, high = times.literal_for(df, time, start), times.literal_for(df, time, end)
    return df.filter(F.col(time).between(low, high) & times.within_years(df, start, end))


def at_time(df: DataFrame, moment: str | dt.datetime, time: str = "time") -> DataFrame:
    return df.filter((F.col(time) == times.literal_for(df, time, moment)) & times.within_years(df, moment, moment))


def at_nearest_time(df: DataFrame, moment: str | dt.datetime, time: str = "time") -> DataFrame:
    """All rows of the time step nearest to ``moment``; of two equally near ones the later.

    The nearest step is a one-row aggregate used as a scalar subquery, so it reaches the file scan
    of the second pass.
    """
    target = times.literal_for(df, time, moment).cast("timestamp_ntz")
    gap = F.col(time).cast("timestamp_ntz") - target
    best = df.agg(F.min_by(time, F.struct(F.abs(gap).alias("far"), (-gap).alias("late"))))
    return df.filter(F.col(time) == best.scalar())


def at_position(df: DataFrame, n: int, axis: str = "time") -> DataFrame:
    """All rows of the n-th distinct axis value (from 0; -1 is the last one).

    Distinct values are cut to the first n+1 by a top-k, so no task sees the whole axis in order.
    """
    order, count = (F.col(axis).asc(), n + 1) if n >= 0 else (F.col(axis).desc(), -n)
    head = df.select(axis).distinct().orderBy(order).limit(count)
    edge = F.max(axis) if n >= 0 else F.min(axis)
    pick = head.agg(F.when(F.count("*") == count, edge)).scalar()
    return df.filter(F.col(axis) == pick)


def last_value(df: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str | None = None) -> DataFrame:
    """The value at the last time of each group, missing or not; with partial aggregation."""
    return df.groupBy(*keys).agg(F.max(time).alias(time), F.max_by(F.col(value), F.col(time)).alias(out or value))


def only_band(df: DataFrame, band: int = 1, column: str = "band") -> DataFrame:
    """One layer of a raster, without its band column."""
    return df.filter(F.col(column) == band).drop(column)


def preview(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*order).limit(n)
