"""Products compared over the same storms: basin precipitation, accumulated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..operators import combine, geo, reduce, running, select

Windows = DataFrame | Sequence[tuple[str, str, str]]


def daily_storm_totals(
    grid: DataFrame, windows: Windows, basin: DataFrame, value: str, how: str = "mean",
    keys: Sequence[str] | None = None, time: str = "day", out: str = "cum", key: Sequence[str] | None = None, chunk: str | None = None,
) -> DataFrame:
    """Daily products: window -> cells of the basin -> mean or sum per day -> running total.

    ``key`` tells cells apart, ``keys`` series (event, product and scenario, as far as they are there).
    A series is as long as its storm window; for windows of many years give ``chunk``.
    """
    keys = [c for c in ("event", "product", "scenario") if c == "event" or c in grid.columns] if keys is None else list(keys)
    rows = geo.mask_drop(combine.event_slices(grid, windows, time), basin, mask_key(grid, basin, key))
    step = (reduce.basin_mean if how == "mean" else reduce.basin_sum)(rows, [*keys, time], value, "__v")
    return running.running_total(step, keys, "__v", time, out, **({"chunk": chunk} if chunk else {})).drop("__v")


def mask_key(grid: DataFrame, basin: DataFrame, key: Sequence[str] | None = None) -> list[str]:
    """What tells cells apart. Products have grids of their own, so a mask without them needs the key in words."""
    if key is not None:
        return list(key)
    if "product" in grid.columns and "product" not in basin.columns:
        raise ValueError("the mask does not tell products apart: give key=('y', 'x') if they share one grid")
    return ["product", "y", "x"] if "product" in grid.columns else ["y", "x"]


def hourly_storm_totals(
    grid: DataFrame, windows: Windows, basin: DataFrame, value: str | Column, accumulated: bool,
    how: str = "mean", keys: Sequence[str] | None = None, key: Sequence[str] | None = None, time: str = "time",
    out: str = "cum", daily: bool = True, clip_negative: bool = False,
) -> DataFrame:
    """Hourly products: as above, taking accumulated rain apart per cell and series first, then the daily highest.

    The change per cell is taken inside its storm window, which bounds the series.
    """
    keys = [c for c in ("event", "product", "scenario") if c == "event" or c in grid.columns] if keys is None else list(keys)
    key = mask_key(grid, basin, key)
    rows = geo.mask_drop(combine.event_slices(grid, windows, time), basin, key)
    if accumulated:
        rows = running.step_change(rows, [*keys, *key], value, time, "__p", clip_negative)
    else:
        rows = rows.withColumn("__p", F.col(value) if isinstance(value, str) else value)
    step = (reduce.basin_mean if how == "mean" else reduce.basin_sum)(rows, [*keys, time], "__p", "__v")
    total = running.running_total(step, keys, "__v", time, out).drop("__v")
    return reduce.to_days(total, keys, out, "max", time, out) if daily else total


def in_metres(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, units.divided(column, 1000))


def series_table(parts: Sequence[tuple[DataFrame, str]], time: str, value: str, title: str = " Basin Cumulative Precipitation") -> DataFrame:
    """Labelled series of all events in one table (event, title, label, time, value), ready to plot."""
    tables = [
        df.select(
            "event", F.concat(F.col("event"), F.lit(title)).alias("title"), F.lit(name).alias("label"),
            F.col(time).alias("time"), F.col(value).alias("value"),
        )
        for df, name in parts
    ]
    return combine.concat_rows(tables)


def event_spread(totals: DataFrame, value: str, time: str) -> DataFrame:
    """Five-number spread over products of the last running total, per event."""
    final = select.last_value(totals, ["event", "product"], value, time)
    return reduce.spread(final, ["event"], value)
