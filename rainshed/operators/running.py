"""Differences and running totals over time.

A series is one key and its times. Where a series can be long, ``chunk`` cuts it by calendar, or by
row count (``pieces``): each piece is handled on its own and one row per piece carries the last value or the total on to the
next. A hot key is then spread over many tasks. Without ``chunk`` the keys must already bound the
series (a storm, a water year). Key and time columns hold no missing values, and a key has one row
per time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "__chunk"


class Pieces(tuple):
    """Borders that cut times into pieces of about equally many rows (``pieces``)."""


def pieces(df: DataFrame, time: str = "time", rows: int = 1_000_000) -> Pieces:
    """A ``chunk`` by row count, for series of any length and spacing: also one without keys is worked on by many tasks.

    The borders are quantiles of the times of all rows, found in one pass, so no piece of any key holds much more than
    ``rows`` rows, whatever the key's share. Times are dates, timestamps or integers. At most 10,000 pieces.
    """
    count = df.count()
    n = min(10_000, -(-count // rows))
    if n < 2:
        return Pieces()
    cuts = F.percentile_approx(time, [k / n for k in range(1, n)], 100 * n)
    return Pieces(sorted(set(df.agg(cuts).first()[0])))


def _is_whole(chunk: str | Pieces | None) -> bool:
    """Without borders there is one piece, which a window takes as it is."""
    return chunk is None or chunk == ()


def _border_tree(c: Column, borders: Sequence, low: int, high: int) -> Column:
    """How many borders lie below a time, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(c <= F.lit(borders[middle]), _border_tree(c, borders, low, middle)).otherwise(_border_tree(c, borders, middle + 1, high))


def _piece(time: str, chunk: str | Pieces) -> Column:
    c = F.col(time)
    if isinstance(chunk, Pieces):
        return _border_tree(c, chunk, 0, len(chunk))
    if chunk == "year":
        return F.year(c)
    if chunk == "month":
        return F.year(c) * 12 + F.month(c)
    if chunk == "day":
        return F.unix_date(F.to_date(c))
    raise ValueError(f"chunk must be year, month, day or pieces, not {chunk}")


def _total(value: Column, window) -> Column:
    """Missing values count as 0, also before the first known one."""
    return F.coalesce(F.sum(value).over(window), F.lit(0.0))


def step_change(
    df: DataFrame, keys: Sequence[str], value: str | Column, time: str = "time",
    out: str = "change", clip_negative: bool = False, chunk: str | Pieces | None = None,
) -> DataFrame:
    """Value minus the value one step earlier. Every row stays; the first of a series is missing.

    ``clip_negative`` turns the drop at a reset of the counter into missing.
    """
    v = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    if _is_whole(chunk):
        result = df.withColumn(out, v - F.lag(v).over(Window.partitionBy(*keys).orderBy(time)))
    else:
        cut = df.withColumn(_CHUNK, _piece(time, chunk)).withColumn("__v", v)
        ends = cut.groupBy(*keys, _CHUNK).agg(F.max_by("__v", time).alias("__end"))
        carried = ends.select(
            *keys, _CHUNK, F.lag("__end").over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias("__before")
        )
        inside = Window.partitionBy(*keys, _CHUNK).orderBy(time)
        first = F.row_number().over(inside) == 1
        result = (
            cut.join(carried, [*keys, _CHUNK], "left")
            .withColumn(out, F.col("__v") - F.when(first, F.col("__before")).otherwise(F.lag("__v").over(inside)))
            .drop(_CHUNK, "__v", "__before")
        )
    return result.withColumn(out, F.when(F.col(out) >= 0, F.col(out))) if clip_negative else result


def series_change(
    df: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str = "change", chunk: str | Pieces | None = None
) -> DataFrame:
    """The same on a reduced series, which loses its first row. Give ``chunk`` where a series may be long."""
    keys = list(keys)
    if not _is_whole(chunk):
        first = df.groupBy(*keys).agg(F.min(time).alias("__first"))
        changed = step_change(df, keys, value, time, out, chunk=chunk)
        joined = changed.join(first, keys) if keys else changed.withColumn("__first", df.agg(F.min(time)).scalar())
        return joined.filter(F.col(time) != F.col("__first")).drop("__first")
    w = Window.partitionBy(*keys).orderBy(time)
    return (
        df.withColumn(out, F.col(value) - F.lag(value).over(w))
        .withColumn("__n", F.row_number().over(w))
        .filter("__n > 1")
        .drop("__n")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], value: str | Column, time: str = "time",
    out: str = "total", chunk: str | Pieces | None = None,
) -> DataFrame:
    return running_totals(df, keys, {out: value}, time, chunk)


def running_totals(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, str | Column], time: str = "time", chunk: str | Pieces | None = None
) -> DataFrame:
    """Running totals of several values (new column -> value) over one sort of the rows."""
    keys = list(keys)
    values = {out: F.col(v) if isinstance(v, str) else v for out, v in values.items()}
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if _is_whole(chunk):
        w = Window.partitionBy(*keys).orderBy(time).rowsBetween(*so_far)
        return df.withColumns({out: _total(v, w) for out, v in values.items()})
    held = {f"__v{i}": v for i, v in enumerate(values.values())}
    cut = df.withColumns({_CHUNK: _piece(time, chunk), **held})
    sums = cut.groupBy(*keys, _CHUNK).agg(*[F.sum(h).alias(h) for h in held])
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, _CHUNK, *[_total(F.col(h), earlier).alias(f"{h}_before") for h in held])
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(time).rowsBetween(*so_far)
    totals = {out: F.col(f"{h}_before") + _total(F.col(h), inside) for out, h in zip(values, held)}
    return (
        cut.join(carried, [*keys, _CHUNK], "left")
        .withColumns(totals)
        .drop(_CHUNK, *held, *[f"{h}_before" for h in held])
    )


def water_year_running(df: DataFrame, keys: Sequence[str], value: str, time: str = "time", out: str = "total") -> DataFrame:
    """A running total that starts again every October; needs a water_year column."""
    return running_total(df, [*keys, "water_year"], value, time, out)
