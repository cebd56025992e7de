"""Spatial and temporal reductions. All are partial aggregates: hot keys are combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times


def basin_mean(df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "mean") -> DataFrame:
    """Unweighted mean over cells; missing cells are left out, and all missing gives missing."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def basin_sum(df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "sum") -> DataFrame:
    """Sum over cells; all missing gives 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(out))


_DAILY = {"max": F.max, "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}


def to_days(
    df: DataFrame, keys: Sequence[str], value: str | Column, how: str, time: str = "time",
    out: str = "value", day: str = "day", spine: Sequence[str] | None = None,
) -> DataFrame:
    """Resample to days by ``max``, ``mean`` or ``sum``.

    Days without data are absent by default. ``spine`` names the keys of one time axis (``[]`` for a
    single one): every group then gets each day between the first and last of its axis, missing
    (0 for sums) where there is no data.
    """
    daily = df.groupBy(*keys, F.to_date(F.col(time)).alias(day)).agg(_DAILY[how](value).alias(out))
    if spine is None:
        return daily
    full = day_spine(daily, keys, day, spine).join(daily, [*keys, day], "left")
    return full.withColumn(out, F.coalesce(F.col(out), F.lit(0.0))) if how == "sum" else full


def day_spine(df: DataFrame, keys: Sequence[str], day: str = "day", axis: Sequence[str] = ()) -> DataFrame:
    """Each group with each day of its axis: exploded from the axis ends, not cross joined."""
    ends = (F.min(day).alias("__a"), F.max(day).alias("__b"))
    if list(axis) == list(keys):
        groups = df.groupBy(*keys).agg(*ends)
    elif axis:
        groups = df.select(*keys).distinct().join(df.groupBy(*axis).agg(*ends), list(axis))
    else:
        bounds = df.agg(F.struct(*ends)).scalar()
        groups = df.select(*keys).distinct() if keys else df.select(F.lit(1).alias("__g")).limit(1)
        groups = groups.withColumn("__s", bounds).select(*keys, F.col("__s.__a").alias("__a"), F.col("__s.__b").alias("__b"))
    return groups.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(day))


def add_water_year(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("water_year", times.water_year(time))


def add_calendar(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "doy": F.dayofyear(time)})


def water_year_total(series: DataFrame, keys: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return basin_sum(series, [*keys, "water_year"], value, out)


def water_year_peak(running: DataFrame, keys: Sequence[str], value: str, out: str = "peak") -> DataFrame:
    return running.groupBy(*keys, "water_year").agg(F.max(value).alias(out))


def value_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Lowest and highest value: colour limits of a map."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Five numbers of a box plot: exact, interpolated quartiles.

    A task keeps the distinct values of its groups, once for all five: for groups such as the products
    of an event, not for whole records.
    """
    marks = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    found = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, marks.values()))).alias("__p"))
    return found.select(*keys, *[F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(marks)])
