"""Calendar functions on naive times (TIMESTAMP_NTZ or DATE)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import _col


def floor_hour(time: Column | str) -> Column:
    """Built from parts: date_trunc would pass through the session time zone and its clock changes."""
    c = _col(time)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def floor_day(time: Column | str) -> Column:
    return F.to_date(_col(time)).cast("timestamp_ntz")


def parse_wrf_time(text: Column | str) -> Column:
    """``YYYY-MM-DD_HH:MM:SS`` floored to the hour; NULL when the text is not a time."""
    return floor_hour(F.replace(_col(text), F.lit("_"), F.lit(" ")).try_cast("timestamp_ntz"))


def wrf_time_text(time: Column | str) -> Column:
    """A naive time to the second as ``YYYY-MM-DD_HH:MM:SS``, without passing through the session zone."""
    return F.replace(F.substring(_col(time).cast("timestamp_ntz").cast("string"), 1, 19), F.lit(" "), F.lit("_"))


def water_year(time: Column | str) -> Column:
    """October to September, named after the year it ends in."""
    c = _col(time)
    return F.year(c) + (F.month(c) >= F.lit(10)).cast("int")


def literal_for(df: DataFrame, column: str, value: str | dt.date | dt.datetime) -> Column:
    """A literal of the column's own type, so that the comparison reaches the file scan."""
    kind = df.schema[column].dataType
    return F.lit(str(value)).cast("date" if isinstance(kind, T.DateType) else kind)


def _as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else dt.date.fromisoformat(str(value)[:10])


def within_years(df: DataFrame, start: str | dt.date, end: str | dt.date, year: str = "year") -> Column:
    """The same years for a store partitioned by the calendar year of its time; true where there is no such column."""
    if year not in df.columns:
        return F.lit(True)
    return F.col(year).between(_as_date(start).year, _as_date(end).year)


def within_days(df: DataFrame, column: str, start: str | dt.date, end: str | dt.date) -> Column:
    """From the start of the first day to the end of the last one; prunes the partitions of a store by year."""
    after = _as_date(end) + dt.timedelta(days=1)
    c = F.col(f"`{column}`")
    return (c >= literal_for(df, column, _as_date(start))) & (c < literal_for(df, column, after)) & within_years(df, start, end)
