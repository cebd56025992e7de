"""Missing values. Spark aggregates let NaN through, so ingest turns NaN and nodata into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import _col


def known(value: Column | str, nodata: float | None = None) -> Column:
    """The value, or NULL where it is NaN or the nodata marker."""
    c = _col(value)
    gone = F.isnan(c) if nodata is None else F.isnan(c) | (c == F.lit(float(nodata)))
    return F.when(~gone, c)


def clean_table(df: DataFrame, nodata: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Apply ``known`` to the given columns, or to every float column.

    Filter first: a condition on a cleaned column no longer reaches the file scan.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: known(c, nodata) for c in columns})


def positive(value: Column | str) -> Column:
    c = _col(value)
    return F.when(c > 0, c)


def where(flag: Column, value: Column | str) -> Column:
    """Keep the value where the flag holds; missing elsewhere (the row stays)."""
    return F.when(flag, _col(value))
