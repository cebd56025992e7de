"""Basin means and sums kept up to date while files arrive late or corrected.

Each file's rows are reduced to one state per key and day: the sum and the number of known values in the basin. States are
merged into a store by the name of their file (``store.merge``), so a file counts once however often it comes, a corrected one
replaces its states, and only partitions whose states differ are written. Reading adds up the states: a few rows per
day instead of the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing
from ..operators import geo
from ..sources import catalog, store

TOTAL, COUNT = "state_total", "state_count"


def states(
    df: DataFrame, basin: DataFrame, value: str, keys: Sequence[str] = ("product",), time: str = "time", file: str = "file_name",
    cell: Sequence[str] = ("y", "x"),
) -> DataFrame:
    """One row per file, key and day with rows in the basin; days whose values are all missing have a count of 0."""
    day = F.to_date(F.col(time)).alias("day")
    rows = geo.mask_drop(df.withColumn(value, missing.known(value)), basin, cell)
    return rows.groupBy(*keys, day, file).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(TOTAL), F.count(value).alias(COUNT))


def update(
    df: DataFrame, basin: DataFrame, path: str, value: str, keys: Sequence[str] = ("product",), time: str = "time", file: str = "file_name",
    cell: Sequence[str] = ("y", "x"),
) -> list[str]:
    """Bring the rows of whole files into the states at ``path``; returns the partitions written.

    A file that comes again must come whole. One that no longer has a row in the basin keeps its old states: give it with a
    row of a missing value.
    """
    return store.merge(states(df, basin, value, keys, time, file, cell), path, file, time="day")


def totals(rolled: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """(keys, day, total, mean): the sum of a day counts missing values as 0, its mean leaves them out."""
    both = rolled.groupBy(*keys, "day").agg(F.sum(TOTAL).alias("total"), F.sum(COUNT).alias("__n"))
    return both.select(*keys, "day", "total", (F.col("total") / F.nullif("__n", F.lit(0))).alias("mean"))


def read(spark, path: str, keys: Sequence[str] = ("product",)) -> DataFrame:
    return totals(catalog.read_cube(spark, path), keys)
