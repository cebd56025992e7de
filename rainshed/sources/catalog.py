"""The cube store: Parquet partitioned by product and year, written and opened by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import curve, missing, units
from ..operators import sizing
from ..operators.select import time_slice

MODES = ("overwrite", "append", "errorifexists")
CELL = "cell"  # the curve code of a store written by cell
PAGE_ROWS = 2000  # rows of a page there: what is read at least
MOST_CELLS = 1000  # cells looked up by ranges
PARTITIONS = ("product", "frequency", "resolution", "year")


def cube_name(product: str, start: str, end: str, *parts: str) -> str:
    """Name of one request's cube: dates, then whatever else tells it apart, then the product."""
    return "_".join([start, end, *[p for p in parts if p], product, "data"])


def ornl_cube_name(
    start_year: str, end_year: str, reference: str = "DaymetV4",
    gcm: str | None = None, climate_scenario: str | None = None, downscaling: str | None = None,
) -> str:
    """Runs driven by a climate model are named after it, the others after their reference."""
    driven = gcm and climate_scenario and downscaling
    parts = (gcm, climate_scenario, downscaling) if driven else ("ref", reference)
    return cube_name("ORNL", start_year, end_year, *parts)


def write_cube(
    df: DataFrame, path: str, mode: str = "errorifexists", partitions: Sequence[str] = PARTITIONS, time: str = "time", by_cell: bool = False
) -> str:
    """Write a long cube, partitioned and sorted by time inside the files; NaN becomes NULL on the way.

    ``by_cell`` sorts by the curve code of (y, x) instead (column ``cell``): files then hold neighbouring cells with all their
    times, and small pages let ``cells_of`` and ``box_of`` skip the rest. It suits series of places, the default maps.


    ``overwrite`` empties the whole store; ``store.replace`` leaves its other products alone.

    The rebalance hint lets AQE cut large partitions and join small ones into files of its target
    size, so a product that holds most rows does not end up in one task.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    df, parts = prepared(df, partitions, time)
    if by_cell:
        df = df.withColumn(CELL, curve.code("y", "x"))
        # ranges are cut by rows, also inside a cell, so neither a large product nor a long series ends up in one task
        placed = df.repartitionByRange(*parts, CELL, time).sortWithinPartitions(*parts, CELL, time)
        placed.write.mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy(*parts).parquet(path)
        return path
    order = [*parts, time, *[c for c in ("y", "x", "site") if c in df.columns]]
    df.hint("rebalance", *parts).sortWithinPartitions(*order).write.mode(mode).partitionBy(*parts).parquet(path)
    return path


def prepared(df: DataFrame, partitions: Sequence[str] = PARTITIONS, time: str = "time") -> tuple[DataFrame, list[str]]:
    """A cube as it is stored, and its partition columns: those of ``partitions`` that it has (``year`` is made from the time)."""
    if "year" in partitions and "year" not in df.columns:
        df = df.withColumn("year", F.year(time))
    return missing.clean_table(df), [p for p in partitions if p in df.columns]


def cells_of(store: DataFrame, cells: DataFrame, key: Sequence[str] = ("y", "x")) -> DataFrame:
    """Rows of a store written ``by_cell`` that lie in the given cells (a table with ``key``; repeats do not matter).

    A few cells become literal ranges of the curve, so that only their pages are read; many are joined.
    """
    wanted = cells.select(*key).distinct()
    few = wanted.limit(MOST_CELLS + 1).collect()  # a bounded number of rows
    if len(few) > MOST_CELLS:
        return store.join(sizing.broadcast_if_small(wanted), list(key), "left_semi")
    known = [(r[0], r[1]) for r in few if r[0] is not None and r[1] is not None]
    near = store.filter(curve.in_ranges(curve.cell_ranges(known), CELL))
    return near.join(F.broadcast(wanted), list(key), "left_semi")


def box_of(store: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Rows of a store written ``by_cell`` in a box of indices, ends included."""
    near = store.filter(curve.in_ranges(curve.box_ranges(y0, y1, x0, x1), CELL))
    return near.filter(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))


def read_cube(spark: SparkSession, *paths: str, schema: StructType | str | None = None) -> DataFrame:
    """One or many cube files or folders as one table: time is a column, so this is the concatenation.

    Values come as they are stored, so that box and time filters reach the files. Files may differ in
    their variables, so the columns are never taken from one of them: they are those of ``schema``, or
    without it those of all footers. Give the schema for large stores, it spares that pass. For files
    of other writers apply ``missing.clean_table`` after the filters.
    """
    reader = spark.read.option("mergeSchema", schema is None)
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths)


def derive(df: DataFrame, product: str) -> DataFrame:
    """The columns each product gets when it is opened; only where their inputs are there."""
    have, product = set(df.columns), product.lower()
    new = {}
    if product in ("wrf", "wrf_era5", "pnnl") and "T2" in have:
        new["T2C"] = units.kelvin_to_celsius("T2")
    if product in ("wrf", "wrf_era5") and {"RAINC", "RAINNC"} <= have:
        new["PRCP"] = units.total_rain("RAINC", "RAINNC")
    if product == "ornl" and {"tmax", "tmin"} <= have:
        new["tmean"] = units.mid_temperature("tmax", "tmin")
    if product == "snotel":
        for source, name in (("AIR TEMP", "T2C"), ("AVG AIR TEMP", "AVG_T2C")):
            if source in have:
                new[name] = units.fahrenheit_to_celsius(source)
        if "elevation_ft" in have:
            new["elevation_m"] = units.feet_to_metres("elevation_ft")
    return df.withColumns(new) if new else df


def open_dataset(
    df: DataFrame, dates: tuple[str, str], product: str, frequency: str = "", resolution: str = "", time: str = "time"
) -> DataFrame:
    """One product between two days, with its derived columns.

    The year filter prunes partitions, the time filter reaches the files. Product names compare
    without case. A frequency or resolution that the store does not tell apart is an error.
    """
    chosen = df.filter(F.lower("product") == product.lower())
    for name, wanted in (("frequency", frequency), ("resolution", resolution)):
        if wanted and name not in df.columns:
            raise ValueError(f"the store has no column {name}, so {wanted} cannot be chosen")
        if wanted:
            chosen = chosen.filter(F.col(name) == wanted)
    return derive(time_slice(chosen, *dates, time=time), product)


def station_request(
    readings: DataFrame, variables: Sequence[str], dates: tuple[str, str],
    ids: str | Sequence[str] | None = None, stations: DataFrame | None = None, frequency: str = "",
) -> DataFrame:
    """Readings of listed stations (comma list or names) or of a table of stations, for some days.

    Stations without readings are simply absent; ``site_name`` comes along from the table.
    ``frequency`` picks the hourly or daily partition of a store that holds both.
    """
    if (ids is None) == (stations is None):
        raise ValueError("give either station ids or a table of stations")
    if frequency:
        readings = readings.filter(F.col("frequency") == frequency)
    chosen = time_slice(readings.filter(F.col("variable").isin(list(variables))), *dates)
    if ids is not None:
        names = [i.strip() for i in (ids.split(",") if isinstance(ids, str) else ids) if i.strip()]
        if not names:
            raise ValueError("no station ids")
        return chosen.filter(F.col("site").isin(names))
    return chosen.join(stations.select("site", "site_name"), ["site"])
