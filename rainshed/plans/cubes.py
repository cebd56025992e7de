"""Cube builds: raw long tables in, one clean cube per product out. ``out`` paths are optional."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import missing, times, units
from ..operators import combine, geo, select
from ..sources import catalog, inventory, store


def known_variables(request: str | Sequence[str], allowed: Sequence[str], defaults: Sequence[str] | None = None) -> list[str]:
    """The known names of a request, the defaults of an empty one; a request of unknown names alone stops."""
    names, unknown = select.choose_variables(request, allowed, defaults)
    if not names:
        raise ValueError(f"no known variable among {', '.join(unknown)}")
    return names


def hrrr_columns(parameters: str | Sequence[str]) -> list[str]:
    """The cube's columns of a request: a parameter stands for all columns it gives."""
    given = schema.HRRR_COLUMNS
    names = known_variables(parameters, [*given, *[c for columns in given.values() for c in columns]])
    return [c for n in names for c in given.get(n, [n])]


def hrrr_cube(
    raw: DataFrame, cells: DataFrame, edges: DataFrame, start: str, end: str, parameters: str | Sequence[str] = ""
) -> DataFrame:
    """Runs of a period -> box of all polygons -> forecast steps -> longitude -> mask that keeps the box.

    The filters reach the scan and the step aggregate is the only shuffle of the data. ``cells``
    holds one row per grid cell with lon (-180..180) and lat. ``parameters``: names of the inventory (TMP) or of the cube
    (t), as a comma list or names; none means all.
    """
    chosen = hrrr_columns(parameters) if parameters else None
    bounds = geo.total_bounds(edges)  # the box is that of all features, the mask that of the first
    box = dataclasses.replace(bounds, min_lon=bounds.min_lon + 360.0, max_lon=bounds.max_lon + 360.0)
    rows = geo.box_filter(select.hour_range(raw, start, end), box, "lon360", "lat")
    cube = combine.merge_forecast_steps(missing.clean_table(rows))
    cube = cube.withColumn("lon", units.lon_from_360("lon360")).drop("lon360")
    variables = [c for c in cube.columns if c not in ("time", "y", "x", "lon", "lat")]
    if chosen is not None:
        variables = [v for v in variables if v in chosen]
        cube = select.select_variables(cube, variables, ["time", "y", "x", "lon", "lat"])
    return geo.mask_keep(cube, geo.basin_cells(cells, edges), variables)


def wrf_cube(
    raw: DataFrame, cells: DataFrame, edges: DataFrame, parameters: str | Sequence[str] = "", stamp: str = "Times"
) -> DataFrame:
    """Text times -> hours; static coordinates; chosen variables; mask that keeps every cell. No shuffle."""
    rows = select.rename_axes(raw).withColumn("time", times.parse_wrf_time(stamp)).drop(stamp)
    rows = missing.clean_table(rows)
    variables = known_variables(parameters, schema.WRF_VARIABLES)
    variables = [v for v in variables if v in rows.columns]
    if not variables:
        raise ValueError("none of the variables is in the data")
    rows = select.select_variables(rows, variables, ["time", "y", "x"])
    marked = geo.mark_cells(cells, geo.basin_cells(cells, edges)).select("y", "x", "lat", "lon", "hgt", "in_basin")
    placed = geo.attach_cells(rows, marked, bound=cells)
    return placed.withColumns({v: missing.where(F.col("in_basin"), v) for v in variables}).drop("in_basin")


def prism_cube(
    raster: DataFrame, grid: DataFrame, edges: DataFrame, variables: str | Sequence[str] = "",
    frequency: str = "daily", nodata: float | None = -9999.0,
) -> DataFrame:
    """Single-variable raster rows (file_name, band, y, x, lat, lon, value) -> one column per variable."""
    variables = known_variables(variables, schema.PRISM_VARIABLES)
    rows = select.only_band(raster).withColumn("value", missing.known("value", nodata))
    rows = inventory.prism_name_parts(rows, frequency=frequency).withColumnRenamed("date", "time").drop("file_name")
    return combine.merge_variables(geo.clip(rows, edges, ["y", "x"], grid=grid), ["time", "y", "x", "lat", "lon"], variables)


def ornl_cube(
    raster: DataFrame, grid: DataFrame, edges: DataFrame, variables: str | Sequence[str] = "", nodata: float | None = -9999.0
) -> DataFrame:
    """Rows (variable, time, y, x, lat, lon, value); times become days.

    An empty request means the archive's seven main variables. Files that gave no rows are listed by
    ``inventory.files_without_rows``.
    """
    variables = known_variables(variables, schema.ORNL_VARIABLES, schema.ORNL_DEFAULTS)
    rows = raster.withColumn("value", missing.known("value", nodata)).withColumn("time", F.to_date("time"))
    cube = combine.merge_variables(geo.clip(rows, edges, ["y", "x"], grid=grid), ["time", "y", "x", "lat", "lon"], variables)
    return catalog.derive(cube, "ornl")


def pnnl_cube(
    tables: Mapping[str, DataFrame], keys: Sequence[str] = ("scenario", "time", "y", "x"), bound: DataFrame | None = None
) -> DataFrame:
    """Tables of one variable each, with any number of files and scenarios, side by side; ``bound`` as in ``merge_variables``."""
    long = [
        df.select(*keys, F.lit(name).alias("variable"), F.col(name).cast("double").alias("value")) for name, df in tables.items()
    ]
    return combine.merge_variables(missing.clean_table(combine.concat_rows(long)), keys, list(tables), bound=bound)


def pnnl_in_basin(cube: DataFrame, cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Only cells of the basin, with their coordinates and land mask."""
    return geo.attach_cells(geo.mask_drop(cube, geo.basin_cells(cells, edges)), cells.select("y", "x", "lat", "lon", "landmask"))


def snotel_cube(
    readings: DataFrame, stations: DataFrame, variables: str | Sequence[str] = "", frequency: str = "hourly",
    dates: tuple[str, str] | None = None,
) -> DataFrame:
    """Station readings -> last per slot -> every site at every time -> coordinates by key."""
    names = known_variables(variables, schema.SNOTEL_VARIABLES)
    rows = select.select_long(readings, names)
    if dates:
        rows = select.time_slice(rows, *dates)
    rows = missing.clean_table(rows).filter(F.col("value").isNotNull())
    chosen = combine.known_sites(rows.withColumn("site", F.col("site").cast("string")), stations)
    # both axes come from the same pairs, whose exchange Spark reuses
    pairs = chosen.select("site", combine.slot("time", frequency).alias("time")).distinct()
    dense = combine.densify(combine.station_slots(chosen, names, frequency), frequency, axis=pairs, sites=pairs)
    return combine.attach_sites(dense, combine.site_coordinates(stations, ["site_name"]))


def write(cube: DataFrame, product: str, path: str, mode: str = "replace") -> str:
    """Write one product's cube. ``replace`` puts it in the place of that product alone; else a mode of ``write_cube``."""
    cube = cube.withColumn("product", F.lit(product))
    if mode != "replace":
        return catalog.write_cube(cube, path, mode)
    store.replace(cube, path)
    return path


def build(
    expected: DataFrame, listing: DataFrame, cube: DataFrame | Callable[[DataFrame], DataFrame], product: str, path: str,
    mode: str = "replace", key: str = "path", raw: DataFrame | None = None, name: str = "file_path",
    local: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """A whole build: account for the files of a manifest, stop when none came, write the cube.

    ``listing`` holds the files that arrived. With ``raw``, rows that carry their file's path (column ``name``, compared
    as ``inventory.arrived_rows`` says), ``cube`` is a function of the rows of those files that were asked for and
    arrived; no other row gets in. A cube given as a table is taken as it is. It is not computed before the check. Returns the arrival
    report.
    """
    inventory.require_arrivals(expected.select(key).join(listing.select(key), [key], "left_semi"))
    if raw is not None:
        cube = cube(inventory.arrived_rows(raw, expected, listing, key, name, local))
    write(cube, product, path, mode)
    return inventory.arrival_report(expected, listing, key=key)
