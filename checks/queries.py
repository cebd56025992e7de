"""The registered queries: (spark, sf_dir) -> DataFrame, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.functions import humidity, missing, times, units
from rainshed.operators import combine, cover, elevation, geo, intervals, reduce, running, select, selection, sizing
from rainshed.plans import cubes, maps, rollups, storms, wateryears
from rainshed.session import scratch_path, stored
from rainshed.sources import catalog, geojson, inventory, manifests, store, textgrid

from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CELL = ["product", "scenario", "day", "y", "x"]
PRODUCTS = ["PRISM", "ORNL", "WRF"]
PEAKS = [("Glacier Peak", 48.1048, -121.1124), ("Mount Baker", 48.7758, -121.8199)]
# what the driver's event types stand for in an inventory
INDEX_LEVELS = {"click": "TMP:surface", "view": "RH:2 m above ground", "error": "APCP:surface:0-1 hour acc fcst", "signup": "TMP:2 m above ground"}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


# -- columns ---------------------------------------------------------------------------------------


@query
def unit_convert(spark, sf):
    rows = select.select_long(v.obs(spark, sf), ["AIR TEMP"]).withColumnRenamed("value", "AIR TEMP")
    placed = combine.attach_sites(rows, v.stations(spark, sf).select("site", "elevation_ft"))
    return rounded(catalog.derive(placed, "SNOTEL"), "T2C", "elevation_m").select("site", "time", F.col("T2C").alias("t2c"), "elevation_m")


@query
def tmean(spark, sf):
    return v.grid(spark, sf).select(*CELL, r6(units.mid_temperature("tmax", "tmin")).alias("tmean"))


@query
def wind_speed(spark, sf):
    return v.grid(spark, sf).select(*CELL, r6(units.wind_speed("u10", "v10")).alias("wind"))


@query
def rel_humidity(spark, sf):
    return v.grid(spark, sf).select(*CELL, r6(humidity.from_specific_humidity("q2", "t2", "psfc")).alias("rh"))


@query
def rel_humidity_vpd(spark, sf):
    mean = units.mid_temperature("tmax", "tmin")
    return v.grid(spark, sf).select(*CELL, r6(humidity.from_pressure_deficit("v10", mean)).alias("rh"))


@query
def normalize_lon(spark, sf):
    return v.hrrr_raw(spark, sf).select("time", "step_h", "y", "x", units.lon_from_360("lon360").alias("lon"))


@query
def floor_time(spark, sf):
    # the WRF text form of each reading's time, parsed and floored, beside the floor to the day
    rows = v.obs(spark, sf).withColumn("text", times.wrf_time_text("time"))
    return rows.select("site", "time", times.parse_wrf_time("text").alias("hour"), times.floor_day("time").alias("day"))


@query
def water_year(spark, sf):
    return reduce.add_water_year(v.grid(spark, sf).select(*CELL), "day")


@query
def nodata_to_null(spark, sf):
    q = F.col("l_quantity")
    marked = v.table(spark, sf, "lineitem").select(
        "l_suppkey", F.when(q == 50, -9999.0).when(q == 49, F.lit(float("nan"))).otherwise(q).alias("value")
    )
    clean = missing.clean_table(marked, nodata=-9999.0)
    return clean.groupBy("l_suppkey").agg(
        F.count("value").alias("known"), F.sum("value").alias("total"), F.max("value").alias("high"), r6(F.avg("value")).alias("mean")
    )


@query
def select_variables(spark, sf):
    names, _ = select.choose_variables("ppt, t2,BOGUS", ["ppt", "t2", "tmax", "tmin"])
    return select.select_variables(v.grid(spark, sf), [*names, "absent"], CELL)


@query
def time_slice(spark, sf):
    return select.time_slice(v.obs(spark, sf), "2024-01-10", "2024-01-20")


@query
def nearest_time(spark, sf):
    near = select.at_nearest_time(v.wrf(spark, sf), "2024-01-12 12:30:00")
    return rounded(near, "rainc", "rainnc").select("time", "y", "x", "rainc", "rainnc")


@query
def exact_time(spark, sf):
    rows = select.at_time(v.wrf(spark, sf), "2024-01-12 00:00:00")
    return rounded(rows, "rainc", "rainnc").select("time", "y", "x", "rainc", "rainnc")


@query
def nth_time(spark, sf):
    rows = select.at_position(v.wrf(spark, sf), 10)
    return rounded(rows, "rainc", "rainnc").select("time", "y", "x", "rainc", "rainnc")


@query
def last_value(spark, sf):
    return select.last_value(v.grid(spark, sf), ["product", "scenario", "y", "x"], "ppt", "day")


@query
def preview(spark, sf):
    return select.preview(v.stations(spark, sf), 10, ["site"])


# -- reductions and running totals -------------------------------------------------------------------


def basin_rows(spark, sf):
    return geo.mask_drop(v.grid(spark, sf), v.basin(spark, sf))


@query
def basin_mean(spark, sf):
    return rounded(reduce.basin_mean(basin_rows(spark, sf), ["product", "day"], "ppt", "mean"), "mean")


@query
def basin_sum(spark, sf):
    return reduce.basin_sum(basin_rows(spark, sf), ["product", "day"], "ppt", "total")


@query
def basin_cumulative(spark, sf):
    series = reduce.basin_mean(basin_rows(spark, sf), ["product", "day"], "ppt", "mean")
    return rounded(running.running_total(series, ["product"], "mean", "day", "cum", chunk="year"), "cum").select("product", "day", "cum")


@query
def daily_max(spark, sf):
    rows = v.wrf(spark, sf)
    return rounded(reduce.to_days(rows, ["y", "x"], "rainnc", "max", out="high"), "high")


@query
def daily_mean_temp(spark, sf):
    now = v.hrrr_raw(spark, sf).filter("step_h = 0")
    return rounded(reduce.to_days(now, ["y", "x"], units.kelvin_to_celsius("t"), "mean", out="t_c"), "t_c")


@query
def daily_precip_positive(spark, sf):
    daily = reduce.to_days(v.hrrr_raw(spark, sf), ["y", "x"], "tp", "sum", out="tp", spine=[])
    return daily.withColumn("tp", r6(missing.positive("tp"))).select("y", "x", "day", "tp")


@query
def wrf_hourly_precip(spark, sf):
    rain = units.total_rain("rainc", "rainnc")
    rows = running.step_change(v.wrf(spark, sf), ["y", "x"], rain, out="prcp", chunk="month")
    return rounded(rows, "prcp").select("time", "y", "x", "prcp")


@query
def diff_series(spark, sf):
    rows = combine.event_slices(v.wrf(spark, sf), v.WINDOWS)
    series = reduce.basin_sum(rows, ["event", "time"], "rainc", "total")
    change = running.series_change(series, ["event"], "total", out="change")
    total = running.running_total(change, ["event"], "change", out="cum")
    return total.select("event", "time", r6("change").alias("change"), r6(units.divided("cum", 1000)).alias("cum_m"))


@query
def global_max(spark, sf):
    return v.grid(spark, sf).agg(F.max("ppt").alias("high"), F.max(units.divided("ppt", 10)).alias("high_tenth"))


# -- geometry ----------------------------------------------------------------------------------------


@query
def polygon_bounds(spark, sf):
    # every order is an outline whose line items are the vertices
    vertices = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("feature"),
        (F.lit(-122.5) + (F.col("l_partkey") % 160) / F.lit(64.0)).alias("lon"),
        (F.lit(47.5) + (F.col("l_suppkey") % 128) / F.lit(64.0)).alias("lat"),
    )
    return geo.polygon_bounds(vertices, ["feature"])


@query
def bbox_filter(spark, sf):
    return geo.box_filter(v.dem(spark, sf), geo.Bounds(-121.5, -120.5, 47.75, 48.5), "x", "y")


@query
def basin_mask_keep(spark, sf):
    rows = geo.mask_keep(v.grid(spark, sf), v.basin(spark, sf), ["ppt", "t2"])
    return rows.select(*CELL, "ppt", r6("t2").alias("t2"))


@query
def basin_mask_drop(spark, sf):
    return basin_rows(spark, sf).select(*CELL, "ppt")


@query
def station_areas(spark, sf):
    """Cells in the six-sided area of each station; areas overlap."""
    inside = cover.features_at(v.cells(spark, sf), v.station_areas(spark, sf), ["y", "x"])
    return inside.withColumnRenamed("feature", "site")


@query
def dem_clip(spark, sf):
    return geo.clip(v.dem(spark, sf), v.edges(spark), ["iy", "ix"], "x", "y")


@query
def mesh_grid(spark, sf):
    dem = v.dem(spark, sf)
    x_axis = dem.select("ix", F.col("x").alias("lon")).distinct()
    y_axis = dem.select("iy", F.col("y").alias("lat")).distinct()
    return geo.mesh(x_axis, y_axis).select("iy", "ix", "lat", "lon")


@query
def stations_in_basin(spark, sf):
    return geo.stations_inside(v.stations(spark, sf), v.edges(spark), v.obs(spark, sf), ["SNOWDEPTH"])


@query
def stations_buffer(spark, sf):
    return geo.stations_in_extent(v.stations(spark, sf), v.edges(spark), 0.25)


@query
def attach_coords(spark, sf):
    rows = geo.attach_cells(v.grid(spark, sf).select(*CELL, "ppt"), v.cells(spark, sf))
    return rows.select(*CELL, "ppt", "lat", "lon", "hgt", "landmask")


@query
def landmask(spark, sf):
    rows = geo.attach_cells(v.grid(spark, sf), v.cells(spark, sf).select("y", "x", "landmask"))
    return rounded(geo.land_only(rows, ["t2"]), "t2").select(*CELL, "t2")


@query
def abs_offset(spark, sf):
    return rounded(geo.offset_from(v.cells(spark, sf), 48.7758, -121.8199), "abslat", "abslon").select("y", "x", "abslat", "abslon")


@query
def nearest_cell_series(spark, sf):
    cube = combine.merge_forecast_steps(v.hrrr_raw(spark, sf))
    rows = maps.point_series(cube, v.hrrr_cells(spark, sf), PEAKS)
    return rounded(rows, "t_c", "tp").select("point", "time", "y", "x", "tp", "t_c").orderBy("point", "time")


@query
def point_series_store(spark, sf):
    """The series of two places out of a store in curve order."""
    path = scratch_path(spark, "by_cell")
    catalog.write_cube(v.grid(spark, sf).select(*CELL, "ppt", "t2"), path, time="day", by_cell=True)
    rows = maps.stored_point_series(catalog.read_cube(spark, path), v.cells(spark, sf), PEAKS, kelvin="t2")
    return rounded(rows, "t_c").select("point", *CELL, "ppt", "t_c")


@query
def series_scan(spark, sf):
    """Running total and change over all orders as one series without keys, in pieces of 2,048 rows."""
    orders = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.sum("l_quantity").alias("quantity"))
    cut = running.pieces(orders, "pos", 2048)
    total = running.running_total(orders, [], "quantity", "pos", "total", cut)
    return running.step_change(total, [], "quantity", "pos", chunk=cut)


@query
def nearest_cells_table(spark, sf):
    """A place for each customer, many of them far from any cell."""
    key = F.col("c_custkey")
    places = v.table(spark, sf, "customer").select(
        key.alias("point"), (F.lit(47.0) + (key * 7919 % 4000) / F.lit(1000.0)).alias("plat"), (F.lit(-124.5) + (key * 104729 % 7000) / F.lit(1000.0)).alias("plon")
    )
    return rounded(geo.nearest_cells_of(v.cells(spark, sf), places).select("point", "y", "x", "km"), "km")


@query
def embed_dem_regular(spark, sf):
    return elevation.embed_on_axes(v.cells(spark, sf), v.dem(spark, sf)).select("y", "x", "lat", "lon", "elevation")


@query
def embed_dem_irregular(spark, sf):
    return elevation.embed_on_curves(v.stations(spark, sf), v.dem(spark, sf)).select("site", "lat", "lon", "elevation")


@query
def dem_band_mean(spark, sf):
    return rounded(elevation.band_mean(v.dem_bands(spark, sf)), "elevation")


@query
def embed_dem_band_mean(spark, sf):
    rows = elevation.embed_band_mean(v.cells(spark, sf), v.dem_bands(spark, sf))
    return rounded(rows, "elevation").select("y", "x", "elevation")


# -- water years -------------------------------------------------------------------------------------


@query
def water_year_total(spark, sf):
    return rounded(wateryears.totals(v.grid(spark, sf), ["product"], "ppt", "day"), "total_m")


@query
def water_year_cumulative(spark, sf):
    return rounded(wateryears.accumulated(v.grid(spark, sf), ["product"], "ppt", "day"), "cum_m").select("product", "water_year", "day", "cum_m")


@query
def water_year_peak(spark, sf):
    return rounded(wateryears.peaks(v.grid(spark, sf), ["product"], "ppt", "day"), "peak_m")


@query
def year_doy_cumulative(spark, sf):
    return rounded(wateryears.by_day_of_year(v.grid(spark, sf), ["product"], "ppt", "day"), "cum_m").select("product", "year", "doy", "cum_m")


# -- combination -------------------------------------------------------------------------------------


@query
def concat_time(spark, sf):
    grid = v.grid(spark, sf)
    early = grid.filter(F.col("day") < F.lit("1998-10-01").cast("date")).select(*CELL, "ppt", "tmax")
    late = grid.filter(F.col("day") >= F.lit("1998-10-01").cast("date")).select(*CELL, "ppt")
    return rounded(combine.concat_rows([early, late]), "tmax")


@query
def merge_variables(spark, sf):
    names = ["ppt", "tmax", "tmin"]
    long = combine.stack_variables(v.grid(spark, sf), CELL, names).filter(F.col("value") > 0)
    return rounded(combine.merge_variables(long, CELL, names), "tmax", "tmin")


@query
def hrrr_merge(spark, sf):
    return rounded(combine.merge_forecast_steps(v.hrrr_raw(spark, sf)), "t", "r2", "tp", "max_10si")


STATION_NAMES = ["AIR TEMP", "PRECIPITATION", "SNOWDEPTH"]
SHORT = {"AIR TEMP": "air_temp", "PRECIPITATION": "precipitation", "SNOWDEPTH": "snowdepth"}


@query
def station_cube(spark, sf):
    slots = combine.station_slots(v.obs(spark, sf), STATION_NAMES)
    return combine.densify(slots).withColumnsRenamed(SHORT).select("site", "time", *SHORT.values())


@query
def station_coords(spark, sf):
    # each reading carries its own coordinates; the first reading of a site counts
    rows = v.obs(spark, sf).join(v.stations(spark, sf).select("site", "site_name", "lon", "lat"), "site")
    rows = rows.withColumn("lat", F.col("lat") + F.col("value") / 1024).withColumn("elevation_ft", F.col("value"))
    return rounded(combine.site_coordinates(rows), "lat")


@query
def site_semi(spark, sf):
    return combine.known_sites(v.stations(spark, sf), v.obs(spark, sf).filter("variable = 'SWE' AND value > 200"))


@query
def event_slices(spark, sf):
    return combine.event_slices(v.grid(spark, sf).select(*CELL, "ppt"), v.WINDOWS, "day")


@query
def event_slices_table(spark, sf):
    # windows as data: each customer asks for a few days
    key = F.col("c_custkey")
    first = F.date_add(F.lit("1995-01-05").cast("date"), (key % 2300).cast("int"))
    windows = v.table(spark, sf, "customer").select(
        key.cast("string").alias("event"), first.alias("start_day"), F.date_add(first, (key % 3).cast("int")).alias("end_day")
    )
    series = reduce.basin_sum(v.grid(spark, sf), ["product", "day"], "ppt", "total")
    return combine.event_slices(series, windows, "day")


@query
def event_totals(spark, sf):
    """A window of up to 19 years for each customer: days with rain, their total, and the wettest."""
    key = F.col("c_custkey")
    start = F.date_add(F.lit("1990-01-01").cast("date"), _days(key * 7919 % 2500))
    windows = v.table(spark, sf, "customer").select(
        key.cast("string").alias("event"), start.alias("start_day"), F.date_add(start, _days(key * 104729 % 7000)).alias("end_day")
    )
    daily = v.grid(spark, sf).groupBy("day").agg(F.sum("ppt").alias("ppt"))
    return intervals.event_totals(daily, windows, {"days": ("count", "ppt"), "total": ("sum", "ppt"), "high": ("max", "ppt")}, time="day")


def _days(c):
    return c.cast("int")


def storm_totals(spark, sf, how="mean", basin=None):
    basin = v.basin(spark, sf) if basin is None else basin
    return storms.daily_storm_totals(v.grid(spark, sf), v.WINDOWS, basin, "ppt", how, ("event", "product"), "day", "cum_ppt", ("y", "x"))


def hourly_totals(spark, sf, basin, how="mean", daily=True):
    rain = units.total_rain("rainc", "rainnc")
    return storms.hourly_storm_totals(v.wrf(spark, sf), v.WINDOWS, basin, rain, True, how, ("event",), ("y", "x"), out="cum_ppt", daily=daily)


@query
def precip_comparison(spark, sf):
    columns = ["event", "product", "day", "cum_ppt"]
    basin = v.basin(spark, sf)
    hourly = combine.label(hourly_totals(spark, sf, basin), product="WRF-hourly")
    both = combine.concat_rows([storm_totals(spark, sf, basin=basin).select(*columns), hourly.select(*columns)])
    return rounded(both, "cum_ppt")


@query
def precip_comparison_sum(spark, sf):
    columns = ["event", "product", "time", "cum_m"]
    basin = v.basin(spark, sf)
    daily = storm_totals(spark, sf, "sum", basin).withColumn("time", F.col("day").cast("timestamp_ntz"))
    hourly = combine.label(hourly_totals(spark, sf, basin, "sum", daily=False), product="WRF-hourly")
    both = [storms.in_metres(t.withColumnRenamed("cum_ppt", "cum_m"), "cum_m").select(*columns) for t in (daily, hourly)]
    return rounded(combine.concat_rows(both), "cum_m")


@query
def product_compare(spark, sf):
    return rounded(combine.by_product(storm_totals(spark, sf), ["event", "day"], PRODUCTS, "cum_ppt"), "prism", "ornl", "wrf")


@query
def product_series(spark, sf):
    totals = storm_totals(spark, sf)
    labels = {"PRISM": "PRISM 4KM", "ORNL": "ORNL 4KM", "WRF": "ERA5 WRF 9KM"}
    named = F.coalesce(*[F.when(F.col("product") == p, F.lit(n)) for p, n in labels.items()])
    return rounded(storms.series_table([(totals, named)], "day", "cum_ppt"), "value")


@query
def event_spread(spark, sf):
    totals = storms.in_metres(storm_totals(spark, sf, "sum"), "cum_ppt")
    return rounded(storms.event_spread(totals, "cum_ppt", "day"), "low", "q1", "median", "q3", "high")


@query
def record_spread(spark, sf):
    """Box plot numbers over the whole record of each product and scenario; ranges are narrowed down to 1,000 values."""
    found = selection.quantiles(v.grid(spark, sf), ["product", "scenario"], "ppt", few=1000)
    return rounded(found, "low", "q1", "median", "q3", "high")


# -- manifests, names, stations ----------------------------------------------------------------------


@query
def manifest_wrf(spark, sf):
    return manifests.wrf_files(v.requests(spark, sf)).select("request", "time", "path")


@query
def manifest_ornl(spark, sf):
    wanted = v.requests(spark, sf).withColumn("variables", F.array(F.lit("prcp"), F.lit("tmax"), F.lit("pet")))
    return manifests.ornl_files(wanted).select("request", "variable", "year", "url")


@query
def manifest_ornl_split(spark, sf):
    wanted = v.requests(spark, sf).withColumn("variables", F.array(F.lit("prcp"), F.lit("rhum")))
    return manifests.ornl_files(wanted, split_year=2019).select("request", "variable", "year", "url")


@query
def manifest_prism(spark, sf):
    asked = v.requests(spark, sf).withColumn("variables", F.array(F.lit("ppt"), F.lit("tmean")))
    asked = asked.withColumns({"region": F.lit("us"), "resolution": F.lit("4km"), "file_format": F.lit("nc")})
    later = F.add_months(F.col("start_date").cast("date"), 14)
    month = lambda c: F.date_format(c, "yyyy-MM")
    parts = {
        "daily": asked,
        "monthly": asked.withColumn("end_date", month(later)).withColumn("start_date", month(F.col("start_date").cast("date"))),
        "annual": asked.withColumn("start_date", F.col("start_year").cast("string")).withColumn("end_date", F.col("end_year").cast("string")),
    }
    files = [manifests.prism_files(t.withColumn("frequency", F.lit(f)), f) for f, t in parts.items()]
    return combine.concat_rows([f.select("request", "frequency", "variable", "date_key", "path") for f in files])


@query
def manifest_hrrr(spark, sf):
    return manifests.hrrr_runs(v.requests(spark, sf)).select("request", "time", "step_h")


@query
def manifest_gaps(spark, sf):
    expected = manifests.wrf_files(v.requests(spark, sf)).select("request", "model", "time", "path")
    arrived = expected.filter((F.hour("time") + F.col("request")) % 5 != 0).select("path")
    return inventory.arrival_report(expected, arrived, ["model"])


@query
def inventory_search(spark, sf):
    level = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(t)) for k, t in INDEX_LEVELS.items()], F.lit("WIND:10 m above ground"))
    index = v.table(spark, sf, "events").select("event_id", F.concat(F.lit(":"), level, F.lit(":"), F.col("props")).alias("line"))
    return inventory.search(index, {"TMP": "surface", "APCP": "surface:0-1 hour acc fcst"})


@query
def download_plan(spark, sf):
    """Every user a file, its events the messages; some messages share their offset."""
    level = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(t)) for k, t in INDEX_LEVELS.items()], F.lit("WIND:10 m above ground"))
    index = v.table(spark, sf, "events").select(
        F.col("user_id").alias("file"), (F.floor(F.col("event_id") / 3) * 1000).alias("offset"), F.concat(F.lit(":"), level, F.lit(":"), F.col("event_id").cast("string")).alias("line")
    )
    plan = inventory.download_plan(index, {"TMP": "surface", "APCP": "surface:0-1 hour acc fcst"})
    return plan.select("file", "first_byte", "last_byte", "messages", F.array_join("lines", " ").alias("lines"))


@query
def filename_meta(spark, sf):
    rows = v.grid(spark, sf).select(*CELL)
    stamp = F.date_format("day", "yyyyMMdd")
    name = F.concat(F.lit("/data/PRISM_"), F.when(F.col("x") % 2 == 0, "ppt").otherwise("tmean"), F.lit("_stable_4kmD2_"), stamp, F.lit(".nc"))
    local = F.concat(F.lit("/cache/DaymetV4_VIC4_prcp_"), F.year("day").cast("string"), F.lit(".nc"))
    named = inventory.prism_name_parts(rows.withColumn("file_name", name))
    return named.select(*CELL, "variable", "date", manifests.ornl_name_to_url(local).alias("url"))


@query
def stations_geojson(spark, sf):
    s = v.stations(spark, sf)
    point = F.when(F.col("site").cast("int") % 7 == 0, F.array().cast("array<double>")).otherwise(
        F.array(F.col("lon"), F.col("lat"), F.col("elevation_ft").cast("double"))
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("site_name").alias("name"), F.col("site").alias("id"), F.lit("NRCS").alias("datasource")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"),
    )
    return geojson.stations_from_lines(s.select(F.to_json(feature).alias("value")))


@query
def station_request(spark, sf):
    inside = geo.stations_inside(v.stations(spark, sf), v.edges(spark))
    rows = catalog.station_request(v.obs(spark, sf), ["AIR TEMP", "SWE"], ("2024-01-05", "2024-01-12"), stations=inside)
    daily = combine.station_slots(rows, ["AIR TEMP", "SWE"], "daily").withColumnsRenamed({"AIR TEMP": "air_temp", "SWE": "swe"})
    return daily.join(geo.broadcast_if_small(inside.select("site", "site_name")), "site").select("site", "site_name", "time", "air_temp", "swe")


# -- catalogue, sinks, cubes -------------------------------------------------------------------------


@query
def open_dataset(spark, sf):
    store = v.grid(spark, sf).withColumnRenamed("t2", "T2")
    ornl = catalog.open_dataset(store, ("1995-11-22", "1996-02-06"), "ornl", time="day")
    wrf = catalog.open_dataset(store, ("1999-10-31", "1999-11-13"), "WRF", time="day")
    both = combine.concat_rows([ornl.select(*CELL, "ppt", "tmean"), wrf.select(*CELL, "ppt", "T2C")])
    return rounded(both.withColumnRenamed("T2C", "t2c"), "tmean", "t2c")


@query
def cube_roundtrip(spark, sf):
    path = scratch_path(spark, "cube_roundtrip")
    grid = v.grid(spark, sf).select(*CELL, "ppt")
    split = F.lit("1998-01-01").cast("date")
    catalog.write_cube(grid.filter(F.col("day") < split), path, "overwrite", time="day")
    catalog.write_cube(grid.filter(F.col("day") >= split), path, "append", time="day")
    return catalog.read_cube(spark, path).select(*CELL, "ppt", "year")


def stored_grid(spark, sf):
    """A store of two appends whose files differ in their variables."""
    path = scratch_path(spark, "store")
    grid = v.grid(spark, sf).withColumns({"frequency": F.lit("daily"), "resolution": F.when(F.col("product") == "PRISM", "4km").otherwise("9km")})
    split = F.lit("1998-01-01").cast("date")
    keys = [*CELL, "frequency", "resolution"]
    catalog.write_cube(grid.filter(F.col("day") < split).select(*keys, "ppt"), path, "overwrite", time="day")
    catalog.write_cube(grid.filter(F.col("day") >= split).select(*keys, "ppt", "tmax", "tmin"), path, "append", time="day")
    return catalog.read_cube(spark, path)


@query
def open_store(spark, sf):
    store = stored_grid(spark, sf)
    chosen = [catalog.open_dataset(store, ("1995-11-22", "2000-02-06"), p, "daily", r, time="day") for p, r in (("PRISM", "4km"), ("ornl", "9km"), ("wrf", "4km"))]
    return combine.concat_rows([c.select(*CELL, "frequency", "resolution", "ppt", "tmax") for c in chosen])


@query
def store_replace(spark, sf):
    """ORNL written again with doubled rain and from 1995 on; the other products stay."""
    path = scratch_path(spark, "store_replace")
    grid = v.grid(spark, sf).select(*CELL, "ppt")
    catalog.write_cube(grid, path, "overwrite", time="day")
    late = grid.filter((F.col("product") == "ORNL") & (F.col("day") >= F.lit("1995-01-01").cast("date")))
    store.replace(late.withColumn("ppt", F.col("ppt") * 2), path, time="day")
    return catalog.read_cube(spark, path).select(*CELL, "ppt", "year")


@query
def store_merge(spark, sf):
    """Monthly files: all but December 1995, then those of 1995 with that month and a corrected March, twice."""
    path = scratch_path(spark, "store_merge")
    month = F.date_format("day", "yyyyMM")
    grid = v.grid(spark, sf).select(*CELL, "ppt").withColumn("file_name", F.concat_ws("_", "product", "scenario", month))
    store.merge(grid.filter(month != "199512"), path, time="day")
    late = grid.filter(F.year("day") == 1995).withColumn("ppt", F.col("ppt") + F.when(month == "199503", 1.0).otherwise(0.0))
    for _ in range(2):
        store.merge(late, path, time="day")
    return catalog.read_cube(spark, path).select(*CELL, "ppt", "load", "year")


@query
def basin_rollup(spark, sf):
    """Basin sums and means from states of monthly files: all but December 1995, then 1995 with a corrected March, twice."""
    path = scratch_path(spark, "rollup")
    month = F.date_format("day", "yyyyMM")
    grid = v.grid(spark, sf).select(*CELL, "ppt").withColumn("file_name", F.concat_ws("_", "product", "scenario", month))
    basin = v.basin(spark, sf)
    rollups.update(grid.filter(month != "199512"), basin, path, "ppt", time="day")
    late = grid.filter(F.year("day") == 1995).withColumn("ppt", F.col("ppt") + F.when(month == "199503", 1.0).otherwise(0.0))
    for _ in range(2):
        rollups.update(late, basin, path, "ppt", time="day")
    return rounded(rollups.read(spark, path), "mean")


@query
def event_slices_store(spark, sf):
    store = stored_grid(spark, sf)
    table = spark.createDataFrame(v.WINDOWS, "event string, a string, b string").select("event", F.to_date("a").alias("start_day"), F.to_date("b").alias("end_day"))
    both = [combine.event_slices(store, w, "day").select(F.lit(name).alias("form"), "event", *CELL, "ppt") for name, w in (("list", v.WINDOWS), ("table", table))]
    return combine.concat_rows(both)


@query
def precip_by_grid(spark, sf):
    """Products with masks of their own: the basin as it is, and every other column of it."""
    basin = v.basin(spark, sf).select("y", "x")
    every = F.array(*[F.lit(p) for p in PRODUCTS])
    masks = basin.select(F.explode(every).alias("product"), "y", "x").filter((F.col("product") == "PRISM") | (F.col("x") % 2 == 0))
    totals = storms.daily_storm_totals(v.grid(spark, sf), v.WINDOWS, masks, "ppt", "sum", ("event", "product"), "day", "cum_ppt")
    return rounded(totals.select("event", "product", "day", "cum_ppt"), "cum_ppt")


@query
def text_grid(spark, sf):
    return textgrid.text_grid(v.grid(spark, sf), "t2", ["product", "scenario", "day"], cells=v.grid_rows(spark, sf))


@query
def hrrr_cube(spark, sf):
    cube = cubes.hrrr_cube(v.hrrr_raw(spark, sf), v.hrrr_cells(spark, sf), v.edges(spark), "2024-01-03 00:00:00", "2024-01-24 00:00:00")
    return rounded(cube, "t", "r2", "tp", "max_10si").select("time", "y", "x", "lon", "lat", "t", "r2", "tp", "max_10si")


@query
def wrf_cube(spark, sf):
    raw = v.wrf(spark, sf).select(
        times.wrf_time_text("time").alias("Times"), F.col("y").alias("south_north"), F.col("x").alias("west_east"),
        F.col("rainc").alias("RAINC"), F.col("rainnc").alias("RAINNC"),
    )
    cube = cubes.wrf_cube(raw, v.cells(spark, sf), v.edges(spark), "RAINC,RAINNC,T2")
    return rounded(cube.withColumnsRenamed({"RAINC": "rainc", "RAINNC": "rainnc"}), "rainc", "rainnc")


def raster_rows(spark, sf, names, keys):
    """Single-variable raster rows over all scenarios; the value 50 stands for missing data."""
    grid = v.grid(spark, sf).groupBy(*keys).agg(F.sum("ppt").alias("ppt"), F.max("tmax").alias("tmax"), F.min("tmin").alias("tmin"))
    long = combine.stack_variables(grid, keys, names)
    return long.withColumn("value", F.when(F.col("value") == 50, -9999.0).otherwise(F.col("value")))


@query
def prism_cube(spark, sf):
    names = ["ppt", "tmax", "tmin"]
    rows = raster_rows(spark, sf, names, ["product", "day", "y", "x"]).filter("product = 'PRISM'")
    name = F.concat(F.lit("PRISM_"), F.col("variable"), F.lit("_stable_4kmD2_"), F.date_format("day", "yyyyMMdd"), F.lit(".nc"))
    raster = geo.attach_cells(rows.withColumn("file_name", name).withColumn("band", F.lit(1)), v.cells(spark, sf).select("y", "x", "lat", "lon"))
    raster = raster.select("file_name", "band", "y", "x", "lat", "lon", "value")
    cube = cubes.prism_cube(raster, v.cells(spark, sf), v.edges(spark), names)
    return rounded(cube, "tmax", "tmin")


@query
def ornl_cube(spark, sf):
    rows = raster_rows(spark, sf, ["ppt", "tmax", "tmin"], ["product", "day", "y", "x"]).filter("product = 'ORNL'")
    raster = rows.withColumn("variable", F.replace("variable", F.lit("ppt"), F.lit("prcp"))).withColumn(
        "time", F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")
    )
    raster = geo.attach_cells(raster, v.cells(spark, sf).select("y", "x", "lat", "lon"))
    raster = raster.select("variable", "time", "y", "x", "lat", "lon", "value")
    cube = cubes.ornl_cube(raster, v.cells(spark, sf), v.edges(spark), ["prcp", "tmax", "tmin"])
    return rounded(cube, "tmax", "tmin", "tmean")


@query
def pnnl_cube(spark, sf):
    # one table per variable, each with gaps of its own; two scenarios
    names = {"PREC_ACC_NC": "ppt", "U10": "u10", "V10": "v10"}
    grid = v.grid(spark, sf).withColumnRenamed("day", "time")
    keys = ["scenario", "time", "y", "x"]
    grid = sizing.spread(grid, keys, v.table(spark, sf, "lineitem")).groupBy(*keys).agg(
        F.sum("ppt").alias("ppt"), F.max("u10").alias("u10"), F.max("v10").alias("v10")
    )
    grid = stored(grid, "pnnl")  # in place of the files
    tables = {n: grid.filter(F.col(c) > 2).select("scenario", "time", "y", "x", F.col(c).alias(n)) for n, c in names.items()}
    cube = cubes.pnnl_in_basin(cubes.pnnl_cube(tables, bound=grid), v.cells(spark, sf), v.edges(spark))
    return rounded(cube.withColumnsRenamed({n: n.lower() for n in names}), "u10", "v10")


@query
def snotel_cube(spark, sf):
    inside = geo.stations_inside(v.stations(spark, sf), v.edges(spark))
    cube = cubes.snotel_cube(v.obs(spark, sf), inside, ",".join(STATION_NAMES), "daily", ("2024-01-03", "2024-01-25"))
    return cube.withColumnsRenamed(SHORT).select("site", "time", *SHORT.values(), "site_name", "lat", "lon", "elevation_ft")


@query
def storm_map(spark, sf):
    days = ("2024-01-10", "2024-01-14")
    rain = maps.storm_map(v.hrrr_raw(spark, sf), days, "tp", "sum", positive_only=True)
    warm = maps.storm_map(v.hrrr_raw(spark, sf).filter("step_h = 0"), days, units.kelvin_to_celsius("t"), "mean")
    both = combine.concat_rows([maps.with_range(combine.label(m, variable=n)) for m, n in ((rain, "tp"), (warm, "t_c"))])
    return rounded(both, "value", "low", "high").select("variable", "y", "x", "day", "value", "low", "high")
