"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from .views import inside_sql, with_views

SQL: dict[str, str] = {}


def add(name: str, sql: str, *views: str, extra: str = "") -> None:
    """``extra``: further common tables, after the views."""
    SQL[name] = with_views(f", {extra}\n{sql.strip()}" if extra else sql, *views) if views else sql.strip()


CELL = "product, scenario, day, y, x"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BASIN_ROWS = "(SELECT g.* FROM v2_grid g JOIN v10_basin b ON g.y = b.y AND g.x = b.x)"

add("unit_convert", """
SELECT o.site, o.time, round((o.value - 32.0) * (5.0 / 9.0), 6) AS t2c, round(s.elevation_ft * CAST(0.3048 AS DOUBLE), 6) AS elevation_m
FROM v1_obs o LEFT JOIN v7_stations s ON o.site = s.site WHERE o.variable = 'AIR TEMP'""", "v1_obs", "v7_stations")
add("tmean", f"SELECT {CELL}, round((tmax + tmin) / 2, 6) AS tmean FROM v2_grid", "v2_grid")
add("wind_speed", f"SELECT {CELL}, round(sqrt(u10 * u10 + v10 * v10), 6) AS wind FROM v2_grid", "v2_grid")
ES = "(CAST(611.2 AS DOUBLE) * exp(CAST(17.67 AS DOUBLE) * ({t} - CAST(273.15 AS DOUBLE)) / ({t} - CAST(29.65 AS DOUBLE))))"
add("rel_humidity", f"""
SELECT {CELL}, round(100 * (q2 / (1 - q2)) / (CAST(0.622 AS DOUBLE) * es / (psfc - es)), 6) AS rh
FROM (SELECT *, {ES.format(t='t2')} AS es FROM v2_grid) t""", "v2_grid")
add("rel_humidity_vpd", f"""
SELECT {CELL}, round(100 * (1 - v10 / (es / 100)), 6) AS rh
FROM (SELECT *, {ES.format(t='((tmax + tmin) / 2 + CAST(273.15 AS DOUBLE))')} AS es FROM v2_grid) t""", "v2_grid")
add("normalize_lon", "SELECT time, step_h, y, x, lon360 - 360 AS lon FROM v4_hrrr_raw", "v4_hrrr_raw")
add("floor_time", """
SELECT site, time, CAST(date_trunc('hour', time) AS TIMESTAMP) AS hour, CAST(date_trunc('day', time) AS TIMESTAMP) AS day FROM v1_obs""", "v1_obs")
add("water_year", f"SELECT {CELL}, CAST(year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END AS INT) AS water_year FROM v2_grid", "v2_grid")
add("nodata_to_null", """
SELECT l_suppkey, count(value) AS known, sum(value) AS total, max(value) AS high, round(avg(value), 6) AS mean
FROM (SELECT l_suppkey, CASE WHEN l_quantity < 49 THEN l_quantity END AS value FROM lineitem) t GROUP BY 1""")
add("select_variables", f"SELECT {CELL}, ppt, t2 FROM v2_grid", "v2_grid")
add("time_slice", """
SELECT * FROM v1_obs WHERE time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-21 00:00:00'""", "v1_obs")
RAIN = "time, y, x, round(rainc, 6) AS rainc, round(rainnc, 6) AS rainnc FROM v3_wrf"
add("nearest_time", f"""
SELECT {RAIN} WHERE time = (SELECT time FROM v3_wrf ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-12 12:30:00')), time DESC LIMIT 1)""", "v3_wrf")
add("exact_time", f"SELECT {RAIN} WHERE time = TIMESTAMP '2024-01-12 00:00:00'", "v3_wrf")
add("nth_time", f"""
SELECT {RAIN} WHERE time = (SELECT time FROM (SELECT DISTINCT time FROM v3_wrf) t ORDER BY time LIMIT 1 OFFSET 10)""", "v3_wrf")
add("last_value", """
SELECT product, scenario, y, x, day, ppt FROM (
  SELECT *, row_number() OVER (PARTITION BY product, scenario, y, x ORDER BY day DESC) AS n FROM v2_grid) t WHERE n = 1""", "v2_grid")
add("preview", "SELECT * FROM v7_stations ORDER BY site LIMIT 10", "v7_stations")

B = ("v2_grid", "v10_basin")
add("basin_mean", f"SELECT product, day, round(avg(ppt), 6) AS mean FROM {BASIN_ROWS} t GROUP BY 1, 2", *B)
add("basin_sum", f"SELECT product, day, coalesce(sum(ppt), 0) AS total FROM {BASIN_ROWS} t GROUP BY 1, 2", *B)
add("basin_cumulative", f"""
SELECT product, day, round(coalesce(sum(m) OVER (PARTITION BY product ORDER BY day {RUN}), 0), 6) AS cum
FROM (SELECT product, day, avg(ppt) AS m FROM {BASIN_ROWS} t GROUP BY 1, 2) s""", *B)
add("daily_max", "SELECT y, x, CAST(time AS DATE) AS day, round(max(rainnc), 6) AS high FROM v3_wrf GROUP BY 1, 2, 3", "v3_wrf")
add("daily_mean_temp", """
SELECT y, x, CAST(time AS DATE) AS day, round(avg(t - CAST(273.15 AS DOUBLE)), 6) AS t_c FROM v4_hrrr_raw WHERE step_h = 0 GROUP BY 1, 2, 3""", "v4_hrrr_raw")
add("daily_precip_positive", """
SELECT c.y, c.x, d.day, CASE WHEN s.tp > 0 THEN round(s.tp, 6) END AS tp
FROM (SELECT DISTINCT y, x FROM v4_hrrr_raw) c
CROSS JOIN (SELECT CAST(unnest(generate_series(min(CAST(time AS DATE)), max(CAST(time AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM v4_hrrr_raw) d
LEFT JOIN (SELECT y, x, CAST(time AS DATE) AS day, sum(tp) AS tp FROM v4_hrrr_raw GROUP BY 1, 2, 3) s
  ON c.y = s.y AND c.x = s.x AND d.day = s.day""", "v4_hrrr_raw")
add("wrf_hourly_precip", """
SELECT time, y, x, round(r - lag(r) OVER (PARTITION BY y, x ORDER BY time), 6) AS prcp
FROM (SELECT time, y, x, rainc + rainnc AS r FROM v3_wrf) t""", "v3_wrf")
add("diff_series", f"""
SELECT event, time, round(change, 6) AS change,
       round(sum(change) OVER (PARTITION BY event ORDER BY time {RUN}) / 1000, 6) AS cum_m
FROM (SELECT event, time, s - lag(s) OVER (PARTITION BY event ORDER BY time) AS change, row_number() OVER (PARTITION BY event ORDER BY time) AS n
      FROM (SELECT w.event, f.time, sum(f.rainc) AS s FROM v3_wrf f
            JOIN v9_events_win w ON CAST(f.time AS DATE) BETWEEN w.start_day AND w.end_day GROUP BY 1, 2) a) b
WHERE n > 1""", "v3_wrf", "v9_events_win")
add("global_max", "SELECT max(ppt) AS high, max(ppt / 10) AS high_tenth FROM v2_grid", "v2_grid")

add("polygon_bounds", """
SELECT l_orderkey AS feature, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat
FROM (SELECT l_orderkey, -122.5 + (l_partkey % 160) / CAST(64 AS DOUBLE) AS lon, 47.5 + (l_suppkey % 128) / CAST(64 AS DOUBLE) AS lat FROM lineitem) t
GROUP BY 1""")
add("bbox_filter", "SELECT * FROM v6_dem WHERE x BETWEEN -121.5 AND -120.5 AND y BETWEEN 47.75 AND 48.5", "v6_dem")
add("basin_mask_keep", """
SELECT g.product, g.scenario, g.day, g.y, g.x, CASE WHEN b.y IS NOT NULL THEN g.ppt END AS ppt, CASE WHEN b.y IS NOT NULL THEN round(g.t2, 6) END AS t2
FROM v2_grid g LEFT JOIN v10_basin b ON g.y = b.y AND g.x = b.x""", *B)
add("basin_mask_drop", f"SELECT {CELL}, ppt FROM {BASIN_ROWS} t", *B)
add("dem_clip", f"""
SELECT d.iy, d.ix, d.band, d.x, d.y, d.elevation FROM v6_dem d JOIN ({inside_sql('(SELECT iy, ix, x AS lon, y AS lat FROM v6_dem)', 'iy, ix')}) i
ON d.iy = i.iy AND d.ix = i.ix""", "v6_dem", "v8_edges")
add("mesh_grid", """
SELECT iy, ix, lat, lon FROM (SELECT DISTINCT ix, x AS lon FROM v6_dem) a CROSS JOIN (SELECT DISTINCT iy, y AS lat FROM v6_dem) b""", "v6_dem")
IN_BASIN = f"({inside_sql('v7_stations', 'site')})"
add("stations_in_basin", f"""
SELECT s.* FROM v7_stations s WHERE s.site IN (SELECT site FROM {IN_BASIN} i)
AND s.site IN (SELECT site FROM v1_obs WHERE variable = 'SNOWDEPTH')""", "v1_obs", "v7_stations", "v8_edges")
add("stations_buffer", """
SELECT s.* FROM v7_stations s, (SELECT min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b, min(least(y1, y2)) AS c, max(greatest(y1, y2)) AS d FROM v8_edges) e
WHERE s.lon BETWEEN a - 0.25 AND b + 0.25 AND s.lat BETWEEN c - 0.25 AND d + 0.25""", "v7_stations", "v8_edges")
add("attach_coords", """
SELECT g.product, g.scenario, g.day, g.y, g.x, g.ppt, c.lat, c.lon, c.hgt, c.landmask
FROM v2_grid g LEFT JOIN v5_cells c ON g.y = c.y AND g.x = c.x""", "v2_grid", "v5_cells")
add("landmask", """
SELECT g.product, g.scenario, g.day, g.y, g.x, CASE WHEN c.landmask = 1 THEN round(g.t2, 6) END AS t2
FROM v2_grid g LEFT JOIN v5_cells c ON g.y = c.y AND g.x = c.x""", "v2_grid", "v5_cells")
add("abs_offset", """
SELECT y, x, round(abs(lat - 48.7758), 6) AS abslat, round(abs(lon - -121.8199), 6) AS abslon FROM v5_cells""", "v5_cells")
KM = """2 * 6371 * asin(sqrt(least(1, pow(sin(radians(c.lat - p.plat) / 2), 2)
  + cos(radians(p.plat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.plon) / 2), 2))))"""
HRRR_MERGED = """(SELECT time, y, x, max(lon360) AS lon360, max(lat) AS lat, max(CASE WHEN step_h = 0 THEN t END) AS t, max(CASE WHEN step_h = 0 THEN r2 END) AS r2,
       max(CASE WHEN step_h = 1 THEN tp END) AS tp, max(CASE WHEN step_h = 1 THEN max_10si END) AS max_10si
FROM v4_hrrr_raw GROUP BY 1, 2, 3)"""
add("nearest_cells_table", f"""
SELECT point, y, x, round(km, 6) AS km FROM (
  SELECT p.point, c.y, c.x, {KM} AS km, row_number() OVER (PARTITION BY p.point ORDER BY {KM}, c.y, c.x) AS n FROM v5_cells c
  CROSS JOIN (SELECT c_custkey AS point, CAST(47.0 AS DOUBLE) + (c_custkey * 7919 % 4000) / CAST(1000.0 AS DOUBLE) AS plat,
                     CAST(-124.5 AS DOUBLE) + (c_custkey * 104729 % 7000) / CAST(1000.0 AS DOUBLE) AS plon FROM customer) p) r WHERE n = 1""", "v5_cells")
add("nearest_cell_series", f"""
SELECT n.point, m.time, m.y, m.x, round(m.tp, 6) AS tp, round(m.t - CAST(273.15 AS DOUBLE), 6) AS t_c
FROM {HRRR_MERGED} m JOIN (
  SELECT point, y, x FROM (
    SELECT p.point, c.y, c.x, row_number() OVER (PARTITION BY p.point ORDER BY {KM}, c.y, c.x) AS n
    FROM v4_cells c CROSS JOIN (SELECT * FROM (VALUES ('Glacier Peak', CAST(48.1048 AS DOUBLE), CAST(-121.1124 AS DOUBLE)),
      ('Mount Baker', CAST(48.7758 AS DOUBLE), CAST(-121.8199 AS DOUBLE))) AS q(point, plat, plon)) p) r WHERE n = 1) n
ON m.y = n.y AND m.x = n.x""", "v4_hrrr_raw", "v4_cells")
add("point_series_store", f"""
SELECT n.point, g.product, g.scenario, g.day, g.y, g.x, g.ppt, round(g.t2 - CAST(273.15 AS DOUBLE), 6) AS t_c
FROM v2_grid g JOIN (
  SELECT point, y, x FROM (
    SELECT p.point, c.y, c.x, row_number() OVER (PARTITION BY p.point ORDER BY {KM}, c.y, c.x) AS n
    FROM v5_cells c CROSS JOIN (SELECT * FROM (VALUES ('Glacier Peak', CAST(48.1048 AS DOUBLE), CAST(-121.1124 AS DOUBLE)),
      ('Mount Baker', CAST(48.7758 AS DOUBLE), CAST(-121.8199 AS DOUBLE))) AS q(point, plat, plon)) p) r WHERE n = 1) n
ON g.y = n.y AND g.x = n.x""", "v2_grid", "v5_cells")
add("series_scan", """
SELECT pos, quantity, sum(quantity) OVER (ORDER BY pos) AS total, quantity - lag(quantity) OVER (ORDER BY pos) AS change
FROM (SELECT l_orderkey AS pos, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) l""")
REGULAR = """
SELECT c.y, c.x, {columns} FROM (
  SELECT c.*, CASE WHEN c.lon BETWEEN h.x0 AND h.x1 AND c.lat BETWEEN h.y0 AND h.y1 THEN ceil((c.lon - h.x0) / h.dx - 0.5) END AS ix,
         CASE WHEN c.lon BETWEEN h.x0 AND h.x1 AND c.lat BETWEEN h.y0 AND h.y1 THEN ceil((c.lat - h.y0) / h.dy - 0.5) END AS iy
  FROM v5_cells c CROSS JOIN (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
       (max(x) - min(x)) / (max(ix) - min(ix)) AS dx, (max(y) - min(y)) / (max(iy) - min(iy)) AS dy FROM v6_dem) h) c
LEFT JOIN {raster} d ON d.ix = c.ix AND d.iy = c.iy"""
add("embed_dem_regular", REGULAR.format(columns="c.lat, c.lon, d.elevation", raster="v6_dem"), "v5_cells", "v6_dem")
add("embed_dem_band_mean", REGULAR.format(
    columns="d.elevation", raster="(SELECT iy, ix, round(avg(elevation), 6) AS elevation FROM v6_bands GROUP BY 1, 2)"
), "v5_cells", "v6_dem", "v6_bands")
add("embed_dem_irregular", """
SELECT s.site, s.lat, s.lon, arg_min(d.elevation, {'d2': (s.lon - d.x) * (s.lon - d.x) + (s.lat - d.y) * (s.lat - d.y), 'id': d.iy * 40 + d.ix}) AS elevation
FROM v7_stations s CROSS JOIN v6_dem d GROUP BY 1, 2, 3""", "v6_dem", "v7_stations")
add("dem_band_mean", "SELECT iy, ix, y, x, round(avg(elevation), 6) AS elevation FROM v6_bands GROUP BY 1, 2, 3, 4", "v6_bands")

WY = "CAST(year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END AS INT)"
WY_CUM = f"""SELECT product, water_year, day, sum(s) OVER (PARTITION BY product, water_year ORDER BY day {RUN}) / 1000 AS c
FROM (SELECT product, {WY} AS water_year, day, sum(ppt) AS s FROM v2_grid GROUP BY 1, 2, 3) t"""
add("water_year_total", f"SELECT product, {WY} AS water_year, round(sum(ppt) / 1000, 6) AS total_m FROM v2_grid GROUP BY 1, 2", "v2_grid")
add("water_year_cumulative", f"SELECT product, water_year, day, round(c, 6) AS cum_m FROM ({WY_CUM}) u", "v2_grid")
add("water_year_peak", f"SELECT product, water_year, round(max(c), 6) AS peak_m FROM ({WY_CUM}) u GROUP BY 1, 2", "v2_grid")
add("year_doy_cumulative", f"""
SELECT product, year, doy, round(sum(s) OVER (PARTITION BY product, year ORDER BY doy {RUN}) / 1000, 6) AS cum_m
FROM (SELECT product, CAST(year(day) AS INT) AS year, CAST(dayofyear(day) AS INT) AS doy, sum(ppt) AS s FROM v2_grid GROUP BY 1, 2, 3) t""", "v2_grid")

add("concat_time", f"SELECT {CELL}, ppt, CASE WHEN day < DATE '1998-10-01' THEN round(tmax, 6) END AS tmax FROM v2_grid", "v2_grid")
add("merge_variables", f"""
SELECT {CELL}, CASE WHEN ppt > 0 THEN ppt END AS ppt, CASE WHEN tmax > 0 THEN round(tmax, 6) END AS tmax, CASE WHEN tmin > 0 THEN round(tmin, 6) END AS tmin
FROM v2_grid WHERE ppt > 0 OR tmax > 0 OR tmin > 0""", "v2_grid")
add("hrrr_merge", f"""
SELECT time, y, x, lon360, lat, round(t, 6) AS t, round(r2, 6) AS r2, round(tp, 6) AS tp, round(max_10si, 6) AS max_10si FROM {HRRR_MERGED} m""", "v4_hrrr_raw")
add("station_cube", """
SELECT s.site, h.time, r.air_temp, r.precipitation, r.snowdepth
FROM (SELECT DISTINCT site FROM v1_obs WHERE variable IN ('AIR TEMP', 'PRECIPITATION', 'SNOWDEPTH')) s
CROSS JOIN (SELECT DISTINCT CAST(date_trunc('hour', time) AS TIMESTAMP) AS time FROM v1_obs WHERE variable IN ('AIR TEMP', 'PRECIPITATION', 'SNOWDEPTH')) h
LEFT JOIN (SELECT site, CAST(date_trunc('hour', time) AS TIMESTAMP) AS time, arg_max(value, o.time) FILTER (WHERE variable = 'AIR TEMP') AS air_temp,
             arg_max(value, o.time) FILTER (WHERE variable = 'PRECIPITATION') AS precipitation,
             arg_max(value, o.time) FILTER (WHERE variable = 'SNOWDEPTH') AS snowdepth
      FROM v1_obs o GROUP BY 1, 2) r ON s.site = r.site AND h.time = r.time""", "v1_obs")
add("station_coords", """
SELECT s.site, s.site_name, round(s.lat + f.value / 1024, 6) AS lat, s.lon, f.value AS elevation_ft
FROM v7_stations s JOIN (SELECT site, arg_min(value, time) AS value FROM v1_obs GROUP BY 1) f ON s.site = f.site""", "v1_obs", "v7_stations")
add("site_semi", "SELECT * FROM v7_stations WHERE site IN (SELECT site FROM v1_obs WHERE variable = 'SWE' AND value > 200)", "v1_obs", "v7_stations")
add("event_slices", """
SELECT g.product, g.scenario, g.day, g.y, g.x, g.ppt, w.event FROM v2_grid g JOIN v9_events_win w ON g.day BETWEEN w.start_day AND w.end_day""", "v2_grid", "v9_events_win")
add("event_slices_table", """
SELECT g.product, g.day, g.total, w.event FROM (SELECT product, day, sum(ppt) AS total FROM v2_grid GROUP BY 1, 2) g
JOIN (SELECT CAST(c_custkey AS STRING) AS event, DATE '1995-01-05' + CAST(c_custkey % 2300 AS INT) AS start_day,
             DATE '1995-01-05' + CAST(c_custkey % 2300 + c_custkey % 3 AS INT) AS end_day FROM customer) w
ON g.day BETWEEN w.start_day AND w.end_day""", "v2_grid")


def storm(agg: str) -> str:
    return f"""(SELECT event, product, day, coalesce(sum(m) OVER (PARTITION BY event, product ORDER BY day {RUN}), 0) AS c
FROM (SELECT w.event, g.product, g.day, {agg} AS m FROM v2_grid g JOIN v9_events_win w ON g.day BETWEEN w.start_day AND w.end_day
      JOIN v10_basin b ON g.y = b.y AND g.x = b.x GROUP BY 1, 2, 3) d)"""


def storm_hourly(agg: str) -> str:
    return f"""(SELECT event, time, coalesce(sum(m) OVER (PARTITION BY event ORDER BY time {RUN}), 0) AS c
FROM (SELECT event, time, {agg} AS m
      FROM (SELECT w.event, f.time, f.y, f.x, f.rainc + f.rainnc - lag(f.rainc + f.rainnc) OVER (PARTITION BY w.event, f.y, f.x ORDER BY f.time) AS ppt
            FROM v3_wrf f JOIN v9_events_win w ON CAST(f.time AS DATE) BETWEEN w.start_day AND w.end_day
                 JOIN v10_basin b ON f.y = b.y AND f.x = b.x) d GROUP BY 1, 2) h)"""


S = ("v2_grid", "v9_events_win", "v10_basin")
add("precip_comparison", f"""
SELECT event, product, day, round(c, 6) AS cum_ppt FROM {storm('avg(g.ppt)')} a
UNION ALL
SELECT event, 'WRF-hourly', CAST(time AS DATE), round(max(c), 6) FROM {storm_hourly('avg(ppt)')} b GROUP BY 1, 2, 3""", *S, "v3_wrf")
add("precip_comparison_sum", f"""
SELECT event, product, CAST(day AS TIMESTAMP) AS time, round(c / 1000, 6) AS cum_m FROM {storm('coalesce(sum(g.ppt), 0)')} a
UNION ALL
SELECT event, 'WRF-hourly', time, round(c / 1000, 6) FROM {storm_hourly('coalesce(sum(ppt), 0)')} b""", *S, "v3_wrf")
add("precip_by_grid", f"""
SELECT event, product, day, round(c, 6) AS cum_ppt
FROM {storm('coalesce(sum(g.ppt), 0)').replace("g.x = b.x", "g.x = b.x AND (g.product = 'PRISM' OR g.x % 2 = 0)")} a""", *S)
add("product_compare", f"""
SELECT event, day, round(max(CASE WHEN product = 'PRISM' THEN c END), 6) AS prism, round(max(CASE WHEN product = 'ORNL' THEN c END), 6) AS ornl,
       round(max(CASE WHEN product = 'WRF' THEN c END), 6) AS wrf FROM {storm('avg(g.ppt)')} a GROUP BY 1, 2""", *S)
add("product_series", f"""
SELECT event, concat(event, ' Basin Cumulative Precipitation') AS title,
       CASE product WHEN 'PRISM' THEN 'PRISM 4KM' WHEN 'ORNL' THEN 'ORNL 4KM' ELSE 'ERA5 WRF 9KM' END AS label, day AS time, round(c, 6) AS value
FROM {storm('avg(g.ppt)')} a""", *S)
add("event_spread", f"""
SELECT event, round(quantile_cont(v, 0), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
       round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 1), 6) AS high
FROM (SELECT event, product, arg_max(c / 1000, day) AS v FROM {storm('coalesce(sum(g.ppt), 0)')} a GROUP BY 1, 2) t GROUP BY 1""", *S)

add("event_totals", """
SELECT CAST(c_custkey AS VARCHAR) AS event, count(ppt) AS days, sum(ppt) AS total, max(ppt) AS high
FROM (SELECT c_custkey, DATE '1990-01-01' + CAST(c_custkey * 7919 % 2500 AS INT) AS a FROM customer) w
JOIN (SELECT day, sum(ppt) AS ppt FROM v2_grid GROUP BY 1) d ON d.day BETWEEN a AND a + CAST(c_custkey * 104729 % 7000 AS INT) GROUP BY 1""", "v2_grid")

add("record_spread", """
SELECT product, scenario, min(ppt) AS low, quantile_cont(ppt, 0.25) AS q1, quantile_cont(ppt, 0.5) AS median, quantile_cont(ppt, 0.75) AS q3,
       max(ppt) AS high FROM v2_grid WHERE ppt IS NOT NULL GROUP BY 1, 2""", "v2_grid")
add("station_areas", """
SELECT y, x, site FROM (
  SELECT c.y, c.x, e.site, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) AS n,
         max(CASE WHEN abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) < 1e-12 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                   AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) AS on_edge
  FROM v5_cells c CROSS JOIN v8_areas e GROUP BY 1, 2, 3) t WHERE n % 2 = 1 AND on_edge = 0""", "v5_cells", "v8_areas", "v7_stations")

HOURS = "unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 HOUR))"
WRF_FILES = f"""(SELECT request, model, time, concat('downscaled_products/', CASE WHEN model LIKE 'era5%' THEN 'reanalysis' ELSE 'gcm' END, '/', model,
       CASE WHEN historical THEN '_historical' ELSE '' END, CASE WHEN bias_corrected THEN '_bc' ELSE '' END, '/hourly/',
       CAST(CASE WHEN month(time) > 9 THEN year(time) ELSE year(time) - 1 END AS STRING), '/d0', CAST(domain AS STRING), '/',
       CASE data_tier WHEN 1 THEN 'wrfout' ELSE 'auxhist' END, '_d01_', strftime(time, '%Y-%m-%d_%H:%M:%S')) AS path
FROM (SELECT *, {HOURS} AS time FROM v11_requests) t)"""
add("manifest_wrf", f"SELECT request, time, path FROM {WRF_FILES} f", "v11_requests")
add("manifest_gaps", f"""
SELECT f.model, count(*) AS expected, count(a.path) AS fetched, count(*) - count(a.path) AS failed
FROM {WRF_FILES} f LEFT JOIN (SELECT DISTINCT path FROM {WRF_FILES} g WHERE (hour(time) + request) % 5 <> 0) a ON f.path = a.path GROUP BY 1""", "v11_requests")
add("manifest_hrrr", f"""
SELECT request, time, CAST(step_h AS INT) AS step_h FROM (SELECT request, {HOURS} AS time FROM v11_requests) t CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS s(step_h)) s""", "v11_requests")


def ornl(variables: str, split: str | None) -> str:
    driven = "(gcm IS NOT NULL AND climate_scenario IS NOT NULL AND downscaling IS NOT NULL)"
    ensemble = "CASE gcm WHEN 'CNRM-ESM2-1' THEN 'r1i1p1f2' WHEN 'EC-Earth3' THEN 'r1i1p1f1' END"
    model = f"year >= {split}" if split else driven
    keep = (
        f"(year < {split} OR ({driven} AND ens IS NOT NULL))" if split
        else f"CASE WHEN {driven} THEN year BETWEEN 1980 AND 2099 AND ens IS NOT NULL ELSE year BETWEEN 1950 AND 2018 END"
    )
    return f"""
SELECT request, variable, year, concat('https://hydrosource2.ornl.gov/files/SWA9505V3/', run, '/', variable, '/', run, '_', hydro_model, '_', variable, '_', CAST(year AS STRING), '.nc') AS url
FROM (SELECT *, CASE WHEN {model} THEN concat(gcm, '_', climate_scenario, '_', ens, '_', downscaling, '_', replace(reference, 'DaymetV4', 'Daymet')) ELSE reference END AS run
      FROM (SELECT *, {ensemble} AS ens FROM (SELECT *, CAST(unnest(generate_series(start_year, end_year)) AS INT) AS year FROM v11_requests) a
            CROSS JOIN (SELECT * FROM (VALUES {variables}) AS v(variable)) v) b) c
WHERE {keep}"""


add("manifest_ornl", ornl("('prcp'), ('tmax'), ('pet')", None), "v11_requests")
add("manifest_ornl_split", ornl("('prcp'), ('rhum')", "2019"), "v11_requests")
add("manifest_prism", """
SELECT request, frequency, variable, date_key, concat('/us/4km/', variable, '/', date_key, '?format=nc') AS path
FROM (SELECT request, 'daily' AS frequency, strftime(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)), '%Y%m%d') AS date_key FROM v11_requests
      UNION ALL
      SELECT request, 'monthly', strftime(unnest(generate_series(date_trunc('month', start_date), date_trunc('month', start_date + INTERVAL 14 MONTH), INTERVAL 1 MONTH)), '%Y%m') FROM v11_requests
      UNION ALL
      SELECT request, 'annual', CAST(unnest(generate_series(start_year, end_year)) AS STRING) FROM v11_requests) d
CROSS JOIN (SELECT * FROM (VALUES ('ppt'), ('tmean')) AS v(variable)) v""", "v11_requests")
add("inventory_search", """
SELECT * FROM (SELECT event_id, concat(':', CASE event_type WHEN 'click' THEN 'TMP:surface' WHEN 'view' THEN 'RH:2 m above ground'
    WHEN 'error' THEN 'APCP:surface:0-1 hour acc fcst' WHEN 'signup' THEN 'TMP:2 m above ground' ELSE 'WIND:10 m above ground' END, ':', props) AS line FROM events) t
WHERE regexp_matches(line, '^(?::TMP:surface|:APCP:surface:0-1 hour acc fcst)')""")
add("download_plan", """
WITH l AS (SELECT user_id AS file, CAST(floor(event_id / 3) AS BIGINT) * 1000 AS o, concat(':', CASE event_type WHEN 'click' THEN 'TMP:surface' WHEN 'view' THEN 'RH:2 m above ground'
    WHEN 'error' THEN 'APCP:surface:0-1 hour acc fcst' WHEN 'signup' THEN 'TMP:2 m above ground' ELSE 'WIND:10 m above ground' END, ':', CAST(event_id AS VARCHAR)) AS line FROM events),
h AS (SELECT *, starts_with(line, ':TMP:surface') OR starts_with(line, ':APCP:surface:0-1 hour acc fcst') AS hit FROM l),
m AS (SELECT file, o, bool_or(hit) AS hit FROM h GROUP BY file, o),
n AS (SELECT *, lead(o) OVER w AS after, sum(CASE WHEN hit AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER w AS r
      FROM (SELECT *, lag(hit) OVER (PARTITION BY file ORDER BY o) AS before FROM m) x WINDOW w AS (PARTITION BY file ORDER BY o)),
t AS (SELECT n.file, n.r, string_agg(line, ' ' ORDER BY n.o, line) AS lines FROM n JOIN h ON n.file = h.file AND n.o = h.o AND h.hit GROUP BY n.file, n.r)
SELECT g.file, g.first_byte, g.last_byte, g.messages, t.lines
FROM (SELECT file, r, min(o) AS first_byte, arg_max(coalesce(after, -1), o) AS a, CASE WHEN a >= 0 THEN a - 1 END AS last_byte, count(*) AS messages FROM n WHERE hit GROUP BY file, r) g
JOIN t ON g.file = t.file AND g.r = t.r""")
add("filename_meta", f"""
SELECT {CELL}, CASE WHEN x % 2 = 0 THEN 'ppt' ELSE 'tmean' END AS variable, day AS date,
       concat('https://hydrosource2.ornl.gov/files/SWA9505V3/DaymetV4/prcp/DaymetV4_VIC4_prcp_', CAST(year(day) AS STRING), '.nc') AS url FROM v2_grid""", "v2_grid")
add("stations_geojson", """
SELECT site AS id, site_name AS name, 'NRCS' AS datasource, CASE WHEN CAST(site AS INT) % 7 <> 0 THEN lon END AS lon,
       CASE WHEN CAST(site AS INT) % 7 <> 0 THEN lat END AS lat, CASE WHEN CAST(site AS INT) % 7 <> 0 THEN CAST(elevation_ft AS DOUBLE) END AS elev_ft FROM v7_stations""", "v7_stations")
add("station_request", f"""
SELECT s.site, s.site_name, CAST(CAST(o.time AS DATE) AS TIMESTAMP) AS time, arg_max(o.value, o.time) FILTER (WHERE variable = 'AIR TEMP') AS air_temp,
       arg_max(o.value, o.time) FILTER (WHERE variable = 'SWE') AS swe
FROM v1_obs o JOIN v7_stations s ON o.site = s.site
WHERE o.variable IN ('AIR TEMP', 'SWE') AND CAST(o.time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND s.site IN (SELECT site FROM {IN_BASIN} i)
GROUP BY 1, 2, 3""", "v1_obs", "v7_stations", "v8_edges")

add("open_dataset", f"""
SELECT {CELL}, ppt, round((tmax + tmin) / 2, 6) AS tmean, CAST(NULL AS DOUBLE) AS t2c FROM v2_grid
WHERE product = 'ORNL' AND day BETWEEN DATE '1995-11-22' AND DATE '1996-02-06'
UNION ALL
SELECT {CELL}, ppt, NULL, round(t2 - CAST(273.15 AS DOUBLE), 6) FROM v2_grid WHERE product = 'WRF' AND day BETWEEN DATE '1999-10-31' AND DATE '1999-11-13'""", "v2_grid")
add("cube_roundtrip", f"SELECT {CELL}, ppt, CAST(year(day) AS INT) AS year FROM v2_grid", "v2_grid")
add("store_replace", f"""
SELECT {CELL}, CASE product WHEN 'ORNL' THEN ppt * 2 ELSE ppt END AS ppt, CAST(year(day) AS INT) AS year FROM v2_grid
WHERE product <> 'ORNL' OR day >= DATE '1995-01-01'""", "v2_grid")
add("store_merge", f"""
SELECT {CELL}, CASE WHEN year(day) = 1995 AND month(day) = 3 THEN ppt + 1 ELSE ppt END AS ppt,
       concat(product, '_', scenario, '_', strftime(day, '%Y%m')) AS load, CAST(year(day) AS INT) AS year FROM v2_grid""", "v2_grid")
add("basin_rollup", """
SELECT g.product, g.day, sum(p) AS total, round(avg(p), 6) AS mean
FROM (SELECT product, day, y, x, CASE WHEN year(day) = 1995 AND month(day) = 3 THEN ppt + 1 ELSE ppt END AS p FROM v2_grid) g
JOIN v10_basin b ON g.y = b.y AND g.x = b.x GROUP BY 1, 2""", "v2_grid", "v10_basin")
STORE = "(SELECT *, 'daily' AS frequency, CASE WHEN product = 'PRISM' THEN '4km' ELSE '9km' END AS resolution, CASE WHEN day >= DATE '1998-01-01' THEN tmax END AS late_tmax FROM v2_grid)"
add("open_store", f"""
SELECT {CELL}, frequency, resolution, ppt, late_tmax AS tmax FROM {STORE} s
WHERE product IN ('PRISM', 'ORNL') AND day BETWEEN DATE '1995-11-22' AND DATE '2000-02-06'""", "v2_grid")
add("event_slices_store", f"""
SELECT f.form, w.event, {CELL}, ppt FROM v2_grid g JOIN v9_events_win w ON g.day BETWEEN w.start_day AND w.end_day
CROSS JOIN (VALUES ('list'), ('table')) f(form)""", "v2_grid", "v9_events_win")
add("text_grid", """
SELECT s.product, s.scenario, s.day, CAST(l.yy - e.y0 AS INT) AS line_no,
       CASE WHEN l.yy > e.y1 THEN '' ELSE string_agg(coalesce(printf('%.2f', g.t2), 'nan'), ' ' ORDER BY l.xx) END AS line
FROM (SELECT DISTINCT product, scenario, day FROM v2_grid) s
CROSS JOIN (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v2_grid) e
CROSS JOIN (SELECT * FROM (SELECT unnest(generate_series(min(y), max(y) + 1)) AS yy FROM v2_grid) a CROSS JOIN (SELECT unnest(generate_series(min(x), max(x))) AS xx FROM v2_grid) b) l
LEFT JOIN v2_grid g ON g.product = s.product AND g.scenario = s.scenario AND g.day = s.day AND g.y = l.yy AND g.x = l.xx
GROUP BY 1, 2, 3, l.yy, e.y0, e.y1""", "v2_grid")

add("hrrr_cube", f"""
SELECT m.time, m.y, m.x, m.lon360 - 360 AS lon, m.lat, CASE WHEN b.y IS NOT NULL THEN round(m.t, 6) END AS t, CASE WHEN b.y IS NOT NULL THEN round(m.r2, 6) END AS r2,
       CASE WHEN b.y IS NOT NULL THEN round(m.tp, 6) END AS tp, CASE WHEN b.y IS NOT NULL THEN round(m.max_10si, 6) END AS max_10si
FROM {HRRR_MERGED} m LEFT JOIN v4_basin b ON m.y = b.y AND m.x = b.x
WHERE m.time BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-24 00:00:00'
AND m.lon360 BETWEEN 237.7 AND 239.6 AND m.lat BETWEEN 47.4 AND 49.1""", "v4_hrrr_raw", "v4_basin")
add("wrf_cube", """
SELECT f.time, f.y, f.x, c.lat, c.lon, c.hgt, CASE WHEN b.y IS NOT NULL THEN round(f.rainc, 6) END AS rainc, CASE WHEN b.y IS NOT NULL THEN round(f.rainnc, 6) END AS rainnc
FROM v3_wrf f LEFT JOIN v5_cells c ON f.y = c.y AND f.x = c.x LEFT JOIN v10_basin b ON f.y = b.y AND f.x = b.x""", "v3_wrf", "v5_cells", "v10_basin")


def raster(product: str, rain: str, time: str, extra: str) -> str:
    known = lambda c: f"CASE WHEN g.{c} <> 50 THEN g.{c} END"
    return f"""
SELECT {time}, g.y, g.x, c.lat, c.lon, {known('ppt')} AS {rain}, round({known('tmax')}, 6) AS tmax, round({known('tmin')}, 6) AS tmin{extra}
FROM (SELECT product, day, y, x, sum(ppt) AS ppt, max(tmax) AS tmax, min(tmin) AS tmin FROM v2_grid GROUP BY 1, 2, 3, 4) g
JOIN v5_cells c ON g.y = c.y AND g.x = c.x JOIN v10_basin b ON g.y = b.y AND g.x = b.x
WHERE g.product = '{product}'"""


R = ("v2_grid", "v5_cells", "v10_basin")
add("prism_cube", raster("PRISM", "ppt", "g.day AS time", ""), *R)
add("ornl_cube", raster("ORNL", "prcp", "g.day AS time", ", round((CASE WHEN g.tmax <> 50 THEN g.tmax END + CASE WHEN g.tmin <> 50 THEN g.tmin END) / 2, 6) AS tmean"), *R)
add("pnnl_cube", """
SELECT g.scenario, g.time, g.y, g.x, CASE WHEN p > 2 THEN p END AS prec_acc_nc, CASE WHEN u > 2 THEN round(u, 6) END AS u10,
       CASE WHEN w > 2 THEN round(w, 6) END AS v10, c.lat, c.lon, c.landmask
FROM (SELECT scenario, day AS time, y, x, sum(ppt) AS p, max(u10) AS u, max(v10) AS w FROM v2_grid GROUP BY 1, 2, 3, 4) g
JOIN v10_basin b ON g.y = b.y AND g.x = b.x JOIN v5_cells c ON g.y = c.y AND g.x = c.x WHERE p > 2 OR u > 2 OR w > 2""", *R)
CHOSEN = f"""o AS (SELECT * FROM v1_obs WHERE variable IN ('AIR TEMP', 'PRECIPITATION', 'SNOWDEPTH')
  AND CAST(time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND site IN (SELECT site FROM {IN_BASIN} i))"""
add("snotel_cube", """
SELECT s.site, h.time, r.air_temp, r.precipitation, r.snowdepth, st.site_name, st.lat, st.lon, st.elevation_ft
FROM (SELECT DISTINCT site FROM o) s CROSS JOIN (SELECT DISTINCT CAST(CAST(time AS DATE) AS TIMESTAMP) AS time FROM o) h
JOIN v7_stations st ON s.site = st.site
LEFT JOIN (SELECT site, CAST(CAST(time AS DATE) AS TIMESTAMP) AS time, arg_max(value, o.time) FILTER (WHERE variable = 'AIR TEMP') AS air_temp,
             arg_max(value, o.time) FILTER (WHERE variable = 'PRECIPITATION') AS precipitation, arg_max(value, o.time) FILTER (WHERE variable = 'SNOWDEPTH') AS snowdepth
      FROM o GROUP BY 1, 2) r ON s.site = r.site AND h.time = r.time""", "v1_obs", "v7_stations", "v8_edges", extra=CHOSEN)
add("storm_map", """
SELECT variable, y, x, day, round(value, 6) AS value, round(min(value) OVER (PARTITION BY variable), 6) AS low, round(max(value) OVER (PARTITION BY variable), 6) AS high
FROM (SELECT 'tp' AS variable, y, x, day, CASE WHEN value > 0 THEN value END AS value
      FROM (SELECT y, x, CAST(time AS DATE) AS day, coalesce(sum(tp), 0) AS value FROM v4_hrrr_raw GROUP BY 1, 2, 3) a
      UNION ALL
      SELECT 't_c', y, x, CAST(time AS DATE), avg(t - CAST(273.15 AS DOUBLE)) FROM v4_hrrr_raw WHERE step_h = 0 GROUP BY 1, 2, 3, 4) t
WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'""", "v4_hrrr_raw")
