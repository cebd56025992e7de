"""Weather-shaped views of the driver tables (FIXTURES.md B), as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.functions import times
from rainshed.operators import geo, running, sizing

RING = [(-122.3, 47.4), (-120.6, 47.45), (-120.4, 48.9), (-121.3, 48.3), (-122.1, 49.1), (-122.3, 47.4)]
WINDOWS = [
    ("1995", "1995-11-22", "1995-12-06"),
    ("1997", "1997-10-14", "1997-10-28"),
    ("1999", "1999-10-31", "1999-11-13"),
    ("2001", "2001-01-01", "2001-02-01"),
    ("2024", "2024-01-10", "2024-01-20"),
]


# given schemas spare a pass over the file footers
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _int(c) -> F.Column:
    return c.cast("int")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    variable = (
        F.when(kind == "click", "AIR TEMP").when(kind == "view", "PRECIPITATION").when(kind == "error", "SNOWDEPTH")
        .when(kind == "signup", "SWE").otherwise("ACCUMULATED PRECIPITATION")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("site"), F.col("ts").alias("time"), variable.alias("variable"), "value"
    )


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the grid view before they are put together by cell and day."""
    flag, supp = F.col("l_returnflag"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", "PRISM").when(flag == "N", "ORNL").otherwise("WRF").alias("product"),
        F.col("l_linestatus").alias("scenario"),
        F.to_date("l_shipdate").alias("day"),
        _int(F.floor(supp / 10)).alias("y"),
        _int(supp % 10).alias("x"),
        "l_quantity", "l_discount", "l_tax",
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["product", "scenario", "day", "y", "x"]
    return (
        sizing.spread(grid_rows(spark, sf), keys, table(spark, sf, "lineitem"))
        .groupBy(*keys)
        .agg(
            F.sum("l_quantity").alias("ppt"),
            (F.lit(260.0) + F.lit(400.0) * F.max("l_discount")).alias("t2"),
            (F.lit(10.0) + F.lit(100.0) * F.max("l_discount")).alias("tmax"),
            (F.lit(100.0) * F.min("l_discount")).alias("tmin"),
            (F.lit(100.0) * F.max("l_discount")).alias("u10"),
            (F.lit(100.0) * F.max("l_tax")).alias("v10"),
            (F.lit(0.001) + F.lit(0.05) * F.max("l_tax")).alias("q2"),
            (F.lit(90000.0) + F.max("l_quantity") * 100).alias("psfc"),
        )
    )


def wrf(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    hourly = table(spark, sf, "events").groupBy(
        times.floor_hour("ts").alias("time"), _int(F.floor(user / 10)).alias("y"), _int(user % 10).alias("x")
    ).agg(F.sum("value").alias("v"))
    rain = running.running_totals(hourly, ["y", "x"], {"rainnc": "v", "rainc": F.col("v") / 10}, chunk="month")
    return rain.select("time", "y", "x", "rainnc", "rainc")


def hrrr_raw(spark: SparkSession, sf: str) -> DataFrame:
    user, now = F.col("user_id"), F.col("event_type").isin("click", "view")
    return (
        table(spark, sf, "events")
        .groupBy(
            times.floor_hour("ts").alias("time"),
            F.when(now, 0).otherwise(1).alias("step_h"),
            _int(F.floor(user / 10)).alias("y"),
            _int(user % 10).alias("x"),
            (F.lit(237.5) + F.lit(0.25) * (user % 10)).alias("lon360"),
            (F.lit(47.5) + F.lit(0.125) * F.floor(user / 10)).alias("lat"),
        )
        .agg(
            F.max(F.lit(260.0) + F.col("value") / 10).alias("t"),
            F.max(F.col("value") / 5).alias("r2"),
            F.max(F.col("value") / 50).alias("max_10si"),
            F.max(F.when(~now, F.col("value") / 100)).alias("tp"),
        )
    )


def hrrr_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The static grid of the forecast view: one row per user."""
    user = F.col("user_id")
    return table(spark, sf, "events").select(
        _int(F.floor(user / 10)).alias("y"), _int(user % 10).alias("x"),
        (F.lit(-122.5) + F.lit(0.25) * (user % 10)).alias("lon"),
        (F.lit(47.5) + F.lit(0.125) * F.floor(user / 10)).alias("lat"),
    ).distinct()


def cells(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        _int(F.floor(key / 10)).alias("y"), _int(key % 10).alias("x"),
        (F.lit(-122.5) + F.lit(0.25) * (key % 10)).alias("lon"),
        (F.lit(47.5) + F.lit(0.1875) * F.floor(key / 10)).alias("lat"),
        F.col("s_acctbal").alias("hgt"),
        F.when(F.col("s_nationkey") % 5 == 0, 0).otherwise(1).alias("landmask"),
    )


def dem(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lit(1).alias("band"), _int(F.floor(key / 40)).alias("iy"), _int(key % 40).alias("ix"),
        (F.lit(-122.5) + F.lit(0.0625) * (key % 40)).alias("x"),
        (F.lit(47.5) + F.lit(0.03125) * F.floor(key / 40)).alias("y"),
        F.col("p_retailprice").alias("elevation"),
    )


def dem_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Two bands; the second lacks some cells."""
    key = F.col("p_partkey")
    second = table(spark, sf, "part").select(
        F.lit(2).alias("band"), _int(F.floor(key / 40)).alias("iy"), _int(key % 40).alias("ix"),
        (F.lit(-122.5) + F.lit(0.0625) * (key % 40)).alias("x"),
        (F.lit(47.5) + F.lit(0.03125) * F.floor(key / 40)).alias("y"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") + F.col("p_size")).alias("elevation"),
    )
    return dem(spark, sf).unionByName(second)


def stations(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().select(
        user.cast("string").alias("site"),
        F.concat(F.lit("Site "), (user % 100).cast("string")).alias("site_name"),
        (F.lit(-122.5) + ((user * 37) % 160) / F.lit(64.0)).alias("lon"),
        (F.lit(47.5) + ((user * 53) % 128) / F.lit(64.0)).alias("lat"),
        (F.lit(3000) + (user * 29) % 3000).alias("elevation_ft"),
    )


def edges(spark: SparkSession) -> DataFrame:
    return geo.edges_from_rings(spark, [RING])


def station_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of an area around each station, of its own size and with a notch in the north."""
    x, y, r = F.col("lon"), F.col("lat"), F.lit(0.11) + F.col("elevation_ft") / 9000.0
    corners = [(-1.0, -0.5), (0.0, -1.0), (1.0, -0.5), (1.0, 0.5), (0.0, 0.25), (-1.0, 0.5)]
    point = lambda c: (x + r * c[0], y + r * c[1])
    ring = [F.struct(*[e.alias(n) for n, e in zip(("x1", "y1", "x2", "y2"), (*point(a), *point(b)))])
            for a, b in zip(corners, corners[1:] + corners[:1])]
    return stations(spark, sf).select(F.col("site").alias("feature"), F.inline(F.array(*ring)))


def basin(spark: SparkSession, sf: str) -> DataFrame:
    return geo.basin_cells(cells(spark, sf), edges(spark))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One archive request per customer, for the manifests."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    start = F.date_add(F.lit("2019-08-25").cast("date"), _int(key % 60))
    days = lambda n: F.date_add(start, _int(n))
    return table(spark, sf, "customer").select(
        key.alias("request"),
        F.when(key % 3 == 0, "era5").when(key % 3 == 1, "cesm2_r11i1p1f1_ssp245").otherwise("ec-earth3_r1i1p1f1").alias("model"),
        _int(F.lit(1) + key % 2).alias("data_tier"),
        _int(F.lit(1) + nation % 4).alias("domain"),
        (key % 5 == 0).alias("historical"),
        (key % 7 == 0).alias("bias_corrected"),
        start.cast("string").alias("start_date"),
        days(key % 2).cast("string").alias("end_date"),
        F.when(key % 4 == 0, "Livneh").otherwise("DaymetV4").alias("reference"),
        F.lit("VIC4").alias("hydro_model"),
        F.when(key % 9 == 0, "CNRM-ESM2-1").when(key % 9 == 1, "EC-Earth3").when(key % 9 == 2, "NoSuchModel").alias("gcm"),
        F.when(key % 9 <= 2, "ssp585").alias("climate_scenario"),
        F.when(key % 9 <= 2, "DBCCA").alias("downscaling"),
        _int(F.lit(1945) + key % 160).alias("start_year"),
        _int(F.lit(1947) + key % 160).alias("end_year"),
    )


VIEWS = {
    "v1_obs": """
SELECT CAST(user_id AS STRING) AS site, ts AS time,
       CASE event_type WHEN 'click' THEN 'AIR TEMP' WHEN 'view' THEN 'PRECIPITATION' WHEN 'error' THEN 'SNOWDEPTH'
                       WHEN 'signup' THEN 'SWE' ELSE 'ACCUMULATED PRECIPITATION' END AS variable,
       value
FROM events""",
    "v2_grid": """
SELECT CASE l_returnflag WHEN 'A' THEN 'PRISM' WHEN 'N' THEN 'ORNL' ELSE 'WRF' END AS product,
       l_linestatus AS scenario, CAST(l_shipdate AS DATE) AS day,
       CAST(floor(l_suppkey / 10) AS INT) AS y, CAST(l_suppkey % 10 AS INT) AS x,
       sum(l_quantity) AS ppt, 260 + 400 * max(l_discount) AS t2,
       10 + 100 * max(l_discount) AS tmax, 100 * min(l_discount) AS tmin,
       100 * max(l_discount) AS u10, 100 * max(l_tax) AS v10,
       0.001 + 0.05 * max(l_tax) AS q2, 90000 + max(l_quantity) * 100 AS psfc
FROM lineitem
GROUP BY 1, 2, 3, 4, 5""",
    "v3_wrf": """
SELECT time, y, x, sum(v) OVER (PARTITION BY y, x ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rainnc,
       sum(v / 10) OVER (PARTITION BY y, x ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rainc
FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, CAST(floor(user_id / 10) AS INT) AS y,
             CAST(user_id % 10 AS INT) AS x, sum(value) AS v
      FROM events GROUP BY 1, 2, 3) h""",
    "v4_hrrr_raw": """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS step_h,
       CAST(floor(user_id / 10) AS INT) AS y, CAST(user_id % 10 AS INT) AS x,
       CAST(237.5 + 0.25 * (user_id % 10) AS DOUBLE) AS lon360, CAST(47.5 + 0.125 * floor(user_id / 10) AS DOUBLE) AS lat,
       max(260 + value / 10) AS t, max(value / 5) AS r2, max(value / 50) AS max_10si,
       max(CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE value / 100 END) AS tp
FROM events
GROUP BY 1, 2, 3, 4, 5, 6""",
    "v5_cells": """
SELECT CAST(floor(s_suppkey / 10) AS INT) AS y, CAST(s_suppkey % 10 AS INT) AS x,
       CAST(-122.5 + 0.25 * (s_suppkey % 10) AS DOUBLE) AS lon, CAST(47.5 + 0.1875 * floor(s_suppkey / 10) AS DOUBLE) AS lat,
       s_acctbal AS hgt, CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE 1 END AS landmask
FROM supplier""",
    "v6_dem": """
SELECT 1 AS band, CAST(floor(p_partkey / 40) AS INT) AS iy, CAST(p_partkey % 40 AS INT) AS ix,
       CAST(-122.5 + 0.0625 * (p_partkey % 40) AS DOUBLE) AS x, CAST(47.5 + 0.03125 * floor(p_partkey / 40) AS DOUBLE) AS y, p_retailprice AS elevation
FROM part""",
    "v6_bands": """
SELECT * FROM v6_dem
UNION ALL
SELECT 2, CAST(floor(p_partkey / 40) AS INT), CAST(p_partkey % 40 AS INT),
       CAST(-122.5 + 0.0625 * (p_partkey % 40) AS DOUBLE), CAST(47.5 + 0.03125 * floor(p_partkey / 40) AS DOUBLE),
       CASE WHEN p_size % 3 <> 0 THEN p_retailprice + p_size END
FROM part""",
    "v7_stations": """
SELECT DISTINCT CAST(user_id AS STRING) AS site, concat('Site ', CAST(user_id % 100 AS STRING)) AS site_name,
       CAST(-122.5 + ((user_id * 37) % 160) / 64.0 AS DOUBLE) AS lon, CAST(47.5 + ((user_id * 53) % 128) / 64.0 AS DOUBLE) AS lat,
       3000 + (user_id * 29) % 3000 AS elevation_ft
FROM events""",
    "v8_edges": """
SELECT CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2
FROM (VALUES (-122.3, 47.4, -120.6, 47.45), (-120.6, 47.45, -120.4, 48.9), (-120.4, 48.9, -121.3, 48.3),
                      (-121.3, 48.3, -122.1, 49.1), (-122.1, 49.1, -122.3, 47.4)) AS e(x1, y1, x2, y2)""",
    "v8_areas": """
SELECT site, lon + r * a AS x1, lat + r * b AS y1, lon + r * c AS x2, lat + r * d AS y2
FROM (SELECT site, lon, lat, 0.11::DOUBLE + elevation_ft / 9000.0::DOUBLE AS r FROM v7_stations) s
CROSS JOIN (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d
            FROM (VALUES (-1, -0.5, 0, -1), (0, -1, 1, -0.5), (1, -0.5, 1, 0.5), (1, 0.5, 0, 0.25), (0, 0.25, -1, 0.5),
                         (-1, 0.5, -1, -0.5)) AS t(a, b, c, d)) e""",
    "v9_events_win": """
SELECT * FROM (VALUES ('1995', DATE '1995-11-22', DATE '1995-12-06'), ('1997', DATE '1997-10-14', DATE '1997-10-28'),
                      ('1999', DATE '1999-10-31', DATE '1999-11-13'), ('2001', DATE '2001-01-01', DATE '2001-02-01'),
                      ('2024', DATE '2024-01-10', DATE '2024-01-20')) AS w(event, start_day, end_day)""",
}


def inside_sql(points: str, key: str) -> str:
    """Points strictly inside the polygon of v8_edges."""
    return f"""
SELECT {key} FROM (
  SELECT {', '.join('c.' + k for k in key.split(', '))},
         sum(CASE WHEN (e.y1 > c.lat) <> (e.y2 > c.lat)
                   AND c.lon < (e.x2 - e.x1) * (c.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END) AS crossings,
         max(CASE WHEN abs((e.x2 - e.x1) * (c.lat - e.y1) - (e.y2 - e.y1) * (c.lon - e.x1)) < 1e-12
                   AND c.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                   AND c.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) THEN 1 ELSE 0 END) AS on_edge
  FROM {points} c CROSS JOIN v8_edges e GROUP BY {', '.join('c.' + k for k in key.split(', '))}) t
WHERE crossings % 2 = 1 AND on_edge = 0"""


VIEWS["v10_basin"] = inside_sql("v5_cells", "y, x")
VIEWS["v4_cells"] = """
SELECT DISTINCT y, x, lon360 - 360 AS lon, lat FROM v4_hrrr_raw"""
VIEWS["v4_basin"] = inside_sql("v4_cells", "y, x")
VIEWS["v11_requests"] = """
SELECT c_custkey AS request,
       CASE WHEN c_custkey % 3 = 0 THEN 'era5' WHEN c_custkey % 3 = 1 THEN 'cesm2_r11i1p1f1_ssp245' ELSE 'ec-earth3_r1i1p1f1' END AS model,
       CAST(1 + c_custkey % 2 AS INT) AS data_tier, CAST(1 + c_nationkey % 4 AS INT) AS domain,
       c_custkey % 5 = 0 AS historical, c_custkey % 7 = 0 AS bias_corrected,
       DATE '2019-08-25' + CAST(c_custkey % 60 AS INT) AS start_date,
       DATE '2019-08-25' + CAST(c_custkey % 60 + c_custkey % 2 AS INT) AS end_date,
       CASE WHEN c_custkey % 4 = 0 THEN 'Livneh' ELSE 'DaymetV4' END AS reference, 'VIC4' AS hydro_model,
       CASE c_custkey % 9 WHEN 0 THEN 'CNRM-ESM2-1' WHEN 1 THEN 'EC-Earth3' WHEN 2 THEN 'NoSuchModel' END AS gcm,
       CASE WHEN c_custkey % 9 <= 2 THEN 'ssp585' END AS climate_scenario,
       CASE WHEN c_custkey % 9 <= 2 THEN 'DBCCA' END AS downscaling,
       CAST(1945 + c_custkey % 160 AS INT) AS start_year, CAST(1947 + c_custkey % 160 AS INT) AS end_year
FROM customer"""

ORDER = [
    "v1_obs", "v2_grid", "v3_wrf", "v4_hrrr_raw", "v5_cells", "v6_dem", "v6_bands", "v7_stations", "v8_edges", "v8_areas",
    "v9_events_win", "v10_basin", "v4_cells", "v4_basin", "v11_requests",
]
NEEDS = {
    "v6_bands": ["v6_dem"],
    "v8_areas": ["v7_stations"],
    "v10_basin": ["v5_cells", "v8_edges"],
    "v4_cells": ["v4_hrrr_raw"],
    "v4_basin": ["v4_cells", "v4_hrrr_raw", "v8_edges"],
}


def with_views(sql: str, *names: str) -> str:
    """The SQL under a WITH chain of the views it names."""
    wanted = set(names)
    for name in names:
        wanted.update(NEEDS.get(name, []))
    chain = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in ORDER if v in wanted)
    return f"WITH {chain}\n{sql.strip()}"
