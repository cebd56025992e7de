import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from rainshed import schema
from rainshed.operators import geo
from rainshed.plans import cubes
from rainshed.sources import catalog, geojson, inventory, manifests, textgrid


def paths(df, column="path"):
    return [r[column] for r in df.orderBy(column).collect()]


def test_wrf_manifest(spark):
    files = manifests.wrf_files(manifests.wrf_request(spark, "era5", "2019-09-30", "2019-10-01", historical=True, bias_corrected=True))
    got = paths(files)
    root = "downscaled_products/reanalysis/era5_historical_bc/hourly"
    assert len(got) == 25
    assert got[0] == f"{root}/2018/d02/auxhist_d01_2019-09-30_00:00:00" and got[-1] == f"{root}/2019/d02/auxhist_d01_2019-10-01_00:00:00"
    assert manifests.wrf_files(manifests.wrf_request(spark, "m", "2019-09-30", "2019-10-01", data_tier=1), include_end=False).count() == 24
    assert files.select(manifests.local_wrf_name("path").alias("p")).orderBy("p").first()[0] == "era5_historical_bc_auxhist_d01_2019-09-30_00-00-00.nc"
    with pytest.raises(ValueError):
        manifests.wrf_request(spark, "m", "2020-01-02", "2020-01-01")
    with pytest.raises(ValueError):
        manifests.wrf_request(spark, "m", "2020-01-01", "2020-01-02", data_tier=3)
    bad = manifests.wrf_request(spark, "m", "2020-01-01", "2020-01-02").withColumn("data_tier", F.lit(3))
    with pytest.raises(Exception, match="unknown data tier 3"):
        manifests.wrf_files(bad).collect()


def test_ornl_manifest(spark):
    request = manifests.ornl_request
    reference = paths(manifests.ornl_files(request(spark, ["prcp"], 1948, 1951)), "url")
    assert reference == [f"{schema.ORNL_ROOT}/DaymetV4/prcp/DaymetV4_VIC4_prcp_{y}.nc" for y in (1950, 1951)]
    model = paths(manifests.ornl_files(request(spark, ["tmax"], 2098, 2101, gcm="CNRM-ESM2-1", climate_scenario="ssp585", downscaling="DBCCA")), "url")
    run = "CNRM-ESM2-1_ssp585_r1i1p1f2_DBCCA_Daymet"
    assert model == [f"{schema.ORNL_ROOT}/{run}/tmax/{run}_VIC4_tmax_{y}.nc" for y in (2098, 2099)]
    unknown = request(spark, ["tmax"], 2000, 2001, gcm="NOPE", climate_scenario="ssp585", downscaling="DBCCA")
    assert manifests.ornl_files(unknown).isEmpty()
    mixed = request(spark, ["prcp"], 2018, 2019, gcm="CNRM-ESM2-1", climate_scenario="ssp585", downscaling="DBCCA")
    assert [u.split("/")[-3] for u in paths(manifests.ornl_files(mixed, split_year=2019), "url")] == [run, "DaymetV4"]
    local = spark.createDataFrame([("/tmp/x/DaymetV4_VIC4_prcp_2001.nc",)], "p string").select(manifests.ornl_name_to_url("p")).first()[0]
    assert local == f"{schema.ORNL_ROOT}/DaymetV4/prcp/DaymetV4_VIC4_prcp_2001.nc"


@pytest.mark.parametrize("frequency, start, end, keys, legacy", [
    ("daily", "2020-02-28", "2020-03-01", ["20200228", "20200229", "20200301"], None),
    ("monthly", "2020-01", "2020-03", ["202001", "202002", "202003"], ["202001", "202002"]),
    ("annual", "2010", "2012", ["2010", "2011", "2012"], ["2010", "2011"]),
])
def test_prism_manifest(spark, frequency, start, end, keys, legacy):
    request = manifests.prism_request(spark, ["ppt", "tmin"], start, end, frequency)
    files = manifests.prism_files(request, frequency)
    assert sorted({r["date_key"] for r in files.collect()}) == keys and files.count() == 2 * len(keys)
    assert f"/us/4km/ppt/{keys[0]}?format=nc" in paths(files)
    if legacy:
        assert sorted({r["date_key"] for r in manifests.prism_files(request, frequency, legacy_end=True).collect()}) == legacy
    assert keys[0] not in {r["date_key"] for r in manifests.prism_files(request, frequency, include_start=False).collect()}


def test_hrrr_runs(spark):
    runs = manifests.hrrr_runs(manifests.hrrr_request(spark, "2020-03-01", "2020-03-02"))
    assert runs.count() == 25 * 2 and {r["step_h"] for r in runs.collect()} == {0, 1}


def test_inventory(spark):
    lines = [":TMP:surface:anl:", ":TMP:2 m above ground:anl:", "1:TMP:surface", ":APCP:surface:0-1 hour acc fcst:"]
    index = spark.createDataFrame([(line,) for line in lines], "line string")
    assert paths(inventory.search(index, ["TMP", "RH"]), "line") == sorted(lines[:2])
    assert paths(inventory.search(index, schema.HRRR_PARAMETERS), "line") == sorted([lines[0], lines[3]])


def test_arrivals(spark):
    expected = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "model string, path string")
    arrived = spark.createDataFrame([("p1",), ("p1",)], "path string")
    report = {r["model"]: tuple(r)[1:] for r in inventory.arrival_report(expected, arrived, ["model"]).collect()}
    assert report == {"a": (2, 1, 1), "b": (1, 0, 1)}
    assert paths(inventory.missing_files(expected, arrived)) == ["p2", "p3"]
    with pytest.raises(ValueError):
        inventory.require_arrivals(arrived.limit(0))


@pytest.mark.parametrize("frequency, key, day", [("daily", "20200229", dt.date(2020, 2, 29)), ("monthly", "202002", dt.date(2020, 2, 1)), ("annual", "2020", dt.date(2020, 1, 1))])
def test_prism_names(spark, frequency, key, day):
    df = spark.createDataFrame([(f"/x/PRISM_ppt_stable_4kmM3_{key}_bil.nc".replace("_bil", ""),)], "file_name string")
    row = inventory.prism_name_parts(df, frequency=frequency).first()
    assert row["variable"] == "ppt" and row["date"] == day


@pytest.mark.parametrize("name", ["/x/PRISM_ppt_stable_4kmM3_2020.nc", "PRISM_ppt_stable_4kmM3_20201341.nc", "short.nc", None])
def test_prism_names_without_a_date_stop_the_job(spark, name):
    df = spark.createDataFrame([(name,), ("PRISM_ppt_stable_4kmM3_20200101.nc",)], "file_name string")
    assert [r[0] for r in inventory.bad_prism_names(df).collect()] == [name]
    with pytest.raises(Exception, match="no date in the file name"):
        inventory.prism_name_parts(df).collect()


def test_only_rows_of_requested_files_that_arrived(spark):
    paths = lambda *names: spark.createDataFrame([(f"/a/{n}",) for n in names], "path string")
    raw = spark.createDataFrame([(f"/a/{n}", i) for i, n in enumerate(["one", "one", "two", "three"])], "file_path string, v int")
    got = inventory.arrived_rows(raw, paths("one", "two", "four"), paths("one", "three", "four", "one"))
    assert sorted(r.v for r in got.collect()) == [0, 1]
    assert [r.path for r in inventory.files_without_rows(raw, paths("one", "four")).collect()] == ["/a/four"]
    short = raw.select(inventory.last_part(F.col("file_path")).alias("name"), "v")
    got = inventory.arrived_rows(short, paths("one", "two"), paths("one", "three"), name="name", local=inventory.last_part)
    assert sorted(r.v for r in got.collect()) == [0, 1]


def test_files_of_another_model_or_domain_are_kept_out(spark):
    ask = lambda model, domain: manifests.wrf_files(manifests.wrf_request(spark, model, "2020-01-01", "2020-01-01", domain=domain)).select("path")
    wanted, other, inner = ask("era5", 2), ask("cesm2_r11i1p1f1_ssp245", 2), ask("era5", 3)
    assert wanted.select(inventory.last_part(F.col("path"))).first() == other.select(inventory.last_part(F.col("path"))).first()
    raw = wanted.union(other).union(inner).withColumnRenamed("path", "file_path")
    got = {r.file_path for r in inventory.arrived_rows(raw, wanted, wanted.union(other).union(inner)).collect()}
    assert got == {r.path for r in wanted.collect()} and len(got) == 1


def test_an_unreadable_file_is_reported_and_the_rest_read(spark, tmp_path):
    for k in range(10):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k} x+y"))
    files = [str(p.relative_to(tmp_path)) for p in sorted((tmp_path / "in").rglob("part-*.parquet"))]
    (tmp_path / files[3]).write_bytes(b"PAR1 not a file")
    rows = inventory.read_arrived(spark, str(tmp_path), files, "id bigint").persist()
    assert sorted(r.id for r in rows.collect()) == [i for i in range(100) if i // 10 != 3]
    listing = spark.createDataFrame([(f,) for f in files], "path string")
    assert [r.path for r in inventory.files_without_rows(rows, listing).collect()] == [files[3]]


def test_download_plan(spark):
    lines = [
        ("a", 0, ":TMP:surface:x"), ("a", 100, ":RH:2 m above ground:x"), ("a", 250, ":TMP:surface:y"), ("a", 300, ":TMP:surface:z"),
        ("a", 300, ":UGRD:10 m:z"), ("a", 420, ":WIND:10 m:x"), ("a", 500, ":TMP:surface:last"), ("b", 7, ":UGRD:10 m"), ("b", 9, None),
        ("c", 5, ":VGRD:z"), ("c", 5, ":TMP:surface:c"), ("c", 8, ":VGRD:z"),
    ]
    index = spark.createDataFrame(lines, "file string, offset bigint, line string").repartition(3)
    got = sorted((r.file, r.first_byte, r.last_byte, r.messages, r.lines) for r in inventory.download_plan(index, {"TMP": "surface"}).collect())
    assert got == [
        ("a", 0, 99, 1, [":TMP:surface:x"]), ("a", 250, 419, 2, [":TMP:surface:y", ":TMP:surface:z"]),
        ("a", 500, None, 1, [":TMP:surface:last"]), ("c", 5, 7, 1, [":TMP:surface:c"]),
    ]
    assert inventory.download_plan(index.limit(0), ["TMP"]).count() == 0


def test_appended_variables_are_read_whatever_the_file_names(spark, tmp_path):
    path = str(tmp_path / "cube")
    for k in range(4):
        rows = spark.createDataFrame([("PRISM", dt.datetime(2000 + k, 1, 1), 1.0)], f"product string, time timestamp_ntz, v{k} double")
        catalog.write_cube(rows, path, "append")
    assert {"v0", "v1", "v2", "v3"} <= set(catalog.read_cube(spark, path).columns)
    assert catalog.read_cube(spark, path, schema="product string, time timestamp_ntz, v2 double, year int").columns == ["time", "v2", "product", "year"]


def test_open_dataset_refuses_what_the_store_does_not_tell_apart(spark):
    df = spark.createDataFrame([("PRISM", dt.datetime(2000, 1, 1))], "product string, time timestamp_ntz")
    for asked in ({"frequency": "monthly"}, {"resolution": "800m"}):
        with pytest.raises(ValueError, match="no column"):
            catalog.open_dataset(df, ("2000-01-01", "2000-02-01"), "prism", **asked)


POINTS = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": "High Meadow", "id": "1:XX:SNTL", "datasource": "NRCS"}, "geometry": {"type": "Point", "coordinates": [-121.25, 48.5, 3600.0]}},
    {"type": "Feature", "properties": {"name": "Bare", "id": "2:XX:SNTL", "datasource": "NRCS"}, "geometry": {"type": "Point", "coordinates": []}},
]}
SHAPES = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 5], [4, 0, 5], [4, 4, 5], [0, 4, 5], [0, 0, 5]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
    {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[10, 10], [12, 10], [11, 12], [10, 10]]], [[[20, 20], [21, 20], [20, 21], [20, 20]]]]}},
]}


def test_geojson(spark, tmp_path):
    (tmp_path / "stations.json").write_text(json.dumps(POINTS, indent=1))
    (tmp_path / "shapes.json").write_text(json.dumps(SHAPES, indent=1))
    rows = [tuple(r) for r in geojson.read_stations(spark, str(tmp_path / "stations.json")).collect()]
    assert rows == [("1:XX:SNTL", "High Meadow", "NRCS", -121.25, 48.5, 3600.0), ("2:XX:SNTL", "Bare", "NRCS", None, None, None)]
    flat = spark.sql("SELECT array(1D, 2D, 3D) AS c UNION ALL SELECT array()").select(geojson.without_z("c")).collect()
    assert sorted(r[0] for r in flat) == [[], [1.0, 2.0]]
    edges = geojson.read_edges(spark, str(tmp_path / "shapes.json"))
    assert {r["feature"]: r["count"] for r in edges.groupBy("feature").count().collect()} == {0: 7, 1: 6}
    assert geo.total_bounds(edges) == geo.Bounds(0.0, 21.0, 0.0, 21.0)
    assert geo.total_bounds(edges.filter("feature = 0")) == geo.Bounds(0.0, 4.0, 0.0, 4.0)
    lines = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(SHAPES["features"])], "feature int, value string")
    assert geojson.edges_from_lines(lines).exceptAll(edges).isEmpty()
    probe = spark.createDataFrame([(0, 3.0, 1.0), (1, 1.7, 1.3), (2, 11.0, 10.5)], "id int, lon double, lat double")
    assert sorted(r["id"] for r in geo.points_inside(probe, edges, ["id"], feature=None).collect()) == [0, 2]


def test_cube_names():
    assert catalog.cube_name("PRISM", "2020-01-01", "2020-01-08", "daily", "800m") == "2020-01-01_2020-01-08_daily_800m_PRISM_data"
    assert catalog.cube_name("SNOTEL", "a", "b", "", "") == "a_b_SNOTEL_data"
    assert catalog.ornl_cube_name("1980", "1981") == "1980_1981_ref_DaymetV4_ORNL_data"
    assert catalog.ornl_cube_name("2020", "2021", gcm="G", climate_scenario="s", downscaling="D") == "2020_2021_G_s_D_ORNL_data"


def test_write_modes_and_pruning(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = [("PRISM", dt.datetime(1999 + i % 3, 1, 1), i, float("nan") if i == 0 else float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "product string, time timestamp_ntz, y int, ppt double")
    catalog.write_cube(df, path)
    with pytest.raises(Exception, match="(?i)exist"):
        catalog.write_cube(df, path)
    catalog.write_cube(df.withColumn("product", F.lit("ORNL")), path, "append")
    assert sorted(os.path.basename(p) for p in glob.glob(f"{path}/product=PRISM/*")) == ["year=1999", "year=2000", "year=2001"]
    cube = catalog.read_cube(spark, path)
    assert cube.count() == 18 and cube.filter("ppt IS NULL").count() == 2
    opened = catalog.open_dataset(cube, ("2000-01-01", "2000-12-31"), "prism")
    assert opened.count() == 3
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(time" in plan
    catalog.write_cube(df, path, "overwrite")
    assert catalog.read_cube(spark, path).count() == 9
    with pytest.raises(ValueError):
        catalog.write_cube(df, path, "replace")


def test_derived_columns_only_where_possible(spark):
    df = spark.createDataFrame([(32.0, 1000.0)], "`AIR TEMP` double, elevation_ft double")
    row = catalog.derive(df, "SNOTEL").first()
    assert row["T2C"] == 0.0 and row["elevation_m"] == pytest.approx(304.8) and "AVG_T2C" not in row.asDict()
    wrf = spark.createDataFrame([(1.0, 2.0, 273.15)], "RAINC double, RAINNC double, T2 double")
    assert catalog.derive(wrf, "wrf_era5").first()["PRCP"] == 3.0 and "PRCP" not in catalog.derive(wrf, "pnnl").columns


def test_text_grid(spark, tmp_path):
    t = dt.datetime(2020, 1, 1, 3)
    rows = [(t, 0, 0, 1.0), (t, 0, 2, 0.125), (t, 2, 1, -3.456)]
    lines = textgrid.text_grid(spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, v double"), "v")
    expected = ["1.00 nan 0.12", "nan nan nan", "nan -3.46 nan", ""]
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == expected
    path = textgrid.write_text_grid(lines, str(tmp_path / "out"))
    written = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/year=2020/*.txt")))
    assert written.split("\n")[:4] == expected
    back = textgrid.read_text_grid(spark, path).orderBy("year", "file", "place").collect()
    assert [r["line"] for r in back] == expected


def test_lines_of_a_step_are_not_looked_up_in_a_map(spark):
    """A step of many lines, most of them known: a look-up in a map takes time with the square of them."""
    df = spark.range(6000).filter("id % 3 > 0").selectExpr("DATE '2000-01-01' AS time", "CAST(id + 5 AS INT) AS y", "1 AS x", "id / 4D AS v")
    lines = textgrid.text_grid(df, "v", cells=spark.sql("SELECT 3 AS y, 0 AS x UNION ALL SELECT 6010, 2"))
    assert "map_from_entries" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = {r.line_no: r.line for r in lines.collect()}
    known = {k + 2: f"nan {k / 4:.2f} nan" for k in range(6000) if k % 3}
    assert got == {n: "nan nan nan" for n in range(6008)} | known | {6008: ""} and lines.count() == 6009
    with pytest.raises(Exception, match="without a grid row"):
        textgrid.text_grid(df.withColumn("y", F.expr("nullif(y, 8)")).unionByName(df.limit(1).withColumn("y", F.lit(None).cast("int"))), "v").collect()


def test_text_grids_of_many_steps_stay_in_order(spark, tmp_path):
    rows = [(dt.datetime(2019 + i // 12, 1 + i % 12, 1), p, y, x, float(i + 100 * y + x)) for i in range(36) for p in ("a", "b") for y in (0, 1) for x in (0, 1)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, p string, y int, x int, v double").repartition(5)
    cells = spark.createDataFrame([(0, 0), (1, 2)], "y int, x int")
    lines = textgrid.text_grid(df, "v", ["p", "time"], cells=cells)
    path = textgrid.write_text_grid(lines, str(tmp_path / "out"), ["p", "time"])
    back = textgrid.read_text_grid(spark, path).orderBy("p", "year", "file", "place").collect()
    assert [r["line"] for r in back] == [r["line"] for r in lines.orderBy("p", "time", "line_no").collect()]
    assert len(back) == 36 * 2 * 3 and all(r["line"].endswith(" nan") for r in back if r["line"])


def test_station_request(spark):
    t = dt.datetime(2020, 1, 1)
    obs = spark.createDataFrame([("1", t, "SWE", 1.0), ("2", t, "SWE", 2.0), ("1", t, "X", 3.0)], "site string, time timestamp_ntz, variable string, value double")
    assert [r["value"] for r in catalog.station_request(obs, ["SWE"], ("2020-01-01", "2020-01-01"), ids="1, 9").collect()] == [1.0]
    names = spark.createDataFrame([("2", "Two"), ("3", "No data")], "site string, site_name string")
    assert [tuple(r) for r in catalog.station_request(obs, ["SWE"], ("2020-01-01", "2020-01-01"), stations=names).select("site", "site_name").collect()] == [("2", "Two")]
    with pytest.raises(ValueError):
        catalog.station_request(obs, ["SWE"], ("2020-01-01", "2020-01-01"))


def test_snotel_cube_keeps_sites_of_equal_name(spark):
    t = dt.datetime(2020, 1, 1)
    obs = spark.createDataFrame([("1", t, "SWE", 1.0), ("2", t + dt.timedelta(hours=2), "SWE", float("nan")), ("2", t + dt.timedelta(hours=1), "SWE", 5.0)], "site string, time timestamp_ntz, variable string, value double")
    stations = spark.createDataFrame([("1", "Same", 48.0), ("2", "Same", 49.0)], "site string, site_name string, lat double")
    cube = cubes.snotel_cube(obs, stations, "SWE")
    assert sorted((r["site"], r["time"].hour, r["SWE"], r["lat"]) for r in cube.collect()) == [("1", 0, 1.0, 48.0), ("1", 1, None, 48.0), ("2", 0, None, 49.0), ("2", 1, 5.0, 49.0)]
    with pytest.raises(ValueError):
        cubes.snotel_cube(obs, stations, "RELATIVE HUMIDITY")
