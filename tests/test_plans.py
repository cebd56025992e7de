"""The physical plans we want, and the streaming job."""

import datetime as dt

import pytest

from checks.queries import QUERIES
from rainshed.session import scratch_path
from rainshed.streaming import hourly


from pyspark.sql import functions as F

from rainshed.plans import cubes, storms, wateryears
from rainshed.sources import catalog, inventory, manifests


def hourly_rain(spark):
    rows = [(dt.datetime(2020, 1, d, h), x, float(d + h % 3 + x)) for d in (1, 2, 3) for h in range(0, 24, 6) for x in (0, 1, 2)]
    return spark.createDataFrame(rows, "time timestamp_ntz, x int, rain double").withColumn("y", F.lit(0))


def test_rates_and_their_accumulation_give_the_same_storm(spark):
    basin = spark.createDataFrame([(0, 0), (0, 1)], "y int, x int")
    rain = hourly_rain(spark)
    windows = [("s", "2020-01-02", "2020-01-03")]
    from rainshed.operators import running

    total = running.running_total(rain, ["y", "x"], "rain", out="acc")
    rates = storms.hourly_storm_totals(rain, windows, basin, "rain", False)
    taken_apart = storms.hourly_storm_totals(total, windows, basin, "acc", True)
    first = rain.filter("time = timestamp_ntz'2020-01-02 00:00:00' AND x < 2").agg(F.avg("rain")).first()[0]
    a, b = ({r["day"].day: r["cum"] for r in d.collect()} for d in (rates, taken_apart))
    # the accumulated form loses the first hour of the window
    assert set(a) == {2, 3} and all(a[d] == pytest.approx(b[d] + first) for d in a)


def test_water_years_add_up(spark):
    rows = [(dt.date(2019, 9, 29) + dt.timedelta(days=i), float(i % 7)) for i in range(800)]
    df = spark.createDataFrame(rows, "time date, ppt double").withColumn("product", F.lit("P"))
    totals = {r["water_year"]: r["total_m"] for r in wateryears.totals(df, ["product"], "ppt").collect()}
    peaks = {r["water_year"]: r["peak_m"] for r in wateryears.peaks(df, ["product"], "ppt").collect()}
    assert set(totals) == {2019, 2020, 2021, 2022} and totals[2019] == pytest.approx(0.001)
    assert sum(totals.values()) == pytest.approx(df.agg(F.sum("ppt")).first()[0] / 1000)
    assert all(totals[y] == pytest.approx(peaks[y]) for y in totals)


def test_build_stops_without_files_and_reports_gaps(spark, tmp_path):
    expected = manifests.wrf_files(manifests.wrf_request(spark, "era5", "2020-01-01", "2020-01-02"))
    cube = hourly_rain(spark)
    with pytest.raises(ValueError, match="no files"):
        cubes.build(expected, expected.limit(0), cube, "WRF", str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    report = cubes.build(expected, expected.filter("hour(time) < 3"), cube, "WRF", str(tmp_path / "b"))
    assert report.first().asDict() == {"expected": 25, "fetched": 4, "failed": 21}
    assert catalog.read_cube(spark, str(tmp_path / "b")).count() == cube.count()
    named = inventory.with_file_name(spark.read.parquet(str(tmp_path / "b")))
    assert named.filter(F.endswith("file_name", F.lit(".parquet"))).count() == cube.count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_products(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in text, bad


@pytest.mark.parametrize("name, pushed", [("time_slice", "GreaterThanOrEqual(ts"), ("event_slices", "GreaterThanOrEqual(l_shipdate")])
def test_filters_reach_the_scan(name, pushed, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert pushed in text.split("PushedFilters: ")[1].split("ReadSchema")[0]


def test_forecast_filters_reach_the_files(spark, tmp_path):
    from rainshed import schema
    from rainshed.operators import geo

    row = (dt.datetime(2024, 1, 1, 5), 0, 1, 2, 238.5, 48.0, 270.0, 50.0, float("nan"), 3.0, None, 1.0, 2.0)
    spark.createDataFrame([row, row[:1] + (1,) + row[2:10] + (0.5, 1.0, 2.0)], schema.HRRR_RAW).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.schema(schema.HRRR_RAW).parquet(str(tmp_path / "raw"))
    cells = spark.createDataFrame([(1, 2, -121.5, 48.0)], "y int, x int, lon double, lat double")
    edges = geo.edges_from_rings(spark, [[(-122, 47), (-121, 47), (-121, 49), (-122, 49)]])
    cube = cubes.hrrr_cube(raw, cells, edges, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    got = cube.first().asDict()
    assert (got["lon"], got["t"], got["tp"], got["si10"]) == (-121.5, 270.0, 0.5, None)
    # the plan text is cut after a hundred characters; conditions on other columns follow these
    assert "PushedFilters: [IsNotNull(time), IsNotNull(lon360), IsNotNull(lat), GreaterThanOrEqual(time," in plan(cube)


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["water_year_total"](spark, sf_dir))
    assert "l_comment" not in text and "l_discount" not in text.split("ReadSchema")[1]


def test_masking_does_not_shuffle_the_data(spark, sf_dir):
    from checks import views
    from rainshed.operators import geo

    raw = views.table(spark, sf_dir, "lineitem").selectExpr("CAST(floor(l_suppkey / 10) AS INT) AS y", "CAST(l_suppkey % 10 AS INT) AS x", "l_quantity AS v")
    text = plan(geo.mask_drop(raw, views.basin(spark, sf_dir)))
    top = text.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in top and "hashpartitioning" not in top


@pytest.mark.parametrize("name", [
    "precip_comparison", "basin_mask_keep", "dem_clip", "wrf_cube", "hrrr_cube", "station_cube", "snotel_cube", "event_slices_table",
    "basin_cumulative", "wrf_hourly_precip", "embed_dem_regular", "text_grid", "mesh_grid", "manifest_gaps",
])
def test_same_rows_when_nothing_may_be_broadcast(name, spark, sf_dir, duck_con, monkeypatch):
    from checks.compare import difference
    from checks.oracle import SQL
    from rainshed.operators import sizing

    monkeypatch.setattr(sizing, "BROADCAST_ROWS", -1)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = QUERIES[name](spark, sf_dir)
        assert difference(df, duck_con, SQL[name]) is None
        assert "BroadcastHashJoin" not in plan(df)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("c1", dt.datetime(2024, 1, d, h), 1.0) for d in range(1, 8) for h in range(24)]
    schema = "cell string, time timestamp, v double"
    for n in range(2):  # two arrivals
        spark.createDataFrame(rows[n * 84:(n + 1) * 84], schema).write.mode("append").parquet(source)
    stream = hourly.hourly_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1000)
    query = hourly.start(hourly.daily_totals(stream, ["cell"], "v"), out, scratch_path(spark, "stream"), once=True)
    assert query.awaitTermination(120)
    got = {r["day"].day: r["value"] for r in spark.read.parquet(out).collect()}
    assert got and all(v == 24.0 for v in got.values()) and set(got) <= set(range(1, 8)) and {1, 2, 3} <= set(got)


def stored(spark, tmp_path):
    rows = [("PRISM", dt.datetime(1999 + i % 4, 1, 1 + i % 5, 6), i % 2, 0, float(i)) for i in range(40)]
    catalog.write_cube(spark.createDataFrame(rows, "product string, time timestamp_ntz, y int, x int, ppt double"), str(tmp_path / "store"))
    return catalog.read_cube(spark, str(tmp_path / "store"))


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]


def test_years_prune_the_partitions_of_a_store(spark, tmp_path):
    from rainshed.operators import combine, select
    from rainshed.plans import maps

    store = stored(spark, tmp_path)
    windows = [("a", "2000-01-02", "2000-01-03"), ("b", "2001-01-01", "2001-01-01")]
    table = spark.createDataFrame(windows, "event string, a string, b string").select("event", F.to_date("a").alias("start_day"), F.to_date("b").alias("end_day"))
    table.write.parquet(str(tmp_path / "windows"))
    table = spark.read.parquet(str(tmp_path / "windows"))
    tried = {
        "slice": select.time_slice(store, "2000-01-01", "2000-01-31"),
        "hours": select.hour_range(store, "2000-01-01 00:00:00", "2000-01-31 00:00:00"),
        "time": select.at_time(store, "2000-01-02 06:00:00"),
        "events": combine.event_slices(store, windows),
        "map": maps.storm_map(store, ("2000-01-01", "2000-01-02"), "ppt", "sum"),
    }
    for name, df in tried.items():
        assert any("year#" in f for f in partition_filters(df)), name
    by_table = combine.event_slices(store, table)
    assert sorted(map(tuple, tried["events"].select("event", "time", "ppt").collect())) == sorted(map(tuple, by_table.select("event", "time", "ppt").collect()))
    assert any("dynamicpruning" in f and "year#" in f for f in partition_filters(by_table))
    assert tried["time"].count() == store.filter("time = timestamp_ntz'2000-01-02 06:00:00'").count() > 0


def test_masks_tell_products_apart(spark):
    rows = [(p, dt.date(2020, 1, d), 0, x, 100.0) for p in ("PRISM", "WRF") for d in (1, 2) for x in (0, 1)]
    grid = spark.createDataFrame(rows, "product string, day date, y int, x int, ppt double")
    windows = [("s", "2020-01-01", "2020-01-02")]
    plain = spark.createDataFrame([(0, 0)], "y int, x int")
    keyed = spark.createDataFrame([("PRISM", 0, 0)], "product string, y int, x int")
    with pytest.raises(ValueError, match="products apart"):
        storms.daily_storm_totals(grid, windows, plain, "ppt")
    assert {r["product"] for r in storms.daily_storm_totals(grid, windows, keyed, "ppt").collect()} == {"PRISM"}
    assert {r["product"] for r in storms.daily_storm_totals(grid, windows, plain, "ppt", key=("y", "x")).collect()} == {"PRISM", "WRF"}
    runs = grid.withColumn("scenario", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert {(r["scenario"], r["cum"]) for r in storms.daily_storm_totals(runs, windows, keyed, "ppt").collect()} == {("a", 100.0), ("b", 100.0), ("a", 200.0), ("b", 200.0)}


def test_builds_refuse_unknown_variables_and_empty_polygons(spark):
    from rainshed import schema
    from rainshed.operators import geo

    assert cubes.known_variables("", schema.ORNL_VARIABLES, schema.ORNL_DEFAULTS) == schema.ORNL_DEFAULTS
    assert cubes.known_variables("PRMS_swe, prcp,bogus", schema.ORNL_VARIABLES) == ["PRMS_swe", "prcp"]
    with pytest.raises(ValueError, match="bogus"):
        cubes.known_variables("bogus", schema.PRISM_VARIABLES)
    edges = geo.edges_from_rings(spark, [[(0, 0), (1, 0), (1, 1)]])
    with pytest.raises(ValueError, match="no edges"):
        geo.total_bounds(edges.limit(0))
    raw = spark.createDataFrame([("2000-01-01_00:00:00", 0, 0, 1.0)], "Times string, y int, x int, T2 double")
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5, 1.0)], "y int, x int, lat double, lon double, hgt double")
    with pytest.raises(ValueError):
        cubes.wrf_cube(raw, cells, edges, "BOGUS")


def test_hrrr_parameters_of_the_inventory_and_of_the_cube():
    assert cubes.hrrr_columns("tp,t2,t") == ["tp", "t"]
    assert cubes.hrrr_columns("APCP, WIND") == ["tp", "si10", "max_10si"]
    assert cubes.hrrr_columns(["tp"]) == ["tp"]  # not a part of another name
    with pytest.raises(ValueError, match="t2"):
        cubes.hrrr_columns("t2")


def test_empty_polygons_hold_nothing(spark):
    from rainshed.operators import geo

    none = geo.edges_from_rings(spark, [[(0, 0), (1, 0), (1, 1)]]).limit(0)
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5)], "y int, x int, lat double, lon double")
    assert geo.clip(cells, none, ["y", "x"]).count() == 0 == geo.stations_in_extent(cells, none).count() == geo.points_inside(cells, none).count()


def test_a_build_takes_only_files_asked_for_that_arrived(spark, tmp_path):
    paths = lambda *names: spark.createDataFrame([(f"/a/{n}",) for n in names], "path string")
    raw = hourly_rain(spark).withColumn("file_path", F.concat(F.lit("/a/d"), F.dayofmonth("time").cast("string")))
    report = cubes.build(paths("d1", "d2"), paths("d2", "d3"), lambda rows: rows.drop("file_path"), "WRF", str(tmp_path / "c"), raw=raw)
    assert report.first().asDict() == {"expected": 2, "fetched": 1, "failed": 1}
    assert {r["time"].day for r in catalog.read_cube(spark, str(tmp_path / "c")).collect()} == {2}
