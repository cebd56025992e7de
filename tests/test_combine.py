import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainshed.operators import combine, select, sizing

T0 = dt.datetime(2020, 1, 1)


def hours(*h):
    return [T0 + dt.timedelta(hours=i) for i in h]


def test_merge_takes_the_union_and_finds_conflicts(spark):
    rows = [(T0, 0, 0, "a", 1.0), (T0, 0, 0, "b", 2.0), (T0, 0, 1, "b", None), (T0, 0, 0, "a", 1.0)]
    long = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, variable string, value double")
    merged = combine.merge_variables(long, ["time", "y", "x"], ["a", "b"])
    assert sorted((r["x"], r["a"], r["b"]) for r in merged.collect()) == [(0, 1.0, 2.0), (1, None, None)]
    clash = long.unionByName(spark.createDataFrame([(T0, 0, 0, "a", 9.0)], long.schema))
    with pytest.raises(Exception, match="conflicting values of a"):
        combine.merge_variables(clash, ["time", "y", "x"], ["a", "b"]).collect()


def test_forecast_steps(spark):
    a, b, c = hours(0, 1, 2)
    rows = [(a, 0, 1.0, None, 5.0), (b, 1, 9.0, 0.5, 6.0), (c, 0, 2.0, None, 7.0), (c, 1, 9.0, 0.7, 8.0), (c, 2, 9.0, 9.0, 9.0)]
    raw = spark.createDataFrame(rows, "time timestamp_ntz, step_h int, t double, tp double, max_10si double").withColumns({"y": F.lit(0), "x": F.lit(0)})
    got = combine.merge_forecast_steps(raw).orderBy("time").collect()
    assert [(r["t"], r["tp"], r["max_10si"]) for r in got] == [(1.0, None, None), (None, 0.5, 6.0), (2.0, 0.7, 8.0)]


def test_last_reading_of_a_slot(spark):
    rows = [("1", T0 + dt.timedelta(minutes=m), "SWE", v) for m, v in [(5, 1.0), (50, 3.0), (20, 2.0), (61, 4.0)]]
    df = spark.createDataFrame(rows, "site string, time timestamp_ntz, variable string, value double")
    got = combine.station_slots(df, ["SWE", "AIR TEMP"]).orderBy("time").collect()
    assert [(r["time"].hour, r["SWE"], r["AIR TEMP"]) for r in got] == [(0, 3.0, None), (1, 4.0, None)]
    assert [r["SWE"] for r in combine.station_slots(df, ["SWE"], "daily").collect()] == [4.0]
    with pytest.raises(ValueError):
        combine.station_slots(df, ["SWE"], "weekly")


def test_dense_cube_has_times_by_sites(spark):
    rows = [("a", hours(0)[0], 1.0), ("b", hours(5)[0], 2.0), ("a", hours(9)[0], 3.0)]
    df = spark.createDataFrame(rows, "site string, time timestamp_ntz, SWE double")
    dense = combine.densify(df)
    assert dense.count() == 3 * 2 and dense.filter("SWE IS NOT NULL").count() == 3
    assert "CartesianProduct" not in dense._jdf.queryExecution().executedPlan().toString()


def test_sites_of_equal_name_stay(spark):
    rows = [("9", "Same", 1.0, hours(0)[0]), ("2", "Same", 2.0, hours(1)[0]), ("9", "Same", 7.0, hours(2)[0])]
    df = spark.createDataFrame(rows, "site string, site_name string, lat double, time timestamp_ntz")
    assert sorted((r["site"], r["lat"]) for r in combine.site_coordinates(df).collect()) == [("2", 2.0), ("9", 1.0)]


def test_event_windows_as_list_and_as_table(spark):
    days = [dt.date(2020, 1, d) for d in range(1, 11)]
    df = spark.createDataFrame([(dt.datetime(d.year, d.month, d.day, h), float(h)) for d in days for h in (0, 23)], "time timestamp_ntz, v double")
    windows = [("a", "2020-01-02", "2020-01-04"), ("b", "2020-01-04", "2020-01-04"), ("c", "2021-01-01", "2021-01-02")]
    table = spark.createDataFrame([(n, dt.date.fromisoformat(s), dt.date.fromisoformat(e)) for n, s, e in windows], "event string, start_day date, end_day date")
    a, b = (combine.event_slices(df, w).select("event", "time", "v") for w in (windows, table))
    assert a.count() == 8 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert "NestedLoop" not in combine.event_slices(df, table)._jdf.queryExecution().executedPlan().toString()


def test_concat_fills_absent_variables(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "t int, a double"), spark.createDataFrame([(2, 3.0)], "t int, b double")
    assert sorted((r["t"], r["a"], r["b"]) for r in combine.concat_rows([a, b]).collect()) == [(1, 2.0, None), (2, None, 3.0)]
    with pytest.raises(ValueError, match="no data"):
        combine.concat_rows([])


def test_variable_choice():
    assert select.choose_variables("", ["a", "b"], ["a"]) == (["a"], [])
    assert select.choose_variables("x, y,b ,a", ["a", "b"]) == (["b", "a"], ["x", "y"])


def test_time_picks(spark):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(hours(0, 2, 4))], "time timestamp_ntz, n int")
    pick = lambda d: [r["n"] for r in d.collect()]
    assert pick(select.at_nearest_time(df, "2020-01-01 01:00:00")) == [1]  # a tie: the later
    assert pick(select.at_nearest_time(df, "2020-01-01 00:59:59")) == [0]
    assert pick(select.at_time(df, "2020-01-01 04:00:00")) == [2]
    assert pick(select.at_position(df, 1)) == [1] and pick(select.at_position(df, -1)) == [2] and pick(select.at_position(df, 3)) == []
    assert pick(select.hour_range(df, "2020-01-01 00:00:00", "2020-01-01 02:00:00")) == [0, 1]


def test_renames_and_drops(spark):
    df = spark.createDataFrame([(1, 2, 3)], "south_north int, west_east int, spare int")
    assert select.drop_variables(select.rename_axes(df), ["spare", "absent"]).columns == ["y", "x"]
    band = spark.createDataFrame([(1, 5), (2, 6)], "band int, v int")
    assert [r["v"] for r in select.only_band(band).collect()] == [5]


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_groups_of_a_task_do_not_grow_with_the_merge(spark, monkeypatch):
    monkeypatch.setattr(sizing, "ROWS_PER_TASK", 100)
    cells = spark.range(5000).selectExpr("id DIV 100 AS y", "id % 100 AS x", "1.0D AS a", "2.0D AS b")
    long = combine.stack_variables(cells, ["y", "x"], ["a", "b"])
    merged = combine.merge_variables(long, ["y", "x"], ["a", "b"], bound=cells)
    assert merged.filter("a = 1 AND b = 2").count() == 5000 and most_in_a_task(merged) < 300
    few = combine.merge_variables(long, ["y", "x"], ["a", "b"], bound=cells.limit(10))
    assert "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()


def test_groups_of_a_task_do_not_grow_with_the_grid(spark, sf_dir, monkeypatch):
    """The grid view and the merge after it, which shares its partitions."""
    from checks import views
    from checks.queries import QUERIES

    plain = sorted(map(str, QUERIES["merge_variables"](spark, sf_dir).collect()))
    monkeypatch.setattr(sizing, "ROWS_PER_TASK", 100)
    assert most_in_a_task(views.grid(spark, sf_dir)) < 300
    merged = QUERIES["merge_variables"](spark, sf_dir)
    assert most_in_a_task(merged) < 300 and sorted(map(str, merged.collect())) == plain
