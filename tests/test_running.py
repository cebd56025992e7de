import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rainshed.operators import reduce, running


def series(spark, values, key="a", step_hours=24 * 11, start=dt.datetime(2020, 1, 1)):
    rows = [(key, start + dt.timedelta(hours=i * step_hours), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")


def column(df, name, order="time"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("chunk", [None, "year", "month", "day"])
def test_step_change_keeps_rows_and_resets_show(spark, chunk):
    df = series(spark, [0.0, 2.0, 5.0, 1.0, 4.0])
    assert column(running.step_change(df, ["k"], "v", chunk=chunk), "change") == [None, 2.0, 3.0, -4.0, 3.0]
    assert column(running.step_change(df, ["k"], "v", chunk=chunk, clip_negative=True), "change") == [None, 2.0, 3.0, None, 3.0]


@pytest.mark.parametrize("keys", [["k"], []])
def test_series_change_in_pieces_is_that_of_the_whole(spark, keys):
    rows = [("a", dt.datetime(2019, 12, 30) + dt.timedelta(hours=7 * i), float(i * i % 17)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")
    whole = running.series_change(df, ["k"], "v").orderBy("time").collect()
    for chunk in ("day", "month", "year"):
        assert running.series_change(df, keys, "v", chunk=chunk).select("k", "time", "v", "change").orderBy("time").collect() == whole


def test_series_change_drops_the_first_row(spark):
    assert column(running.series_change(series(spark, [0.0, 2.0, None, 1.0]), ["k"], "v"), "change") == [2.0, None, None]


@pytest.mark.parametrize("chunk", [None, "year", "month", "day"])
def test_running_total_counts_missing_as_zero(spark, chunk):
    df = series(spark, [None, 2.0, None, 3.0])
    assert column(running.running_total(df, ["k"], "v", chunk=chunk), "total") == [0.0, 2.0, 2.0, 5.0]


def test_chunks_give_the_same_as_one_window_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", dt.datetime(2001, 1, 1) + dt.timedelta(hours=7 * i), rng.choice([None, float(rng.randint(0, 9))])) for i in range(4000)]
    rows += [(f"k{i % 50}", dt.datetime(2001, 1, 1) + dt.timedelta(days=i), float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")
    for op, name in ((running.running_total, "total"), (running.step_change, "change")):
        plain, cut = (op(df, ["k"], "v", chunk=c).select("k", "time", name) for c in (None, "month"))
        assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()


def test_totals_and_changes_agree(spark):
    df = series(spark, [float(i * i % 17) for i in range(200)])
    total = running.running_total(df, ["k"], "v", chunk="month")
    assert column(total, "total")[-1] == df.agg(F.sum("v")).first()[0]
    change = running.running_total(running.step_change(df, ["k"], "v"), ["k"], "change")
    values = column(df, "v")
    assert column(change, "total")[-1] == values[-1] - values[0]


def test_mean_and_sum_of_missing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (2, 4.0)], "t int, v double")
    assert {r["t"]: r["mean"] for r in reduce.basin_mean(df, ["t"], "v").collect()} == {1: None, 2: 4.0}
    assert {r["t"]: r["sum"] for r in reduce.basin_sum(df, ["t"], "v").collect()} == {1: 0.0, 2: 4.0}


@pytest.mark.parametrize("spine, days, high", [(None, [1, 2, 4], [5.0, 1.0, 2.0]), ([], [1, 2, 3, 4], [5.0, 1.0, None, 2.0]), (["k"], [1, 2, 3, 4], [5.0, 1.0, None, 2.0])])
def test_daily_max_with_and_without_spine(spark, spine, days, high):
    rows = [("a", dt.datetime(2020, 1, d, h), v) for d, h, v in [(1, 0, 3.0), (1, 5, 5.0), (2, 0, 1.0), (4, 0, 2.0)]]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")
    got = reduce.to_days(df, ["k"], "v", "max", spine=spine).orderBy("day").collect()
    assert [r["day"].day for r in got] == days and [r["value"] for r in got] == high


def test_spine_axis_is_shared_by_groups(spark):
    rows = [("p", "a", dt.datetime(2020, 1, 1), 1.0), ("p", "b", dt.datetime(2020, 1, 3), 2.0), ("q", "a", dt.datetime(2020, 2, 1), 3.0)]
    df = spark.createDataFrame(rows, "product string, cell string, time timestamp_ntz, v double")
    got = reduce.to_days(df, ["product", "cell"], "v", "sum", spine=["product"])
    assert sorted((r["product"], r["cell"], r["day"].day, r["value"]) for r in got.collect()) == [
        ("p", "a", 1, 1.0), ("p", "a", 2, 0.0), ("p", "a", 3, 0.0), ("p", "b", 1, 0.0), ("p", "b", 2, 0.0), ("p", "b", 3, 2.0), ("q", "a", 1, 3.0),
    ]
