import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rainshed.functions import humidity, missing, times, units
from rainshed.functions.text import two_decimals


def one(df):
    return [r[0] for r in df.collect()]


def test_units(spark):
    df = spark.createDataFrame([(273.15, 212.0, 1000.0, 237.5)], "k double, f double, ft double, lon double")
    row = df.select(
        units.kelvin_to_celsius("k"), units.fahrenheit_to_celsius("f"), units.feet_to_metres("ft"),
        units.lon_from_360("lon"), units.divided("ft", 10),
    ).first()
    assert [round(v, 9) for v in row] == [0.0, 100.0, 304.8, -122.5, 100.0]


def test_humidity_from_deficit(spark):
    es = 6.112 * math.exp(17.67 * 20 / (20 + 243.5))
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 20.0), (es, 20.0)], "vpd double, t double")
    dry, between, none = one(df.select(humidity.from_pressure_deficit("vpd", "t")))
    assert dry == 100 and between == pytest.approx(100 * (1 - 10 / es), abs=1e-9) and none == pytest.approx(0, abs=1e-9)


def test_humidity_from_specific(spark):
    df = spark.createDataFrame([(0.01, 298.15, 100000.0)], "q double, t double, p double")
    es = 611.2 * math.exp(17.67 * 25.0 / 268.5)
    expected = 100 * (0.01 / 0.99) / (0.622 * es / (100000 - es))
    assert one(df.select(humidity.from_specific_humidity("q", "t", "p")))[0] == pytest.approx(expected)


def test_nan_and_nodata_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (-9999.0,), (None,)], "v double")
    assert one(missing.clean_table(df, -9999.0)) == [1.0, None, None, None]
    assert one(missing.clean_table(df)) == [1.0, None, -9999.0, None]


def test_water_year(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2020-09-30 23:00:00'), (timestamp_ntz'2020-10-01 00:00:00') AS t(time)")
    assert one(df.select(times.water_year("time"))) == [2020, 2021]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_floor_does_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist on that day in the second zone
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:15.5' AS t, '2024-03-10_02:59:59' AS s, 'bad' AS b")
        row = df.select(times.floor_hour("t"), times.floor_day("t"), times.parse_wrf_time("s"), times.parse_wrf_time("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert list(row) == [dt.datetime(2024, 3, 10, 2), dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 10, 2), None]


def test_two_decimals_is_exact_at_every_size(spark):
    values = [1e13 + 0.125, 10000000000000.375, 2.0**45 + 0.125, 2.0**52 + 0.5, 2.0**53, -(2.0**60) - 512, 2.0**62, 2.0**63, 1e22, 1.5e30, 3.9e37, 0.995, 0.999, 1.995, 99.995, float("inf"), float("-inf"), -0.001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert one(df.select(two_decimals("v"))) == ["%.2f" % v for v in values]
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(1e38,)], "v double").select(two_decimals("v")).collect()


def test_two_decimals_prints_like_c(spark):
    rng = random.Random(7)
    values = [0.125, 0.295, 0.375, -0.001, -2.675, 1.005, 0.0, 1e9 + 0.125, 123456.785, 2.5, 99.995, 8192.015625]
    values += [k / 8 for k in range(-40, 40)] + [k / 200 for k in range(-400, 400)]
    values += [rng.uniform(-400, 400) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert one(df.select(two_decimals("v"))) == ["%.2f" % v for v in values]
    gone = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert one(gone.select(two_decimals("v"))) == ["nan", "nan"]


def test_slice_covers_the_whole_last_day(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2003-10-16 00:00:00'), (timestamp_ntz'2003-10-18 23:00:00'),"
        " (timestamp_ntz'2003-10-19 00:00:00') AS t(time)"
    )
    assert df.filter(times.within_days(df, "time", "2003-10-16", "2003-10-18")).count() == 2


def test_positive(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-1.0,)], "v double")
    assert one(df.select(missing.positive(F.col("v")))) == [None, 2.0, None]
