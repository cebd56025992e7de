import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rainshed.operators import combine, intervals, sizing

ZERO = dt.date(1960, 1, 1)


def day(k):
    return ZERO + dt.timedelta(days=k)


def windows_of(spark, rows):
    return spark.createDataFrame(rows, "event string, start_day date, end_day date")


def test_covers_are_exact_and_small(spark):
    rng = random.Random(5)
    rows = [(f"e{k}", day(a := rng.randrange(30_000)), day(a + rng.choice([0, 1, 2, rng.randrange(200), rng.randrange(15_000)]))) for k in range(300)]
    rows += [("whole", day(-40_000), day(60_000)), ("back", day(5), day(4)), ("none", None, day(4)), ("open", day(4), None)]
    found = {}
    for r in intervals.cover(windows_of(spark, rows)).collect():
        found.setdefault(r.event, []).append((r["__level"], r["__index"]))
    for event, a, b in rows:
        if a is None or b is None or a > b:
            assert event not in found
            continue
        days = [d for level, i in found[event] for d in range(i << level, (i + 1) << level)]
        assert sorted(days) == list(range((a - dt.date(1970, 1, 1)).days, (b - dt.date(1970, 1, 1)).days + 1))
        assert len(found[event]) <= 2 * intervals.LEVELS


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz"])
def test_slices_and_totals_against_the_join_on_days(spark, kind):
    rng = random.Random(6)
    windows = windows_of(spark, [(f"e{k % 25}" if k < 2 else f"e{k}", day(a := rng.randrange(900)), day(a + rng.randrange(700))) for k in range(40)] + [("back", day(9), day(3))])
    data = spark.range(1500).selectExpr("'p' || id % 2 AS product", f"CAST(DATE '1960-01-01' + CAST(id % 1200 AS INT) AS {kind}) AS time", "CAST(id % 7 AS DOUBLE) AS v")
    want = combine.event_slices(data, windows)
    got = intervals.event_slices(data, windows)
    assert sorted(map(str, got.select("event", "product", "time", "v").collect())) == sorted(map(str, want.select("event", "product", "time", "v").collect()))
    totals = intervals.event_totals(data, windows, {"s": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "high": ("max", F.col("v") * 2)}, keys=("product",))
    plain = want.groupBy("event", "product").agg(F.sum("v"), F.count("v"), F.min("v"), F.max("v") * 2)
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, plain.collect()))


def test_empty_and_wrong(spark):
    data = spark.createDataFrame([(day(3), 1.0)], "time date, v double")
    none = windows_of(spark, [("back", day(9), day(3))])
    assert intervals.event_slices(data, none).count() == 0 == intervals.event_totals(data, none, {"s": ("sum", "v")}).count()
    assert intervals.event_slices(data.limit(0), windows_of(spark, [("a", day(1), day(9))])).count() == 0
    with pytest.raises(ValueError, match="mean"):
        intervals.event_totals(data, none, {"s": ("mean", "v")})


def test_many_long_windows(spark):
    """20,000 windows of up to 40 years: a few dozen nodes each, no row per day."""
    windows = spark.range(20_000).selectExpr("CAST(id AS STRING) AS event", "DATE '1960-01-01' + CAST(id % 900 AS INT) AS start_day", "DATE '1960-01-01' + CAST(id % 900 + 5000 + id * 7919 % 9600 AS INT) AS end_day")
    data = spark.range(16_000).selectExpr("DATE '1960-01-01' + CAST(id AS INT) AS time", "1.0D AS v")
    assert intervals.cover(windows).count() < 20_000 * 2 * 14
    total = intervals.event_totals(data, windows, {"n": ("sum", "v")}).join(windows, "event")
    assert total.filter("n <> datediff(end_day, start_day) + 1").count() == 0 and total.count() == 20_000


def test_nodes_of_many_windows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A small file of windows grows by its cover; only the sums of the nodes may be broadcast."""
    spark.range(300).selectExpr("CAST(id AS STRING) AS event", "DATE '1960-01-01' AS start_day", "DATE '1963-01-01' AS end_day").write.parquet(str(tmp_path / "w"))
    windows = spark.read.parquet(str(tmp_path / "w"))
    data = spark.range(1200).selectExpr("DATE '1960-01-01' + CAST(id AS INT) AS time", "1.0D AS v")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    totals = intervals.event_totals(data, windows, {"n": ("sum", "v")})
    assert "BuildRight" in plan(totals) and "BuildLeft" not in plan(totals)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 100)
    for df in (intervals.event_totals(data, windows, {"n": ("sum", "v")}), intervals.event_slices(data, windows), combine.event_slices(data, windows)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
        assert df.count() == (300 if "n" in df.columns else 300 * 1097)
