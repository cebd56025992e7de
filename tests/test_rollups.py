import datetime as dt

from pyspark.sql import functions as F

from rainshed.operators import reduce
from rainshed.plans import rollups
from rainshed.sources import store


def files(spark, *entries):
    """(file, first day, value): two products, three days, a 4 x 4 grid with gaps."""
    rows = [
        (p, dt.datetime(2000, 12, 30) + dt.timedelta(days=first + d, hours=6), y, x, name, None if (x + y + d) % 5 == 0 else value + x)
        for name, first, value in entries for p in ("A", "B") for d in range(3) for y in range(4) for x in range(4)
    ]
    return spark.createDataFrame(rows, "product string, time timestamp_ntz, y int, x int, file_name string, v double")


def test_rollup_equals_a_recomputation(spark, tmp_path):
    path = str(tmp_path / "r")
    basin = spark.createDataFrame([(y, x) for y in range(3) for x in range(2)], "y int, x int")

    def got():
        return sorted(tuple(r) for r in rollups.read(spark, path).collect())

    def want(rows):
        inside = rows.join(basin, ["y", "x"]).withColumn("day", F.to_date("time"))
        total = reduce.basin_sum(inside, ["product", "day"], "v", "total")
        return sorted(tuple(r) for r in total.join(reduce.basin_mean(inside, ["product", "day"], "v", "mean"), ["product", "day"]).select("product", "day", "total", "mean").collect())

    first = files(spark, ("a", 0, 1.0), ("c", 6, 3.0))
    assert rollups.update(first, basin, path, "v")
    assert got() == want(first)
    late = files(spark, ("b", 1, 2.0))  # overlaps the days of a
    rollups.update(late, basin, path, "v")
    both = first.union(late)
    assert got() == want(both)
    before = store.partition_files(spark, path)
    assert rollups.update(late, basin, path, "v") == [] and rollups.update(first, basin, path, "v") == []
    corrected = files(spark, ("c", 5, 9.0))
    rollups.update(corrected, basin, path, "v")
    now = files(spark, ("a", 0, 1.0), ("b", 1, 2.0), ("c", 5, 9.0))
    assert got() == want(now)
    after = store.partition_files(spark, path)
    assert all(after[f] == n for f, n in before.items() if f.endswith("year=2000"))  # c lies in 2001


def test_days_without_known_values(spark, tmp_path):
    path = str(tmp_path / "r")
    basin = spark.createDataFrame([(0, 0)], "y int, x int")
    rows = spark.createDataFrame([("A", dt.date(2000, 1, 1), 0, 0, "f", None), ("A", dt.date(2000, 1, 2), 0, 0, "f", float("nan"))], "product string, time date, y int, x int, file_name string, v double")
    rollups.update(rows, basin, path, "v")
    assert sorted(map(tuple, rollups.read(spark, path).collect())) == [("A", dt.date(2000, 1, 1), 0.0, None), ("A", dt.date(2000, 1, 2), 0.0, None)]
    assert rollups.update(rows.limit(0), basin, path, "v") == []
