import datetime as dt

import pytest
from pyspark.sql import functions as F

from rainshed.plans import cubes
from rainshed.sources import catalog, store

DAYS = [dt.date(2000, 1, 1) + dt.timedelta(days=100 * k) for k in range(12)]


def cube(spark, product, days, value=1.0):
    return spark.createDataFrame([(product, d, y, value + y) for d in days for y in range(3)], "product string, time date, y int, ppt double")


def held(spark, path):
    return sorted((r.product, r.time, r.y, r.ppt) for r in catalog.read_cube(spark, path).collect())


def rows(*cubes_):
    return sorted(tuple(r) for c in cubes_ for r in c.select("product", "time", "y", "ppt").collect())


def test_replacing_a_product_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "s")
    prism, ornl = cube(spark, "PRISM", DAYS), cube(spark, "ORNL", DAYS)
    cubes.write(prism, "PRISM", path)
    cubes.write(ornl, "ORNL", path)
    assert held(spark, path) == rows(prism, ornl)
    before = store.partition_files(spark, path)
    fewer = cube(spark, "ORNL", DAYS[5:], 9.0)
    written = store.replace(fewer, path)
    after = store.partition_files(spark, path)
    assert held(spark, path) == rows(prism, fewer)  # years that the new cube lacks are gone
    assert written and all(f.startswith("product=ORNL") for f in written) and "product=ORNL/year=2000" not in after
    assert {f: n for f, n in before.items() if "PRISM" in f} == {f: n for f, n in after.items() if "PRISM" in f}
    store.replace(fewer.limit(0), path)
    assert held(spark, path) == rows(prism, fewer)


def test_a_failed_write_leaves_the_old_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    old = cube(spark, "PRISM", DAYS)
    store.replace(old, path)
    before = store.partition_files(spark, path)
    bad = cube(spark, "PRISM", DAYS, 5.0).withColumn("ppt", F.when(F.col("time") == F.lit(DAYS[-1]), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("ppt")))
    with pytest.raises(Exception, match="broken"):
        store.replace(bad, path)
    assert store.partition_files(spark, path) == before and held(spark, path) == rows(old)


def test_replacing_needs_a_product_partition(spark, tmp_path):
    with pytest.raises(ValueError, match="product"):
        store.replace(cube(spark, "PRISM", DAYS).drop("product"), str(tmp_path / "s"))


def files(spark, *entries):
    """(file, days, value) -> rows that carry their file's name."""
    out = [cube(spark, "PRISM", days, value).withColumn("file_name", F.lit(name)) for name, days, value in entries]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def test_files_appended_twice_add_no_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    first = files(spark, ("a", DAYS[:4], 1.0), ("b", DAYS[4:8], 1.0))
    assert len(store.merge(first, path)) == 2  # two years
    before = store.partition_files(spark, path)
    assert store.merge(first, path) == [] and store.merge(files(spark, ("b", DAYS[4:8], 1.0)), path) == []
    assert store.partition_files(spark, path) == before and held(spark, path) == rows(first)


def test_a_corrected_file_wins_and_other_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge(files(spark, ("a", DAYS[:4], 1.0), ("b", DAYS[4:8], 1.0), ("c", DAYS[8:], 1.0)), path)
    before = store.partition_files(spark, path)
    written = store.merge(files(spark, ("a", DAYS[:4], 1.0), ("c", DAYS[8:], 7.0)), path)
    after = store.partition_files(spark, path)
    assert held(spark, path) == rows(files(spark, ("a", DAYS[:4], 1.0), ("b", DAYS[4:8], 1.0), ("c", DAYS[8:], 7.0)))
    assert {f for f in after if after[f] != before.get(f)} == set(written) == {f"product=PRISM/year={y}" for y in {d.year for d in DAYS[8:]}}


def test_rows_that_moved_leave_their_old_partition(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge(files(spark, ("a", [dt.date(1990, 5, 1)], 1.0), ("b", DAYS[:2], 1.0)), path)
    store.merge(files(spark, ("a", [dt.date(1991, 5, 1)], 1.0)), path)
    assert held(spark, path) == rows(files(spark, ("a", [dt.date(1991, 5, 1)], 1.0), ("b", DAYS[:2], 1.0)))
    assert "product=PRISM/year=1990" not in store.partition_files(spark, path)


def test_late_files_with_more_variables_nulls_and_new_products(spark, tmp_path):
    path = str(tmp_path / "s")
    store.merge(files(spark, ("a", DAYS[:2], 1.0)), path)
    late = files(spark, ("b", [*DAYS[:1], None], 2.0)).withColumn("tmax", F.lit(3.0)).withColumn("product", F.when(F.col("y") > 0, F.col("product")))
    store.merge(late, path)
    again = store.partition_files(spark, path)
    assert store.merge(late, path) == [] and store.partition_files(spark, path) == again
    got = catalog.read_cube(spark, path)
    assert got.count() == 12 and got.filter("tmax = 3 and load = 'b'").count() == 6 and got.filter("product is null").count() == 2
    with pytest.raises(Exception, match="without a file name"):
        store.merge(files(spark, ("a", DAYS[:2], 1.0)).withColumn("file_name", F.lit(None).cast("string")), path)
    assert store.merge(late.limit(0), path) == []


def test_a_store_of_another_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    cubes.write(cube(spark, "PRISM", DAYS), "PRISM", path)
    with pytest.raises(ValueError, match="not written by merge"):
        store.merge(files(spark, ("a", DAYS[:2], 1.0)), path)


def test_late_rows_are_computed_once(spark, tmp_path):
    """What leads to the rows may be costly: a merge reads it once, whether the store is new or not."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(v):
        seen.add(1)
        return float(v)

    df = spark.range(50).select(
        F.lit("P").alias("product"), F.to_timestamp_ntz(F.lit("2000-01-01")).alias("time"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"),
        costly("id").alias("v"), F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file_name"),
    )
    for times, rows in ((1, df), (2, df.withColumn("v", F.col("v") + 1))):
        assert store.merge(rows, str(tmp_path / "s"))
        assert seen.value == 50 * times
