import itertools
import random

import pytest

from rainshed.functions import curve
from rainshed.operators import running
from rainshed.plans import maps
from rainshed.sources import catalog


def rows_scanned(df):
    """Rows that the file scan of a collected frame gave on."""
    leaves, total = [df._jdf.queryExecution().executedPlan()], 0
    while leaves:
        node = leaves.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            leaves.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        else:
            children = node.children()
            leaves += [children.apply(i) for i in range(children.size())]
    return total


def test_codes(spark):
    rng = random.Random(1)
    cells = [(0, 0), (0, 1), (1, 0), (2**31 - 1, 2**31 - 1), (2**31 - 1, 0)] + [(rng.randrange(2**31), rng.randrange(2**31)) for _ in range(200)]
    df = spark.createDataFrame(cells, "y int, x int")
    assert [r[0] for r in df.select(curve.code()).collect()] == [curve.code_of(y, x) for y, x in cells]
    assert [curve.code_of(y, x) for y, x in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2))] == [0, 1, 2, 3, 4]
    assert spark.createDataFrame([(None, 1), (1, None)], "y int, x int").select(curve.code()).collect() == [(None,), (None,)]
    with pytest.raises(Exception, match="no curve code"):
        spark.createDataFrame([(-1, 1)], "y int, x int").select(curve.code()).collect()


@pytest.mark.parametrize("most", [1, 4, 64])
def test_ranges_cover_boxes_and_cells(most):
    rng = random.Random(most)
    for _ in range(60):
        (y0, y1), (x0, x1) = sorted(rng.choices(range(40), k=2)), sorted(rng.choices(range(40), k=2))
        ranges = curve.box_ranges(y0, y1, x0, x1, most)
        codes = {curve.code_of(y, x) for y, x in itertools.product(range(y0, y1 + 1), range(x0, x1 + 1))}
        assert len(ranges) <= most and all(any(a <= c <= b for a, b in ranges) for c in codes)
        assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        if most == 64:  # enough to be nearly exact on such boxes
            assert sum(b - a + 1 for a, b in ranges) <= 1.5 * len(codes)
    cells = {(rng.randrange(99), rng.randrange(99)) for _ in range(30)}
    ranges = curve.cell_ranges(cells, most)
    assert len(ranges) <= most and all(any(a <= curve.code_of(*c) <= b for a, b in ranges) for c in cells)
    assert curve.box_ranges(3, 2, 0, 5) == [] == curve.cell_ranges([]) and curve.box_ranges(0, 0, 0, 0) == [(0, 0)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """60 x 60 cells over 200 days of two years."""
    path = str(tmp_path_factory.mktemp("curve") / "s")
    cube = spark.range(60 * 60 * 200).selectExpr(
        "'PRISM' AS product", "date_add(DATE '2000-06-01', CAST(2 * (id % 200) AS INT)) AS time",
        "CAST(id DIV 200 DIV 60 AS INT) AS y", "CAST(id DIV 200 % 60 AS INT) AS x", "CAST(id AS DOUBLE) AS t",
    )
    catalog.write_cube(cube, path, by_cell=True)
    return catalog.read_cube(spark, path)


def test_a_point_series_reads_few_rows(spark, store):
    cells = spark.range(3600).selectExpr("CAST(id DIV 60 AS INT) AS y", "CAST(id % 60 AS INT) AS x", "48 + (id DIV 60) / 10D AS lat", "-122 + (id % 60) / 10D AS lon")
    places = [("a", 50.01, -120.02), ("b", 48.5, -117.3)]
    got = maps.stored_point_series(store, cells, places)
    rows = got.select("point", "time", "y", "x", "t").collect()
    want = maps.point_series(store, cells, places).select("point", "time", "y", "x", "t").collect()
    assert sorted(rows) == sorted(want) and len(rows) == 400
    near = catalog.cells_of(store, spark.createDataFrame([(20, 20), (20, 20), (5, 47), (None, 1)], "y int, x int"))
    assert len(near.collect()) == 400 and rows_scanned(near) < 0.05 * 720_000
    box = catalog.box_of(store, 16, 19, 8, 11)
    assert len(box.collect()) == 16 * 200 and rows_scanned(box) < 0.05 * 720_000


def test_many_cells_are_joined(spark, store, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_CELLS", 2)
    cells = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "y int, x int")
    assert catalog.cells_of(store, cells).count() == 600
    assert catalog.cells_of(store, cells.limit(0)).count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_series_in_pieces_of_rows(spark, keys):
    """A hot key, uneven times; both forms agree with one window over a whole series."""
    rng = random.Random(3)
    times = sorted(rng.sample(range(10**6), 3000)) if keys else rng.sample(range(10**6), 3000)
    rows = [("hot" if i % 10 else f"k{i % 70}", t, float(rng.randint(0, 9)) if i % 13 else None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, time long, v double").repartition(5)
    cut = running.pieces(df, rows=100)
    sizes = df.groupBy(running._piece("time", cut)).count().collect()
    assert 25 <= len(cut) + 1 <= 31 and max(r["count"] for r in sizes) <= 200
    names = ["k", "time", "total"]
    whole, parts = running.running_total(df, keys, "v"), running.running_total(df, keys, "v", chunk=cut)
    assert sorted(parts.select(names).collect()) == sorted(whole.select(names).collect())
    names = ["time", "change"]
    for form in (running.step_change, running.series_change):
        whole, parts = form(df, keys, "v"), form(df, keys, "v", chunk=cut)
        assert sorted(map(str, parts.select(names).collect())) == sorted(map(str, whole.select(names).collect()))
    assert running.pieces(df, rows=10**6) == () and running.pieces(df.limit(0)) == ()
    none = running.running_total(df, keys, "v", chunk=running.pieces(df, rows=10**6))
    assert none.count() == 3000


def test_pieces_of_dates_and_timestamps(spark):
    df = spark.range(1000).selectExpr("timestamp_ntz'2000-01-01' + make_dt_interval(0, CAST(id * id AS INT)) AS time", "1.0D AS v")
    for one in (df, df.selectExpr("CAST(time AS DATE) AS time", "v").distinct()):
        cut = running.pieces(one, rows=10)
        assert len(cut) > 2
        got = running.running_total(one, [], "v", chunk=cut).agg({"total": "max"}).first()[0]
        assert got == one.count()
