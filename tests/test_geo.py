import math
import random

import pytest
from pyspark.sql import functions as F

from rainshed.operators import elevation, geo

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id int, lon double, lat double")


def inside_ids(spark, rows, edges, **kw):
    return sorted(r["id"] for r in geo.points_inside(points(spark, rows), edges, ["id"], **kw).collect())


@pytest.mark.parametrize("bands", [1, 7, None])
def test_edge_points_are_outside(spark, bands):
    rows = [(2, 2), (5, 2), (4, 2), (0, 2), (2, 0), (0, 0), (2, 4), (4, 4)]
    assert inside_ids(spark, rows, geo.edges_from_rings(spark, [SQUARE]), bands=bands) == [0]


def test_hole_and_second_feature(spark):
    edges = geo.edges_from_rings(spark, [SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)]]).unionByName(
        geo.edges_from_rings(spark, [[(10, 10), (12, 10), (11, 12)]], feature=1)
    )
    rows = [(2, 2), (0.5, 0.5), (11, 11), (20, 20), (1, 2)]
    assert inside_ids(spark, rows, edges) == [1]
    assert inside_ids(spark, rows, edges, feature=None) == [1, 2]
    assert inside_ids(spark, rows, edges, feature=7) == []


def test_overlapping_features_are_a_union(spark):
    edges = geo.edges_from_rings(spark, [SQUARE]).unionByName(geo.edges_from_rings(spark, [[(2, 2), (6, 2), (6, 6), (2, 6)]], feature=1))
    assert inside_ids(spark, [(3, 3), (1, 1), (5, 5), (2, 3)], edges, feature=None) == [0, 1, 2, 3]


def test_polygon_against_brute_force(spark):
    rng = random.Random(11)
    ring = [(rng.uniform(5, 10) * c, rng.uniform(5, 10) * s) for c, s in [(__import__("math").cos(a / 20 * 6.2832), __import__("math").sin(a / 20 * 6.2832)) for a in range(20)]]
    rows = [(rng.uniform(-11, 11), rng.uniform(-11, 11)) for _ in range(3000)]

    def brute(px, py):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    expected = [i for i, (x, y) in enumerate(rows) if brute(x, y)]
    assert inside_ids(spark, rows, geo.edges_from_rings(spark, [ring])) == expected


def test_keep_and_drop_give_the_same_mean(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("int").alias("y"), F.floor(F.col("id") / 20).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    cells = df.select("y", "x", F.col("x").cast("double").alias("lon"), F.col("y").cast("double").alias("lat"))
    inside = geo.basin_cells(cells, geo.edges_from_rings(spark, [[(2, 3), (15, 4), (9, 17)]]))
    keep, drop = geo.mask_keep(df, inside, ["v"]), geo.mask_drop(df, inside)
    assert keep.count() == 400 and 0 < drop.count() < 400
    assert keep.agg(F.avg("v")).first()[0] == drop.agg(F.avg("v")).first()[0]
    marked = geo.mark_cells(cells, inside)
    assert marked.count() == 400 and marked.filter("in_basin").count() == drop.count()


def test_shuffle_join_when_too_big_to_broadcast(spark):
    cells = spark.range(100).select(F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    assert "BROADCAST" in geo.broadcast_if_small(cells)._jdf.queryExecution().logical().toString().upper()
    assert geo.broadcast_if_small(cells, max_rows=10) is cells


def lattice(spark, nx, ny, descending=False):
    y = F.lit(10.0 + (ny - 1) * 0.5) - F.col("iy") * 0.5 if descending else F.lit(10.0) + F.col("iy") * 0.5
    return (
        spark.range(nx * ny)
        .select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
        .withColumns({"x": F.lit(-5.0) + F.col("ix") * 0.25, "y": y, "band": F.lit(1)})
        .withColumn("elevation", (F.col("x") * 100 + F.col("y")).cast("double"))
    )


@pytest.mark.parametrize("descending", [False, True])
def test_nearest_on_axes(spark, descending):
    dem = lattice(spark, 9, 5, descending)
    rows = [(-5.0, 10.0), (-4.875, 10.25), (-4.86, 10.26), (-5.1, 10.0), (-3.0, 12.0), (-2.99, 12.0), (-5.01, 12.01)]
    got = {r["id"]: r["elevation"] for r in elevation.embed_on_axes(points(spark, rows), dem).collect()}
    assert got == {0: -490.0, 1: -490.0, 2: -475 + 10.5, 3: None, 4: -288.0, 5: None, 6: None}


@pytest.mark.parametrize("descending", [False, True])
def test_nearest_on_curves_against_brute_force(spark, descending):
    dem = lattice(spark, 17, 11, descending)
    rng = random.Random(5)
    rows = [(rng.uniform(-7, 1), rng.uniform(8, 17)) for _ in range(400)]
    grid = [(r["x"], r["y"], r["elevation"]) for r in dem.collect()]
    expected = {i: min(grid, key=lambda g: (g[0] - x) ** 2 + (g[1] - y) ** 2)[2] for i, (x, y) in enumerate(rows)}
    got = {r["id"]: r["elevation"] for r in elevation.embed_on_curves(points(spark, rows), dem).collect()}
    assert got == expected


def test_missing_raster_value_stays_missing(spark):
    dem = lattice(spark, 9, 5).withColumn("elevation", F.when(F.col("ix") != 0, F.col("elevation")))
    got = elevation.embed_on_curves(points(spark, [(-9.0, 10.0), (-4.7, 10.0)]), dem).orderBy("id").collect()
    assert [r["elevation"] for r in got] == [None, -475 + 10.0]


def test_embed_has_no_product_of_sides(spark):
    for op in (elevation.embed_on_axes, elevation.embed_on_curves):
        plan = op(points(spark, [(0, 0)]), lattice(spark, 9, 5))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_cell_ties_take_the_lowest_key(spark):
    cells = spark.createDataFrame([(0, 1, 1.0, 0.0), (0, 0, -1.0, 0.0), (1, 0, 5.0, 5.0)], "y int, x int, lon double, lat double")
    row = geo.nearest_cells(cells, [("p", 0.0, 0.0)]).first()
    assert (row["y"], row["x"]) == (0, 0) and row["km"] == pytest.approx(111.19, abs=0.01)


def test_mesh_without_cross_join(spark):
    x = spark.createDataFrame([(0, 1.0), (2, 3.0)], "ix int, lon double")
    y = spark.createDataFrame([(5, 7.0), (6, 8.0)], "iy int, lat double")
    df = geo.mesh(x, y)
    assert sorted((r["lon"], r["lat"]) for r in df.collect()) == [(1.0, 7.0), (1.0, 8.0), (3.0, 7.0), (3.0, 8.0)]
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_first_layer_and_stations(spark):
    meta = spark.createDataFrame([(0, 0, 2, 9.0), (0, 0, 1, 5.0)], "y int, x int, time int, lat double")
    assert geo.first_layer(meta).collect()[0]["lat"] == 5.0
    edges = geo.edges_from_rings(spark, [SQUARE])
    stations = points(spark, [(2, 2), (4.3, 2), (9, 9)]).withColumnRenamed("id", "site")
    assert [r["site"] for r in geo.stations_inside(stations, edges).collect()] == [0]
    assert sorted(r["site"] for r in geo.stations_in_extent(stations, edges, 0.5).collect()) == [0, 1]
    assert geo.total_bounds(edges) == geo.Bounds(0.0, 4.0, 0.0, 4.0)


def test_one_band_of_a_raster_counts(spark):
    dem = lattice(spark, 9, 5)
    two = dem.unionByName(dem.withColumns({"band": F.lit(2), "elevation": F.col("elevation") + 1000}))
    for op in (elevation.embed_on_axes, elevation.embed_on_curves):
        assert [r["elevation"] for r in op(points(spark, [(-5.0, 10.0)]), two).collect()] == [-490.0]
        assert [r["elevation"] for r in op(points(spark, [(-5.0, 10.0)]), two, band=2).collect()] == [510.0]


def test_a_raster_without_regular_steps_is_an_error(spark):
    dem = lattice(spark, 9, 5).withColumn("x", F.when(F.col("ix") == 3, F.col("x") + 0.1).otherwise(F.col("x")))
    with pytest.raises(Exception, match="regular steps"):
        elevation.embed_on_axes(points(spark, [(-5.0 + 0.25 * k, 10.0) for k in range(8)]), dem).collect()


@pytest.mark.parametrize("tiles", [None, [8], [8, 64, 512], [2, 4, 16, 160]])
def test_nearest_cells_of_a_table_against_brute_force(spark, tiles):
    rng = random.Random(8)
    cells = [(i // 10, i % 10, rng.choice([rng.uniform(-180, 180), rng.uniform(5, 9), 179.9, -179.9]), rng.choice([rng.uniform(-90, 90), rng.uniform(40, 44), 89.5])) for i in range(200)]
    places = [(k, rng.choice([rng.uniform(-90, 90), 41.0, 90.0, -90.0]), rng.choice([rng.uniform(-180, 180), 7.0, 180.0, -180.0])) for k in range(300)]
    cells += [(90, 0, 7.0, 41.5), (80, 0, 7.0, 40.5)]
    places.append((999, 41.0, 7.0))

    def km(a, o, b, p):
        h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(p - o) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))

    df = spark.createDataFrame(cells, "y int, x int, lon double, lat double")
    got = {r["point"]: r for r in geo.nearest_cells_of(df, spark.createDataFrame(places, "point int, plat double, plon double"), tiles=tiles).collect()}
    assert len(got) == len(places)
    for k, a, o in places:
        assert got[k]["km"] == pytest.approx(min(km(a, o, c[3], c[2]) for c in cells), abs=1e-6)
    assert got[999]["y"] in (80, 90)
    unplaced = spark.createDataFrame([(1, None, 7.0), (2, 41.0, 7.0)], "point int, plat double, plon double")
    assert [r["point"] for r in geo.nearest_cells_of(df, unplaced).collect()] == [2]
    assert geo.nearest_cells_of(df.limit(0), unplaced).count() == 0


def test_nearest_cells_meet_few_pairs(spark):
    """A grid of 40,000 cells and far places: the joined rows of a place are bounded, not all cells."""
    cells = spark.range(40_000).selectExpr("CAST(id DIV 200 AS INT) AS y", "CAST(id % 200 AS INT) AS x", "-122 + (id % 200) / 25D AS lon", "45 + (id DIV 200) / 25D AS lat")
    places = spark.range(100).selectExpr("CAST(id AS INT) AS point", "-60 + id * 1.3D AS plat", "-180 + id * 3.5D AS plon")
    levels, count = geo._tile_levels(cells, "lon", "lat")
    assert count == 40_000 and len(levels) >= 1
    found = geo.nearest_cells_of(cells, places)
    assert len(found.collect()) == 100
    plans, joined = [found._jdf.queryExecution().executedPlan()], 0
    while plans:
        node = plans.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            plans.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            plans.append(node.plan())
        else:
            if "Join" in node.nodeName():
                joined += node.metrics().get("numOutputRows").get().value()
            children = node.children()
            plans += [children.apply(i) for i in range(children.size())]
    assert 0 < joined < 100 * 2000


def test_places_are_not_shuffled_to_find_their_cells(spark, monkeypatch):
    """Many places of a small area share blocks: no exchange by place, also none for blocks with more cells than a row holds."""
    cells = spark.range(400).selectExpr("CAST(id DIV 20 AS INT) AS y", "CAST(id % 20 AS INT) AS x", "-122 + (id % 20) / 50D AS lon", "45 + (id DIV 20) / 50D AS lat")
    places = spark.range(3000).selectExpr("CAST(id AS INT) AS point", "44.8 + id * 7 % 900 / 1000D AS plat", "-122.2 + id * 13 % 700 / 1000D AS plon")
    found = geo.nearest_cells_of(cells, places)
    assert "hashpartitioning(point" not in found._jdf.queryExecution().executedPlan().toString()
    each = places.crossJoin(cells).withColumn("km", geo.great_circle_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")))
    want = sorted(map(tuple, each.groupBy("point").agg(F.min(F.struct("km", "y", "x")).alias("b")).select("point", "b.y", "b.x", "b.km").collect()))
    columns = ["point", "y", "x", "km"]
    assert sorted(map(tuple, found.select(*columns).collect())) == want
    monkeypatch.setattr(geo, "HELD", 3)
    assert sorted(map(tuple, geo.nearest_cells_of(cells, places).select(*columns).collect())) == want
