import math
import random

import pytest

from rainshed.operators import cover, geo


def star(cx, cy, r, n, seed):
    rnd = random.Random(seed)
    points = [(cx + s * math.cos(a), cy + s * math.sin(a)) for a, s in ((2 * math.pi * i / n, r * rnd.uniform(0.3, 1)) for i in range(n))]
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def box(x0, y0, x1, y1):
    p = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(*a, *b) for a, b in zip(p, p[1:] + p[:1])]


def plain(points, features):
    found = set()
    for k, (px, py) in points.items():
        for f, edges in features.items():
            odd = edge = False
            for x1, y1, x2, y2 in edges:
                if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                    odd = not odd
                on = abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) < 1e-12
                edge |= on and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2)
            if odd and not edge:
                found.add((k, f))
    return found


@pytest.mark.parametrize("most, deepest", [(4, 10), (16, 1)])
def test_equals_ray_casts(spark, most, deepest):
    rnd = random.Random(3)
    features = {f"s{i}": star(rnd.uniform(-120, 120), rnd.uniform(-60, 60), 10 ** rnd.uniform(-3, 1.8), rnd.choice([3, 9, 60]), i) for i in range(25)}
    features["long"] = star(0.0, 0.0, 40.0, 700, 99)
    features["box"] = box(-4.0, -4.0, 4.0, 4.0)
    features["ring"] = box(0.0, 0.0, 8.0, 8.0) + box(2.0, 2.0, 6.0, 6.0)
    features["fan"] = [e for i in range(12) for a in [(0.1 + i, 5.0, 10.0, 20.0), (10.0, 20.0, 0.6 + i, 5.0), (0.6 + i, 5.0, 0.1 + i, 5.0)] for e in [a]]
    spots = [(float(x), float(y)) for x in range(-6, 10) for y in range(-6, 10)]
    spots += [(rnd.uniform(-130, 130), rnd.uniform(-70, 70)) for _ in range(600)] + [(rnd.uniform(-40, 40), rnd.uniform(-40, 40)) for _ in range(600)]
    spots += [(e[0] + rnd.gauss(0, 1e-2), e[1] + rnd.gauss(0, 1e-2)) for f in features.values() for e in f[:20]] + [f[0][:2] for f in features.values()]
    points = dict(enumerate(spots))
    edges = spark.createDataFrame([(f, *e) for f, es in features.items() for e in es] + [("void", None, 1.0, 2.0, 3.0)], "feature string, x1 double, y1 double, x2 double, y2 double")
    table = spark.createDataFrame([(k, *p) for k, p in points.items()] + [(-1, None, 1.0)], "id long, lon double, lat double")
    tiles = cover.cover(edges, most, deepest)
    got = [(r["id"], r["feature"]) for r in cover.features_at(table, edges, ["id"], tiles=tiles).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(points, features)


def test_bounded_tiles_and_clip(spark):
    rows = [(f, *e) for f in range(40) for e in star(f % 8 * 3.0, f // 8 * 3.0, 2.5, 150, f)]
    edges = spark.createDataFrame(rows, "feature int, x1 double, y1 double, x2 double, y2 double")
    tiles = cover.cover(edges)
    assert tiles.selectExpr("max(size(__edges))").first()[0] <= cover.MOST
    assert tiles.count() < 4 * len(rows)
    assert cover.features_at(spark.createDataFrame([(1, 1.0, 1.0)], "id int, lon double, lat double"), edges.limit(0), ["id"]).count() == 0
    cells = spark.range(900).selectExpr("id div 30 y", "id % 30 x", "(id % 30) * 0.8d lon", "(id div 30) * 0.5d lat")
    got = {(r["y"], r["x"]) for r in geo.clip(cells, edges, ["y", "x"]).collect()}
    features = {f: [r[1:] for r in rows if r[0] == f] for f in range(40)}
    assert got == {k for k, _ in plain({(i // 30, i % 30): (i % 30 * 0.8, i // 30 * 0.5) for i in range(900)}, features)}
