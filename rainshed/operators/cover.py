"""Points in the polygons of many features, by a quadtree cover of each.

A feature begins with the at most four square tiles that its box meets, and a tile with more than ``MOST`` edges is cut into
4 x 4 (two levels of a quadtree at once) until it has no more, or is ``DEEPEST`` cuts below the first. Each tile knows whether
its centre is inside: a child's centre is reached from its parent's on two straight lines, and only edges of the parent can lie
between. A tile without edges is inside as a whole or dropped; in a border tile a point is joined to the centre in the same way
and meets only the edges of that tile. Tiles of all features lie on one lattice, so points meet them by an equi-join per level.

Feature and edges: (feature, x1, y1, x2, y2), any number of rings. Where more than MOST edges meet in one place, the last tile
there keeps them all. Edges and points without coordinates are left out; points on an edge or corner are outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .sizing import broadcast_if_small

MOST, DEEPEST, CUT = 16, 10, 4
# borders and centres of tiles lie off the round numbers that outlines are drawn with
ORIGIN = (-541.0837419, -517.0519283)
TILE = ["__level", "__tx", "__ty"]
_OWN = ["feature", *TILE]
_EDGE = ["x1", "y1", "x2", "y2"]
_EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), -level)


def _centre(level: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    return F.lit(ORIGIN[0]) + (tx + 0.5) * _size(level), F.lit(ORIGIN[1]) + (ty + 0.5) * _size(level)


def _index(level: Column, c: Column, axis: int) -> Column:
    return F.floor((c - F.lit(ORIGIN[axis])) / _size(level))


def _ahead(e, px: Column, py: Column) -> Column:
    """The edge lies to the right of a point, on its latitude (a ray cast counts these)."""
    return ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])


def _above(e, px: Column, py: Column) -> Column:
    return ((e["x1"] > px) != (e["x2"] > px)) & (py < (e["y2"] - e["y1"]) * (px - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"])


def _between(e, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 where the edge crosses the way from a to b (north or south first) an odd number of times."""
    way = lambda side, *points: F.coalesce(side(e, *points[:2]), F.lit(False)) != F.coalesce(side(e, *points[2:]), F.lit(False))
    return (way(_above, ax, ay, ax, by) != way(_ahead, ax, by, bx, by)).cast("int")


def _meets(e, level: Column, cx: Column, cy: Column) -> Column:
    """The edge touches the tile, a little widened: boxes overlap, and the tile is not on one side of the line."""
    half = _size(level) * (0.5 + 1e-6)
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    near = lambda a, b, c: (F.least(a, b) <= c + half) & (F.greatest(a, b) >= c - half)
    cuts = F.abs((cx - e["x1"]) * dy - (cy - e["y1"]) * dx) <= half * (F.abs(dx) + F.abs(dy))
    return near(e["x1"], e["x2"], cx) & near(e["y1"], e["y2"], cy) & cuts


def _first_tiles(edges: DataFrame) -> DataFrame:
    """Tiles as wide as a feature's box that the box meets."""
    ends = lambda a, b: (F.min(F.least(a, b)), F.max(F.greatest(a, b)))
    (x0, x1), (y0, y1) = ends("x1", "x2"), ends("y1", "y2")
    boxes = edges.groupBy("feature").agg(x0.alias("a"), x1.alias("b"), y0.alias("c"), y1.alias("d"))
    extent = F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c"), F.lit(1e-6))
    level = F.col("__level")
    boxes = boxes.withColumn("__level", F.floor(-F.log2(extent)).cast("int"))
    rows = boxes.withColumn("__tx", F.explode(F.sequence(_index(level, F.col("a"), 0), _index(level, F.col("b"), 0))))
    return rows.withColumn("__ty", F.explode(F.sequence(_index(level, F.col("c"), 1), _index(level, F.col("d"), 1)))).select(*_OWN)


def cover(edges: DataFrame, most: int = MOST, deepest: int = DEEPEST) -> DataFrame:
    """The tiles of each feature: feature, tile, ``__in`` (1: the centre is inside) and ``__edges`` (empty: all of it is)."""
    edges = edges.select("feature", *[F.col(c).cast("double").alias(c) for c in _EDGE]).dropna(subset=_EDGE)
    e = {c: F.col(c) for c in _EDGE}
    centre = _centre(*[F.col(c) for c in TILE])
    first = stored(_first_tiles(edges), "cover-first")
    rows = edges.join(broadcast_if_small(first), "feature").withColumn("__flips", _ahead(e, *centre).cast("int"))
    start = F.lit(0)
    leaves = []
    for depth in range(deepest + 1):
        met = _meets(e, F.col("__level"), *centre).alias("__met")
        rows = rows.select(*_OWN, *_EDGE, start.alias("__start"), F.coalesce("__flips", F.lit(0)).alias("__flips"), met)
        rows = stored(rows, "cover-rows")
        count = F.count_if("__met").alias("__count")
        tiles = stored(rows.groupBy(*_OWN).agg(((F.first("__start") + F.sum("__flips")) % 2).alias("__in"), count), "cover-tiles")
        ended = F.lit(True) if depth == deepest else F.col("__count") <= most
        whole = tiles.filter((F.col("__count") == 0) & (F.col("__in") == 1))
        leaves.append(whole.select(*_OWN, "__in", F.lit(None).cast(_EDGES).alias("__edges")))
        members = rows.filter("__met").select(*_OWN, *_EDGE).join(broadcast_if_small(tiles), _OWN)
        border = members.filter(ended).groupBy(*_OWN, "__in").agg(F.collect_list(F.struct(*_EDGE)).alias("__edges"))
        leaves.append(border.select(*_OWN, "__in", "__edges"))
        if depth == deepest or tiles.filter(F.col("__count") > most).isEmpty():
            break
        # two levels down; the way from the old centre to each new one
        parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(CUT) for j in range(CUT)])
        old = _centre(F.col("__level"), F.col("__tx"), F.col("__ty"))
        cut = members.filter(~ended).select(*_OWN, *_EDGE, F.col("__in").alias("__start"), old[0].alias("__ox"), old[1].alias("__oy"), F.inline(parts))
        inner = {"__level": F.col("__level") + 2, "__tx": F.col("__tx") * CUT + F.col("i"), "__ty": F.col("__ty") * CUT + F.col("j")}
        cut = cut.withColumns(inner)
        rows = cut.withColumn("__flips", _between(e, F.col("__ox"), F.col("__oy"), *centre))
        start = F.col("__start")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return stored(out, "cover-leaves")


def features_at(
    points: DataFrame, edges: DataFrame, key: Sequence[str] = ("y", "x"), lon: str = "lon", lat: str = "lat", tiles: DataFrame | None = None
) -> DataFrame:
    """(key, feature): the features that hold each point strictly inside. ``tiles``: a cover made before.

    A point becomes one row per level in use and meets one tile, of at most ``MOST`` edges, of each feature about it.
    """
    tiles = cover(edges) if tiles is None else tiles
    levels = sorted(r[0] for r in tiles.select("__level").distinct().collect()) or [0]  # a few dozen at most
    key, (px, py) = list(key), (F.col("__px"), F.col("__py"))
    rows = points.select(*key, F.col(lon).alias("__px"), F.col(lat).alias("__py")).dropna(subset=["__px", "__py"])
    own = [F.struct(F.lit(n).alias("__level"), _index(F.lit(n), px, 0).alias("__tx"), _index(F.lit(n), py, 1).alias("__ty")) for n in levels]
    met = rows.select("*", F.inline(F.array(*own))).join(broadcast_if_small(tiles), TILE)
    centre = _centre(*[F.col(c) for c in TILE])
    n = F.aggregate("__edges", F.col("__in").cast("bigint"), lambda n, e: n + _between(e, *centre, px, py))
    touched = F.exists("__edges", lambda e: (
        (F.abs((e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])) < F.lit(1e-12))
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    ))
    inside = F.col("__edges").isNull() | ((n % 2 == 1) & ~touched)
    return met.filter(inside).select(*key, "feature")
