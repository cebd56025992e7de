"""Stations and polygons from GeoJSON.

A FeatureCollection file is one JSON value and is read by one task; that fits outlines and station
lists. Large sets come as one feature per line (``features_from_lines``), which splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = (
    "struct<type: string, properties: struct<name: string, id: string, datasource: string>, "
    "geometry: struct<type: string, coordinates: array<double>>>"
)
_SHAPE = "struct<type: string, geometry: struct<type: string, coordinates: string>>"


def _collection(spark: SparkSession, path: str, feature: str) -> DataFrame:
    return spark.read.schema(f"type string, features array<{feature}>").option("multiLine", True).json(path)


def station_columns(feature: str | Column = "feature") -> list[Column]:
    """id, name, datasource, lon, lat, elev_ft of a point feature; an empty geometry gives missing."""
    f = F.col(feature) if isinstance(feature, str) else feature
    at = lambda i: F.get(f["geometry"]["coordinates"], F.lit(i))
    text = lambda c: f["properties"][c].alias(c)
    return [text("id"), text("name"), text("datasource"), at(0).alias("lon"), at(1).alias("lat"), at(2).alias("elev_ft")]


def without_z(coordinates: str | Column) -> Column:
    """Longitude and latitude of a position; an empty one passes through."""
    c = F.col(coordinates) if isinstance(coordinates, str) else coordinates
    return F.slice(c, 1, 2)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    features = _collection(spark, path, _POINT).select(F.explode("features").alias("feature"))
    return features.select(*station_columns())


def stations_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stations from a table of feature texts, one per row."""
    return lines.select(F.from_json(column, _POINT).alias("feature")).select(*station_columns())


def _edges(shapes: DataFrame) -> DataFrame:
    """Edges of (feature, kind, coordinates text): every ring of every polygon."""
    deep = "array<array<array<array<double>>>>"
    polygons = F.when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", deep)).when(
        F.col("kind") == "Polygon", F.from_json(F.concat(F.lit("["), F.col("coordinates"), F.lit("]")), deep)
    )
    rings = shapes.select("feature", F.explode(F.flatten(polygons)).alias("ring"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("ring") - 1),
        lambda i: F.struct(
            F.col("ring")[i - 1][0].alias("x1"), F.col("ring")[i - 1][1].alias("y1"),
            F.col("ring")[i][0].alias("x2"), F.col("ring")[i][1].alias("y2"),
        ),
    )
    return rings.filter(F.size("ring") > 1).select("feature", F.inline(pairs))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a polygon file; ``feature`` counts its features from 0."""
    found = _collection(spark, path, _SHAPE).select(F.posexplode("features").alias("feature", "f"))
    return _edges(found.select("feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates")))


def edges_from_lines(lines: DataFrame, column: str = "value", feature: str = "feature") -> DataFrame:
    """Edges from a table of (feature, text of one polygon feature)."""
    parsed = lines.select(F.col(feature).alias("feature"), F.from_json(column, _SHAPE).alias("f"))
    return _edges(parsed.select("feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates")))
