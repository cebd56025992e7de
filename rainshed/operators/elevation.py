"""Elevation of grid cells from a raster.

A raster is a lattice of regular steps, so the nearest raster point is an index computed per axis
and an equi-join on it. No candidate pairs are made, whatever the density of either side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _axis(dem: DataFrame, index: str, coord: str) -> tuple[Column, ...]:
    """First and last index and coordinate of an axis, from a one-row aggregate."""
    return (
        F.min(index).alias(f"{coord}_i0"), F.max(index).alias(f"{coord}_i1"),
        F.min_by(coord, index).alias(f"{coord}_0"), F.max_by(coord, index).alias(f"{coord}_1"),
    )


def _nearest_index(at: Column, first: Column, last: Column, i0: Column, i1: Column, clamp: bool) -> Column:
    """Nearest lattice index; half a step goes to the lower coordinate, also on a descending axis."""
    step = (last - first) / F.when(i1 > i0, i1 - i0)
    low, high = F.least(first, last), F.greatest(first, last)
    inside = at.between(low, high)
    pos = (F.least(F.greatest(at, low), high) - first) / step
    index = F.when(step > 0, F.ceil(pos - F.lit(0.5))).when(step < 0, F.floor(pos + F.lit(0.5))).otherwise(F.lit(0)) + i0
    index = index.cast("int")
    return index if clamp else F.when(inside, index)


def _embed(
    targets: DataFrame, dem: DataFrame, lon: str, lat: str, clamp: bool, x: str, y: str, ix: str, iy: str, elevation: str, band: int
) -> DataFrame:
    """One row for each target: of a raster with bands one band counts. Steps that are not regular are an error."""
    if "band" in dem.columns:
        dem = dem.filter(F.col("band") == band)
    header = dem.agg(F.struct(*_axis(dem, ix, x), *_axis(dem, iy, y))).scalar()
    head = lambda axis: [F.col(f"__h.{axis}_{part}") for part in ("0", "1", "i0", "i1")]
    located = targets.withColumn("__h", header).withColumns({
        "__ix": _nearest_index(F.col(lon), *head(x), clamp), "__iy": _nearest_index(F.col(lat), *head(y), clamp),
    }).drop("__h")

    def off_lattice(at: str, index: str, axis: str) -> Column:
        first, last, i0, i1 = head(axis)
        step = (last - first) / F.when(i1 > i0, i1 - i0)
        return F.coalesce(F.abs(F.col(at) - first - (F.col(index) - i0) * step) > F.abs(step) * 0.01, F.lit(False))

    odd = off_lattice(x, ix, x) | off_lattice(y, iy, y)
    checked = F.when(odd, F.raise_error(F.lit("the raster has no regular steps")).cast("double")).otherwise(F.col(elevation))
    points = dem.withColumn("__h", header).select(F.col(ix).alias("__ix"), F.col(iy).alias("__iy"), checked.alias("elevation"))
    return located.join(points, ["__ix", "__iy"], "left").drop("__ix", "__iy")


def embed_on_axes(
    targets: DataFrame, dem: DataFrame, lon: str = "lon", lat: str = "lat",
    x: str = "x", y: str = "y", ix: str = "ix", iy: str = "iy", elevation: str = "elevation", band: int = 1,
) -> DataFrame:
    """Nearest raster value for cells of 1-D axes; missing outside the raster."""
    return _embed(targets, dem, lon, lat, False, x, y, ix, iy, elevation, band)


def embed_on_curves(
    targets: DataFrame, dem: DataFrame, lon: str = "lon", lat: str = "lat",
    x: str = "x", y: str = "y", ix: str = "ix", iy: str = "iy", elevation: str = "elevation", band: int = 1,
) -> DataFrame:
    """Nearest raster value for cells with 2-D coordinates; never missing for want of a near point.

    Squared distance is a sum over the axes, so the nearest lattice point is the nearest one on each
    axis, and outside the raster it is the one on the border. Ties go to the lower coordinate. A raster
    point whose value is missing gives a missing elevation.
    """
    return _embed(targets, dem, lon, lat, True, x, y, ix, iy, elevation, band)


def band_mean(dem: DataFrame, keys: Sequence[str] = ("iy", "ix", "y", "x")) -> DataFrame:
    """Mean over the bands of a raster (missing bands are left out)."""
    return dem.groupBy(*keys).agg(F.avg("elevation").alias("elevation"))


def embed_band_mean(targets: DataFrame, dem: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The older form: all bands count, by their mean."""
    return embed_on_axes(targets, band_mean(dem), lon, lat)
