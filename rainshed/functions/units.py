"""Unit changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(f"`{value}`") if isinstance(value, str) else value


def kelvin_to_celsius(value: Column | str) -> Column:
    return _col(value) - F.lit(273.15)


def fahrenheit_to_celsius(value: Column | str) -> Column:
    return (_col(value) - F.lit(32.0)) * F.lit(5.0 / 9.0)


def feet_to_metres(value: Column | str) -> Column:
    return _col(value) * F.lit(0.3048)


def divided(value: Column | str, by: float) -> Column:
    """mm to m (by 1000), tenths to units (by 10) and the like."""
    return _col(value) / F.lit(float(by))


def lon_from_360(value: Column | str) -> Column:
    """Longitudes west of Greenwich given on 0..360."""
    return _col(value) - F.lit(360.0)


def total_rain(convective: Column | str, other: Column | str) -> Column:
    return _col(convective) + _col(other)


def mid_temperature(high: Column | str, low: Column | str) -> Column:
    return (_col(high) + _col(low)) / F.lit(2.0)


def wind_speed(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(_col(u) * _col(u) + _col(v) * _col(v))
