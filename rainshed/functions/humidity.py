"""Relative humidity in percent. Saturation vapour pressure after Bolton (1980)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import _col


def saturation_pressure(kelvin: Column | str) -> Column:
    """Pa."""
    t = _col(kelvin)
    return F.lit(611.2) * F.exp(F.lit(17.67) * (t - F.lit(273.15)) / (t - F.lit(29.65)))


def from_specific_humidity(q: Column | str, kelvin: Column | str, pressure: Column | str) -> Column:
    """q in kg/kg, pressure in Pa."""
    q, p, es = _col(q), _col(pressure), saturation_pressure(kelvin)
    mixing = q / (F.lit(1.0) - q)
    saturated = F.lit(0.622) * es / (p - es)
    return F.lit(100.0) * mixing / saturated


def from_pressure_deficit(deficit: Column | str, celsius: Column | str) -> Column:
    """Deficit in hPa."""
    es = saturation_pressure(_col(celsius) + F.lit(273.15)) / F.lit(100.0)
    return F.lit(100.0) * (F.lit(1.0) - _col(deficit) / es)
