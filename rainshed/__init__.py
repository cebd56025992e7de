"""Hydro-meteorological data cubes as Spark DataFrame jobs.

A cube is a long table: one row per (product, scenario, time, y, x) with one DOUBLE column per
variable. Every operator takes DataFrames and returns a DataFrame; nothing is collected except
one-row bounds of static tables (a polygon, a raster header).
"""
