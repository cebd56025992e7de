"""Putting arrays, forecast steps, stations and products together.

Merges on coordinates are one conditional aggregate instead of a chain of outer joins: one shuffle,
with partial aggregation, whatever the number of variables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..schema import HRRR_INSTANT
from .sizing import bounded_join_side, broadcast_if_small, spread


def concat_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables one after the other; a variable that one of them lacks is missing there."""
    if not tables:
        raise ValueError("no data: nothing to put together")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def label(df: DataFrame, **names: str) -> DataFrame:
    """Constant columns, such as the dataset or the event a table belongs to."""
    return df.withColumns({k: F.lit(v) for k, v in names.items()})


def merge_variables(
    long: DataFrame, keys: Sequence[str], variables: Sequence[str], variable: str = "variable", value: str = "value",
    bound: DataFrame | None = None,
) -> DataFrame:
    """One column per variable on the union of all coordinates.

    Two different known values for one place and variable are an error, found in the same pass. ``bound``, a table with
    no fewer rows than there are coordinates, bounds what a task holds (``sizing.spread``).
    """

    def merged(name: str) -> Column:
        mine = F.when(F.col(variable) == name, F.col(value))
        clash = F.concat(F.lit(f"conflicting values of {name} at "), F.to_json(F.struct(*keys)))
        return F.when(F.min(mine) < F.max(mine), F.raise_error(clash)).otherwise(F.max(mine)).alias(name)

    known = long.filter(F.col(variable).isin(list(variables)))
    if bound is not None:
        known = spread(known, keys, bound)
    return known.groupBy(*keys).agg(*[merged(v) for v in variables])


def stack_variables(wide: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """The reverse: one row per variable. Used to read single-variable files as one table."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").alias("value")) for v in variables])
    return wide.select(*keys, F.inline(pairs))


def merge_forecast_steps(
    raw: DataFrame, keys: Sequence[str] = ("time", "y", "x"), static: Sequence[str] = ("lon360", "lat"), step: str = "step_h"
) -> DataFrame:
    """Step 0 gives the instantaneous variables, step 1 the rain and the highest wind of the hour.

    Rows keep the time of the run, so rain is that of the following hour. One aggregate, no join.
    """
    have = set(raw.columns)
    at = lambda h, c: F.max(F.when(F.col(step) == h, F.col(c))).alias(c)
    columns = [F.max(c).alias(c) for c in static if c in have]
    columns += [at(0, c) for c in HRRR_INSTANT if c in have]
    columns += [at(1, c) for c in ("tp", "max_10si") if c in have]
    return raw.filter(F.col(step).isin(0, 1)).groupBy(*keys).agg(*columns)


def slot(time: str, frequency: str) -> Column:
    if frequency not in ("hourly", "daily"):
        raise ValueError(f"frequency must be hourly or daily, not {frequency}")
    return times.floor_hour(time) if frequency == "hourly" else times.floor_day(time)


def station_slots(readings: DataFrame, variables: Sequence[str], frequency: str = "hourly") -> DataFrame:
    """Readings (site, time, variable, value) as one row per site and hour or day.

    Of several readings of a variable in one slot the last one counts; of readings at the same
    instant the highest.
    """
    kept = readings.filter(F.col("variable").isin(list(variables)) & F.col("value").isNotNull()).select(
        F.col("site").cast("string").alias("site"), slot("time", frequency).alias("__slot"), "time", "variable", "value"
    )
    # both aggregates follow one shuffle by slot, and are hash aggregates: a maximum of structs would sort all readings
    names = {v: f"__v{i}" for i, v in enumerate(variables)}
    instants = kept.repartition("site", "__slot").groupBy("site", "__slot", "time").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(n) for v, n in names.items()]
    )
    last = lambda v, n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("time"))).alias(v)
    return instants.groupBy("site", F.col("__slot").alias("time")).agg(*[last(v, n) for v, n in names.items()])


def densify(
    slots: DataFrame, frequency: str = "hourly", site: str = "site", time: str = "time",
    axis: DataFrame | None = None, sites: DataFrame | None = None,
) -> DataFrame:
    """Every site at every time that occurs at any site, from at most one row per site and time.

    The result is as large as times x sites by definition, so it is made last, without a shuffle of
    its rows: slots and times are packed by day (by month for daily data), sites and packs meet in
    equi-joins, and only then are the times unfolded. A pack holds at most 24 hours or 31 days.
    ``axis`` and ``sites`` may be given where they come cheaper than from ``slots``.
    """
    values = [c for c in slots.columns if c not in (site, time)]
    unit = "day" if frequency == "hourly" else "month"
    pack = lambda c: F.to_date(c) if unit == "day" else F.trunc(c, "month")
    times_of = (
        (slots if axis is None else axis).select(time).distinct()
        .groupBy(pack(F.col(time)).alias("__p")).agg(F.collect_list(time).alias("__times"))
    )
    ends = times_of.agg(F.struct(F.min("__p").alias("a"), F.max("__p").alias("b"))).scalar()
    entry = F.struct(F.col(time), F.struct(*[F.col(f"`{v}`") for v in values]).alias("v"))
    held = slots.groupBy(site, pack(F.col(time)).alias("__p")).agg(F.map_from_entries(F.collect_list(entry)).alias("__held"))
    frame = (
        (slots if sites is None else sites).select(site).distinct()
        .withColumn("__e", ends)
        .select(site, F.explode(F.sequence("__e.a", "__e.b", F.expr(f"interval 1 {unit}"))).alias("__p"))
    )
    rows = frame.join(held, [site, "__p"], "left").join(times_of, "__p").withColumn(time, F.explode("__times"))
    found = F.element_at("__held", F.col(time))
    return rows.select(site, time, found.alias("__v")).select(site, time, *[F.col(f"__v.`{v}`").alias(v) for v in values])


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the first in the given order; an aggregate, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in key]
    ordered = [*order, *[c for c in rest if c not in order]]
    first = F.min(F.struct(*ordered)).alias("__r")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def site_coordinates(rows: DataFrame, order: Sequence[str] = ("time",)) -> DataFrame:
    """Coordinates of each site from its first row, joined later by key. Sites of equal name all stay."""
    names = [c for c in ("site_name", "lat", "lon", "elevation_ft") if c in rows.columns]
    wanted = [*order, *[n for n in names if n not in order]]
    first = first_per_key(rows.select("site", *wanted), ["site"], order)
    return first.select("site", *names)


def known_sites(rows: DataFrame, cube: DataFrame) -> DataFrame:
    """Rows whose site is in the cube."""
    return rows.join(cube.select("site").distinct(), ["site"], "left_semi")


def attach_sites(cube: DataFrame, coordinates: DataFrame) -> DataFrame:
    return cube.join(broadcast_if_small(coordinates), ["site"], "left")


def event_slices(df: DataFrame, windows: DataFrame | Sequence[tuple[str, str, str]], time: str = "time") -> DataFrame:
    """One copy of the rows of each event window (both end days whole), with an ``event`` column.

    A list of windows becomes literal predicates: their union reaches the file scan and no join is
    made. A table of windows of any size is joined on the day, and on the year where the store has it,
    so that partitions are pruned by the windows at run time; first and last day of all windows are
    scalars that reach the scan.
    """
    if isinstance(windows, DataFrame):
        windows = windows.filter(F.col("start_day") <= F.col("end_day"))
        day = F.explode(F.sequence("start_day", "end_day", F.expr("interval 1 day")))
        days = windows.select("event", day.alias("__day"))
        ends = windows.agg(F.min("start_day").alias("a"), F.date_add(F.max("end_day"), 1).alias("b"))
        kind = df.schema[time].dataType
        low, high = (ends.select(F.col(c).cast(kind)).scalar() for c in ("a", "b"))
        rows, keys = df.filter((F.col(time) >= low) & (F.col(time) < high)), ["__day"]
        if "year" in df.columns and time != "year":
            days, keys = days.withColumn("year", F.year("__day").cast(df.schema["year"].dataType)), ["year", "__day"]
        joined = rows.withColumn("__day", F.to_date(F.col(time))).join(bounded_join_side(days), keys)
        return joined.select(*df.columns, "event")
    if not windows:
        return df.withColumn("event", F.lit(None).cast("string")).limit(0)
    tests = [(name, times.within_days(df, time, start, end)) for name, start, end in windows]
    hits = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return df.filter(reduce(lambda a, b: a | b, [t for _, t in tests])).withColumn("event", F.explode(hits))


def by_product(df: DataFrame, keys: Sequence[str], products: Sequence[str], value: str, product: str = "product") -> DataFrame:
    """Products side by side on one axis: one column each, missing where a product has no value."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(product) == p, F.col(value))).alias(p.lower()) for p in products]
    )
