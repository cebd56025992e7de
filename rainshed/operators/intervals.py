"""Event windows of any length and number, by a dyadic cover of the days.

A node (level, index) stands for 2^level days. A window is covered by at most two nodes per level, and a day lies in one
node of each level, so windows and days meet in equi-joins on nodes: no row per day of a window, no range join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .sizing import bounded_join_side

LEVELS = 17  # the widest node: 2^16 days, 179 years; longer windows take several of them
_LEVEL, _INDEX = "__level", "__index"


def cover(windows: DataFrame, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """The windows (both end days whole) with a row per node of their cover. Windows that end before they start, or lack
    a day, have none."""
    a, b = F.unix_date(start), F.unix_date(end) + 1
    first = lambda level: F.shiftright(a + ((1 << level) - 1), level)
    last = lambda level: F.shiftright(b, level)

    def nodes(level: int, low: Column, high: Column) -> Column:
        found = F.transform(F.sequence(low, high - 1), lambda i: F.struct(F.lit(level).alias(_LEVEL), i.alias(_INDEX)))
        none = F.array().cast(f"array<struct<{_LEVEL}:int,{_INDEX}:int>>")
        return F.when(low < high, found).otherwise(none)

    parts = []
    for level in range(LEVELS):
        low, high = first(level), last(level)
        if level == LEVELS - 1:
            parts.append(nodes(level, low, high))
            continue
        # what the nodes twice as wide inside the window leave over at either side
        up, down = 2 * first(level + 1), 2 * last(level + 1)
        parts += [nodes(level, low, F.when(up < down, up).otherwise(high)), nodes(level, F.when(up < down, down).otherwise(high), high)]
    known = windows.filter(F.col(start) <= F.col(end))
    return known.select("*", F.inline(F.flatten(F.array(*parts))))


def _nodes_of(day: Column, levels: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias(_LEVEL), F.shiftright(F.unix_date(day), n).alias(_INDEX)) for n in levels])


def _levels(windows: DataFrame, start: str, end: str) -> list[int]:
    """Levels that a cover may use, by the longest window."""
    longest = windows.filter(F.col(start) <= F.col(end)).agg(F.max(F.datediff(end, start) + 1)).first()[0]
    return list(range(min(LEVELS, int(longest).bit_length()))) if longest else []


def event_slices(df: DataFrame, windows: DataFrame, time: str = "time", start: str = "start_day", end: str = "end_day") -> DataFrame:
    """One copy of the rows of each window, with an ``event`` column: ``combine.event_slices`` for many or long windows."""
    nodes = cover(windows, start, end).select("event", _LEVEL, _INDEX)
    levels = _levels(windows, start, end)
    if not levels:
        return df.withColumn("event", F.lit(None).cast(windows.schema["event"].dataType)).limit(0)
    ends = windows.filter(F.col(start) <= F.col(end)).agg(F.min(start).alias("a"), F.date_add(F.max(end), 1).alias("b"))
    low, high = (ends.select(F.col(c).cast(df.schema[time].dataType)).scalar() for c in ("a", "b"))
    rows = df.filter((F.col(time) >= low) & (F.col(time) < high))
    placed = rows.select("*", F.inline(_nodes_of(F.to_date(F.col(time)), levels)))
    return placed.join(bounded_join_side(nodes), [_LEVEL, _INDEX]).select(*df.columns, "event")


def event_totals(
    df: DataFrame, windows: DataFrame, values: Mapping[str, tuple[str, str | Column]], time: str = "time",
    keys: tuple[str, ...] = (), start: str = "start_day", end: str = "end_day",
) -> DataFrame:
    """Sums, counts, lows and highs of each window (event, keys, new columns) without a row per day and window.

    ``values`` maps a new column to (sum, count, min or max; value). Rows are reduced once per day, days once per node, and a
    window adds up the nodes of its cover. Windows without rows are absent. Events are told apart by ``event``. The sums of
    the nodes, a few per day and key, are written once and broadcast if small; the windows' nodes never are.
    """
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    if wrong := {how for how, _ in values.values()} - set(again):
        raise ValueError(f"{', '.join(sorted(wrong))} cannot be put together from parts")
    keys, day = list(keys), F.to_date(F.col(time)).alias("__day")
    # dealt by event, so that the nodes are made on all tasks and added up where they are
    nodes = cover(windows.repartition("event"), start, end).select("event", _LEVEL, _INDEX)
    levels = _levels(windows, start, end) or [0]
    first = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    daily = df.groupBy(*keys, day).agg(*[first[how](v).alias(out) for out, (how, v) in values.items()])
    parts = [again[how](out).alias(out) for out, (how, _) in values.items()]
    by_node = daily.select("*", F.inline(_nodes_of(F.col("__day"), levels))).groupBy(*keys, _LEVEL, _INDEX).agg(*parts)
    by_node = bounded_join_side(stored(by_node, "nodes"))
    return nodes.join(by_node, [_LEVEL, _INDEX]).groupBy("event", *keys).agg(*parts)
