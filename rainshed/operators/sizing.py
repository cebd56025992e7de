"""Broadcast only what has been counted, and deal groups over tasks by count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Static tables have narrow rows (keys and a few doubles): a million of them stays under 100 MB.
BROADCAST_ROWS = 1_000_000
# Groups of a dozen columns take some 300 bytes in each of the hash maps of a stage.
ROWS_PER_TASK = 250_000
FEW_PARTS = 8


def broadcast_if_small(df: DataFrame, bound: DataFrame | None = None, max_rows: int | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` when ``bound``, a table it cannot outgrow, is small enough.

    Catalyst overestimates the result of joins and aggregates, so a few hundred basin cells would
    otherwise send the whole cube through a shuffle. Above the limit ``df`` is returned as it is and
    the join is a shuffle join under AQE, which splits hot keys. The count reads no columns.
    """
    rows = (df if bound is None else bound).count()
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if max_rows is None else max_rows) else df


def spread(df: DataFrame, keys: Sequence[str], bound: DataFrame) -> DataFrame:
    """``df`` dealt by its keys for an aggregate by them, in as many parts as the rows of ``bound`` need.

    ``bound`` is a table that the number of keys cannot outgrow. Shuffles of a fixed number of parts let the groups that a
    task holds grow with the input; here a task holds about ROWS_PER_TASK. Small tables are left to AQE.
    """
    parts = -(-bound.count() // ROWS_PER_TASK)
    return df.repartition(parts, *keys) if parts > FEW_PARTS else df


def bounded_join_side(df: DataFrame) -> DataFrame:
    """``df`` for a join whose other side must not be broadcast unseen: broadcast if small, else a merge join is asked for.

    Without the hint Catalyst may take a table that grows by an explode for its small source, and send it to the driver.
    """
    sized = broadcast_if_small(df)
    return df.hint("merge") if sized is df else sized
