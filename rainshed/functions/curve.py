"""The Z-order curve over grid cells: codes as columns, and the code ranges of cells and boxes as numbers."""

from __future__ import annotations

import functools
import heapq
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 31  # of an index; codes take 62
Range = tuple[int, int]


def _spread(c: Column) -> Column:
    """The bits of an index with a gap before each."""
    c = c.cast("long")
    for shift in (16, 8, 4, 2, 1):
        mask = sum(((1 << shift) - 1) << at for at in range(0, 63, 2 * shift)) & (1 << 63) - 1
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def code(y: str = "y", x: str = "x") -> Column:
    """The code of a cell; cells with near codes are near. Indices are 0 or more and below 2^31; others are errors."""
    good = F.col(y).between(0, (1 << BITS) - 1) & F.col(x).between(0, (1 << BITS) - 1)
    wrong = F.raise_error(F.concat(F.lit("no curve code for cell "), F.concat_ws(",", F.col(y).cast("string"), F.col(x).cast("string"))))
    found = F.shiftleft(_spread(F.col(y)), 1).bitwiseOR(_spread(F.col(x)))
    return F.when(F.col(y).isNull() | F.col(x).isNull(), F.lit(None).cast("long")).when(good, found).otherwise(wrong.cast("long"))


def code_of(y: int, x: int) -> int:
    return sum((y >> k & 1) << 2 * k + 1 | (x >> k & 1) << 2 * k for k in range(BITS))


def joined_ranges(ranges: Iterable[Range], most: int) -> list[Range]:
    """Ranges in order, neighbours joined; beyond ``most`` those with the smallest gaps too, so they may hold other codes."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])
        close, joined = set(gaps[: len(out) - most]), []
        for i, piece in enumerate(out):
            if i in close:
                joined[-1][1] = piece[1]
            else:
                joined.append(piece)
        out = joined
    return [(a, b) for a, b in out]


def cell_ranges(cells: Iterable[tuple[int, int]], most: int = 64) -> list[Range]:
    return joined_ranges(((c, c) for c in {code_of(y, x) for y, x in cells}), most)


def box_ranges(y0: int, y1: int, x0: int, x1: int, most: int = 64) -> list[Range]:
    """Ranges that cover the cells of a box (ends included): quadrants, the largest that sticks out cut first."""
    y0, x0 = max(0, y0), max(0, x0)
    if y0 > y1 or x0 > x1:
        return []
    whole = max(y1, x1).bit_length()
    done, cut = [], [(-whole, 0, 0)]
    while cut and len(done) + len(cut) < 2 * most:
        bits, y, x = heapq.heappop(cut)
        half = -bits - 1
        for qy, qx in ((y, x), (y, x + (1 << half)), (y + (1 << half), x), (y + (1 << half), x + (1 << half))) if half >= 0 else ((y, x),):
            size = 1 << max(half, 0)
            if qy > y1 or qx > x1 or qy + size <= y0 or qx + size <= x0:
                continue
            if half <= 0 or (qy >= y0 and qx >= x0 and qy + size - 1 <= y1 and qx + size - 1 <= x1):
                done.append((max(half, 0), qy, qx))
            else:
                heapq.heappush(cut, (-half, qy, qx))
    blocks = done + [(-bits, y, x) for bits, y, x in cut]
    starts = ((code_of(y, x), bits) for bits, y, x in blocks)
    return joined_ranges(((start, start + (1 << 2 * bits) - 1) for start, bits in starts), most)


def in_ranges(ranges: Iterable[Range], column: str) -> Column:
    """A condition of literals, which reaches the statistics of files, row groups and pages."""
    tests = [F.col(column).between(a, b) for a, b in ranges]
    return functools.reduce(operator.or_, tests) if tests else F.lit(False)
