"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import _col

_HALF = 2.0**62
_SPLIT = 134217729.0  # 2**27 + 1: cuts a double into two halves whose products with 100 are exact


def two_decimals(value: Column | str) -> Column:
    """``%.2f`` of the exact binary value with ties to even, as C and Python print it.

    Spark's own formatting rounds the shortest decimal form half up (0.125 -> 0.13, 0.295 -> 0.30).
    The whole part and the fraction of a double are doubles themselves, so the fraction alone is
    rounded: the error of fraction*100 is computed exactly and settles what looks like a tie. NULL and
    NaN give ``nan``, infinities ``inf``. Values of 4e37 and more stop the job.
    """
    v = F.abs(_col(value))
    floor = F.when(v < F.lit(2.0**53), F.floor(v).cast("double")).otherwise(v)
    part = v - floor
    high = part * F.lit(_SPLIT) - (part * F.lit(_SPLIT) - part)
    low = part - high
    cents = part * F.lit(100.0)
    error = (high * F.lit(100.0) - cents) + low * F.lit(100.0)
    tie = cents - F.floor(cents) == F.lit(0.5)
    rounded = (
        F.when(tie & (error > 0), F.ceil(cents)).when(tie & (error < 0), F.floor(cents)).otherwise(F.rint(cents))
    ).cast("bigint")
    sign = F.when(F.startswith(_col(value).cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    # the carry of a fraction that rounds to one; above 2**62 a double has no fraction and is cut into two exact halves
    small = (F.when(v < F.lit(_HALF), floor).cast("bigint") + (rounded == F.lit(100)).cast("bigint")).cast("string")
    upper = F.floor(v / F.lit(_HALF))
    lower = (v - upper.cast("double") * F.lit(_HALF)).cast("bigint")
    pieces = upper.cast("decimal(19,0)") * F.lit(int(_HALF)).cast("decimal(19,0)") + lower.cast("decimal(19,0)")
    too_large = F.raise_error(F.lit("too large a number for text with two decimals"))
    large = F.when(v < F.lit(4e37), pieces.cast("decimal(38,0)").cast("string")).otherwise(too_large)
    digits = F.when(v < F.lit(_HALF), small).otherwise(large)
    exact = F.concat(sign, digits, F.lit("."), F.lpad((rounded % F.lit(100)).cast("string"), 2, "0"))
    known = _col(value).isNotNull() & ~F.isnan(_col(value))
    return F.when(known & (v < F.lit(float("inf"))), exact).when(known, F.concat(sign, F.lit("inf"))).otherwise(F.lit("nan"))
