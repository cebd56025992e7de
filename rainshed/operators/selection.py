"""Exact quantiles of groups of any size, by histograms of ever narrower ranges.

A quantile lies between the values at one or two ranks. For each rank the value range that holds it is kept, with the number
of values below. A pass cuts the range at ``BINS`` quantiles of a mergeable sketch, takes the few bins around the rank, and
counts exactly what lies under, at and between their ends. So the sketch only guides; the counts decide. A pass leaves about
three bins in a thousand, and values at the ends, however often they occur, are settled by their count. Only rows in open
ranges are stored for the next pass. Ranges of at most ``few`` values are sorted at last; no task holds more of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .sizing import broadcast_if_small

BINS = 1000
FEW = 100_000
FIVE = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
_STATE = ["__g", "__rank", "__lo", "__hi", "__below", "__n"]


def _sketch(bins: int) -> Column:
    marks = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return F.percentile_approx("__v", marks, 10 * bins).alias("__marks")


def _settled(state: DataFrame, final: Column | None = None) -> DataFrame:
    """The state with ``__value`` where the range tells it: its ends, or one value alone."""
    at = F.col("__rank") - F.col("__below")
    ends = F.when((at == 0) | (F.col("__lo") == F.col("__hi")), F.col("__lo")).when(at == F.col("__n") - 1, F.col("__hi"))
    return state.select(*_STATE, (ends if final is None else F.coalesce(final, ends)).alias("__value"))


def _in_ranges(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Each row with each open range of its group that holds it."""
    return rows.join(broadcast_if_small(probes), "__g").filter(F.col("__v").between(F.col("__lo"), F.col("__hi")))


def _narrow(rows: DataFrame, state: DataFrame, bins: int) -> DataFrame:
    """One pass: the state with smaller ranges, or with values."""
    at = F.floor((F.col("__rank") - F.col("__below")) * bins / F.col("__n"))
    bracket = {
        "__a": F.get("__marks", F.greatest(at - 1, F.lit(0))), "__b": F.get("__marks", F.least(at + 2, F.lit(bins))),
    }
    probes = stored(state.withColumns(bracket).select(*_STATE, "__a", "__b"), "selection-brackets")
    v, a, b = F.col("__v"), F.col("__a"), F.col("__b")
    inside = (v > a) & (v < b)
    met = _in_ranges(rows, probes).groupBy(*_STATE, "__a", "__b").agg(
        F.count_if(v < a).alias("__under"), F.count_if(v == a).alias("__at_a"), F.count_if(inside).alias("__inside"),
        F.count_if((v == b) & (a < b)).alias("__at_b"), F.max(F.when(v < a, v)).alias("__top"), F.min(F.when(inside, v)).alias("__first"),
        F.max(F.when(inside, v)).alias("__last"), F.min(F.when(v > b, v)).alias("__next"),
    )
    upto_a = F.col("__under") + F.col("__at_a")
    before_b = upto_a + F.col("__inside")
    upto_b = before_b + F.col("__at_b")
    place = F.col("__rank") - F.col("__below")
    low, low_end, mid, high_end = place < F.col("__under"), place < upto_a, place < before_b, place < upto_b

    def choose(*of: Column) -> Column:
        under, between, over = of
        return F.when(low, under).when(mid, between).otherwise(over)

    final = F.when(~low & low_end, a).when(~mid & high_end, b)
    after = {
        "__lo": choose(F.col("__lo"), F.col("__first"), F.col("__next")), "__hi": choose(F.col("__top"), F.col("__last"), F.col("__hi")),
        "__below": F.col("__below") + choose(F.lit(0), upto_a, upto_b),
        "__n": choose(F.col("__under"), F.col("__inside"), F.col("__n") - upto_b),
    }
    return _settled(met.withColumn("__final", final).withColumns(after), F.col("__final"))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, marks: Mapping[str, float] = FIVE, few: int = FEW, bins: int = BINS
) -> DataFrame:
    """Exact, interpolated quantiles of each group, one column per mark (name: share from 0 to 1).

    Missing values and NaN are left out; a group of those alone, and an empty table without keys, have no row. ``df`` is read
    three times (bounds, counts, rows left), so it should be stored. Null keys are a group like any other.
    """
    if bad := [n for n, p in marks.items() if not 0 <= p <= 1]:
        raise ValueError(f"{', '.join(bad)}: a share is from 0 to 1")
    v, keys = F.col(value).cast("double"), list(keys)
    group = F.struct(*keys, F.lit(0).alias("__0"))
    rows = df.select(group.alias("__g"), v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    place = lambda n, p: (n - 1) * F.lit(float(p))
    n = F.col("__n")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(n, p)), F.ceil(place(n, p))) for p in marks.values()])))
    whole = rows.groupBy("__g").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), _sketch(bins))
    whole = stored(whole, "selection-groups")
    state = whole.select("__g", "__n", "__lo", "__hi", "__marks", F.explode(ranks).alias("__rank"), F.lit(0).cast("bigint").alias("__below"))
    first = stored(_settled(state), "selection-ranks")
    done, live = first.filter("__value is not null"), first.filter("__value is null")
    found, sketches, by = [done], whole.select("__g", "__marks"), ["__g"]
    while not live.isEmpty():
        small = live.filter(F.col("__n") <= few)
        values = _in_ranges(rows, small).groupBy(*_STATE).agg(F.sort_array(F.collect_list("__v")).alias("__all"))
        picked = F.get("__all", (F.col("__rank") - F.col("__below")).cast("int"))
        found.append(stored(values.select(*_STATE, picked.alias("__value")), "selection-small"))
        large = live.filter(F.col("__n") > few)
        if large.isEmpty():
            break
        narrowed = stored(_narrow(rows, large.join(sketches, by), bins), "selection-ranks")
        found.append(narrowed.filter("__value is not null"))
        live = narrowed.filter("__value is null")
        open_ranges = live.groupBy("__g").agg(F.collect_set(F.struct("__lo", "__hi")).alias("__open"))
        kept = rows.join(broadcast_if_small(open_ranges), "__g")
        kept = kept.filter(F.exists("__open", lambda r: F.col("__v").between(r["__lo"], r["__hi"])))
        rows = stored(kept.select("__g", "__v"), "selection-rows")
        by = ["__g", "__rank"]
        sketches = stored(_in_ranges(rows, live.filter(F.col("__n") > few)).groupBy(*by).agg(_sketch(bins)), "selection-sketches")
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    held = values.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__at"))

    def mark(p: float) -> Column:
        at = place(F.col("__n"), p)
        under, over = F.col("__at")[F.floor(at)], F.col("__at")[F.ceil(at)]
        return F.when(F.floor(at) == F.ceil(at), under).otherwise(under * (F.ceil(at) - at) + over * (at - F.floor(at)))

    out = whole.select("__g", "__n").join(held, "__g")
    return out.select(*[F.col("__g")[k].alias(k) for k in keys], *[mark(p).alias(name) for name, p in marks.items()])
