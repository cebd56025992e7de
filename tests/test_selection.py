import random

import pytest
from pyspark.sql import functions as F

from rainshed.operators import selection

MARKS = {"low": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


def expected(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] * (1 - (at - lo)) + values[hi] * (at - lo)


def groups():
    r = random.Random(5)
    yield "even", [r.random() for _ in range(5000)]
    yield "heavy", [7.0] * 4000 + [r.gauss(0, 1) for _ in range(500)] + [1e300, -1e300]
    yield "edge", [0.0] * 2500 + [float(i) for i in range(1, 2501)]  # a mark between a frequent value and the rest
    yield "two", [1.0] * 3000 + [2.0] * 3000
    yield "one", [3.5]
    yield "pair", [1.0, 2.0]
    yield None, [float(r.randrange(50)) for _ in range(3000)]
    yield "wide", [10.0 ** r.uniform(-300, 300) for _ in range(4000)]


@pytest.mark.parametrize("few, bins", [(1, 8), (100_000, 1000)])
def test_equals_sorting(spark, few, bins):
    data = list(groups())
    rows = [(g, v) for g, vs in data for v in vs] + [("even", None), ("even", float("nan")), ("void", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in selection.quantiles(df, ["g"], "v", MARKS, few, bins).collect()}
    assert set(got) == {g for g, _ in data}
    for g, values in data:
        for name, p in MARKS.items():
            assert got[g][name] == pytest.approx(expected(values, p), rel=1e-12), (g, name)


def test_without_keys_and_empty(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    assert selection.quantiles(df, [], "v", few=100, bins=10).collect() == [(0.0, 2500.0, 5000.0, 7500.0, 10000.0)]
    assert selection.quantiles(df.limit(0), [], "v").count() == 0
    with pytest.raises(ValueError, match="share"):
        selection.quantiles(df, [], "v", {"x": 1.5})
