"""Connected components of a table of edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); the component is the smallest id in it.

    Every round writes its labels to the shared folder. Tables are joined as written, so that Spark can split the rows of
    a label that many share; labels fall by jumps, so the rounds grow with the logarithm of the longest path.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("c")), "labels")
    total = _total(labels)
    while total is not None:
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("d"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("c", "d").alias("c"))
        step = materialize(step, "labels")
        labels = materialize(step.join(step.select(F.col("id").alias("c"), F.col("c").alias("d")), "c").select("id", F.col("d").alias("c")), "labels")
        now = _total(labels)
        if now == total:
            break
        total = now
    return labels.withColumnRenamed("c", "component")


def _total(labels: DataFrame):
    """Falls whenever a label falls."""
    return labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
