"""Daily totals over hourly files as they arrive: the batch daily resample as a streaming query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def hourly_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_totals(stream: DataFrame, keys: Sequence[str], value: str, time: str = "time", late: str = "2 days") -> DataFrame:
    """Sum per key and day. A day is closed, and its state dropped, once it is ``late`` behind.

    Needs a TIMESTAMP column in UTC as event time, because watermarks do not take naive times.
    """
    day = F.window(time, "1 day")
    sums = stream.withWatermark(time, late).groupBy(*keys, day).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))
    return sums.select(*keys, F.to_date("window.start").alias("day"), "value")


def start(totals: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append closed days to Parquet; ``once`` handles what is there and stops."""
    writer = totals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
