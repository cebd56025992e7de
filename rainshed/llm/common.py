"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.session import scratch_path

ROWS_PER_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(array: pa.Array, rows: int = ROWS_PER_BATCH) -> Iterator[pa.Array]:
    """An Arrow array in pieces, so that only few long texts are Python objects at a time."""
    for at in range(0, len(array), rows):
        yield array.slice(at, rows)


def joined(words: pa.Array, chosen: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The chosen words (BINARY) after each other, and where each begins and the last one ends."""
    taken = words.take(pa.array(chosen, pa.int32()))
    if not len(taken):
        return pa.py_buffer(b""), np.zeros(1, np.int32)
    return taken.buffers()[2] or pa.py_buffer(b""), np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset)


def packed(text: Column | str) -> Column:
    """BINARY text, compressed: for texts that are shuffled more than once. Null is the empty text."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.array([compress(t or b"") for piece in slices(batch.cast(pa.binary())) for t in piece.to_pylist()], pa.binary())

    return pack(text)


def unpacked(array: pa.Array) -> Iterator[bytes]:
    restore = zstandard.ZstdDecompressor().decompress
    return (restore(x) for piece in slices(array) for x in piece.to_pylist())
