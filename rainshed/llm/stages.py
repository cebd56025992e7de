"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> the documents a stage keeps, with the columns they have.

Null texts are empty: they have no language and go with the first stage. Rows without an id are documents like others; rows
that repeat an id and its text are copies. Columns beyond those of ``documents`` are passed on. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, neardup, pii
from .common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an undetermined language (no letters) go."""
    model = langid.fit(langid.training_rows(docs))
    if not model.langs:  # nothing to learn from: letters alone decide
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.filter(langid.identify("text", model)["lang"] != langid.UNDETERMINED)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 that with the smallest id stays (one without an id only if none has one).

    What is linked is texts, not ids: rows that share an id, or have none, are told apart by their text.
    """
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    classes = neardup.near_duplicates(keyed.select("_row", "text"), doc_id="_row", percent=80).select(F.col("doc_id").alias("_row"), "component_id")
    ids = keyed.select("_row", F.col("doc_id").cast("long").alias("_id")).distinct()
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first")
    kept = classes.distinct().join(ids, "_row").groupBy("component_id").agg(first).select("first._row", "first._id")
    same = keyed["_row"].eqNullSafe(F.col("kept._row")) & keyed["doc_id"].cast("long").eqNullSafe(F.col("kept._id"))
    stay = keyed.join(materialize(kept, "kept").alias("kept"), same, "left_semi")
    return stay.dropDuplicates(["_row"]).select(*docs.columns)


def decontaminate_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), out="_found")
    return found.filter(F.size("_found.hits") == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    done = pii.masked(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, beside its columns."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
