"""From raw documents to token ids: stages over the table ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rainshed.llm.common import materialize, table
from rainshed.llm import stages

STAGES = [
    ("language_id", stages.identify_language),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontamination", stages.decontaminate_benchmarks),
    ("personal_data", stages.mask_personal_data),
    ("byte_level_bpe", stages.encode),
]
#: Language, similarity and token ids are not expressible in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
