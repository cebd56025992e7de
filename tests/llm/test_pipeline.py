import importlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rainshed.llm import stages

from test_decontaminate import plain as hits
from test_neardup import plain as groups
from test_pii import plain as finds


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]


def test_run_keeps_what_the_plain_stages_keep(spark, sf_dir, documents, items):
    rows = [r for r in documents.collect() if any(map(str.isalpha, r.text or ""))]
    group = groups([(r.doc_id, r.text) for r in rows], 80)
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    hit = {d for d, _, n, _ in hits([(r.doc_id, r.text) for r in rows], items) if n}
    rows = {r.doc_id: r for r in rows if r.doc_id not in hit}
    out = corpus_pipeline.run(spark, sf_dir)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(rows) and out.columns == [*documents.columns, "ids"]
    for i, r in got.items():
        assert (r.text == rows[i].text) == (not finds(rows[i].text)) and r.n_chars == len(r.text) and len(r.ids) > 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_edge_rows_and_nothing(spark, sf_dir, edge, none, name, stage):
    out = stage(spark, edge, sf_dir)
    assert out.columns[: len(edge.columns)] == edge.columns and out.count() <= edge.count()
    again = stage(spark, none, sf_dir)
    assert again.count() == 0 and again.columns == out.columns


def test_texts_stay_where_no_language_can_be_learned(spark, sf_dir, edge):
    kept = stages.identify_language(spark, edge.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    want = [r for r in edge.collect() if any(map(str.isalpha, r.text or ""))]
    assert want and sorted(map(str, (r.text for r in kept.collect()))) == sorted(str(r.text) for r in want)


def test_one_of_repeated_rows_stays(spark, sf_dir, edge):
    kept = stages.drop_near_duplicates(spark, edge, sf_dir)
    assert kept.filter("doc_id = 5").groupBy("text").count().filter("count > 1").count() == 0
    assert {r.doc_id for r in kept.filter(F.col("text").isNull()).collect()} == {0, None}


def test_texts_are_linked_not_ids(spark, sf_dir):
    rng = random.Random(8)
    a, z, q = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (5, a + " tail"), (5, z), (9, q), (None, q + " end"), (None, z[::-1]), (None, z[::-1] + "x")]
    docs = spark.createDataFrame([(*r, None, None, 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {(r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert {(1, a), (5, z), (9, q)} < kept and len(kept) == 4
    assert len([t for d, t in kept if d is None]) == 1


def test_entry_registers_all(spark):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= names
