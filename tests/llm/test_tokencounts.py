import pytest
from pyspark.sql import functions as F

from rainshed.llm import tokencounts as t
from rainshed.session import scratch_path

CHANGES = f"change_id string, before {t.SIDE}, after {t.SIDE}, sign int, n_docs int"


def changes(spark, *rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], CHANGES)


@pytest.fixture
def store(spark):
    return t.Rollup(spark, scratch_path(spark, "rollup"))


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_inserts_revisions_and_deletes(spark, store):
    assert totals(store) == []
    a, b, c = ("s", "en", "v1", 10), ("s", "en", "v1", 5), (None, None, "v1", 3)
    assert store.commit("1", changes(spark, ("a", None, a), ("b", None, b), ("c", None, c), ("c", None, c)))
    assert totals(store) == sorted([("s", "en", "v1", 2, 15), (None, None, "v1", 1, 3)], key=str)
    assert store.commit("2", changes(spark, ("a", a, ("s", "en", "v2", 8)), ("b", b, None), ("n", None, None), ("z", None, ("s", "fr", "v2", None))))
    assert totals(store) == sorted([("s", "en", "v2", 1, 8), ("s", "fr", "v2", 1, 0), (None, None, "v1", 1, 3)], key=str)


def test_a_batch_counts_once(spark, store):
    batch = changes(spark, ("a", None, ("s", "en", "v1", 10)))
    assert store.commit("1", batch) and not store.commit("1", batch)
    assert totals(store) == [("s", "en", "v1", 1, 10)]


def test_what_was_left_unfinished_is_written_again(spark, store):
    store.commit("1", changes(spark, ("a", None, ("s", "en", "v1", 10))))
    store.commit("2", changes(spark, ("b", None, ("s", "en", "v1", 1))))
    fs, place = store._files(f"{store.path}/batch=2/_SUCCESS")
    fs.delete(place, False)
    assert totals(store) == [("s", "en", "v1", 1, 10)]
    assert store.commit("2", changes(spark, ("b", None, ("s", "en", "v1", 2))))
    assert totals(store) == [("s", "en", "v1", 2, 12)]


def test_an_empty_batch(spark, store):
    assert store.commit("1", changes(spark)) and totals(store) == []


def test_counts(edge):
    import re

    rows = edge.select("text", *[t.count_tokens("text", k).alias(k) for k in t.TOKENIZERS]).collect()
    for r in rows:
        assert r["words-1"] == len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))
        assert r["pieces-1"] == len(re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n\x0b\f\r]", r.text or ""))


def test_query_is_that_of_the_sql(spark, sf_dir, duck_con):
    got = sorted((tuple(r) for r in t.op7_token_counts(spark, sf_dir).collect()), key=str)
    assert got == sorted(duck_con.sql(t.SQL).fetchall(), key=str)
    assert sum(r[3] for r in got) == spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("n_chars") >= 200).count()


def test_query_on_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert t.op7_token_counts(spark, str(tmp_path)).count() == 0
