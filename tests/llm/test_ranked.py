import math
import random
import re
from collections import Counter

import pytest

from rainshed.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS, ITEMS = "doc_id bigint, text string, item_id string, score bigint, rank string", "item_id string, text string, doc_id int, term string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """(item, rank, doc_id, score) of (doc_id, text) and (item_id, text) rows."""
    every = [(d, Counter(terms(t))) for d, t in docs]
    every = [(d, c, sum(c.values())) for d, c in every if c]
    n_docs, n_words = len(every), sum(n for *_, n in every)
    df = Counter(t for _, c, _ in every for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for d, c, n in every:
            m = 10 + 90 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def test_terms_of_a_text_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", 7)
    for text in ("", "a", "Ünïcode É9-x_y 中文,ab" * 9, " ,;", "x" * 40, "ÀB c" * 11):
        assert [w.decode() for words in ranked.words_of(text.encode()) for w in words] == terms(text)


@pytest.mark.parametrize("shard", [1, 3, 4096])
@pytest.mark.parametrize("bundle, pairs", [(1, 20), (2, 10**6), (256, 10**6)])
def test_random_corpora(spark, monkeypatch, shard, bundle, pairs):
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "BUNDLE", bundle)
    rng = random.Random(shard * 10 + bundle)
    words = ["".join(rng.choice("abcÉ") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    text = lambda n: " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)]
    docs += [(1000 + i, docs[3][1]) for i in range(20)]  # ties
    items = [(f"i{k}", text(rng.randint(1, 25))) for k in range(7)]
    found = ranked.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), 10, pairs)
    assert rows(found) == brute(docs, items)


def test_edges(spark, edge):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    texts = [t for _, t in docs if t]
    items = [("a", texts[3]), ("a", "more words"), (None, texts[6]), ("b", None), ("c", " ,"), ("d", "nowhere1234"), ("e", texts[5]), ("e", texts[5])]
    table = spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)
    found = ranked.search(edge, table)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == brute(docs, items)


def test_empty_tables(spark, edge, none):
    items = spark.createDataFrame([("a", "b", 1, "t")], ITEMS)
    assert rows(ranked.search(none, items)) == [] == rows(ranked.search(edge, items.limit(0)))
    assert rows(ranked.search(none, items.limit(0))) == []


def test_top_and_null_ids(spark):
    docs = [(None, "x y"), (3, "x y"), (None, "x y"), (1, "x y"), (7, "z")]
    table = spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS)
    items = spark.createDataFrame([("i", "X", None, None)], ITEMS)
    assert [(r[1], r[2]) for r in rows(ranked.search(table, items, 3))] == [(1, 1), (2, 3), (3, None)]
