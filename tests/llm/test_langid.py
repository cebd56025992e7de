import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshed.llm import langid
from rainshed.llm.langid import Model


def counts(texts):
    out = {}
    for lang, text in texts.items():
        for w in langid._words(text.lower()):
            keys = [("script", langid.script_of(w[0]), len(w))] + [(str(len(g)), g, 1) for g in langid._grams(w)]
            for kind, value, n in keys:
                out[lang, kind, value] = out.get((lang, kind, value), 0) + n
    return [(*k, n) for k, n in out.items()]


@pytest.fixture(scope="module")
def model():
    return Model(counts({"en": "the and of that this with " * 9, "de": "der und das nicht schön ist " * 9, "ru": "это не так как было " * 9}))


def test_viterbi_is_the_best_path(model):
    words = "the und this der the of nicht".split()
    for n in range(1, len(words) + 1):
        rows = model.score_rows(words[:n])
        score = lambda path: sum(model.rows[r, k] for r, k in zip(rows, path, strict=True)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=score)
        assert score(model.label([rows])[0].tolist()) == pytest.approx(score(best), abs=1e-3)


def test_texts_are_labelled_together_as_alone(model):
    texts = [["the"] * 5 + ["und", "nicht", "schön"] * 9, [], ["это"] * 3, ["das"] * 50]
    rows = [model.score_rows(t) for t in texts]
    assert all(np.array_equal(a, model.label([r])[0]) for a, r in zip(model.label(rows), rows, strict=True))


def test_spans_of_mixed_text(model):
    text = "the and of that this with the of. " * 3 + "это не так как было, не было так. " * 3
    (got,) = model.predict([text])
    assert [s["lang"] for s in got["spans"]] == ["en", "ru"] and 0.4 < got["score"] < 0.7
    assert text[got["spans"][1]["start"] :].startswith("это") and got["spans"][-1]["end"] == len(text)


def test_scripts_narrow_the_candidates(model):
    at = model.score_rows(["ываэ", "zzz"])
    rows = model.rows[at]
    assert rows[0, model.langs.index("en")] <= rows[0, model.langs.index("ru")] - 90
    assert np.ptp(rows[1]) < 90


def test_undetermined(model):
    assert {r["lang"] for r in model.predict([None, "", " ", "12 ½ ²", "!?", "😀"])} == {"und"}
    assert Model([]).predict(["words"])[0] == {"lang": "und", "score": 0.0, "spans": []}


def test_edge_rows_and_empty_table(edge, none):
    model = langid.fit(langid.training_rows(edge))
    out = edge.withColumn("found", langid.identify("text", model)).collect()
    assert len(out) == edge.count()
    assert all((r.found["lang"] == "und") == (not any(map(str.isalpha, r.text or ""))) for r in out)
    assert langid.fit(langid.training_rows(none)).langs == []


def test_held_out_accuracy(spark, sf_dir, documents):
    got = langid.op9_language_id(spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = got.join(documents.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("held_out and n > 50")
    right, total = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 20 and right / total > 0.97
    assert got.count() == documents.count() and got.filter("score < 0 or score > 1").count() == 0


def test_words_are_learned_together():
    """Texts with a new word each do not copy the scores of all known words each time."""
    letters = "abcdefghij"
    model = langid.Model([("x", "script", "Latin", 9), ("x", "2", "<a", 3), ("y", "script", "Latin", 9), ("y", "2", "<b", 3)])
    texts = [" ".join(letters[int(c)] * 2 + letters[k % 10] for c in f"{k:03}") for k in range(300)]
    learned, learn = [], model._learn
    model._learn = lambda words: (learned.append(len(words)), learn(words))
    found = model.predict(texts)
    assert len(learned) == 1 and learned[0] == len({w for t in texts for w in t.split()})
    assert found == [model.predict([t])[0] for t in texts]


def test_learned_scores_are_sums_over_the_sequences():
    words = ["a", "ab", "äöü", "привет", "𐐀𐐁𐐂", "你好", "zzzz"]
    keys = {g for w in words[:-1] for g in langid._grams(w)}
    counts = [(lang, str(len(g)), g, n + k) for k, g in enumerate(sorted(keys)) for n, lang in enumerate("pqr")]
    model = langid.Model([*counts, *((lang, "script", "Latin", 1) for lang in "pqr")])
    rows, sizes = model.rows[at := model.score_rows(words)], model.sizes[at]
    for w, row, size in zip(words, rows, sizes, strict=True):
        plain = model.scores[[model.row.get(g, 0) for g in langid._grams(w)]].sum(0)
        assert np.allclose(row, plain, atol=1e-4) and size == len(w)
