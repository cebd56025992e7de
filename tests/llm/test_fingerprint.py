import hashlib
import re
import statistics
from collections import Counter

from pyspark.sql import functions as F

from rainshed.llm import fingerprint


def weights(text):
    return Counter(w for w in re.split(r"[\W_]+", text.lower()) if w)


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_collisions_follow_the_generalised_jaccard_similarity(spark):
    """Texts of one to forty terms of unlike weights; the mean error over many pairs is near zero."""
    pairs = []
    for i in range(120):
        a = " ".join(f"w{i}x{k} " * (1 + (k * 7 + i) % 5) for k in range(1 + i % 40))
        b = " ".join(f"w{i}x{k} " * (1 + (k * 3 + i) % 6) for k in range(i % 7, 1 + i % 40 + i % 5))
        pairs.append((i, a, b))
    texts = spark.createDataFrame([(i, s, t) for i, *ab in pairs for s, t in enumerate(ab)], "i int, side int, text string")
    found = {(r.i, r.side): r.signature for r in fingerprint.signatures(texts, ["i", "side"]).collect()}
    errors = []
    for i, a, b in pairs:
        x, y = found[i, 0], found.get((i, 1))
        if y is None:
            continue
        either = [k for k in range(len(x)) if x[k] is not None or y[k] is not None]
        errors.append(sum(x[k] == y[k] for k in either) / len(either) - jaccard(a, b))
    assert abs(statistics.mean(errors)) < 0.03 and statistics.pstdev(errors) < 0.15


def test_heavy_terms_count_by_their_weight(spark):
    """A word that makes up nearly the whole text decides; the error of each pair is small, not only the mean."""
    heavy = lambda i, side: "x " * 1000 + " ".join(f"r{i}x{side}x{k}" for k in range(7))
    texts = [(i, heavy(i, 0), heavy(i, 1)) for i in range(40)]
    df = spark.createDataFrame(texts, "i int, text string, other string")
    found = fingerprint.signatures(df, ["i"], "text", ("other",)).select("i", fingerprint.likeness("signature", "other").alias("like"))
    got = {r.i: r.like for r in found.collect()}
    errors = [abs(got[i] - jaccard(a, b)) for i, a, b in texts]
    assert max(errors) < 0.15 and statistics.mean(errors) < 0.05


def test_versions_have_the_signatures_of_texts_alone(spark):
    rows = [(0, "a b b c", "a c c d"), (1, "", "x"), (2, "y y", " "), (3, None, None)]
    df = spark.createDataFrame(rows, "i int, text string, other string")
    both = {r.i: (r.signature, r.other) for r in fingerprint.signatures(df, ["i"], "text", ("other",)).collect()}
    for n, column in enumerate(("text", "other")):
        alone = {r.i: r.signature for r in fingerprint.signatures(df, ["i"], column).collect()}
        assert {i: s[n] for i, s in both.items() if s[n]} == alone


def test_rows_and_their_next(spark, edge):
    docs = edge.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = sorted(((i, t, n) for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True)), key=str)
    got = sorted(((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(docs).collect()), key=str)
    assert got == want


def test_edge_rows_and_empty_table(spark, edge, none, tmp_path):
    for df, name in ((edge, "e"), (none, "n")):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = fingerprint.op2_fingerprints(spark, str(tmp_path / "e")).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    empty = next(r for r in rows if r.doc_id == 0)
    assert empty.n_chars == 0 and set(empty.fingerprint) == {"-"} and empty.near_edited == 1.0
    assert fingerprint.op2_fingerprints(spark, str(tmp_path / "n")).count() == 0


def test_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in fingerprint.op2_fingerprints(spark, sf_dir).collect()}
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    errors, prints = [], {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    assert abs(statistics.mean(errors)) < 0.03 and statistics.pstdev(errors) < 0.1


def test_plan_is_native(spark, sf_dir):
    plan = fingerprint.op2_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
