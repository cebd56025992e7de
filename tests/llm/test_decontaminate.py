import hashlib
import re

from rainshed.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """Every window of every item against every place of every document."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[k]
        out.append((doc, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=str)


def found(df):
    rows = df.select("doc_id", "_f").collect()
    return sorted(((r.doc_id, r._f["n_words"], sum(h["end"] - h["start"] for h in r._f["hits"]), tuple(r._f["items"])) for r in rows), key=str)


def items_of(spark, docs):
    texts = [r.text for r in docs.select("text").collect() if r.text]
    long = max(texts, key=len)
    rows = [(1, " ".join(words(long)[50:75])), (1, "A"), (2, None), (3, ""), (4, "é😀"), (None, " ".join(words(long)[60:70]).upper()), (5, "x"), (10, words(long)[3]), (2, "more x")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_edge_rows(spark, edge, none):
    items = items_of(spark, edge)
    want = plain([(r.doc_id, r.text) for r in edge.collect()], [tuple(r) for r in items.collect()])
    assert found(decontaminate.find_items(edge, items, out="_f")) == want
    assert decontaminate.find_items(none, items).count() == 0
    assert all(x[2] == 0 for x in found(decontaminate.find_items(edge, items.limit(0), out="_f")))


def test_blocks_of_items_give_the_same(spark, edge, monkeypatch):
    items = items_of(spark, edge)
    want = found(decontaminate.find_items(edge, items, out="_f"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 80)
    assert found(decontaminate.find_items(edge, items, out="_f")) == want


def test_query(spark, sf_dir, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0]: r for r in plain([(r.doc_id, r.text) for r in documents.collect()], items)}
    rows = decontaminate.op5_decontaminate(spark, sf_dir).collect()
    assert len(rows) == len(want) and any(r.contaminated for r in rows)
    for r in rows:
        _, n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
