import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rainshed.llm import repeats


def plain(texts, length):
    """Every window of every text, counted."""
    seen, out = {}, []
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(t, gone, strict=True) if not g), bytes(gone)))
    return out


def check(df, rows, length, key=lambda r: r.doc_id):
    want = plain([(r.text or "").encode() for r in rows], length)
    want = {(key(r), r.text): w for r, w in zip(rows, want, strict=True)}
    got = repeats.remove_repeats(df.withColumn("same", df.text), length=length).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, gone = want[key(r), r.same]
        assert bytes(r.kept) == kept
        assert sum(x["end"] - x["start"] for x in r.removed) == sum(gone) and len(r.removed) == (b"\0" + gone).count(b"\0\1")


def test_sort_suffixes():
    rng = random.Random(3)
    for _ in range(300):
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(4)]
        strings = [rng.choice(base)[: rng.randint(0, 90)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 40))]
        order, common = repeats.sort_suffixes(strings)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            assert a[: common[k]] == b[: common[k]] and (common[k] == min(len(a), len(b)) or a[common[k]] != b[common[k]])


@pytest.mark.parametrize("wide, ends", [(512, 1 << 16), (1, 1 << 16), (1, 2)])
@pytest.mark.parametrize("seed", range(3))
def test_texts_of_shared_pieces(spark, monkeypatch, wide, ends, seed):
    """Pieces of all lengths around the limit, cut at odd places, repeated within texts and across them."""
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "SORTED", ends)
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcdé") for _ in range(rng.randint(50, 260))) for _ in range(12)] + ["ab" * 150, "x" * 200]
    rows = []
    for i in range(60):
        parts = [(p := rng.choice(pieces))[rng.randint(0, 9) : len(p) - rng.randint(0, 9)] if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(df, df.collect(), 100)


def test_passage_of_five_thousand_texts(spark):
    """More contexts of an anchor than are sorted whole; ends that agree by chance in the first bytes."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(180))
    some = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    rows = [(i, some(rng.randint(0, 60)) + passage[rng.choice([0, 0, 0, 7, 30]) :] + some(rng.randint(0, 60))) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    check(df, df.collect(), 100)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = repeats.anchors_of(data, 400)
    monkeypatch.setattr(repeats, "PIECE", 333)
    assert (repeats.anchors_of(data, 400) == whole).all() and len(repeats.anchors_of(data[:399], 400)) == 0


def test_edge_rows(edge, none):
    check(edge, edge.collect(), 400, key=lambda r: (r.doc_id, r.lang))
    assert repeats.remove_repeats(none).count() == 0


def test_query(spark, sf_dir, documents):
    rows = documents.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text.encode() for r in rows], 400), strict=True))
    for r in repeats.op10_repeated_passages(spark, sf_dir).collect():
        kept, gone = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(gone), sum(gone), (b"\0" + gone).count(b"\0\1"))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_wide_anchors_are_split_no_finer_than_needed(spark, monkeypatch):
    """Windows well within a passage are told in blocks: the runs that are joined stay few for each text."""
    monkeypatch.setattr(repeats, "WIDE", 1)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, texts = some(1500), 60
    rows = [(i, some(700) + passage + some(700)) for i in range(texts)]
    counted, write = {}, repeats.materialize

    def counting(df, name):
        out = write(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "materialize", counting)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(df, df.collect(), 400)
    assert counted["runs"] <= 25 * texts  # a run of 16 windows each would make 51


@pytest.mark.parametrize("size", [400, 401, 415, 416, 527, 528, 529, 700])
def test_short_texts_at_wide_anchors(spark, monkeypatch, size):
    """Blocks that the text does not hold in full, at either end of it."""
    monkeypatch.setattr(repeats, "WIDE", 1)
    rng = random.Random(size)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = some(size)
    rows = [(i, some(rng.choice([0, 0, 5, 300])) + passage[rng.choice([0, 0, 1, 20]) :] + some(rng.choice([0, 0, 5, 300]))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(df, df.collect(), 400)


def plain_windows(rows, words):
    """Windows of words of each text that a text of another row holds too."""
    split = [re.split(rb"[\x20\x09-\x0D]+", (r.text or "").encode().strip(b" \t\n\v\f\r")) for r in rows]
    wins = [[tuple(w[i : i + words]) for i in range(len(w) - words + 1)] for w in split]
    holders = {}
    for r, ws in zip(rows, wins, strict=True):
        for w in ws:
            holders.setdefault(w, set()).add(tuple(r))
    return [sum(len(holders[w]) > 1 for w in ws) for ws in wins]


def test_passages_of_over_fifty_words_below_the_length(spark, tmp_path):
    """51 to 59 words of under 400 bytes stay, as the contract has it, but the query tells that other texts hold them."""
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6))) for _ in range(n))
    passages = [some(n) for n in (50, 51, 55, 59)]
    assert all(len(p) < 400 for p in passages)
    rows = [(i, f"{some(rng.randint(0, 80))}\n{passages[i % 4]}  {some(rng.randint(0, 80))}") for i in range(24)]
    rows += [(24, some(200)), (25, f"{(p := some(60))} {some(40)} {p}"), (26, None), (27, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in repeats.op10_repeated_passages(spark, str(tmp_path)).collect()}
    assert all(got[i].n_removed == 0 for i in range(25)) and got[25].n_removed == 0
    assert [got[i].n_shared_windows for i in range(28)] == [(0, 1, 5, 9)[i % 4] if i < 24 else 0 for i in range(28)]


@pytest.mark.parametrize("piece", [1 << 20, 37])
@pytest.mark.parametrize("seed", range(3))
def test_shared_windows(spark, monkeypatch, seed, piece):
    """Copies, near copies, passages at odd places, repeats within one text, other white space, anchors of many contexts."""
    monkeypatch.setattr(repeats, "PIECE", piece * 100 if piece < 100 else piece)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    some = lambda n: " ".join(word() for _ in range(n))
    pieces = [some(rng.randint(5, 60)) for _ in range(10)] + ["la " * 40]
    texts = []
    for _ in range(70):
        parts = [" ".join((p := rng.choice(pieces).split())[rng.randint(0, 4) : len(p) - rng.randint(0, 4)]) if rng.random() < 0.7 else some(rng.randint(0, 9)) for _ in range(rng.randint(0, 7))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += rng.sample(texts, 8) + [None, "", " ", texts[0] + " end", texts[1].replace(" ", "  ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = df.collect()
    want = dict(zip([r.doc_id for r in rows], plain_windows(rows, 20), strict=True))
    got = repeats.remove_repeats(df, length=100, words=20).collect()
    assert {r.doc_id: r.shared for r in got} == want and 0 < sum(map(bool, want.values())) < len(want)
    plainly = {r.doc_id: (bytes(r.kept), r.removed) for r in repeats.remove_repeats(df, length=100).collect()}
    assert {r.doc_id: (bytes(r.kept), r.removed) for r in got} == plainly


def test_shared_windows_of_odd_rows(edge, none):
    rows = edge.select("doc_id", "lang", "text").collect()
    want = {tuple(r): n for r, n in zip(rows, plain_windows(rows, 51), strict=True)}
    got = repeats.remove_repeats(edge.select("doc_id", "lang", "text", F.col("text").alias("same")), words=51).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r.shared, want[r.doc_id, r.lang, r.same]) for r in got if want[r.doc_id, r.lang, r.same] != r.shared] == []
    assert repeats.remove_repeats(none, words=51).count() == 0
