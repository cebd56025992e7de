import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rainshed.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BITS = ["ab", "é", " ", "  ", "\n", "▁", "😀", "中文", "the", "ing", "12", "<s>", "<|endoftext|>", "\x00", "ﬁ", "zq", "'s", " word", "…", "\x85"]


class Plain:
    """Every token of both sides against every other, by the libraries of the two files."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.word, self.letter = {i: w for w, i in self.a.get_vocab().items()}, alignment.byte_letters()

    def spans(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        words = [bytes(self.letter[c] for c in self.word[i]) for i in a], [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        out = []
        for ids, own in zip((a, b), words):
            if b"".join(own) != (" " + text).encode():
                return None
            ends = [sum(map(len, own[: k + 1])) for k in range(len(own))]
            out.append([(i, e - len(w), e) for i, w, e in zip(ids, own, ends)])
        return out

    def one(self, text):
        """n_a, n_b, groups, links by pair."""
        if not text or (spans := self.spans(text)) is None:
            return 0, 0, [], Counter()
        a, b = spans
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts)]
        links = Counter((i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v))
        return len(a), len(b), groups, links

    def corpus(self, rows):
        each = [(d, *self.one(t)) for d, t in rows]
        held = Counter(p for *_, links in each for p in links)
        top = {}
        for (a, _), n in held.items():
            top[a] = max(top.get(a, 0), n)
        out = []
        for d, n_a, n_b, groups, links in each:
            best = sum(n for p, n in links.items() if held[p] == top[p[0]])
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            out.append((d, n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), digest))
        return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))) for _ in range(250)]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*(open(p, "rb").read() for p in PATHS))


def test_ids_of_every_code_point(plain, aligner):
    """A byte-level file is encoded by ranks; code points of each script and their neighbours give the file's own ids."""
    for start in range(0, 0x110000, 61 * 64):
        own = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)}! '{chr(c)} s" for c in range(start, min(start + 61 * 64, 0x110000), 61) if not 0xD800 <= c < 0xE000]
        assert [x.tolist() for x in aligner.encode_a(own)] == [e.ids for e in plain.a.encode_batch(own, add_special_tokens=False)]


def test_pieces_of_long_texts_change_nothing(plain, aligner, monkeypatch):
    monkeypatch.setattr(alignment, "LONG", 40)
    text = "some words é 12 of a text, its  spaces\nand lines and words " * 20
    assert len(aligner.cut(text)) > 5 and " ".join(aligner.cut(text)) == text
    (n_a, n_b, n_groups, n_links, digest, pairs, times), = aligner.measures([text])
    want = plain.one(text)
    assert (n_a, n_b, n_groups, n_links) == (want[0], want[1], len(want[2]), sum(want[3].values()))
    assert digest == hashlib.sha256(";".join(want[2]).encode()).hexdigest()
    assert {divmod(p, aligner.width): n for p, n in zip(pairs.tolist(), times.tolist())} == want[3]


@pytest.mark.parametrize("most", [None, 0])  # pair counts broadcast, and joined by a shuffle
def test_random_corpus(spark, plain, texts, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(alignment, "PAIR_ROWS", most)
    docs = [(i, t) for i, t in enumerate(texts * 2)] + [(900 + i, texts[i % 3]) for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert rows(alignment.align_documents(table, *PATHS)) == plain.corpus(docs)


def test_edges(spark, plain, edge, none):
    docs = [(r.doc_id, None if r.text == "x" * 30_000 else r.text) for r in edge.collect()]
    clashing = "doc_id bigint, text string, key string, copies int, n int, pairs string, n_best string"
    table = spark.createDataFrame([(*d, "k", None, 1, "p", "b") for d in docs if len(d[1] or "") < 9000], clashing)
    found = alignment.align_documents(table, *PATHS)
    assert found.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert rows(found) == plain.corpus([d for d in docs if len(d[1] or "") < 9000])
    assert alignment.align_documents(none, *PATHS).count() == 0
    assert alignment.align_documents(edge, *PATHS).count() == edge.count()


def test_query(spark, sf_dir, plain, documents):
    """The whole table: counts of every document from the libraries, sums from all of them."""
    got = alignment.op12_tokenizer_alignment(spark, sf_dir).orderBy("doc_id").collect()
    short = [(r.doc_id, r.text) for r in documents.collect() if len(r.text or "") < 4000]
    assert len(got) == documents.count()
    want = {d: plain.one(t) for d, t in short}
    for r in got:
        if r.doc_id in want:
            n_a, n_b, groups, links = want[r.doc_id]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, len(groups), sum(links.values()))
            assert r.groups_sha256 == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
