import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from rainshed.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(vocabulary):
    mph = vocabulary.whole
    assert sorted(mph.slot) == list(range(len(vocabulary.words)))
    assert [mph.find(w) for w in vocabulary.words[:3000]] == list(range(3000))
    assert mph.find(b"no such pre-token at all") == -1 and mph.find(b"") == -1


@pytest.mark.parametrize("keys", [[], [b"a"], [b"a", b"b"], [bytes([i, j]) for i in range(40) for j in range(40)]])
def test_perfect_hash_of_small_sets(keys):
    mph = bpe.PerfectHash(keys)
    assert [mph.find(k) for k in keys] == list(range(len(keys))) and mph.find(b"zzz") == -1


def test_ids_are_those_of_the_library(vocabulary, library):
    rng = random.Random(1)
    pieces = ["ab", "é", "'s", "'LL", "12", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "​", "😀", "中文", "ñ", "—", "<|endoftext|>", "²", "œ", "zq"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert vocabulary.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 50_000, " " * 5000, "qzj" * 4000):
        assert vocabulary.encode(text) == library.encode_ordinary(text)


def test_decoding_lists(vocabulary):
    words, place = pa.array(vocabulary.words, pa.binary()), np.full(max(vocabulary.ids) + 1, -1)
    place[vocabulary.ids] = np.arange(len(vocabulary.ids))
    lists = pa.array([[31373], None, [], [995, 0, 255]], pa.list_(pa.int32()))
    want = [vocabulary.words[vocabulary.ids.index(31373)], None, b"", b"".join(vocabulary.words[vocabulary.ids.index(i)] for i in (995, 0, 255))]
    for at in range(4):
        assert bpe.decoded(lists.slice(at), words, place).to_pylist() == want[at:]
    for wrong in (-1, 10**6):
        with pytest.raises(KeyError):
            bpe.decoded(pa.array([[wrong]], pa.list_(pa.int32())), words, place)


def test_memo_generations(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_TOKENS", 3)
    text = "several unusual prewordtokens xqzt inhere"
    assert vocabulary.encode(text) == vocabulary.encode(text) == library.encode_ordinary(text)


def test_latin_pattern_is_left_out_where_it_cannot_be_spelt():
    assert bpe._latin_pattern(P.PATTERN) and bpe._latin_pattern(r"\p{Lu}+|\d") is None


def test_documents(spark, edge, none, library):
    out = bpe.encode_documents(edge, PATH, P.PATTERN, out="found")
    assert out.columns == edge.columns
    assert all(r.found == library.encode_ordinary(r.text or "") for r in out.collect())
    sent = bpe.load(spark, PATH, P.PATTERN)
    back = out.select("text", bpe.decode("found", sent).alias("b")).collect()
    assert all(bytes(r.b).decode() == (r.text or "") for r in back)
    assert bpe.encode_documents(none, PATH, P.PATTERN).count() == 0


def test_query(spark, sf_dir, documents, library):
    got = {r.doc_id: r for r in bpe.op8_bpe_roundtrip(spark, sf_dir).collect()}
    for r in documents.collect():
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
