import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from rainshed.llm import pieces

PATH = P.path("piece_bpe_32k.model")
BITS = ["ab", "é", " ", "  ", "\n", "\t", "▁", "▁▁", "😀", "中文", "the", "ing", "12", "3.", "<s>", "<0x41>", "\x00", "ﬁ", "Ⅷ", "　", "​", "zq", "é", "…"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def source():
    with open(PATH, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(source):
    return sentencepiece.SentencePieceProcessor(model_proto=source)


@pytest.fixture(scope="module")
def model(source):
    return pieces.Model(source)


def test_ids_and_texts_are_those_of_the_library(model, library):
    for text in [*random_texts(1500, 1), "a" * 50_000, " " * 5000, "qzj" * 4000]:
        ids, starts, ends = model.encode(text)
        assert ids.tolist() == library.encode(text) and model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert starts[1:].tolist() == ends[:-1].tolist()
        assert not text or (starts[0] == 0 and ends[-1] == len(text.encode()))


def test_any_ids_are_decoded(model, library):
    rng = random.Random(2)
    for _ in range(1000):
        ids = [rng.randrange(600) for _ in range(8)]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_character_maps_keep_the_source_spans(source, rule, squeeze, prefix):
    """The public maps of the library, put into the model: ids, texts and spans equal the library's."""
    p = proto.ModelProto.FromString(source)
    p.normalizer_spec.precompiled_charsmap = proto.ModelProto.FromString(
        sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    ).normalizer_spec.precompiled_charsmap
    p.normalizer_spec.remove_extra_whitespaces, p.normalizer_spec.add_dummy_prefix = squeeze, prefix
    library, model = sentencepiece.SentencePieceProcessor(model_proto=p.SerializeToString()), pieces.Model(p.SerializeToString())
    assert model.map
    for text in random_texts(300, 3):
        ids, starts, ends = model.encode(text)
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [x.id for x in want] and model.decode(ids.tolist()) == library.decode(ids.tolist())
        spans = [(i, a, b) for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist()) if model.kind[i] == 0]
        assert spans == [(x.id, x.begin, x.end) for x in want if model.kind[x.id] == 0]


def test_memo_generations(source, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_SEGMENTS", 3)
    model, text = pieces.Model(source), "several unusual words xqzt inhere several times xqzt"
    assert model.encode(text)[0].tolist() == model.encode(text)[0].tolist() == library.encode(text)
    assert len(model.young) <= 20


def test_other_models_are_refused(source):
    p = proto.ModelProto.FromString(source)
    p.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="only BPE"):
        pieces.Model(p.SerializeToString())
    p = proto.ModelProto.FromString(source)
    p.pieces[300].type = proto.ModelProto.SentencePiece.USER_DEFINED
    with pytest.raises(ValueError, match="not supported"):
        pieces.Model(p.SerializeToString())


def test_documents(spark, edge, none, library):
    out = pieces.encode_documents(edge, PATH, out="found", end_id=True)
    assert out.columns == edge.columns
    for r in out.collect():
        assert r.found.ids == [*library.encode(r.text or ""), 2]
        data = (r.text or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.found.starts, r.found.ends)) == data
    sent = pieces.load(spark, PATH)
    back = out.select("text", pieces.decode("found.ids", sent).alias("b")).collect()
    assert all(r.b == (r.text or "") for r in back)
    assert pieces.encode_documents(none, PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([5, 260],)], "ids array<int>").select(pieces.decode("ids", sent).alias("t")).collect()
    assert [r.t for r in nulls] == [None, "", library.decode([5, 260])]


def test_query(spark, sf_dir, documents, library):
    got = {r.doc_id: r for r in pieces.op13_sentencepiece(spark, sf_dir).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = [*library.encode(r.text), 2]
        found = got[r.doc_id]
        assert (found.n_tokens, found.n_spanned) == (len(ids), len(r.text.encode()))
        assert found.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("end_id", [True, False])
def test_texts_come_with_their_ids(spark, edge, library, end_id):
    sent = pieces.load(spark, PATH)
    texts = edge.select("text").union(spark.createDataFrame([(t,) for t in random_texts(300, 7)], "text string"))
    found = texts.select("text", pieces.encode("text", sent, end_id, decoded=True).alias("p"), pieces.encode("text", sent, end_id).alias("q"))
    for r in found.select("text", "p", "q", pieces.decode("p.ids", sent).alias("apart")).collect():
        assert r.p.ids == library.encode(r.text or "") + [2] * end_id
        assert r.p.decoded == r.apart == library.decode(r.p.ids)
        assert (r.p.ids, r.p.starts, r.p.ends) == (r.q.ids, r.q.starts, r.q.ends)


def test_query_needs_one_worker_a_task(spark, sf_dir):
    """Each Python operator of a stage has a worker of its own, with a model and a batch: there is one."""
    plan = pieces.op13_sentencepiece(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_known_segments_are_kept_as_bytes(source):
    model = pieces.Model(source)
    model.encode("some words of a text")
    assert model.young and all(isinstance(ids, bytes) for ids in model.young.values())
