"""Alignment of two tokenizers over a corpus, each distinct text worked on once.

Texts are shuffled by their full text, so each distinct one is tokenised and aligned once, with the number of its copies. The
ends of the tokens of both sides cut a text into stretches of bytes: each stretch lies in one token of either side and is one
link; where both sides end, a group ends. Counts of id pairs are sums over the distinct texts, weighted by their copies.
They are joined to the links of each text, and the measures of a text to its documents by its SHA-256.

The table of pair counts is broadcast when its counted rows are few (it cannot outgrow the product of the vocabularies, but
in practice holds some tens of pairs per id), else the links are joined to it by a shuffle; results are the same.

Edge cases: texts that are null or empty, or whose token bytes on either side differ from a space and the text, have no tokens:
zeros and an empty digest. Repeated rows and ids are documents of their own. Very long texts are tokenised in pieces where
that changes nothing (before a space between two ASCII letters), else whole. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.operators.sizing import broadcast_if_small

from .common import joined, materialize, table
from .pieces import Model

TEXT_BYTES = 1 << 20  # texts tokenised at a time
LONG = 1 << 16  # characters from which a text is cut into pieces
PAIR_ROWS = 4_000_000  # pair counts that are broadcast at most: about 200 MB in an executor
ALIGNED = "key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
# fixed value: how byte-level files split texts
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, Aligner] = {}


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 and on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligner:
    """Tokens of both sides, their bytes, and the measures of texts."""

    def __init__(self, source_a: bytes, source_b: bytes):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_proto=source_b)
        letter, model, spec = byte_letters(), Model(source_b), json.loads(source_a)
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        ranks = {bytes(letter[c] for c in w): i for w, i in spec["model"]["vocab"].items() if i not in special}
        words = [b""] * (max([*ranks.values(), *special]) + 1)
        for word, i in [*ranks.items(), *((w, i) for i, w in special.items())]:
            words[i] = word
        self.words_a = pa.array(words, pa.binary())
        self.words_b = model.surfaces
        byte_level = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.encode_a = _by_rank(ranks) if byte_level and _in_id_order(spec) else _by_file(source_a)
        self.bytes_a = np.array([len(w) for w in words], np.int64)
        self.bytes_b = np.array([len(w.as_py()) for w in model.surfaces], np.int64)
        self.width = len(model.pieces)  # a pair is a times this plus b
        # a space between letters begins a token on either side where both cut texts there by themselves
        self.cuts = bool(model.plain) and byte_level
        self.printed = pa.array([f"{i}{end}".encode() for i in range(max(len(words), self.width)) for end in (",", "|", ";", "")], pa.binary())

    def cut(self, text: str) -> list[str]:
        """Pieces that a single space joins to the text."""
        if not self.cuts or len(text) <= LONG:
            return [text]
        out, at = [], 0
        while len(text) - at > LONG:
            end = at + LONG
            while (end := text.find(" ", end)) >= 0 and not _between_letters(text, end):
                end += 1
            if end < 0:
                break
            out.append(text[at:end])
            at = end + 1
        return [*out, text[at:]]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, and how many each text has."""
        parts = [self.cut(t) for t in texts]
        flat, text = [p for ps in parts for p in ps], np.repeat(np.arange(len(parts)), [len(ps) for ps in parts])
        out = []
        for ids in (self.encode_a([" " + p for p in flat]), [np.array(i, np.int64) for i in self.b.encode(flat)]):
            out.append((np.concatenate(ids).astype(np.int64), np.bincount(text, [len(i) for i in ids], len(texts)).astype(np.int64)))
        return out

    def measures(self, texts: list[str]) -> Iterator[tuple]:
        """Counts, digest of the groups, and the distinct pairs with their occurrences, text by text."""
        (a, n_a), (b, n_b) = self.tokens(texts)
        good = self._covers(self.words_a, a, n_a, texts) & self._covers(self.words_b, b, n_b, texts)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        # both sides cover the same bytes, so their running lengths are places in the texts put after each other
        end_a, end_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        ends = np.union1d(end_a, end_b)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = ends[(end_a[in_a] == ends) & (end_b[in_b] == ends)]
        last = np.concatenate([[0], end_a])[np.cumsum(n_a)]
        links = np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        groups = np.diff(np.searchsorted(both, last, "right"), prepend=0)
        digests = self._digests(a, b, end_a, end_b, both, last, n_a, n_b)
        # pairs by text: sorted, so equal ones are neighbours
        pair = a[in_a] * self.width + b[in_b]
        order = np.lexsort((pair, owner := np.repeat(np.arange(len(texts)), links)))
        pair, owner = pair[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])) if len(pair) else np.zeros(0, np.int64)
        times, pair = np.diff(first, append=len(pair)), pair[first]
        at = np.searchsorted(owner[first], np.arange(len(texts) + 1))
        for k in range(len(texts)):
            own = slice(at[k], at[k + 1])
            yield int(n_a[k]), int(n_b[k]), int(groups[k]), int(links[k]), digests[k], pair[own], times[own]

    @staticmethod
    def _covers(words: pa.Array, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> np.ndarray:
        data, places = joined(words, ids)
        data, cuts = memoryview(data).cast("B"), places[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return np.array([data[x:y] == b" " + t.encode() for (x, y), t in zip(itertools.pairwise(cuts), texts, strict=True)], bool)

    def _digests(self, a, b, end_a, end_b, both, last, n_a, n_b) -> list[str]:
        """SHA-256 of the groups in decimal ids, made by taking each id printed with the sign that follows it."""
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        row = np.empty(len(a) + len(b), np.int64)
        close_a, close_b = both[group_a] == end_a, both[group_b] == end_b
        final = np.isin(end_b, last, assume_unique=False)
        row[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a * 4 + close_a
        row[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b * 4 + np.where(final, 3, 2 * close_b)
        data, places = joined(self.printed, row)
        data, cuts = memoryview(data).cast("B"), places[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in itertools.pairwise(cuts)]


def _in_id_order(spec: dict) -> bool:
    """Whether each merge makes the next id, so that the rank of a token is its id."""
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    ids = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    plain = all(not spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return plain and ids == sorted(ids) and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"].get("add_prefix_space")


def _by_rank(ranks: dict[bytes, int]):
    """The faster library for byte-level files; its ids equal those of the file's own for every code point (tests)."""
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    return lambda texts: [encode(t, disallowed_special=()) for t in texts]


def _by_file(source: bytes):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the texts
    tokenizer = Tokenizer.from_str(source.decode())
    tokenizer.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, np.int64) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _between_letters(text: str, at: int) -> bool:
    around = text[at - 1 : at] + text[at + 1 : at + 2]
    return len(around) == 2 and around.isascii() and around.isalpha()


def _aligner(sent) -> Aligner:
    key, a, b = sent.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(a, b)
    return _LOADED[key]


def _by_bytes(texts: pa.Array) -> Iterator[pa.Array]:
    """Pieces of a column of texts that hold about TEXT_BYTES, one text at least."""
    size = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct texts (key, text, copies) with their counts, groups digest, distinct pairs and occurrences.

    ``path_a`` is a byte-level BPE file of the tokenizers library, ``path_b`` a sentencepiece model; both are sent to the executors
    (files of a few MB whatever the corpus holds; checked here).
    """
    sources = []
    for path in (path_a, path_b):
        with open(path, "rb") as file:
            sources.append(file.read())
    if max(map(len, sources)) > 64 << 20:
        raise ValueError("a tokenizer file of more than 64 MB is not broadcast")
    names = f"{xxhash.xxh3_64_hexdigest(sources[0])}:{xxhash.xxh3_64_hexdigest(sources[1])}"
    sent = texts.sparkSession.sparkContext.broadcast((names, *sources))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(sent)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            at = 0
            for piece in _by_bytes(batch.column(1)):
                *plain, pairs, times = zip(*aligner.measures(piece.to_pylist()), strict=True)
                cuts = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                columns = [batch.column(0).slice(at, len(piece)), batch.column(2).slice(at, len(piece))]
                columns += [pa.array(x, kind) for x, kind in zip(plain, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [c.split()[0] for c in ALIGNED.split(", ")])
                at += len(piece)

    return texts.select("key", "text", "copies").mapInArrow(work, ALIGNED)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no pair of its A id is held by more."""
    counts = links.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("n"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {width}")), "pairs")
    # one row per A id: a vocabulary
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of every document: ids of both sides, groups, links, links of the best pair, sum of the pairs' counts."""
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    texts = rows.filter(F.col("text") != "").groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", digest)
    links = materialize(aligned(texts, path_a, path_b), "aligned")
    with open(path_b, "rb") as file:
        width = len(Model(file.read()).pieces)
    counts = pair_counts(links, width)
    each = links.select("key", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    weighed = each.join(broadcast_if_small(counts, max_rows=PAIR_ROWS), "pair")
    sums = weighed.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    measured = rows.select(key, digest.alias("key")).join(links.drop("copies", "pairs", "times"), "key", "left").join(sums, "key", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in MEASURES]
    return measured.select(key, *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of 50k ids (A) against the 32k pieces (B), over all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
