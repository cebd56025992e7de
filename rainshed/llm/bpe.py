"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary as a whole is resolved by a minimal perfect hash (hash and displace: one seed
for each bucket of keys, single keys placed directly). Others are merged: the bytes form a linked list, the possible
merges a heap ordered by rank and position; stale heap entries are recognised when they are popped.

Edge cases: a null text is the empty text and gives no ids; repeated rows and null ids in other columns do not matter,
since each row is encoded on its own; texts of any length are encoded whole. Unknown ids make ``decode`` fail.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, slices, table

MEMO_TOKENS = 250_000  # resolved pre-tokens of a generation; a worker keeps two
MEMO_LENGTH = 64  # longer pre-tokens are not kept
_LOADED: dict[str, Vocabulary] = {}
_WORDS: dict[str, tuple[pa.Array, np.ndarray]] = {}


class PerfectHash:
    """A minimal perfect hash of byte strings to their positions: n keys in n slots, keys are compared at the end."""

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, n // 3 + 1
        if len(set(keys)) != len(keys):
            raise ValueError("keys must differ")
        hashes = np.array([self._hash(k) for k in keys], dtype=np.uint64).reshape(-1, 2)
        bucket = (hashes[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate(bucket.tolist()):
            members[b].append(i)
        second = hashes[:, 1].tolist()
        self.seed = [0] * self.buckets
        self.slot: list[int] = [-1] * n
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not members[b]:
                break
            if len(members[b]) == 1:
                while self.slot[free] >= 0:
                    free += 1
                self.seed[b], self.slot[free] = -free - 1, members[b][0]
                continue
            for d in itertools.count():
                places = {self._place(second[i], d) for i in members[b]}
                if len(places) == len(members[b]) and all(self.slot[p] < 0 for p in places):
                    break
            self.seed[b] = d
            for i in members[b]:
                self.slot[self._place(second[i], d)] = i
        self.keys = [keys[i] if i >= 0 else b"" for i in self.slot]

    @staticmethod
    def _hash(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFFFFFFFFFF, h >> 64

    def _place(self, h: int, seed: int) -> int:
        return ((h ^ seed * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """The position of ``key`` among the keys, or -1."""
        low, high = self._hash(key)
        d = self.seed[low % self.buckets]
        at = -d - 1 if d < 0 else self._place(high, d)
        return self.slot[at] if self.keys[at] == key else -1


def _latin_pattern(pattern: str) -> str | None:
    r"""``pattern`` for texts of code points below 256, its classes \p{L} \p{N} \s \S spelt out for the faster ``re``."""
    members = {
        name: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside = "", False
    for part in re.findall(r"\\p\{[LN]\}|\\s|\\S|\\.|\[\^?|.", pattern):
        if part in members:
            out += members[part] if inside else f"[{members[part]}]"
        elif part == r"\S" and not inside:
            out += f"[^{members[r'\s']}]"
        elif part.startswith("\\"):
            return None
        else:
            inside = part.startswith("[") or inside and part != "]"
            out += part
    return out


def ranked_words(source: bytes) -> list[tuple[bytes, int]]:
    return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, source.splitlines())]


class Vocabulary:
    """Ranks of byte strings; the rank is the id. ``source`` holds lines of base64 bytes and rank."""

    def __init__(self, source: bytes, pattern: str):
        pairs = ranked_words(source)
        self.words, self.ids = [w for w, _ in pairs], [i for _, i in pairs]
        self.whole = PerfectHash(self.words)
        self.split_any = regex.compile(pattern).findall
        self.split_latin = re.compile(latin).findall if (latin := _latin_pattern(pattern)) else self.split_any
        rank = {w: i for w, i in pairs}
        self.of_byte = [rank[bytes([b])] for b in range(256)]
        self.merged = {
            rank[w[:cut]] << 32 | rank[w[cut:]]: i for w, i in pairs for cut in range(1, len(w)) if w[:cut] in rank and w[cut:] in rank
        }
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merge the bytes of ``word``, the pair of lowest rank first, from the left among equals."""
        merged, n = self.merged.get, len(word)
        ids = [self.of_byte[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := merged(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or merged(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (s := merged(r << 32 | ids[k])) is not None:
                    push(heap, s << 32 | i)
            h = before[i]
            if h >= 0 and (s := merged(ids[h] << 32 | r)) is not None:
                push(heap, s << 32 | h)
        return tuple(x for x in ids if x >= 0)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def resolve(self, token: str) -> tuple[int, ...]:
        word = token.encode()
        at = self.whole.find(word)
        return (self.ids[at],) if at >= 0 else self.merge(word)

    def encode(self, text: str) -> list[int]:
        tokens, young, old = self.split(text), self.young, self.old
        found = list(map(young.get, tokens))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    token = tokens[k]
                    if (ids := young.get(token)) is None:
                        if (ids := old.get(token)) is None:
                            ids = self.resolve(token)
                        if len(token) <= MEMO_LENGTH:
                            young[token] = ids
                    found[k] = ids
            if len(young) > MEMO_TOKENS:  # what is in use moves on from the old generation
                self.old, self.young = young, {}
        return list(itertools.chain.from_iterable(found))


def load(spark: SparkSession, path: str, pattern: str):
    """Send a rank file to the executors. A vocabulary is a file of a few MB whatever the corpus holds; checked here."""
    with open(path, "rb") as file:
        source = file.read()
    if len(source) > 64 << 20:
        raise ValueError(f"{path}: a rank file of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast((f"{path}:{xxhash.xxh3_64_hexdigest(source)}:{pattern}", source, pattern))


def _vocabulary(sent) -> Vocabulary:
    key, source, pattern = sent.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(source, pattern)
    return _LOADED[key]


def _words(sent) -> tuple[pa.Array, np.ndarray]:
    """The words, and where each id has its word; decoding needs no more."""
    key, source, _ = sent.value
    if key not in _WORDS:
        _WORDS.clear()
        pairs = ranked_words(source)
        place = np.full(max((i for _, i in pairs), default=0) + 1, -1)
        place[[i for _, i in pairs]] = np.arange(len(pairs))
        _WORDS[key] = pa.array([w for w, _ in pairs], pa.binary()), place
    return _WORDS[key]


def decoded(ids: pa.ListArray, words: pa.Array, place: np.ndarray) -> pa.Array:
    """BINARY: the words of each list after each other; null stays null."""
    flat, at = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).fill_null(0))])
    if len(flat) and not (0 <= flat.min() and flat.max() < len(place) and (found := place[flat]).min() >= 0):
        raise KeyError("an id that is not in the vocabulary")
    data, starts = joined(words, found if len(flat) else flat)
    known = None if not ids.null_count else ids.is_valid().cast(pa.uint8()).to_numpy()
    valid = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(starts[at].astype(np.int32).tobytes()), data])


def encode(text: Column | str, vocabulary) -> Column:
    """ARRAY<INT> of the ids of a text. ``vocabulary`` comes from ``load``."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _vocabulary(vocabulary)
        for batch in batches:  # what goes back is sent in small parts, as it is larger than the texts
            for piece in slices(batch):
                ids: list[int] = []
                ends = [0]
                for s in piece.to_pylist():
                    ids += v.encode(s) if s else []
                    ends.append(len(ids))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))

    return ids_of(text)


def decode(ids: Column | str, vocabulary) -> Column:
    """BINARY text of an array of ids; null stays null."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, place = _words(vocabulary)
        for batch in batches:
            yield from (decoded(piece, words, place) for piece in slices(batch))

    return bytes_of(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out`` of ids (replaced if there is one of that name)."""
    return docs.withColumn(out, encode(text, load(docs.sparkSession, path, pattern)))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the public 50k rank file, and the text decoded from the ids."""
    import public_tokenizers

    vocabulary = load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", encode("text", vocabulary).alias("ids"))
    return docs.select("doc_id", "ids", decode("ids", vocabulary).alias("decoded")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
