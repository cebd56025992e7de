"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ten words (a shorter item is one window), a window into shingles of three. A document
holds a window only if it holds all shingles of it, so one shingle is the necessary prefix: the rarest in the corpus.
Documents are probed for these prefix shingles only; the shingle's place in the window and the window's length bound
where it can lie, and the words there are compared with the window itself.

The items are taken in blocks of at most ``BLOCK_BYTES`` of text, the bound of what is broadcast; the documents are never
shuffled. A benchmark of one block takes two passes over the documents (shingle counts, join), each further block two more.

Edge cases: null texts and texts without words have no words and no windows. Rows with the same item id are one item;
items without an id hit words and are listed as an empty string. Repeated documents are each reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 32 << 20
RESULT = "struct<n_words:bigint,hits:array<struct<start:int,end:int>>,items:array<string>>"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))}


def _shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    n = min(SHINGLE, len(window))
    return [window[i : i + n] for i in range(len(window) - n + 1)]


class ShingleSet:
    """Finds the places of known shingles in a list of words."""

    def __init__(self, shingles: set[tuple[bytes, ...]]):
        self.shingles, self.lengths, self.first = shingles, sorted({len(s) for s in shingles}), {s[0] for s in shingles}

    def places(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        first, shingles, lengths = self.first, self.shingles, self.lengths
        for i in [i for i, w in enumerate(words) if w in first]:
            for n in lengths:
                if (s := tuple(words[i : i + n])) in shingles and len(s) == n:
                    yield i, s


class Index:
    """Windows by their prefix shingle, its place in them and their length; each with the items that hold it."""

    def __init__(self, items: dict[tuple[bytes, ...], set[str]], counts: dict[tuple[bytes, ...], int]):
        self.by_prefix: dict[tuple, dict[tuple[int, int], dict[tuple, frozenset[str]]]] = {}
        for window, names in items.items():
            at, prefix = min(enumerate(_shingles(window)), key=lambda x: (counts.get(x[1], 0), x[1], x[0]))
            self.by_prefix.setdefault(prefix, {}).setdefault((at, len(window)), {})[window] = frozenset(names)
        self.known = ShingleSet(set(self.by_prefix))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside occurrences of windows, and the items these belong to."""
        n, found, names = len(words), [], set()
        for i, prefix in self.known.places(words):
            for (at, length), windows in self.by_prefix[prefix].items():
                start = i - at
                if start >= 0 and start + length <= n and (held := windows.get(tuple(words[start : start + length]))):
                    found.append((start, start + length))
                    names |= held
        return merge_spans(found), names


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _rarity(docs: DataFrame, text: str, shingles: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """In how many documents each of the given shingles occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(ShingleSet(shingles))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for piece in slices(batch.column(0).cast(pa.binary())):
                for t in piece.to_pylist():
                    if t:
                        seen.update({s for _, s in sent.value.places(words_of(t))})
        keys = [b" ".join(s) for s in seen]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "s binary, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r["s"]).split(b" ")): r["n"] for r in counts.collect()}  # no more rows than the block has shingles


def search(text: Column | str, before: Column, index: Index) -> Column:
    """Hits of the index in a text, joined with the hits found ``before`` (null at first)."""
    sent = SparkSession.active().sparkContext.broadcast(index)

    @F.arrow_udf(RESULT)
    def hits_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(span)), ("items", pa.list_(pa.string()))])
        for texts, earlier in batches:
            out = []
            for piece, old in zip(slices(texts.cast(pa.binary())), slices(earlier), strict=True):
                for t, o in zip(piece.to_pylist(), old.to_pylist(), strict=True):
                    words = words_of(t) if t else []
                    spans, names = sent.value.search(words)
                    if o:
                        spans = merge_spans(spans + [(h["start"], h["end"]) for h in o["hits"]])
                        names |= set(o["items"])
                    out.append({"n_words": len(words), "hits": [{"start": s, "end": e} for s, e in spans], "items": sorted(names)})
            yield pa.array(out, kind)

    return hits_of(text, before)


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with a column ``out``: n_words, hits (spans of words inside occurrences of windows) and the items' ids."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = docs.withColumn(out, F.lit(None).cast(RESULT))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else items
        windows: dict[tuple[bytes, ...], set[str]] = {}
        for r in part.toLocalIterator():  # a block, of the size checked above
            for w in windows_of(words_of(r["text"].encode())):
                windows.setdefault(w, set()).add(r["id"])
        counts = _rarity(docs, text, {s for w in windows for s in _shingles(w)}) if windows else {}
        if k:
            docs = materialize(docs, "decontaminate")
        docs = docs.withColumn(out, search(text, F.col(out), Index(windows, counts)))
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie inside ten words of a benchmark item, and of which items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found")
    hit = F.aggregate("found.hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
