"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of five-word shingles; texts of equal sets are one node.
2. MinHash signatures are cut into bands; nodes that agree in a band share a bucket. In each bucket all are compared with
   its first node only, never with one another, so a bucket gives as many candidates as it has nodes.
3. Candidates are compared by batches of the signature. After each batch the posterior probability that the similarity
   reaches the threshold (uniform prior) is looked up; under ``MISS`` the pair is dropped. Survivors are verified on the
   full shingle sets of their texts. Links give components.
4. Buckets that still hold several components are taken up again, in blocks of ``BLOCK`` nodes that are dealt over the
   tasks. Nodes of different components are compared by their signatures in the first bucket they share. Nodes with a
   survivor bring their texts to the same blocks, where the sizes of all intersections come from one product of matrices;
   no pair becomes a row unless it is a link between components.

With 26 bands of 5 a pair of similarity 0.85 shares no bucket with probability 2e-7, one of 0.8 with 3e-5.

Edge cases: a text with fewer than five words has its whole sequence as one shingle; without words the set is empty and
linked with nothing. Rows of one id count as one document. Rows without an id take the component of their copies with one,
else none; they link nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, slices, table, unpacked
from .components import components
from .hashing import Substrings

WORDS = 5
BANDS, ROWS = 26, 5
BATCH = 13  # signature positions compared at a time
MISS = 1e-5
BLOCK = 256
SEGMENT = 200_000  # words hashed at a time
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = "struct<n:int,key:binary,signature:binary,bands:array<bigint>>"


def shingles_of(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    words = text.translate(_LOWER).split()
    n = min(WORDS, len(words))
    if not n:
        return np.empty(0, np.uint64)
    parts = []
    for at in range(0, len(words) - n + 1, SEGMENT):
        piece = words[at : at + SEGMENT + n - 1]
        data = np.frombuffer(b" ".join(piece), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, piece), np.int64, len(piece)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts.append(Substrings(data).of(starts[: len(piece) - n + 1], ends[n - 1 :]))
    return np.unique(np.concatenate(parts))


def minhash(shingles: np.ndarray) -> np.ndarray:
    lowest = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(lowest, (shingles[at : at + 256, None] * _FACTORS).min(0), out=lowest)
    return lowest


def sketch(text: Column | str) -> Column:
    """Size of the shingle set, a key that equal sets share, the signature (16 bits a position) and the band hashes."""

    @F.arrow_udf(SKETCH)
    def sketch_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n", pa.int32()), ("key", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for piece in slices(batch.cast(pa.binary())):
                for t in piece.to_pylist():
                    s = shingles_of(t) if t else ()
                    if not len(s):
                        out.append({"n": 0, "key": None, "signature": None, "bands": []})
                        continue
                    lowest = minhash(s)
                    bands = [xxhash.xxh3_64_intdigest(lowest[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)]
                    signature = (lowest >> np.uint64(48)).astype(np.uint16).tobytes()
                    out.append({"n": len(s), "key": xxhash.xxh3_128_digest(s.tobytes()), "signature": signature, "bands": bands})
            yield pa.array(out, kind)

    return sketch_of(text)


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n positions a pair goes on only with m matches, else P(similarity >= threshold) is under ``miss``."""
    t, out = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1  # the Beta(m + 1, n - m + 1) posterior as a binomial sum
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _plausible(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signature rows that survive all batches: their positions, and the matches of their signatures."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in steps:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(1)
        go = matches >= least
        alive, matches, done = alive[go], matches[go], n
    return alive, matches


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _prune(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the signatures leave possible."""
    steps = least_matches(percent)
    signature = nodes.select("id", "signature")

    @F.arrow_udf("boolean")
    def possible(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            keep = np.zeros(len(a), bool)
            if len(a):
                keep[_plausible(_signatures(a), _signatures(b), steps)[0]] = True
            yield pa.array(keep)

    with_a = pairs.join(signature.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
    with_both = with_a.join(signature.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return with_both.filter(possible("sa", "sb")).select("a", "b")


def _verify(pairs: DataFrame, packs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold. ``packs`` holds the compressed texts (id, data)."""

    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for left, right in batches:
            out = []
            for a, b in zip(unpacked(left), unpacked(right), strict=True):
                if a != last[0]:
                    last = (a, shingles_of(a))
                other = shingles_of(b)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                out.append(100 * common >= percent * (len(last[1]) + len(other) - common))
            yield pa.array(out, pa.bool_())

    with_a = pairs.join(packs.select(F.col("id").alias("a"), F.col("data").alias("ta")), "a")
    with_both = with_a.join(packs.select(F.col("id").alias("b"), F.col("data").alias("tb")), "b")
    return with_both.filter(similar("ta", "tb")).select("a", "b").distinct()


_DEALT = "band bigint, left int, right int, id bigint, component bigint, part int"


def _crossing(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of a block's nodes, and the places of its two parts (the same twice, or two different ones)."""
    part, left, right = group.column("part").to_numpy(), group.column("left")[0].as_py(), group.column("right")[0].as_py()
    return group.column("component").to_numpy(), np.flatnonzero(part == left), np.flatnonzero(part == right)


def _open_nodes(percent: int):
    """Nodes of a block with a possible link to another component that no earlier band shows."""
    steps = least_matches(percent)

    def compare(group: pa.Table) -> pa.Table:
        comps, first, second = _crossing(group)
        signatures = _signatures(group.column("signature").combine_chunks())
        bands = np.array(group.column("bands").to_pylist())
        own = int(np.flatnonzero(bands[0] == group.column("band")[0].as_py())[0])
        wanted = np.zeros(len(comps), bool)
        for i in first:
            others = second[comps[second] != comps[i]]
            others = others[~(bands[others, :own] == bands[i, :own]).any(1)]
            if len(others):
                alive, _ = _plausible(np.broadcast_to(signatures[i], (len(others), signatures.shape[1])), signatures[others], steps)
                wanted[others[alive]] = True
                wanted[i] |= len(alive) > 0
        return group.select(["band", "left", "right", "id", "component", "part"]).filter(pa.array(wanted))

    return compare


def _exact_links(percent: int):
    """Linked components (a, b) among the nodes of a block, by the intersections of their full shingle sets."""

    def link(group: pa.Table) -> pa.Table:
        comps, first, second = _crossing(group)
        sets = [shingles_of(t) for t in unpacked(group.column("data").combine_chunks())]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # a shingle of one node adds to no intersection
        keep = copies[column] > 1
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float64)
        width = 1 << 13
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            held = np.zeros((len(sets), width), np.float32)
            held[owner[a:b], column[a:b] - at] = 1
            common += held @ held.T
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        x, y = np.nonzero(linked[np.ix_(first, second)])
        x, y = comps[first[x]], comps[second[y]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return link


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept) for every row: linked at a Jaccard similarity of ``percent`` or more.

    ``row`` is a hash of id and text, by which the rows of ``docs`` can be joined even if they have no id.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialize(source.select(F.xxhash64("id", "text").alias("row"), "id", sketch("text").alias("s")).select("row", "id", "s.*"), "sketches")
    # one node for each set: the first of its ids
    firsts = materialize(rows.filter("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("id")), "firsts")
    nodes = materialize(rows.join(firsts, ["key", "id"]).select("id", "signature", "bands"), "nodes")
    buckets = nodes.select("id", F.explode("bands").alias("band"))
    heads = materialize(buckets.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("size")).filter("size > 1"), "heads")
    shared = materialize(buckets.join(heads, "band"), "buckets")
    pairs = materialize(shared.filter("id != a").select("a", F.col("id").alias("b")).distinct(), "pairs")
    # texts of nodes that share a bucket with another move once, compressed; how many these are is not bounded, so no broadcast
    candidates = materialize(shared.select("id").distinct(), "candidates")
    packs = materialize(source.select("id", packed("text").alias("data")).join(candidates.hint("merge"), "id", "left_semi"), "packs")
    links = materialize(_verify(materialize(_prune(pairs, nodes, percent), "pairs"), packs, percent), "links")
    labels = components(links)

    component = F.coalesce("component", "id").alias("component")
    members = shared.filter("size > 2").select("band", "id").join(labels, "id", "left").select("band", "id", component)
    members = materialize(members, "members")
    ends = [F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")]
    mixed = members.groupBy("band").agg(*ends).filter("low < high")
    mixed = materialize(mixed.select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "mixed")
    dealt = members.join(mixed, "band").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right")
    dealt = materialize(dealt.select("band", *sides, "id", "component", "part"), "dealt")
    block = ["band", "left", "right"]
    possible = materialize(dealt.join(nodes, "id").groupBy(*block).applyInArrow(_open_nodes(percent), _DEALT), "open")
    found = materialize(possible.join(packs, "id").groupBy(*block).applyInArrow(_exact_links(percent), "a bigint, b bigint"), "links")
    if not found.isEmpty():
        labels = components(links.union(found))
    classes = materialize(firsts.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component")), "classes")
    found = rows.select("row", "id", F.col("n").cast("long").alias("n_shingles"), "key").join(classes, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    kept = F.col("id").eqNullSafe(component).alias("kept")
    return found.select("row", F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), kept)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at 0.85, their smallest id kept."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("row")
