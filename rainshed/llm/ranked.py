"""Ranked lexical search by pipelined term partitioning, in integer arithmetic.

One pass over the documents keeps, for the terms of the items, the postings of each shard (some thousand documents) as
packed arrays in a written table. From it come the counts of documents and words, so the weight of every term. The terms
are dealt to a few owners, the heaviest first, each with about as many postings. Bundles of items then go through the
owners one after the other: for each shard a bundle carries sparse accumulators (item, document, score so far), meets the
owner's postings in a cogroup, and adds their integer contributions. The last owner gives the best documents of
every item in the shard; a window over them makes the final selection.

Accumulators stay sparse and results whole: a document is dropped, or not admitted, only where its score and the most that
the remaining owners could add (a contribution is below weight times a million) stay under the score that the item's
last wanted rank has already reached in the shard.

The item terms are read in blocks of a bounded number of (item, term) pairs, cut between items; each block is searched in all
documents. An item alone larger than a block is a block of its own (its distinct words).

Edge cases: null texts have no terms; texts of any length are read whole, in pieces of about a megabyte. Rows of equal item_id
(null is an id too) are one item with the terms of all of them. Every document row counts on its own, also copies and repeated
or null doc_ids; a null doc_id ranks behind equal scores. Items without terms or hits, and empty tables, give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, table

OWNERS = 4  # stages a bundle goes through
BUNDLE = 256  # items that travel together
SHARD_DOCS, SHARD_WORDS = 4096, 4_000_000  # a shard is closed at either
BLOCK_PAIRS = 1_000_000  # (item, term) pairs of a block
PIECE = 1 << 20  # bytes of a text that are split into words at a time
MOST = 1_000_000  # a contribution is below its weight times this
# fixed values: letters, digits and what is beyond ASCII make terms, A-Z count as a-z
_TERM_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
POSTINGS = "shard bigint, docs array<bigint>, sizes binary, terms binary, places binary, times binary"
STATE = "bundle int, shard bigint, docs array<bigint>, items binary, places binary, scores binary, floors binary"
FOUND = "item int, doc_id bigint, score bigint"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, cut where no term is."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


class Plan(NamedTuple):
    """What the stages of a block need: weights and owners of its terms, and the terms of the items by owner."""

    documents: int
    words: int
    weights: np.ndarray
    owners: np.ndarray
    items: list[list[list[int]]]  # item -> owner -> terms
    rest: np.ndarray  # item, owner: the most that this and later owners can add
    width: int  # items of a bundle

    def bundle(self, b: int) -> range:
        return range(b * self.width, min(len(self.items), (b + 1) * self.width))

    @property
    def bundles(self) -> int:
        return -(-len(self.items) // self.width)


def make_plan(items: list[list[int]], df: np.ndarray, documents: int, words: int) -> Plan:
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)
    order = [t for t in np.lexsort((np.arange(len(df)), -weights)).tolist() if weights[t] > 0]
    owners, total, passed = np.full(len(df), -1), sum(int(df[t]) for t in order), 0
    for t in order:
        owners[t] = OWNERS * passed // total
        passed += int(df[t])
    split = [[[t for t in terms if owners[t] == s] for s in range(OWNERS)] for terms in items]
    rest = np.zeros((len(items), OWNERS + 1), np.int64)
    for s in reversed(range(OWNERS)):
        rest[:, s] = rest[:, s + 1] + [MOST * int(weights[item[s]].sum()) for item in split]
    return Plan(documents, words, weights, owners, split, rest, BUNDLE)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (item, term) pairs, in order of items."""

    @F.arrow_udf("array<binary>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [sorted({w for words in words_of(t or b"") for w in words}) for piece in slices(batch.cast(pa.binary())) for t in piece.to_pylist()]
            yield pa.array(out, pa.list_(pa.binary()))

    return items.select(F.col(key).alias("item"), F.explode(terms(text)).alias("term")).distinct().orderBy("item", "term")


def blocks_of(pairs: Iterator[tuple[Any, bytes]], limit: int = BLOCK_PAIRS) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """Blocks of whole items: their keys, their terms as numbers, and the numbers."""
    keys, items, numbers, size = [], [], {}, 0
    for key, group in itertools.groupby(pairs, key=lambda p: p[0]):
        terms = [bytes(t) for _, t in group]
        if keys and size + len(terms) > limit:
            yield keys, items, numbers
            keys, items, numbers, size = [], [], {}, 0
        keys.append(key)
        items.append([numbers.setdefault(t, len(numbers)) for t in terms])
        size += len(terms)
    if keys:
        yield keys, items, numbers


def postings(docs: DataFrame, numbers: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed postings of the numbered terms, a row per shard: documents with a term at all, their sizes, and sorted (term, place, times)."""
    sent, most_docs, most_words = docs.sparkSession.sparkContext.broadcast(numbers), SHARD_DOCS, SHARD_WORDS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = sent.value.get, TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        sizes: list[int] = []
        terms: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            place = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            every, times = np.unique(np.concatenate(terms).astype(np.int64) * len(terms) + place, return_counts=True)
            arrays = np.array(sizes, np.int64), (every // len(terms)).astype(np.int32), (every % len(terms)).astype(np.int32), times.astype(np.int32)
            row = [pa.array([shard], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
            return pa.RecordBatch.from_arrays(row, ["shard", "docs", "sizes", "terms", "places", "times"])

        for batch in batches:
            at = 0
            for piece in slices(batch.column(1).cast(pa.binary())):
                own = batch.column(0).slice(at, len(piece)).to_pylist()
                at += len(piece)
                for doc, data in zip(own, piece.to_pylist(), strict=True):
                    n, found = 0, []
                    for words in words_of(data or b""):
                        n += len(words)
                        found.append(np.array([x for x in map(number, words) if x is not None], np.int32))
                    if not n:
                        continue
                    ids.append(doc)
                    sizes.append(n)
                    terms.append(np.concatenate(found))
                    held += len(terms[-1])
                    if len(ids) >= most_docs or held >= most_words:
                        yield flush()
                        ids, sizes, terms, held, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, POSTINGS)


def counts(packed: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Document counts of the terms, documents and words: sums of one row per task and term."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for sizes, terms in zip(batch.column(0), batch.column(1), strict=True):
                n = np.frombuffer(sizes.as_py(), np.int64)
                documents, words = documents + len(n), words + int(n.sum())
                df += np.bincount(np.frombuffer(terms.as_py(), np.int32), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *held.tolist()], pa.int32()), pa.array([documents, words, *df[held].tolist()], pa.int64())], ["term", "n"]
        )

    rows = packed.select("sizes", "terms").mapInArrow(partial, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(n_terms, np.int64), {-2: 0, -1: 0}
    for term, n in rows:
        if term < 0:
            total[term] = n
        else:
            df[term] = n
    return df, total[-2], total[-1]


def owned(packed: DataFrame, plan, owner: int) -> DataFrame:
    """The postings of one owner for each bundle that has terms there, with the factor a weight is multiplied by."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        wanted = []
        for b in range(p.bundles):
            mask = np.zeros(len(p.weights), bool)
            mask[[t for i in p.bundle(b) for t in p.items[i][owner]]] = True
            wanted.append(mask)
        for batch in batches:
            for row in range(len(batch)):
                sizes, terms, places, times = (
                    np.frombuffer(batch.column(k)[row].as_py(), kind) for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32))
                )
                pick = p.owners[terms] == owner
                terms, places, tf = terms[pick], places[pick], times[pick].astype(np.int64)
                m = 10 + (90 * sizes * p.documents) // p.words
                factor = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[places])).astype(np.int32)
                for b, mask in enumerate(wanted):
                    own = mask[terms]
                    if own.any():
                        values = [terms[own], places[own], factor[own]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([b], pa.int32()), batch.column(0).slice(row, 1), *[pa.array([v.tobytes()], pa.binary()) for v in values]],
                            ["bundle", "shard", "terms", "places", "factors"],
                        )

    columns = packed.select("shard", "sizes", "terms", "places", "times")
    return columns.mapInArrow(deal, "bundle int, shard bigint, terms binary, places binary, factors binary")


def departure(packed: DataFrame, plan: Plan) -> DataFrame:
    """Every bundle at every shard, with empty accumulators."""
    start = packed.select(F.explode(F.sequence(F.lit(0), F.lit(plan.bundles - 1))).alias("bundle"), "shard", "docs")
    empty = F.lit(b"")
    return start.withColumns({"items": empty, "places": empty, "scores": empty, "floors": empty})


def visit(state: DataFrame, lists: DataFrame, plan, owner: int, top: int) -> DataFrame:
    """A stage: accumulators meet the owner's postings; behind the last owner the best documents come out."""
    last = owner == OWNERS - 1

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        p: Plan = plan.value
        bundle = p.bundle(key[0].as_py())
        carried = {n: left.column(n)[0] for n in left.column_names}
        docs = carried["docs"].values
        read = lambda n, kind: np.frombuffer(carried[n].as_py(), kind)
        items, places, scores, floors = read("items", np.int32), read("places", np.int32), read("scores", np.int64), read("floors", np.int64)
        floors = floors.copy() if len(floors) else np.zeros(len(bundle), np.int64)
        terms, where, factors = (
            np.frombuffer(right.column(n)[0].as_py() if len(right) else b"", np.int32) for n in ("terms", "places", "factors")
        )
        cuts = np.searchsorted(items, np.arange(len(bundle) + 1))
        out = []
        for k, i in enumerate(bundle):
            own, total = places[cuts[k] : cuts[k + 1]], np.zeros(len(docs), np.int64)
            total[own] = scores[cuts[k] : cuts[k + 1]]
            for t in p.items[i][owner]:
                a, b = np.searchsorted(terms, [t, t + 1])
                total[where[a:b]] += p.weights[t] * factors[a:b]
            # documents met only now count where the terms from here on can lift them to the floor
            own = np.flatnonzero(total) if p.rest[i, owner] >= floors[k] else own
            reached = total[own]
            if len(own) >= top:
                floors[k] = max(floors[k], np.partition(reached, len(own) - top)[len(own) - top])
            stay = reached + p.rest[i, owner + 1] >= floors[k]
            out.append((own[stay], reached[stay]))
        if last:
            return _best(bundle, out, docs, top)
        columns = np.repeat(np.arange(len(bundle)), [len(o) for o, _ in out]).astype(np.int32), *map(np.concatenate, zip(*out, strict=True)), floors
        kinds = np.int32, np.int32, np.int64, np.int64
        values = [pa.array([c.astype(d).tobytes()], pa.binary()) for c, d in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays([*left.select(["bundle", "shard", "docs"]).columns, *values], ["bundle", "shard", "docs", "items", "places", "scores", "floors"])

    return state.groupBy("bundle", "shard").cogroup(lists.groupBy("bundle", "shard")).applyInArrow(add, FOUND if last else STATE)


def _best(bundle: range, out: list[tuple[np.ndarray, np.ndarray]], docs: pa.Array, top: int) -> pa.Table:
    """The best ``top`` documents of each item in a shard: highest score, then lowest id, null ids last."""
    known = docs.is_valid().to_numpy(zero_copy_only=False)
    ids = docs.fill_null(0).to_numpy(zero_copy_only=False)
    items, places, scores = [], [], []
    for i, (own, reached) in zip(bundle, out, strict=True):
        order = np.lexsort((ids[own], ~known[own], -reached))[:top]
        items += [i] * len(order)
        places.append(own[order])
        scores.append(reached[order])
    places = np.concatenate(places)
    return pa.Table.from_arrays(
        [pa.array(items, pa.int32()), pa.array(ids[places], pa.int64(), mask=~known[places]), pa.array(np.concatenate(scores), pa.int64())], ["item", "doc_id", "score"]
    )


def search(docs: DataFrame, items: DataFrame, top: int = 10, block_pairs: int = BLOCK_PAIRS, key: str = "item_id", text: str = "text") -> DataFrame:
    """The ``top`` documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score.

    Scores are positive; equal ones rank by doc_id.
    """
    spark, kind, done = docs.sparkSession, items.schema[key].dataType, []
    pairs = ((r.item, r.term) for r in item_terms(items, key, text).toLocalIterator())
    for keys, terms, numbers in blocks_of(pairs, block_pairs):
        packed = materialize(postings(docs, numbers), "postings")
        df, documents, words = counts(packed, len(numbers))
        if not documents:
            continue
        plan = make_plan(terms, df, documents, words)
        sent = spark.sparkContext.broadcast(plan)
        state = departure(packed, plan)
        for owner in range(OWNERS):
            state = visit(state, owned(packed, sent, owner), sent, owner, top)
        ids = spark.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField(key, kind)]))
        by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = state.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
        # a block has at most as many items as pairs
        done.append(best.join(F.broadcast(ids), "item").select(key, "rank", "doc_id", "score"))
    if not done:
        empty = T.StructType([T.StructField(key, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) x),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) x
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term) y, s),
c AS (SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS c
      FROM p JOIN f ON p.term = f.term, s),
t AS (SELECT item_id, r, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c ON q.term = c.term GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t WHERE score > 0) z
WHERE rank <= 10
"""
