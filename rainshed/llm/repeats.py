"""Suffix-array removal of repeated byte strings, by deep-shallow sorting of anchored suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts at another place, in the same text or another.

Sorting every suffix of a corpus is out of reach, so only suffixes at anchors are sorted. In each window of ``length``
bytes the anchor is the first of the smallest hashes of its ``ANCHOR`` byte strings. It depends on the window's bytes
alone, so equal windows have their anchors at the same offset and every repeated window is seen at a repeated anchor. The
context of an anchor is what the windows around it can cover: length - ANCHOR bytes before it and length bytes from it on,
within the text.

1. Anchors are counted by (anchor, context hash). A context that occurs twice is covered whole, without looking at bytes.
2. Anchors with several contexts are compared: one copy of each of their contexts, cut out of the texts, is sorted by the
   suffix that starts at the anchor: multikey quicksort to ``SHALLOW`` bytes, then blind tries for the groups left. The
   same is done for the reversed bytes before the anchor. In the tree of common prefixes a node of depth r joins suffixes
   with r bytes in common; a member that shares l bytes to the left with another one of the node, l + r >= length, is
   covered from l bytes before the anchor to r bytes after its start. Texts are judged as they came in.
3. Whole contexts of an anchor with more than ``WIDE`` of them (a passage at which many texts begin to differ) are too much
   for one task. They are first split in Spark, by ``BLOCK`` * ``RUN`` neighbouring windows at a time: if the bytes that the
   windows of a block cover together occur twice, all are repeated. One of such equal blocks and the other blocks are split
   again, by ``RUN`` windows: these too are repeated if what they cover occurs twice; if the bytes that all of a run share,
   the core, occur once, none is. What is left, the runs at the ends of repeated passages, meets by core and is sorted as above, of each run only the
   RUN - 1 bytes on either side of its core. A core with more than ``SORTED`` such runs is not brought into one task: its
   windows become rows, compared by core and the bytes about it.

Passages under ``length`` bytes stay, however many words they have. If ``words`` is given, windows of that many words that
another text holds too are counted beside that, in the same passes: the anchor of a window is the first of the smallest
hashes of its ``SHINGLE`` word strings, and every window has one. Windows of an anchor are told together first (the context),
and where texts share an anchor and not its context one by one. Of a context that several texts hold, two stand for it: a
window of any third text is then in another one than itself. Rows that are equal in all columns are one text here.

Contexts, covers, cores and words are told apart by 64-bit hashes, seeds differing; suffixes are compared byte by byte.

Edge cases: a null text is empty; texts under ``length`` bytes lose nothing; repeated rows are copies of each other. Rows
are told apart by a hash of all columns, which equal rows share, as they share the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, packed, slices, table, unpacked
from .hashing import Substrings, mix

LENGTH = 400
ANCHOR = 64
WORDS = 51
SHINGLE = 8  # words
SHALLOW = 32
WIDE = 512
RUN = 16
BLOCK = 8  # runs
SORTED = 1 << 16  # runs of one core sorted in a task, 2 * (RUN - 1) bytes each
PIECE = 1 << 20  # bytes whose anchors are sought at a time


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values: suffix minima of one block meet prefix minima of the next."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, length: int) -> np.ndarray:
    """Places of the anchors of all windows of ``length`` bytes, ascending."""
    found = []
    width = length - ANCHOR + 1
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[at : at + PIECE + length - 1]
        starts = np.arange(len(piece) - ANCHOR + 1)
        hashes = Substrings(piece).of(starts, starts + ANCHOR)
        # the place makes ties go to the first
        ranked = (hashes >> np.uint64(22) << np.uint64(22)) | starts.astype(np.uint64)
        found.append(np.unique(_window_minima(ranked, width) & np.uint64((1 << 22) - 1)).astype(np.int64) + at)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))


def _words(data: np.ndarray, sub: Substrings) -> np.ndarray:
    """Hashes of the words of a text."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return sub.of(edges[::2], edges[1::2])


def _word_anchors(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors of windows of ``words`` words; the first window of each and how many windows it has."""
    places, firsts = [], []
    for at in range(0, len(hashes) - words + 1, PIECE):
        piece = hashes[at : at + PIECE + words - 1]
        starts = np.arange(len(piece) - SHINGLE + 1)
        ranked = (Substrings(piece).of(starts, starts + SHINGLE) >> np.uint64(22) << np.uint64(22)) | starts.astype(np.uint64)
        place = (_window_minima(ranked, words - SHINGLE + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        places.append(place[first] + at)
        firsts.append(first + at)
    first = np.concatenate(firsts)
    return np.concatenate(places), first, np.diff(first, append=len(hashes) - words + 1)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


_ANCHOR = "key bigint, context bigint, row bigint, at bigint, size bigint, words boolean"
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def _anchor_rows(length: int, words: int | None):
    """Per text: its anchors, as (key, context, row, at, end of the text); those of windows of words as (key, context, row,
    first window, how many windows)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in zip(slices(batch.column(0)), slices(batch.column(1).cast(pa.binary())), strict=True):
                out, of_words = [], []
                for row, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
                    if t is None or len(t) < (length if words is None else min(length, 2 * words - 1)):
                        continue
                    data = np.frombuffer(t, np.uint8)
                    sub = Substrings(data)
                    if len(t) >= length:
                        at = anchors_of(data, length)
                        start, end = np.maximum(at - (length - ANCHOR), 0), np.minimum(at + length, len(data))
                        context = mix(sub.of(start, end) + (at - start).astype(np.uint64) * _TURN)
                        out.append((sub.of(at, at + ANCHOR), context, np.full(len(at), row, np.int64), at, np.full(len(at), len(data), np.int64)))
                    if words is not None and len(hashes := _words(data, sub)) >= words:
                        sub = Substrings(hashes)
                        at, first, many = _word_anchors(hashes, words)
                        context = mix(sub.of(first, first + many + words - 1) + (at - first).astype(np.uint64) * _TURN)
                        of_words.append((sub.of(at, at + SHINGLE), context, np.full(len(at), row, np.int64), first, many))
                for kind, found in ((False, out), (True, of_words)):
                    columns = [_signed(np.concatenate([o[i] for o in found])) if found else pa.array([], pa.int64()) for i in range(5)]
                    columns.append(pa.array(np.full(len(columns[0]), kind)))
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "row", "at", "size", "words"])

    return rows


def _shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that ``a`` and ``b`` have in common from the front; the first ``start`` are known to be."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, step = start, 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    high = min(n, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _multikey(strings: list[bytes], members: list[int], depth: int, out: list[list[int]]) -> None:
    """Multikey quicksort: ``out`` gets groups in order, each alike in its first SHALLOW bytes (or of one string)."""
    todo = [(members, depth)]
    while todo:
        members, depth = todo.pop()
        if len(members) < 2 or depth >= SHALLOW:
            out.append(members)
            continue
        keys = [strings[i][depth] if len(strings[i]) > depth else -1 for i in members]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(members, keys, strict=True) if k < pivot]
        same = [i for i, k in zip(members, keys, strict=True) if k == pivot]
        more = [i for i, k in zip(members, keys, strict=True) if k > pivot]
        if more:
            todo.append((more, depth))
        if pivot >= 0:
            todo.append((same, depth + 1))
        elif same:
            out.append(same)  # strings that end here; nothing sorts before them
        if less:
            todo.append((less, depth))


class _Node:
    """An inner node of a blind trie: the depth of its branch, and children by the byte there (-1 is the end)."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def _blind_order(strings: list[bytes], members: list[int]) -> list[int]:
    """Order a group by a blind trie: descend by branch bytes alone, compare with one leaf, insert where they part."""
    root: _Node | list[int] = [members[0]]
    for i in members[1:]:
        s, path, node = strings[i], [], root
        while isinstance(node, _Node):
            path.append(node)
            node = node.children.get(_byte(s, node.depth)) or next(iter(node.children.values()))
        leaf = strings[node[0]]
        common = _shared(s, leaf)
        if common == len(s) == len(leaf):
            node.append(i)
            continue
        k = next((k for k, p in enumerate(path) if p.depth >= common), len(path))
        if k < len(path) and path[k].depth == common:
            path[k].children[_byte(s, common)] = [i]
            continue
        inner = _Node(common)
        below = path[k] if k < len(path) else node
        inner.children = {_byte(leaf, common): below, _byte(s, common): [i]}
        if k:
            above = path[k - 1]
            above.children[_byte(s, above.depth)] = inner
        else:
            root = inner
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, _Node):
            todo += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            order += node
    return order


def sort_suffixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and what each has in common with the one before it (0 for the first)."""
    groups: list[list[int]] = []
    _multikey(strings, list(range(len(strings))), 0, groups)
    order = [i for g in groups for i in (_blind_order(strings, g) if len(g) > 1 else g)]
    return order, [0] + [_shared(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def cover(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int]]:
    """For contexts around one anchor: the bytes before and after it that windows shared with another context cover.

    ``lefts`` are the reversed bytes before the anchor, ``rights`` the bytes from it on.
    """
    n = len(rights)
    if n == 2:
        left, right = _shared(lefts[0], lefts[1]), _shared(rights[0], rights[1])
        return [(left, right) if left + right >= length else (0, 0)] * 2
    order, common = sort_suffixes(rights)
    back, common_back = sort_suffixes(lefts)
    place = {i: p for p, i in enumerate(back)}
    best = [(0, 0)] * n

    def judge(members: list[int], depth: int) -> None:
        places = sorted(place[i] for i in members)
        between = [min(common_back[p + 1 : q + 1]) for p, q in zip(places, places[1:], strict=False)]
        for k, p in enumerate(places):
            left = max(between[k - 1] if k else 0, between[k] if k < len(between) else 0)
            if left + depth >= length:
                i = back[p]
                best[i] = (max(best[i][0], left), max(best[i][1], depth))

    # the tree of common prefixes, by a stack of (depth, first place)
    stack: list[tuple[int, int]] = []
    for p in range(1, n + 1):
        depth, first = (common[p] if p < n else -1), p - 1
        while stack and stack[-1][0] > depth:
            r, first = stack.pop()
            judge(order[first:p], r)
        if p < n and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return best


def _compare(need: int, core: int = 0):
    """Spans of a group of (row, at, before, after) covered by shared strings of ``need`` bytes about ``at``; ``core`` bytes
    from there on are known to be shared and not among those given."""

    def compare(group: pa.Table) -> pa.Table:
        lefts = [b[::-1] for b in group.column("before").to_pylist()]
        found = cover(lefts, group.column("after").to_pylist(), need)
        at = group.column("at").to_numpy()
        spans = np.array(found, np.int64).reshape(-1, 2)
        keep = spans.sum(1) > 0
        return pa.Table.from_arrays(
            [pa.array(group.column("row").to_numpy()[keep]), pa.array((at - spans[:, 0])[keep]), pa.array((at + core + spans[:, 1])[keep])],
            names=["row", "start", "end"],
        )

    return compare


_CUT = "row bigint, key bigint, at bigint, before binary, after binary, low bigint, block bigint, window bigint"
_RUN = "row bigint, at bigint, before binary, after binary, cover bigint, core bigint"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _blocks(t: bytes, sub: Substrings, at: int, length: int) -> Iterator[tuple]:
    """Blocks of windows through an anchor, told by their distance to it.

    (highest start of the block; the bytes it covers within the text; where these begin; their hash)
    """
    first, last = max(0, at - (length - ANCHOR)), min(at, len(t) - length)
    if last < first:
        return
    top = np.arange((at - last) // RUN, (at - first) // RUN + 1)
    bottom, top = at - (np.append(top[BLOCK - 1 : -1 : BLOCK], top[-1]) + 1) * RUN + 1, at - top[::BLOCK] * RUN
    low, high = np.maximum(bottom, 0), np.minimum(top + length, len(t))
    for s, a, b, block in zip(top.tolist(), low.tolist(), high.tolist(), sub.of(low, high).view(np.int64).tolist(), strict=True):
        yield s, t[a:b], a, block


def _runs_of(length: int):
    """Blocks split into runs: (row, highest start of the run, which is where its core begins; bytes before and after the
    core; hash of what the whole run covers, or None if the text does not hold it; hash of the core)."""
    schema = _arrow(_RUN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                texts = piece.column("after").to_pylist()
                ends = np.cumsum([len(t) for t in texts])
                starts = ends - [len(t) for t in texts]
                tops = piece.column("at").to_numpy() - piece.column("low").to_numpy()
                many = tops // RUN + 1
                of = np.repeat(np.arange(len(texts)), many)
                top = tops[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * RUN
                bottom, sub = top - RUN + 1, Substrings(np.frombuffer(b"".join(texts), np.uint8))
                cores = sub.of(starts[of] + top, starts[of] + bottom + length).view(np.int64).tolist()
                whole = (bottom >= 0) & (top + length <= (ends - starts)[of])
                covers = iter(sub.of((starts[of] + bottom)[whole], (starts[of] + top + length)[whole]).view(np.int64).tolist())
                row, low = piece.column("row").to_pylist(), piece.column("low").to_pylist()
                out = []
                for k, e, s, full, core in zip(of.tolist(), top.tolist(), bottom.tolist(), whole.tolist(), cores, strict=True):
                    t = texts[k]
                    out.append((row[k], low[k] + e, t[max(0, s) : e], t[s + length : e + length], next(covers) if full else None, core))
                yield _batch(out, schema)

    return rows


def _windows(row: int, hashes: np.ndarray, spots: list[dict], words: int) -> tuple[np.ndarray, ...]:
    """Windows of words of a text: (row, place, 1 if it is known to be shared and stands for others only, hash)."""
    first, many, known = (np.array([a[k] for a in spots], np.int64) for k in ("at", "size", "known"))
    starts = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    return np.full(len(starts), row), starts, np.repeat(known, many), Substrings(hashes).of(starts, starts + words)


def _cut_out(length: int, words: int | None):
    """Contexts of a text's anchors as bytes; of wide anchors the blocks of windows through them; windows of words."""
    schema = _arrow(_CUT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unpacked(batch.column("data"))
            for piece in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out: list[tuple] = []
                of_words: list[tuple] = []
                for row, anchors, spots in zip(*(piece.column(c).to_pylist() for c in ("row", "anchors", "windows")), strict=True):
                    t = next(texts)
                    sub = Substrings(np.frombuffer(t, np.uint8)) if spots or any(a["contexts"] > WIDE for a in anchors) else None
                    if spots:
                        of_words.append(_windows(row, _words(np.frombuffer(t, np.uint8), sub), spots, words))
                    for a in anchors:
                        at = a["at"]
                        if a["contexts"] <= WIDE:
                            out.append((row, a["key"], at, t[max(0, at - (length - ANCHOR)) : at], t[at : at + length], None, None, None))
                        else:
                            out += [(row, None, s, None, *b, None) for s, *b in _blocks(t, sub, at, length)]
                yield _batch(out, schema)
                if of_words:
                    columns = dict(zip(("row", "at", "low", "window"), (_signed(np.concatenate(c)) for c in zip(*of_words, strict=True)), strict=True))
                    n = len(columns["row"])
                    yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    return rows


def _marked(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` (one row for each row, at and ``by``) written once: ``twice`` where ``by`` occurs twice, ``stands`` in one row
    of each ``by``, which stays to be compared with what is left, as the twin of a window may lie in a repeated stretch."""
    twice = df.groupBy(by).agg(F.count("*").alias("n"), F.min("row").alias("one"), F.min_by("at", "row").alias("place")).filter("n > 1")
    marked = df.join(materialize(twice.drop("n"), f"twice-{name}"), by, "left")
    stands = F.col("one").isNull() | (F.col("row") == F.col("one")) & (F.col("at") == F.col("place"))
    return materialize(marked.withColumns({"twice": F.col("one").isNotNull(), "stands": stands}).drop("one", "place"), name)


def _met(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, n): windows of words in contexts that several texts hold; (row, w): windows to be told one by one, of anchors
    that texts share in several contexts."""
    held = anchors.groupBy("key", "context").agg(F.min("row").alias("one"), F.max("row").alias("other"))
    held = materialize(held, "held")
    shared = materialize(held.filter("one <> other").select("key", "context"), "shared-contexts")
    # sets, as equal rows share their number
    known = anchors.join(shared, ["key", "context"]).groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("w"))
    known = known.select("row", F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + w["size"]).alias("n"))
    keys = held.groupBy("key").agg(F.count("*").alias("n"), F.min("one").alias("low"), F.max("other").alias("high"))
    keys = materialize(keys.filter("n > 1 and low <> high").select("key"), "parted")
    parted = materialize(held.join(keys, "key"), "parted-contexts")
    apart = anchors.join(parted, ["key", "context"]).filter("row = one or row = other")
    return known, apart.select("row", F.struct("at", "size", (F.col("one") != F.col("other")).alias("known")).alias("w"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, words: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(row, start, end): bytes of ``texts`` (row, text) that lie in repeated strings of ``length`` bytes; may overlap.

    And, unless ``words`` is None, (row, n): windows of so many words that another text holds too, in parts to be summed."""
    found = materialize(texts.mapInArrow(_anchor_rows(length, words), _ANCHOR), "anchors")
    anchors = found.filter("not words")
    # one place of each context stands for it
    counts = anchors.groupBy("key", "context").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by("at", "row").alias("at"))
    counts = materialize(counts, "contexts")
    twice = materialize(counts.filter("n > 1").select("key", "context"), "twice")
    low, high = F.greatest(F.col("at") - (length - ANCHOR), F.lit(0)), F.least(F.col("at") + length, F.col("size"))
    whole = anchors.join(twice, ["key", "context"]).select("row", low.alias("start"), high.alias("end"))
    several = materialize(counts.groupBy("key").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "several")
    standing = counts.join(several, "key").select("row", F.struct("key", "at", "contexts").alias("a"))
    if words is not None:
        known, apart = _met(found.filter("words"))
        standing = standing.unionByName(apart, allowMissingColumns=True)
    else:
        standing = standing.withColumn("w", F.lit(None).cast("struct<at:bigint,size:bigint,known:boolean>"))
    wanted = standing.groupBy("row")
    wanted = materialize(wanted.agg(F.collect_list("a").alias("anchors"), F.collect_set("w").alias("windows")), "places")
    packs = texts.select("row", packed("text").alias("data"))
    cuts = packs.join(wanted, "row").select("row", "data", "anchors", "windows").mapInArrow(_cut_out(length, words), _CUT)
    cuts = materialize(cuts, "cuts")
    narrow = cuts.filter("key is not null").select("row", "key", "at", "before", "after")
    narrow = narrow.groupBy("key").applyInArrow(_compare(length), "row bigint, start bigint, end bigint")
    blocks = cuts.filter("key is null and window is null").select("row", "at", "after", "low", "block").dropDuplicates(["row", "at", "block"])
    blocks = _marked(blocks, "block", "blocks")
    in_blocks = blocks.filter("twice").select("row", F.col("low").alias("start"), (F.col("low") + F.octet_length("after")).alias("end"))
    runs = blocks.filter("stands").select("row", "at", "after", "low").mapInArrow(_runs_of(length), _RUN)
    runs = materialize(runs.dropDuplicates(["row", "at", "core"]), "split")
    cores = materialize(runs.groupBy("core").count().filter("count > 1").select("core"), "cores")
    # a run without a cover gets a key that nothing else has, lest all of them meet in one task
    cover = F.coalesce("cover", F.xxhash64("row", "at", "core"))
    runs = _marked(materialize(runs.join(cores, "core").withColumn("cover", cover), "shared"), "cover", "runs")
    covered = runs.filter("twice").select("row", (F.col("at") - RUN + 1).alias("start"), (F.col("at") + length).alias("end"))
    ends = materialize(runs.filter("stands").select("row", "at", "core", "before", "after"), "ends")
    sizes = materialize(ends.groupBy("core").count(), "sizes")
    few = ends.join(sizes.filter(F.col("count").between(2, SORTED)), "core", "left_semi")
    core = length - RUN + 1
    free = length - core
    sorted_ends = few.groupBy("core").applyInArrow(_compare(free, core), "row bigint, start bigint, end bigint")
    many = ends.join(sizes.filter(F.col("count") > SORTED), "core", "left_semi")
    windows = many.select("row", "at", "core", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(free))).alias("n"))
    windows = windows.filter((F.octet_length("before") >= F.col("n")) & (F.octet_length("after") >= free - F.col("n")))
    near = [F.expr("substring(before, octet_length(before) - n + 1, n)").alias("left"), F.expr(f"substring(after, 1, {free} - n)").alias("right")]
    windows = windows.select("core", "n", *near, "row", (F.col("at") - F.col("n")).alias("start"))
    window = ["core", "n", "left", "right"]
    seen = windows.groupBy(*window).count().filter("count > 1").select(*window)
    counted = windows.join(seen, window).select("row", "start", (F.col("start") + length).alias("end"))
    wide = in_blocks.union(covered).union(sorted_ends).union(counted)
    spans = whole.union(narrow).union(wide)
    if words is None:
        return spans, None
    windows = cuts.filter("window is not null").select("row", "at", "window", "low")
    again = windows.groupBy("window").agg(F.min("row").alias("one"), F.max("row").alias("other")).filter("one <> other")
    again = windows.filter("low = 0").join(materialize(again.select("window"), "windows"), "window")
    return spans, known.union(again.groupBy("row").agg(F.size(F.collect_set("at")).cast("long").alias("n")))


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, out: str = "kept", spans: str = "removed", words: int | None = None, shared: str = "shared"
) -> DataFrame:
    """``docs`` with the remaining bytes (``out``) and the maximal removed runs (``spans``) in place of the text.

    With ``words``, ``shared`` is the number of the text's windows of that many words that another text holds too."""
    gone = (text, out, spans, *([shared] if words is not None else []))
    names = [F.col(c) for c in docs.columns if c not in gone]
    row = F.xxhash64(*names, text)
    found, windows = repeated_spans(docs.select(row.alias("row"), F.col(text).alias("text")), length, words)
    found = found.select("row", F.struct("start", "end").alias("f"))
    if words is not None:
        found = found.unionByName(windows, allowMissingColumns=True)
    n = F.coalesce(F.sum("n"), F.lit(0)) if words is not None else F.lit(0)
    found = materialize(found.groupBy("row").agg(F.collect_set("f").alias("found"), n.cast("long").alias("n")), "spans")

    @F.arrow_udf("struct<kept:binary,removed:array<struct<start:bigint,end:bigint>>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for data, found in batches:
            out = []
            for d, f in zip(unpacked(data), (x for piece in slices(found) for x in piece.to_pylist()), strict=True):
                runs: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in f or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                ends = [0, *(x for r in runs for x in r), len(d)]
                kept = b"".join(d[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if runs else d
                out.append({"kept": kept, "removed": [{"start": s, "end": e} for s, e in runs]})
            yield pa.array(out, kind)

    packs = docs.select(F.struct(*names).alias("doc"), row.alias("row"), packed(text).alias("data"))
    done = packs.join(found, "row", "left").select("doc", cut("data", "found").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    more = [F.col("n").alias(shared)] if words is not None else []
    return done.select("doc.*", F.col("c.kept").alias(out), F.col("c.removed").alias(spans), *more)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 400 bytes that occur elsewhere; beside it, without effect on what is
    removed, how many strings of over 50 words other documents hold too."""
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), words=WORDS)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return docs.select(
        "doc_id",
        (F.octet_length("kept") + n_removed).alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("shared").alias("n_shared_windows"),
    )
