import math
import random
import re
from collections import Counter

import pytest

from rainshed.llm import neardup
from rainshed.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, percent):
    """(id -> component) by all pairs; rows of one id are one node."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    places = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for j, n in Counter(m for x in s for m in places[x] if m < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
    return {i: find(i) for i in root}


def check(df, rows, percent):
    got = neardup.near_duplicates(df, percent=percent).collect()
    want = plain(rows, percent)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, c, i == c) for i, c in want.items()}
    return got


def test_query(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = check(documents, rows, 85)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert neardup.op3_near_duplicates(spark, sf_dir).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_group_of_near_copies_that_the_first_node_does_not_link(spark, monkeypatch):
    """Chains and stars around a node that is not the smallest; blocks of a few nodes."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(1, 5)):
            t[rng.randrange(200)] = f"e{rng.randint(0, 99999)}"
        texts.append(" ".join(t))
    for _ in range(25):  # a chain: every text a little further
        base[rng.randrange(200)] = f"c{rng.randint(0, 99999)}"
        base[rng.randrange(200)] = f"c{rng.randint(0, 99999)}"
        texts.append(" ".join(base))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(df, rows, 85)
    check(df, rows, 80)


def test_edge_rows(edge, none):
    got = neardup.near_duplicates(edge, percent=85).collect()
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    want = plain([r for r in rows if r[0] is not None], 85)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == (want[r.doc_id] if r.n_shingles else r.doc_id) and r.kept == (r.component_id == r.doc_id)
    # without an id: the component of a copy with one, else none
    assert sorted(((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None), key=str) == [(0, None, True), (1, None, True), (116, 5, False)]
    assert neardup.near_duplicates(none).count() == 0


def test_least_matches_bounds_the_posterior():
    for n, m in neardup.least_matches(85):
        tail = lambda k: sum(math.comb(n + 1, j) * 0.85**j * 0.15 ** (n + 1 - j) for j in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= neardup.MISS and (m == 0 or tail(m - 1) < neardup.MISS)


def test_shingles_of_long_texts_in_segments(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000)).encode()
    whole = neardup.shingles_of(text)
    monkeypatch.setattr(neardup, "SEGMENT", 37)
    assert (neardup.shingles_of(text) == whole).all() and len(whole) == len(shingles(text.decode()))


@pytest.mark.parametrize("edges", [[(1, 2)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(9)] + [(20, 21), (22, 21)], [(i, i + 20) for i in range(20)]])
def test_components(spark, edges):
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
