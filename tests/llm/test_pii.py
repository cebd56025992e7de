import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rainshed.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def found(df):
    return df.select("doc_id", pii.listed("base").alias("base"), pii.listed("finds").alias("finds")).collect()


def test_base_finds_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["1", "2", ".", "@", "a", "-", "+", " ", "4111111111111111", "é", "😀", "_", "(", "255", "b.c", "\n", "192.168.0.1", "+1 (555) 010-9999", "0000001"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))) for i in range(800)]
    rows += [(9001, "1" * 20_000), (9002, "a@" + "b.c" * 3000), (9003, "1." * 6000), (9004, "-" * 20_000 + "@"), (9005, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1")]
    got = found(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")))
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.base == ",".join(plain(want[r.doc_id])), want[r.doc_id][:200]
        assert set(filter(None, r.base.split(","))) <= set(r.finds.split(","))


@pytest.fixture(scope="module")
def contexts(spark):
    rows = [(i, f"please write my mailbox is user{i}@host{i}.org now and then") for i in range(30)]
    rows += [(100, "please write my mailbox is secret77@localhost today"), (101, "My  mailbox\nis x@y, +1 555 010 9999"), (102, "nothing here 12345678 x@y"), (103, "my mailbox is 5550109999")]
    # a context of seeds and as many other things teaches nothing
    rows += [(200 + i, f"the number is {f'10.0.0.{i}' if i % 2 else f'77{i}.88{i}.99'} ok") for i in range(40)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, row string, base string")


def test_contexts_find_what_patterns_do_not(contexts):
    extra = {r.doc_id: r.finds for r in found(pii.find(contexts)) if r.finds != r.base}
    assert extra == {100: "email:27:45", 101: "email:15:18,phone:20:35"}


def test_patterns_without_seeds_learn_from_shared_values(spark):
    rows = [f"my mailbox is user{i}@host{i}.org now" for i in range(400)]
    rows += [f"{where} user{i}@localhost now" for i in range(40) for where in ("my mailbox is", "the internal login")]
    rows += ["the internal login unseen1@localhost now", "the internal login unseen2@localhost now"]
    # as many shared values do not make a pattern of other things confident
    rows += [f"some other thing user{i}@localhost now" for i in range(10)] + [f"some other thing no{i}@where now" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id for r in found(pii.find(df)) if r.finds != r.base}
    assert got == set(range(400, 482))


def test_rounds_go_on_until_nothing_rises(spark):
    """A chain of patterns; each shares its values with the one before and after it."""
    edges = [("p0", f"seed{i}", "email") for i in range(400)]
    for k in range(4):
        edges += [(p, f"v{k}-{i}", None) for i in range(10) for p in (f"p{k}", f"p{k + 1}")]
    got = {r.pattern: r.confidence for r in pii._score(spark.createDataFrame(edges, "pattern string, value string, seed string")).collect()}
    values = {}
    for p, v, _ in edges:
        values.setdefault(p, set()).add(v)
    score = lambda sums: {p: sums[p] / (len(values[p]) + pii.PRIOR) for p in values}
    firm = {p: 400.0 if p == "p0" else 0.0 for p in values}
    want, rise = score(firm), 1.0
    while rise > pii.SETTLED:
        sums, was = dict(firm), want
        for p, v, seed in edges:
            if not seed:
                sums[p] += 1 - math.prod(1 - min(was[q], 0.999) for q in values if q != p and v in values[q])
        want = score(sums)
        rise = max(want[p] - was[p] for p in values)
    assert got == pytest.approx(want) and all(want.values())  # three rounds would not reach the end of the chain


def test_patterns_reach_back_at_any_distance(spark):
    far = "w" * 300 + " " * 200 + "is:" + "\n" * 100
    rows = [f"{far}user{i}@host{i}.org" for i in range(30)] + [f"x {far}hidden9@localhost"]
    got = {r.doc_id: r.finds for r in found(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"))) if r.finds != r.base}
    assert got == {30: f"email:{2 + len(far)}:{2 + len(far) + 17}"}


def test_contexts_equal_plain_ones(spark):
    """Patterns of finds within and over the borders of parts."""
    rng = random.Random(8)
    bits = ["a@b.c", "mail", " ", "  ", "\n", "é9", "d@e.fg,", "X", "w" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in (1, 5, 40, 300, 3000)]
    df = pii.base_finds(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for r in df.collect():
        text = texts[r.doc_id]
        assert len(r.base) == len([x for x in plain(text) if x])
        for m in r.base:
            words = re.search(r"(?<!\S)(\S+)[ \n]+(\S+)[ \n]+$", text[: m.start])
            want = re.sub("[0-9]", "#", f"{words[1][-64:]} {words[2][-64:]}".lower()) if words else None
            assert (m.value, m.pattern) == (text[m.start : m.end], want)


def test_texts_with_very_many_finds(spark):
    """Many parts; of the second text all finds are in one word."""
    n = 20_000
    dense = "".join(f"u{i}@h.org," for i in range(n))
    df = spark.createDataFrame([(1, "".join(f"mail u{i}@h.org or x{i}@y " for i in range(n))), (2, dense)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in df.transform(pii.find).select("doc_id", F.size("base").alias("n"), F.size("finds").alias("all")).collect()}
    text = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert rows[1].n == rows[2].n == n and text[2] == "[EMAIL]," * n and text[1].count("[EMAIL]") == rows[1].all


def test_mask(contexts):
    got = {r.doc_id: r for r in pii.masked(contexts).collect()}
    assert len(got) == contexts.count() and pii.masked(contexts).columns == contexts.columns
    assert got[0].text == "please write my mailbox is [EMAIL] now and then" and got[0].row == "x"
    assert got[101].text == "My  mailbox\nis [EMAIL], [PHONE]" and got[102].text == "nothing here 12345678 x@y"


def test_overlaps_are_masked_once(spark):
    df = spark.createDataFrame([(1, "card +4111 1111 1111 1111 end"), (2, "x +1 192.168.10.10 y")], "doc_id bigint, text string")
    assert [r.text for r in pii.masked(df).orderBy("doc_id").collect()] == ["card +[CARD] end", "x [PHONE] y"]
    for r in pii.masked(df).collect():
        assert not re.search(r"\d{4}", r.text)


def test_edge_rows(edge, none):
    got = found(pii.find(edge))
    assert len(got) == edge.count() and all(r.base == "" for r in got)
    assert sorted(map(str, pii.masked(edge).collect())) == sorted(map(str, edge.collect()))
    assert pii.find(none).count() == 0 and pii.masked(none).count() == 0


def test_query_and_plan(spark, sf_dir, documents):
    df = pii.op6_personal_data(spark, sf_dir)
    got = {r.doc_id: r for r in df.collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        base = plain(r.text)
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
        assert g.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(g.spans.split(","))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
