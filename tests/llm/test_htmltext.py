import itertools
import random
import re

import pytest

from rainshed.llm import htmltext as h


def text_of(page):
    kept = [b for b in h.blocks_of(page) if b[1]]
    return " ".join(b[0] for b in ([b for b in kept if b[2]] or kept))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<", "<"),
        ("a < b &lt; c &amp;amp; &#233;", "a < b < c &amp; é"),
        ("<p>one\n two<p>three<br>four<b>five</b>", "one two three fourfive"),
        ('<div class="ad">open<article><p>yes</article><p>no', "yes"),
        ("<header><h1>Site</h1></header><main><header><h1>Title</h1><p>by</header><p>x<footer>f</footer></main>", "Title x"),
        ('<article>a<div class="comments"><article>c</article></div><aside>s</aside><form>f</form>b</article>', "a b"),
        ("<article>a<script>if (1 < 2) {x = '</p>'}</script><style>p{}</style><!-- <p>c --> b</article>", "a b"),
        ("<article>a</article><nav>n</nav><article>b</article>", "a b"),
        ("<ul class=menu><li>a<li>b</ul><p>text</p>", "text"),
        ('<body class="has-sidebar"><p>t<div id="cookie-notice">c</div><p hidden>h<p style="display: none">d', "t"),
        ('<p title="a > b">x</p><a href=\'q"\'>y</a>', "x y"),
        ("<article><p>never closed <b>bold", "never closed bold"),
        ("<title>t</title><textarea>x</textarea>body", "body"),
        ('<div role="navigation">n</div><div itemprop="articleBody">m</div>z', "m"),
    ],
)
def test_blocks(page, text):
    assert text_of(page) == text


def test_any_input_is_parsed():
    rng = random.Random(2)
    bits = ["<", ">", "<p>", "</p>", "<div class='ad'", '"', "'", "<!--", "-->", "<script>", "</script", "x", "&", "&lt", "<li>", "</article>", "<article>", "<!", "</"]
    for _ in range(800):
        h.blocks_of("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))))
    h.blocks_of("<div>" * 20_000 + "deep")


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = h.common_lines(a, b)
        assert got == sorted(set(got))
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in got))
        best = next(n for n in range(min(len(a), len(b)), -1, -1) if set(itertools.combinations(a, n)) & set(itertools.combinations(b, n)))
        assert len(got) == best


def plain(rows):
    """Each page against its neighbours in the sorted list of all pages of the host, one by one."""
    split = lambda u: (m[1].lower(), m[2]) if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", u or "")) else ("", "")
    pages = sorted({(*split(u), u, p) for _, u, p in rows}, key=lambda x: (x[0], x[1], str(x[2]), str(x[3])))
    out = {}
    for n, (host, path, url, page) in enumerate(pages):
        own = h.blocks_of(page or "")
        lines = [b[0] for b in own]
        content = h.content_of(own)
        near = [(len([1 for c, d in itertools.takewhile(lambda z: z[0] == z[1], zip(path, q[1], strict=False))]), -k, q) for k, q in ((0, pages[n - 1] if n else None), (1, pages[n + 1] if n + 1 < len(pages) else None)) if q and q[0] == host]
        drop = set()
        if near:
            other = h.blocks_of(max(near)[2][3] or "")
            if [c[1] for c in h.content_of(other)] != [c[1] for c in content]:
                drop = set(h.common_lines(lines, [b[0] for b in other])) - {c[0] for c in content if c[2]}
        article = [(k, t) for k, t, inside in content if inside]
        asked = []
        for q in pages[max(n - h.NEAR, 0) : n] + pages[n + 1 : n + 1 + h.NEAR]:
            other = h.blocks_of(q[3] or "")
            texts = [b[0] for b in other]
            mine = sum(len(t) for _, t in article if t in texts)
            if q[0] == host and [c[1] for c in h.content_of(other)] != [c[1] for c in content] and 2 * mine <= sum(len(t) for _, t in article):
                asked.append(texts)
        if len(asked) >= h.LEAST:
            left = [(k, t) for k, t in article if all(t in texts for texts in asked)]
            for texts in asked:
                left = [left[k] for k in h.common_lines([t for _, t in left], texts)]
            drop |= {k for k, _ in left}
        out[url, page] = " ".join(t for k, t, _ in content if k not in drop)
    return out


def test_differencing(spark):
    """Paths differ on each host, so that the order of pages is fixed."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        body = "".join(f"<p>{rng.choice(['about us', 'all rights', 'line ' + str(rng.randint(0, 30)), f'own {i}'])}</p>" for _ in range(rng.randint(0, 8)))
        rows.append((i, f"http://{rng.choice(['one', 'two'])}.org/{i % 7}/{i}", f"<p>welcome</p>{body}<p>bye</p>" + ("<article>A</article>" if i % 5 == 0 else "")))
    for i in range(60):
        # a line once a page: of several longest common subsequences any one is right
        lines = "".join(f"<p>{x}</p>" for x in rng.sample(["say it", "hear it", "part 1", "part 2", f"a long line of page {i}, own"], 4))
        rows.append((200 + i, f"http://three.org/{i}", f"<nav>n</nav><article><p>join us</p>{lines}<p>what page {i} says of its matter</p></article>"))
    rows += [(500, "http://alone.org/", "<p>x</p>"), (501, "http://copy.org/1", "<p>x</p><p>y</p>"), (502, "http://copy.org/2", "<p>x</p><p>y</p>"), (503, None, None), rows[3], rows[3], (None, "odd", "<p>z")]
    df = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], "page_id bigint, url string, html string, text string, host string, k int").repartition(4)
    want = plain(rows)
    got = h.main_text(df).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.url, r.html] for r in got)
    assert h.main_text(df.limit(0)).count() == 0


def texts(spark, pages, parts=3):
    df = spark.createDataFrame(pages, "url string, html string").repartition(parts)
    return {r.url: r.text for r in h.main_text(df).collect()}


def test_lines_shared_inside_a_main_container_go(spark):
    site = "<main><p>Read more on our site</p><p>{}</p><p>Tell a friend</p></main>"
    got = texts(spark, [(f"http://a.org/{i}", site.format(f"story {i}")) for i in range(9)])
    assert got == {f"http://a.org/{i}": f"story {i}" for i in range(9)}


def test_template_heavy_pages_are_no_copies(spark):
    template = "".join(f"<p>template {k}</p>" for k in range(34))
    got = texts(spark, [(f"http://a.org/{i}", f"{template}<p>own {i}</p><p>more {i}</p>") for i in range(9)])
    assert got == {f"http://a.org/{i}": f"own {i} more {i}" for i in range(9)}


def test_lines_that_all_pages_share_leave_articles(spark):
    site = "<article><p>Read it on our site</p><p>{}</p><p>Tell a friend</p></article>"
    story = lambda i: f"The story of number {i} is told here at some length, as it was"
    want = {f"http://a.org/{i:03}": story(i) for i in range(200)}
    for parts in (1, 7):
        assert texts(spark, [(u, site.format(t)) for u, t in want.items()], parts) == want


def test_lines_that_some_pages_share_stay_in_articles(spark):
    """Two neighbours with one paragraph, near copies, and hosts of few pages."""
    page = lambda *lines: f"<article>{''.join(f'<p>{x}</p>' for x in lines)}</article>"
    own = lambda i: f"own line {i} " + "word " * i
    rows = [(f"http://a.org/{i}", [own(i), "a passage of two", own(i + 20)] if i in (3, 4) else [own(i)]) for i in range(9)]
    rows += [(f"http://copies.org/{i}", ["one long paragraph that all versions have", f"v {i}"]) for i in range(9)]
    rows += [(f"http://few.org/{i}", ["site", own(i)]) for i in range(3)]
    got = texts(spark, [(u, page(*lines)) for u, lines in rows])
    assert got == {u: " ".join(" ".join(lines).split()) for u, lines in rows}


def test_walk_decides_every_page_once(monkeypatch):
    """Whatever the cut into tasks, pages meet their own neighbours."""
    monkeypatch.setattr(h, "shared_blocks", lambda own, before, after: (own["k"], [x["k"] for x in before], [x["k"] for x in after]))
    for total in range(20):
        out = list(h._walk({"k": k, "task": 0} for k in range(total)))
        done = [x["shared"] for x in out if "shared" in x]
        edges = [x for x in out if "page" in x]
        assert sorted([x[0] for x in done] + [x["k"] for x in edges if x["asked"]]) == list(range(total))
        assert all(b == [k - 1, k - 2, k - 3] and a == [k + 1, k + 2, k + 3] for k, b, a in done)
        ks = [x["k"] for x in edges]
        assert ks == [x["n"] for x in edges]
        for x in edges:  # the neighbours of undecided pages are edges too
            if x["asked"]:
                assert set(range(max(x["n"] - 3, 0), min(x["n"] + 4, total))) <= set(ks)


def test_query(spark, sf_dir):
    rows = h.op4_main_text(spark, sf_dir).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)
        assert r.n_chars == len(r.text) and (not inner or r.text == " ".join(h.htmllib.unescape(re.sub(r"<(?:p|br|/p|h1|/h1)>", " ", inner[1]).replace("<b>", "").replace("</b>", "")).split()))
