"""Main text of HTML pages: containers by tag, and page differencing with the nearest URL.

A page becomes a list of blocks. Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are told by tag, role and class and never give text. If the page has an article or main container, its blocks are
the content, otherwise all blocks are. Page differencing decides about every page: pages are put in the order of URL paths
within their host, the lines of a page and of its neighbours are aligned by longest common subsequence, and shared lines are
deleted. Outside articles (in main containers, on pages without a container) the nearest neighbour decides, the one with the
longer common path, else the former. Inside an article two neighbours may share a true paragraph, so a line goes only if all
of the ``NEAR`` pages before and after share it, ``LEAST`` pages at the least: the site's own lines are on every page. Pages
of equal content are copies, which share it rightly and tell nothing; in an article neither does a page that has more than
half of the article's characters (a near copy).

Neighbours are found by one sort of narrow rows (line hashes, no text) over all hosts, so a host of any size is spread over
tasks. A task walks through its pages in order; the pages at the edges of tasks, ``2 * NEAR`` a task, meet in a small table.

Edge cases: null and empty pages have empty text; null or odd URLs form a host of their own; repeated rows get the same
text; a page alone on its host keeps all its lines. Containers that are never closed end with the page.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table

NEAR = 3  # pages before and as many after that are asked about the lines of an article
LEAST = 3  # with fewer of them on the host an article keeps its lines
COPY_SHARE = 0.5  # a page with a larger share of an article's characters is a near copy
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# Element names and class words of HTML pages
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
DROPPED = set(
    "script style nav footer aside form noscript template iframe button select textarea svg canvas object menu dialog head title "
    "search datalist audio video math noembed noframes".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert alerts popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments disqus replies reply respond social share sharing related recommended recommendations pagination pager toolbar "
    "masthead topbar disclaimer".split()
)


def _attributes(text: str) -> dict[str, str]:
    return {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(text)}


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
    if hidden or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        last = parts[-1] in NOISE and parts[0] not in ("has", "no", "with")
        first = parts[0] in NOISE and parts[0] not in ("share", "related")
        if name in NOISE or last or first:
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, bool, int]]:
    """(text, is content, 2 inside an article, 1 inside another container, else 0) of each block that has text, in page order."""
    out: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, content, inside, header
    content, inside, header, met = True, 0, False, False
    at, size = 0, len(page)

    def close_block():
        if parts:
            if text := " ".join(htmllib.unescape("".join(parts)).split()):
                out.append((text, content and not header, inside))
            parts.clear()

    def pop_to(depth: int):
        nonlocal content, inside, header
        _, content, inside, header = stack[depth]
        del stack[depth:]

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if (text := m[0])[0] != "<" or text == "<":
                parts.append(text)
            continue
        tag = name.lower()
        if tag in BLOCK:
            close_block()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag not in BLOCK and any(s[0] in BLOCK for s in stack[depth:]):
                        close_block()
                    pop_to(depth)
                    break
            continue
        attributes = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in RAW:
            if not (m[3] or "").rstrip().endswith("/") or tag in ("script", "style"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if tag == "li":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ("ul", "ol", "menu"):
                    break
                if stack[depth][0] == "li":
                    pop_to(depth)
                    break
        article = tag == "article" or attributes.get("itemprop") == "articleBody"
        container = 2 if article else 1 if tag == "main" or attributes.get("role") == "main" else 0
        noise = tag in DROPPED or tag not in ("body", "html", "main") and _is_noise(tag, attributes) or tag == "header" and not inside
        if noise and tag not in BLOCK:
            close_block()
        stack.append((tag, content, inside, header))
        if container and not noise and not met:
            # the first container ends whatever was not closed before it
            content, inside, header, met = True, container, False, True
        elif noise:
            content = False
        elif container and content:
            inside = max(inside, container)
        elif tag == "header":
            header = True
        elif header and tag in HEADINGS:
            header = False
    close_block()
    return out


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - 2**63


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    places: dict[int, list[int]] = {}
    for j in range(len(b) - last - 1, first - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(first, len(a) - last):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    middle = []
    link = chains[-1] if chains else None
    while link:
        middle.append(link[0])
        link = link[1]
    return [*range(first), *middle[::-1], *range(len(a) - last, len(a))]


def _path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _shared_with_nearest(own: dict, near: list[dict]) -> list[int]:
    """Blocks of a page that its nearest neighbour of the same host has too. ``near``: before and after, where there are any."""

    def common_path(x: dict) -> int:
        n = 0
        for c, d in zip(own["path"], x["path"], strict=False):
            if c != d:
                break
            n += 1
        return n

    if not near:
        return []
    other = max(near, key=common_path)
    return [] if own["content"] == other["content"] else common_lines(own["lines"], other["lines"])


def _shared_by_all(own: dict, near: list[dict]) -> list[int]:
    """Blocks of a page's articles that all of its neighbours share in order, copies and near copies aside."""
    article = [own["lines"][n] for n in own["article"]]
    others = []
    for x in near:
        lines = set(x["lines"])
        same = sum(size for line, size in zip(article, own["sizes"], strict=True) if line in lines)
        if x["content"] != own["content"] and same <= COPY_SHARE * sum(own["sizes"]):
            others.append((x["lines"], lines))
    if len(others) < LEAST:
        return []
    met = set(article).intersection(*(lines for _, lines in others))
    left = [k for k, line in enumerate(article) if line in met]
    for lines, _ in others:
        left = [left[k] for k in common_lines([article[k] for k in left], [line for line in lines if line in met])] if left else left
    return [own["article"][k] for k in left]


def shared_blocks(own: dict, before: list[dict], after: list[dict]) -> list[int]:
    """Positions of the blocks to delete. ``before`` and ``after``: up to ``NEAR`` pages each, the nearest first."""
    same = lambda near: [x for x in near if x["host"] == own["host"]]
    before, after = same(before), same(after)
    inside = set(own["article"])
    drop = [n for n in _shared_with_nearest(own, before[:1] + after[:1]) if n not in inside] if own["open"] else []
    return sorted(drop + _shared_by_all(own, before + after)) if inside else drop


def content_of(found: list[tuple[str, bool, int]]) -> list[tuple[int, str, bool]]:
    """(position, text, is inside an article) of the content blocks of a page: those inside its containers if it has any."""
    inside = [(n, t, i == 2) for n, (t, c, i) in enumerate(found) if c and i]
    return inside or [(n, t, False) for n, (t, c, _) in enumerate(found) if c]


_PAGE = "host string, path string, open boolean, content bigint, lines array<bigint>, article array<int>, sizes array<int>"
_FIELDS = [
    ("host", pa.string()), ("path", pa.string()), ("open", pa.bool_()), ("content", pa.int64()), ("lines", pa.list_(pa.int64())),
    ("article", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
]
_KEYED = pa.schema([("k", pa.int64()), *_FIELDS])
_WALKED = pa.schema([("k", pa.int64()), ("shared", pa.list_(pa.int32())), ("task", pa.int32()), ("n", pa.int64()), ("asked", pa.bool_()), ("page", pa.struct(_FIELDS))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 256)):
        yield pa.RecordBatch.from_pylist(part, schema)


def _narrow(row: dict) -> dict:
    found = blocks_of(row.pop("html") or "")
    content = content_of(found)
    article = [(n, len(t)) for n, t, inside in content if inside]
    return row | {
        "open": len(article) < len(content), "content": line_hash("\n".join(x[1] for x in content)), "lines": [line_hash(x[0]) for x in found],
        "article": [n for n, _ in article], "sizes": [size for _, size in article],
    }


def _walk(rows: Iterator[dict]) -> Iterator[dict]:
    """The blocks to delete of a task's pages, in order; then the pages at its edges, of which the outer ones are undecided."""
    head, near, total = [], deque(maxlen=2 * NEAR + 1), 0
    for row in rows:
        near.append(row)
        total += 1
        if total <= 2 * NEAR:
            head.append(row)
        if len(near) == 2 * NEAR + 1:
            pages = list(near)
            yield {"k": pages[NEAR]["k"], "shared": shared_blocks(pages[NEAR], pages[NEAR - 1 :: -1], pages[NEAR + 1 :])}
    edges = dict(enumerate(head)) | dict(enumerate(near, total - len(near)))
    for n, row in sorted(edges.items()):
        yield {"k": row["k"], "task": row["task"], "n": n, "asked": n < NEAR or n >= total - NEAR, "page": row}


def shared_lines(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(k, shared): the positions of blocks to delete, for pages that have any."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(map(_narrow, _rows(batches)), _KEYED)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_walk(_rows(batches)), _WALKED)

    rows = pages.select("k", _host_of(F.col(url)).alias("host"), _path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rows = materialize(rows.mapInArrow(narrow, f"k bigint, {_PAGE}"), "lines").dropDuplicates(["k"])
    ordered = rows.repartitionByRange("host", "path", "k").sortWithinPartitions("host", "path", "k").withColumn("task", F.spark_partition_id())
    walked = ordered.mapInArrow(walk, f"k bigint, shared array<int>, task int, n bigint, asked boolean, page struct<{_PAGE.replace(' ', ':').replace(',:', ',')}>")
    walked = materialize(walked, "walked")
    # a few pages a task
    across = Window.orderBy("task", "n")
    step = lambda move: F.filter(F.array(*(move("page", d).over(across) for d in range(1, NEAR + 1))), lambda p: p.isNotNull())
    edges = walked.filter("page is not null").withColumns({"before": step(F.lag), "after": step(F.lead)})

    @F.arrow_udf("array<int>")
    def shared(own: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        rows = zip(own.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True)
        return pa.array([shared_blocks(*r) for r in rows], pa.list_(pa.int32()))

    edges = edges.filter("asked").select("k", shared("page", "before", "after").alias("shared"))
    return walked.filter("page is null").select("k", "shared").union(edges).filter(F.size("shared") > 0)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each in the column ``out``."""
    names = [c for c in pages.columns if c != out]
    keyed = pages.select(F.struct(*names).alias("page"), F.xxhash64(url, html).alias("k"), F.col(html).alias("html"))
    rows = pages.select(F.xxhash64(url, html).alias("k"), F.col(url).alias("url"), F.col(html).alias("html"))
    shared = materialize(shared_lines(rows, "url", "html"), "shared")

    @F.arrow_udf("array<struct<text:string,at:int>>")
    def content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())]))
        for batch in batches:
            parsed = []
            for piece in slices(batch):
                for page in piece.to_pylist():
                    parsed.append([{"text": t, "at": n} for n, t, _ in content_of(blocks_of(page or ""))])
            yield pa.array(parsed, kind)

    parsed = keyed.select("page", "k", content("html").alias("blocks")).join(shared, "k", "left")
    kept = F.filter("blocks", lambda b: F.col("shared").isNull() | ~F.array_contains("shared", b["at"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return parsed.select("page.*", text.alias(out))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
