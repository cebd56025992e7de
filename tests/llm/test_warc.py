import gzip
import hashlib
import io

import pytest

from rainshed.llm import warc
from rainshed.session import scratch_path

PAGES = "page_id bigint, url string, html string, digest string, first int, payload string"


def want(rows):
    """By the contract: of equal payloads of 1000 bytes or more the largest id is the response."""
    first = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        if len(b) >= warc.REVISIT_BYTES and i is not None:
            first[b] = max(first.get(b, i), i)
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        to = first.get(b)
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(records):
    number = lambda s: int(s.removeprefix(warc.ID_PREFIX)) if s and s.startswith(warc.ID_PREFIX) else None
    return sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in records), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    long, two = "é" * 700, "z" * 999
    rows = [(1, "http://a/1", long), (2, None, long), (3, "x\r\ny", long), (4, "u", two), (5, "u", two), (6, "u", None), (7, "u", ""), (None, "n", long), (8, "big", "<p>" + "q1" * 400_000)]
    rows += [(3, "x\r\ny", long), (None, None, "w" * 2000), (None, None, "w" * 2000)]
    return spark.createDataFrame([(*r, "d", 1, "p") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("size", [97, 5000, 8 << 20])
def test_round_trip_by_ranges(spark, pages, size):
    manifest = warc.write_archives(pages, scratch_path(spark, "warc"))
    records = warc.read_archives(manifest, size).collect()
    assert got(records) == want(pages.collect())
    by_id = {r.record_id: r for r in records}
    assert by_id["urn:page:3"].target_uri == "x%0D%0Ay" and by_id["urn:page:2"].target_uri is None
    assert bytes(by_id["urn:page:8"].payload).decode() == "<p>" + "q1" * 400_000


def test_every_record_is_a_gzip_member_of_its_own(spark, pages):
    manifest = warc.write_archives(pages, scratch_path(spark, "warc")).filter("records > 0").collect()
    assert sum(r.records for r in manifest) == pages.count()
    for r in manifest:
        path = r.archive.removeprefix("file://")
        data = open(path, "rb").read()
        assert len(data) == r.bytes and gzip.decompress(data).count(b"WARC-Record-ID") == r.records
        assert len(list(warc.records_between(io.BytesIO(data), 0, len(data)))) == r.records


def test_false_magic_is_passed_over():
    record = warc._record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2020-01-01T00:00:00Z")
    noise = b"\x1f\x8b\x08 no member" + gzip.compress(b"not an archive, but a member") + b"\x1f\x8b"
    data = noise + gzip.compress(record) + noise + gzip.compress(record) + b"\x1f\x8b\x08"
    found = [(o, r) for a in range(0, len(data), 7) for o, r in warc.records_between(io.BytesIO(data), a, a + 7)]
    assert [r for _, r in found] == [record] * 2


def test_wrong_digest_and_short_record_are_errors():
    record = warc._record(1, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None, "d")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record)
    with pytest.raises(ValueError, match="shorter"):
        warc.parse_record(record[:-10])


def test_no_pages(spark):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), scratch_path(spark, "warc"))
    assert warc.read_archives(manifest).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op1_warc_roundtrip(spark, sf_dir).collect()), key=str) == want(rows)
