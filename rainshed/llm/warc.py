"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Reader: the archives are cut into byte ranges, a task each. A task scans its range for the gzip magic, takes a candidate
for a member only if it inflates to a WARC header, and owns the records that start in its range; the last may end beyond
it. Within a range the end of a member is the place to look next. (An archive stored uncompressed inside a record could
show members of its own; nothing but reading from the start tells these apart.)

Writer: equal payloads of ``REVISIT_BYTES`` or more are stored once, by the record of the largest page id; the others are
revisits that refer to it. Every task writes archives under names of its own and lists them in a manifest, which Spark
commits; files of lost or repeated attempts are in no manifest and are not read.

Edge cases: a null payload is empty. Rows that repeat the largest id of a payload are responses each; if no row of a
payload has an id, all are responses. A null id gives a record whose id is a random UUID and comes back as null. Line ends
in a URL are escaped; a null URL leaves the target out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshed.session import scratch_path

from .common import materialize, slices, table

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 18
MAGIC = b"\x1f\x8b\x08"
# The profile of a revisit, and the prefix of our record ids
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
RECORD = (
    "archive string, offset bigint, record_type string, record_id string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of a WARC record, not compressed. ``digest`` is hexadecimal SHA-1."""
    name = lambda i: f"<{ID_PREFIX}{i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` under ``path``; the manifest (archive, bytes, records) comes back."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    first = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written, so that Spark can split the rows of a payload that many pages share
    first = materialize(first.select("digest", "first"), "payloads")
    rows = rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out, listed = None, []

        def close():
            out.close()
            listed[-1] = (*listed[-1][:2], size, records)

        for batch in batches:
            columns = [batch.column(c) for c in range(5)]
            for pieces in zip(*map(slices, columns), strict=True):
                for row in zip(*(p.to_pylist() for p in pieces), strict=True):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        listed.append((f"{path.rstrip('/')}/{name}", name, 0, 0))
                        out, size, records = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = pack.compress(_record(*row, date)) + pack.flush()
                    out.write(data)
                    size, records = size + len(data), records + 1
                    if size >= ARCHIVE_BYTES:
                        close()
                        out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in listed], pa.string()), pa.array([x[2] for x in listed], pa.int64()), pa.array([x[3] for x in listed], pa.int64())],
            names=["archive", "bytes", "records"],
        )

    return materialize(rows.mapInArrow(write, "archive string, bytes bigint, records bigint"), "manifest")


class _Window:
    """A file read forward; what lies before the current place is let go."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop_to(self, offset: int) -> None:
        if offset > self.start:
            self.data = self.data[offset - self.start :]
            self.start = offset


def _member(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """The record whose gzip member starts at ``offset`` and the member's end; None if there is no such member."""
    window.drop_to(offset)
    inflate, parts, size, checked = zlib.decompressobj(31), [], 0, False
    data = window.data
    end = window.start + len(data)
    while True:
        try:
            part = inflate.decompress(data)
        except zlib.error:
            return None
        parts.append(part)
        size += len(part)
        if not checked and (size >= 8 or inflate.eof):
            if not b"".join(parts).startswith(b"WARC/1."):
                return None
            checked = True
        if inflate.eof:
            return b"".join(parts), end - len(inflate.unused_data)
        if not window.more():
            return None
        data = window.data[end - window.start :]
        end = window.start + len(window.data)


def records_between(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that start in [start, end)."""
    window, at = _Window(file, start), start
    while at < end:
        window.drop_to(at)
        found = window.data.find(MAGIC)
        if found < 0:
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            if at >= end or not window.more():
                return
            continue
        at = window.start + found
        if at >= end:
            return
        member = _member(window, at)
        if member is None:
            at += 1
            continue
        yield at, member[0]
        at = member[1]


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("a record is shorter than its Content-Length")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(m[1]) if (m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)) else len(payload)
    scheme, _, digest = fields.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(digest).hex() if scheme == "sha1" else None
    if fields["warc-type"] == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
    refers_to = fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None
    return {
        "record_type": fields["warc-type"], "record_id": fields.get("warc-record-id", "").strip("<>"), "refers_to": refers_to,
        "target_uri": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size,
        "payload": None if fields["warc-type"] == "revisit" else payload,
    }


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives listed in ``manifest`` (archive, bytes), as in ``RECORD``. Each range is a task's."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = manifest.filter("bytes > 0").select("archive", F.explode(starts).alias("start"))
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / range_bytes)), F.lit(1))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
            ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for archive, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(archive)
                out = []
                with fs.open_input_file(name) as file:
                    for offset, record in records_between(file, start, start + range_bytes):
                        out.append({"archive": archive, "offset": offset, **parse_record(record)})
                        if len(out) == 256:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return ranges.repartition(int(min(n, 100_000)), "archive", "start").mapInArrow(read, RECORD)


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives in the shared folder and read back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    number = lambda c: F.when(F.startswith(c, F.lit(ID_PREFIX)), F.substring(c, len(ID_PREFIX) + 1, 100).cast("long"))
    payload = F.when(F.col("record_type") == "response", F.col("payload"))
    return read_archives(manifest).select(
        number(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length(payload).cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1(payload), "payload_digest").alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
