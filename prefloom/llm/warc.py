"""WARC archives: a writer of gzip members, and a splittable reader.

Writer: pages of equal payload (by SHA-1) are one group; the page with the smallest id is
written as ``response``, the others as ``revisit`` records that refer to it. Every task writes
its own files under a fresh name and reports them; only files of the manifest (a written
table) count, so a retried or speculative task leaves nothing that is read.

Reader: a file is cut into byte ranges. A task looks for gzip magic from its range's start,
validates a candidate by decoding its header (``WARC/1.``, a complete header block of the
stated length) and by what follows the member (the end of the file or another magic), and owns
every record that starts inside its range; the last may end beyond it. No index is needed.
Records of any type and writer are returned (gzip member a record); headers that are not there are null.
A payload is what follows the HTTP header as stored; transfer and content codings are not undone.

Archives are opened by path in the tasks: local or mounted paths directly, other schemes
through pyarrow's file systems.

Defined results: a null html is an empty payload; a null page id is carried as such, and is
a response only if no page of its group has an id; rows repeated under the smallest id are
all responses; payloads smaller than ``revisit_from`` bytes are always responses; an empty
table writes no file and reads as no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import lean, qualified, written
from prefloom.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 18


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@contextmanager
def _opened(path: str, mode: str):
    """A binary file by plain path, file: URI or any URI that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode) as f:
            yield f
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    if mode == "wb":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
    with (system.open_output_stream(inner) if mode == "wb" else system.open_input_file(inner)) as f:
        yield f


def _clean(value: str) -> str:
    """A header value without line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` under ``folder``; returns the manifest (path, bytes, records)."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # only payloads that occur again, written: the planner's size check broadcasts a small table, so that no
    # html moves; a join with a larger one can be split where a payload is hot
    first = src.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    first = written(first.filter("c > 1").drop("c"), "first-pages")
    folder = qualified(pages.sparkSession, folder)
    revisit = (F.octet_length("html") >= revisit_from) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = src.join(first, "sha", "left").select("id", "url", "html", "first", revisit.alias("revisit"))

    @lean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    for r in b.slice(at, 256).to_pylist():
                        payload = r["html"].encode()
                        yield record(r["id"], r["url"], payload, base32_sha1(payload), r["first"], r["revisit"])

        source, ended = records(), False
        ahead = next(source, None)
        while ahead is not None and not ended:
            path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with _opened(path, "wb") as f:
                while ahead is not None and size < file_bytes:
                    f.write(ahead)
                    size, n = size + len(ahead), n + 1
                    ahead = next(source, None)
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}], schema=manifest)

    manifest = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
    return written(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Bytes:
    """Forward reads of a file with a buffer."""

    def __init__(self, f):
        self.f, self.at, self.buf = f, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` (fewer only at the end of the file)."""
        if not (self.at <= at and at + n <= self.at + len(self.buf)):
            self.f.seek(at)
            self.at, self.buf = at, self.f.read(max(n, _CHUNK))
        return self.buf[at - self.at : at - self.at + n]


def _member(src: _Bytes, at: int) -> tuple[bytes, int] | None:
    """(decoded bytes, end) of the gzip member at ``at``; None if it is no WARC record."""
    unpack, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            chunk = src.get(pos, 1 << 14)
            if not chunk:
                return None
            parts.append(unpack.decompress(chunk))
            pos += len(chunk)
            if len(parts) == 1 and not b"WARC/1.".startswith(parts[0][:7]):
                return None
    except zlib.error:
        return None
    end = pos - len(unpack.unused_data)
    data = b"".join(parts)
    head, mark, rest = data.partition(b"\r\n\r\n")
    length = _whole(_headers(head).get("content-length"))
    if not (data.startswith(b"WARC/1.") and mark and length is not None and len(rest) == length + 4):
        return None
    follows = src.get(end, 3)
    return (data, end) if not follows or follows == MAGIC else None


def records_in(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of the records that start in [start, end)."""
    src, at, synced = _Bytes(f), start, False
    while at < end:
        if not synced:  # the next magic at or after `at`
            chunk = src.get(at, _CHUNK)
            hit = chunk.find(MAGIC)
            if hit < 0:
                if len(chunk) < _CHUNK:
                    return
                at += len(chunk) - 2
                continue
            at += hit
            if at >= end:
                return
        found = _member(src, at)
        if found is None:
            if synced:
                raise ValueError(f"no WARC record at byte {at}")
            at += 1
            continue
        yield at, found[0]
        at, synced = found[1], True
        if not src.get(at, 1):
            return


def _headers(block: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name: any space around the colon, folded lines joined."""
    lines: list[str] = []
    for x in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if x[:1] in (" ", "\t") and lines:
            lines[-1] += " " + x.strip()
        elif ":" in x:
            lines.append(x)
    return {k.strip(" \t").lower(): v.strip(" \t") for k, v in (x.split(":", 1) for x in reversed(lines))}


def _page(name: str | None) -> int | None:
    """The page id of a record id of this module's writer; null for any other."""
    own = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(own[1]) if own else None


def _whole(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def parse(data: bytes) -> dict:
    """Fields of a decoded record of any type; what its headers do not state is null."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = _headers(head)
    kind = h.get("warc-type")
    revisit = kind == "revisit"
    body = rest[: int(h["content-length"])]
    http = h.get("content-type", "").lower().startswith("application/http")
    payload = body.partition(b"\r\n\r\n")[2] if http else body
    stated = h.get("warc-payload-digest")
    return {
        "page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": kind,
        "payload": None if revisit else payload,
        "payload_bytes": _whole(h.get("x-payload-length")) if revisit else len(payload),
        # as stated in a revisit (without the name of SHA-1), computed from any other payload
        "payload_digest": (re.sub(r"(?i)^sha1:", "", stated) if stated else None) if revisit else base32_sha1(payload),
        "refers_to": _page(h.get("warc-refers-to")) if revisit else None,
        "record_id": h.get("warc-record-id"), "refers_to_id": h.get("warc-refers-to"),
    }


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of ``files`` (path, bytes): page_id, url, record_type, payload (null in a
    revisit), payload_bytes, payload_digest, refers_to, path, offset, record_id, refers_to_id.
    ``page_id`` and ``refers_to`` are null but for ids of this module's writer; the ids as
    written are ``record_id`` and ``refers_to_id``."""
    ranges = files.filter(F.col("bytes") > 0).select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least("bytes", F.col("start") + split_bytes)).drop("bytes")
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0]
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
              ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()),
              ("record_id", pa.string()), ("refers_to_id", pa.string())]
    schema = pa.schema([x for x in fields if payload or x[0] != "payload"])

    @lean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, size = [], 0
                with _opened(r["path"], "rb") as f:
                    for offset, data in records_in(f, r["start"], r["end"]):
                        rows.append(parse(data) | {"path": r["path"], "offset": offset})
                        size += len(data) if payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "page_id long, url string, record_type string, " + "payload binary, " * payload + "payload_bytes long, payload_digest string, refers_to long, path string, offset long, record_id string, refers_to_id string"
    return ranges.repartition(int(max(1, n or 0))).mapInArrow(run, ddl)


def query(pages: DataFrame) -> DataFrame:
    """op9: write all ``pages``, read the archives back."""
    files = write_warc(pages, scratch_path(pages.sparkSession, "warc"))
    return read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
five AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, s DESC) AS d
         FROM (SELECT h, g, CAST('0x' || substr(h, 1 + 5 * g, 5) AS INTEGER) AS v FROM f, range(0, 8) t(g)), (VALUES (15), (10), (5), (0)) x(s) GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h) JOIN five USING (h)
"""
