"""Archives written and read back; ranges against a serial reading."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from prefloom.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://x/{i}", rnd.choice(["", None, "same page", f"<p>{i}</p>" * rnd.randint(1, 900), "é\r\n\r\nü\x00"])) for i in range(120)]
    rows += [(5, "u", "same page"), (5, "u", "same page"), (None, None, "same page"), (None, "bad\r\nurl: x", "alone"), (300, "u", "q" * 300_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", __import__("pyspark").sql.functions.lit(1))


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = len(b) >= least and f is not None and i != f
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_query(pages):
    rows, df = pages
    assert sorted((tuple(r) for r in warc.query(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("split", [100, 1000, 7777, 1 << 20])
def test_any_split(pages, tmp_path, split):
    rows, df = pages
    files = warc.write_warc(df, str(tmp_path / "a"), revisit_from=5, file_bytes=20_000)
    assert files.count() > 1 and sum(r["records"] for r in files.collect()) == len(rows)
    back = warc.read_warc(files, split_bytes=split).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str)
    assert got == brute(rows, 5)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in back)
    assert len({(r["path"], r["offset"]) for r in back}) == len(rows)


def test_gzip_inside_a_payload_is_no_record(tmp_path):
    """Stored blocks that hold whole archives: only outer members are records."""
    inner = warc.record(9, "u", b"inner", warc.base32_sha1(b"inner"), None, False)
    outer = []
    for k in range(6):
        raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(inner * 2) + inner + inner + b"\r\n\r\n"
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        outer.append(c.compress(raw) + c.flush())
    data = b"".join(outer)
    starts, at = [], 0
    for x in outer:
        starts.append(at)
        at += len(x)
    assert [o for o, _ in warc.records_in(io.BytesIO(data), 0, len(data))] == starts
    assert gzip.decompress(outer[0]).startswith(b"WARC/")


def test_broken_file():
    good = warc.record(1, "u", b"x" * 100, "D", None, False)
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(good + good[:-3] + b"???" + good), 0, 10_000))


def test_empty(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_an_archive_of_another_writer(spark, tmp_path):
    """warcinfo without a target, request, uuid ids, other header spacing, a revisit without lengths."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [
        (b"warc-type:warcinfo\r\nWARC-Record-ID:<urn:uuid:0>\r\nContent-Type: application/warc-fields", b"software: x\r\n\r\nformat: WARC\r\n"),
        (b"WARC-Type:  request\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nContent-Type:application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
        (b"WARC-Type: response\r\nWARC-Record-ID:\t<urn:uuid:2>\r\nWARC-Target-URI: http://x/?a:b\r\nContent-Type: application/http;\r\n msgtype=response", http + b"<p>one</p>"),
        (b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:2>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:ABC", http),
        (b"WARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:4>", b""),
        (b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5>", b""),
    ]
    data = b"".join(gzip.compress(b"WARC/1.0\r\n" + head + b"\r\nContent-Length :%d\r\n\r\n" % len(body) + body + b"\r\n\r\n") for head, body in records)
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "path string, bytes long")
    for split in (150, 1 << 20):
        got = {r["record_id"]: r for r in warc.read_warc(files, split_bytes=split).collect()}
        assert [got[f"<urn:uuid:{i}>"]["record_type"] for i in range(6)] == ["warcinfo", "request", "response", "revisit", "metadata", "revisit"]
        assert [got[f"<urn:uuid:{i}>"]["url"] for i in range(4)] == [None, "http://x/", "http://x/?a:b", None]
        assert [got[f"<urn:uuid:{i}>"]["payload"] for i in range(6)] == [records[0][1], b"", b"<p>one</p>", None, b"", None]
        assert (got["<urn:uuid:3>"]["refers_to_id"], got["<urn:uuid:3>"]["payload_digest"], got["<urn:uuid:3>"]["payload_bytes"]) == ("<urn:uuid:2>", "ABC", None)
        assert got["<urn:uuid:5>"]["payload_digest"] is None and all(r["page_id"] is None and r["refers_to"] is None for r in got.values())
