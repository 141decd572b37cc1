"""Archives of other writers."""

import base64
import gzip
import hashlib

from caseweave.llm.warc import parse_records, read_archive, resolve_revisits


def record(kind, block, **fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"Content-Length: " + str(len(block)).encode()] + [k.replace("_", "-").encode() + b": " + v for k, v in fields.items()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive():
    page = b"<p>caf\xc3\xa9</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    sha = base64.b32encode(hashlib.sha1(page).digest())
    parts = [
        record(b"warcinfo", b"software: x\r\n"), record(b"request", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI=b"http://a/"), record(b"response", http, WARC_Target_URI=b"http://a/", WARC_Payload_Digest=b"sha1:" + sha, WARC_Record_ID=b"<urn:uuid:1>"),
        record(b"response", http, WARC_Target_URI=b"http://b/"), record(b"revisit", b"", WARC_Payload_Digest=b"sha1:" + sha, WARC_Record_ID=b"<urn:page:9>"), record(b"metadata", b"k: v"),
    ]
    return page, parts


def test_records_without_digest_or_address():
    page, parts = archive()
    for data in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts)) + b"\x1f\x8bbroken"):
        got = list(parse_records(data))
        assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "revisit", "metadata"]
        assert [r["url"] for r in got] == [None, "http://a/", "http://a/", "http://b/", None, None]
        assert [r["digest_ok"] for r in got] == [None, None, True, None, None, None]
        assert [r["payload"] for r in got] == [None, None, page, page, None, None] and [r["page_id"] for r in got] == [None, None, None, None, 9, None]
    assert list(parse_records(b"")) == [] and list(parse_records(b"\x1f\x8b\x00")) == []


def test_foreign_archives_are_read(spark, tmp_path):
    (tmp_path / "part-0.warc").write_bytes(archive()[1][0] + b"".join(archive()[1]))
    records = read_archive(spark, str(tmp_path))
    assert records.count() == 7
    assert sorted(r.record_type for r in resolve_revisits(records).collect()) == ["response", "response", "revisit"]
