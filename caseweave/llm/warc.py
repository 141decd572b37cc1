"""WARC archives: writing with revisit records for repeated payloads, reading, and resolving the revisits."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.plans.scratch import Scratch, shared_dir

CRLF = "\r\n"
END = "\r\n\r\n"
SALTS = 32  # tasks that rows of one digest are dealt over


def payload_roles(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """(digest, payload_bytes, keeper) of the payloads of at least ``min_bytes`` that several pages share, from (page_id, digest, payload_bytes).

    Headers only are shuffled, combined before by digest; the keeper is the largest page_id.
    """
    shared = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
    return shared.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")


def _spread(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def record_text(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC record without its closing two line breaks: a response with an HTTP head, or a revisit without a block when ``refers_to`` is set."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    lines = lambda *c: F.concat_ws(CRLF, *c)
    common = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Record-ID: "), urn(page_id)), F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
    ]
    length = F.octet_length(head) + F.octet_length(payload)
    response = F.concat(
        lines(*common, F.lit("WARC-Type: response"), F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string"))),
        F.lit(END), head, payload,
    )
    revisit = F.concat(
        lines(*common, F.lit("WARC-Type: revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
              F.concat(F.lit("WARC-Refers-To: "), urn(refers_to)), F.lit("Content-Length: 0")),
        F.lit(END),
    )
    return F.when(refers_to.isNull(), response).otherwise(revisit)


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, file_bytes: int = 16 << 20) -> None:
    """Writes one record per page to gzipped WARC files of about ``file_bytes`` before compression, with Spark's own writer, so to any store that Spark reaches.

    Of equal payloads of at least ``min_bytes`` bytes the page with the largest id is the response and the others revisit it;
    rows that repeat that id are responses too. Null html is an empty payload, a null url an empty address, a null id an empty one.
    No rows give an archive without records. A file is one gzip member.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    scratch = Scratch(pages.sparkSession)
    heads = scratch.write(base.select("page_id", "digest", "payload_bytes"))
    roles = scratch.write(payload_roles(heads, min_bytes=min_bytes))
    # a payload that a third of all pages share is dealt over several tasks
    revisits = _spread(heads, "page_id").join(_repeated(roles).hint("shuffle_merge"), ["digest", "payload_bytes", "salt"]).where("page_id IS NULL OR page_id < keeper")
    page_key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_key")
    revisits = scratch.write(revisits.select(page_key, "digest", "keeper").distinct())
    files = max(1, -(-(heads.agg(F.sum("payload_bytes")).first()[0] or 0) // file_bytes))
    # the payloads are dealt once, into as many partitions as there are files
    dealt = base.withColumn("page_key", page_key).repartition(files, "page_key", "digest")
    out = dealt.join(revisits.hint("shuffle_merge"), ["page_key", "digest"], "left")
    record = record_text(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("keeper"))
    out = out.select(record.alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").text(path)
    scratch.drop(heads, roles, revisits)


RECORDS = "page_id long, url string, record_type string, digest string, refers_to long, payload binary, digest_ok boolean"
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)


def _sha1_hex(value: bytes | None) -> str | None:
    """A declared SHA-1 as lower-case hex, from hex or base 32; others as they stand."""
    if value is None:
        return None
    text = value.decode(errors="replace").strip()
    text = text[5:] if text.lower().startswith("sha1:") else text
    if len(text) == 32:
        try:
            return base64.b32decode(text.upper()).hex()
        except ValueError:
            return text
    return text.lower() if len(text) == 40 else text


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive file, by their declared lengths.

    Records of every type come, with null for what a header lacks: url, digest, or the ids of other writers' archives; digest_ok is null without a payload or a digest. Payload is what
    follows the HTTP header of a response. Bytes that are no gzip or no record end the file; what stood before is kept.
    """
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":  # one member a file or one a record
            unzip = zlib.decompressobj(31)
            try:
                parts.append(unzip.decompress(data))
            except zlib.error:
                break
            data = unzip.unused_data
        data = b"".join(parts)
    at = 0
    while (head := data.find(b"\r\n\r\n", at)) >= 0:
        field = {k.lower(): v for k, v in _FIELD.findall(data[at:head])}
        size = field.get(b"content-length", b"0").strip()
        length = int(size) if size.isdigit() else 0
        block = data[head + 4 : head + 4 + length]
        number = lambda v: int(m[1]) if v and (m := re.match(rb"<urn:page:(-?\d+)>", v)) else None
        text = lambda name: None if name not in field else field[name].decode(errors="replace")
        kind = text(b"warc-type")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        digest = _sha1_hex(field.get(b"warc-payload-digest"))
        yield {
            "page_id": number(field.get(b"warc-record-id")), "url": text(b"warc-target-uri"), "record_type": kind, "digest": digest,
            "refers_to": number(field.get(b"warc-refers-to")), "payload": payload, "digest_ok": None if payload is None or digest is None else hashlib.sha1(payload).hexdigest() == digest,
        }
        at = head + 4 + length + 4


def read_archive(spark, path: str) -> DataFrame:
    """One row per record of the archive files under ``path``: see ``RECORDS``. A revisit has no payload of its own."""

    def rows(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for record in parse_records(content.as_py()):
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits joined to the responses that they refer to: adds ``payload_bytes`` of the full payload.

    Only lengths move, matched by digest and id, so a payload shared by a third of all pages is looked up from one response row. A revisit whose response is not in the archive,
    or that names none, stays with a null ``payload_bytes``. Records with equal ids are responses each; of several responses with one id and digest the revisits take the longest. No records give no rows.
    """
    sized = records.select("page_id", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("own"))
    sized = Scratch(records.sparkSession).write(sized)
    revisits = sized.where("record_type = 'revisit'")
    asked = revisits.select("digest", "refers_to").distinct()
    responses = sized.where("record_type = 'response'").groupBy("digest", F.col("page_id").alias("refers_to")).agg(F.max("own").alias("full"))
    asked = Scratch(records.sparkSession).write(responses.join(asked.hint("shuffle_merge"), ["digest", "refers_to"]))
    revisits = _spread(revisits, "page_id").join(_repeated(asked).hint("shuffle_merge"), ["digest", "refers_to", "salt"], "left").drop("salt")
    both = sized.where("record_type = 'response'").withColumn("full", F.col("own")).unionByName(revisits)
    return both.select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve_revisits(read_archive(spark, path))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
  FROM pages)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < keeper THEN keeper END AS refers_to
FROM p
"""
