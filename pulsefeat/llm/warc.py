"""Converter from legacy ARC archives to WARC, and a reader of the result.

An ARC file begins with a ``filedesc:`` record whose body names the version (1 or 2) and the fields of
the header lines that follow. Every record is a header line, as many bytes as it declares, and a
newline. Each becomes a WARC record: identifier and timestamp are synthesised from the header line,
the type from the content, the digests from block and payload. Of records with equal payloads of at
least ``SMALLEST`` bytes, the one of smallest page id stays a response and the others become revisits
that refer to it.

A WARC file has a gzip member for each record, so that readers can seek, begins with a ``warcinfo``
record and holds about ``ARCHIVE_BYTES`` of members. A file is one row to Spark's text writer. It ends
with an empty member, whose last byte, always zero, is the writer's line separator. Files are read back
as binary files, record by record, by declared lengths.

Defined edge cases
  * null html counts as empty: a response with an empty payload
  * a null or blank URL is written as ``urn:unknown``; white space in a URL as percent escapes
  * a null page_id is read back as null; such records rank behind others of equal payload
  * repeated rows become records of their own with the same identifier
  * an ARC file may be gzipped; a block that ends before its declared length is kept as it is and
    marked ``WARC-Truncated``; a header line cut short is an error
  * an empty table gives no archives and an empty result; extra columns are not read
"""

from __future__ import annotations

import hashlib
import io
import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.llm.storage import bounded_broadcast, cut, new_path, small_batches

#: Header fields of ARC versions 1 and 2.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SMALLEST = 100
ARCHIVE_BYTES = 4 << 20
#: Representatives of repeated payloads are broadcast up to this count (about 150 bytes each).
MAX_BROADCAST_PAYLOADS = 100_000
RECORD = "page_id long, record_id string, uri string, date string, ip string, mime string, head binary, payload binary, digest string, truncated boolean"


def http_message(page_id: int | None, payload: bytes) -> bytes:
    number = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + number + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def arc_header(version: int, url: str, date: str, mime: str, name: str, offset: int, block: bytes) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


def arc_archives(pages: DataFrame) -> DataFrame:
    """``name, content``: the pages as ARC files of about ARCHIVE_BYTES, of version 1 and 2 in turn. A
    page's fetch date is 2024-01-01 plus its page_id in seconds."""

    def run(batches):
        task, number, out = TaskContext.get().partitionId(), 0, None

        def begin():
            version, name = 1 + number % 2, f"pages-{task:06d}-{number:06d}.arc"
            body = f"{version} 0 pulsefeat\n{' '.join(FIELDS[version])}\n".encode()
            start = io.BytesIO()
            start.write(arc_header(version, f"filedesc://{name}", "20240101000000", "text/plain", name, 0, body) + body + b"\n")
            return start, version, name

        for batch in batches:
            for page_id, url, date, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "date", "html"))):
                if out is None:
                    out, version, name = begin()
                url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "urn:unknown"
                block = http_message(page_id, (html or "").encode("utf-8", "surrogatepass"))
                out.write(arc_header(version, url, date, "text/html", name, out.tell(), block) + block + b"\n")
                if out.tell() >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])
                    out, number = None, number + 1
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary())], names=["name", "content"])

    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyyMMddHHmmss")
    return pages.select(F.col("page_id").cast("long"), "url", date.alias("date"), "html").mapInArrow(run, "name string, content binary")


def parse_arc(content: bytes) -> Iterator[dict]:
    """Header fields, ``block`` and ``truncated`` (the block ends before its declared length) of each
    record but the first, which says what the fields are."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    fields: list[str] | None = None
    at = 0
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line cut short: {content[at : at + 80]!r}")
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line.strip():
            at = end + 1
            continue
        names = fields or FIELDS[1]
        values = line.rsplit(" ", len(names) - 1)
        if fields is None and len(values) == len(names) - 1 + 1 and not values[-1].isdigit():
            raise ValueError(f"no ARC header line: {line[:80]}")
        record = dict(zip(names, values))
        size = int(record["Archive-length"])
        block = content[end + 1 : end + 1 + size]
        at = end + 1 + size
        if fields is None:
            version, _, rest = block.decode().partition("\n")
            declared = rest.split("\n")[0].split()
            fields = declared or FIELDS[int(version.split()[0])]
            continue
        yield record | {"block": block, "truncated": len(block) < size}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers, with the blank line, and the payload; no headers where it isn't HTTP."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4 :]
    return b"", block


def header_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def convert(archives: DataFrame) -> DataFrame:
    """The records of ARC files (``name, content``) as rows of RECORD."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in parse_arc(content.as_py()):
                    head, payload = split_http(record["block"])
                    page = header_value(head, b"X-Page-Id")
                    d = record["Archive-date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{record['URL']} {d} {page}")
                    rows.append((None if page is None else int(page), f"urn:uuid:{identity}", record["URL"], date, record["IP-address"], record["Content-type"], head, payload, hashlib.sha256(payload).hexdigest(), record["truncated"]))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.string(), pa.bool_()]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RECORD.split(", ")])

    return archives.mapInArrow(run, RECORD)


def warc_record(kind: str, record_id: str, uri: str, date: str, ip: str, mime: str, head: bytes, payload: bytes, digest: str, refers: str | None, truncated: bool = False) -> bytes:
    """A record without the two line ends that close it."""
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers:
        lines += [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    if truncated:
        lines.append("WARC-Truncated: unspecified")
    lines += ["Content-Type: " + ("application/http; msgtype=response" if head else mime), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warcinfo(first_id: str, date: str) -> bytes:
    """The record that begins a file, told apart by the first record behind it; closed like any other."""
    block = b"software: pulsefeat\r\nformat: WARC File Format 1.1\r\n"
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {first_id}")
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{identity}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of RECORD as WARC files, with revisits in place of repeated payloads."""
    worth = F.octet_length("payload") >= SMALLEST
    order = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id")
    repeated = records.where(worth).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    repeated = cut(repeated.select(F.col("digest").alias("same"), F.col("first.page_id").alias("first_page"), F.col("first.record_id").alias("first_id")), "repeated")
    few = bounded_broadcast(repeated, MAX_BROADCAST_PAYLOADS)
    marked = records.join(few, worth & (F.col("digest") == F.col("same")), "left")
    is_first = (F.col("record_id") == F.col("first_id")) & F.col("page_id").eqNullSafe(F.col("first_page"))
    marked = marked.withColumn("refers", F.when(F.col("same").isNotNull() & ~is_first, F.col("first_id")))

    names = ["record_id", "uri", "date", "ip", "mime", "head", "payload", "digest", "refers", "truncated"]

    def run(batches):
        member = lambda record: gzip.compress(record + b"\r\n\r\n", 6, mtime=0)
        last = gzip.compress(b"", mtime=0)[:-1]
        file = lambda out: pa.RecordBatch.from_arrays([pa.array([out.getvalue() + last], pa.binary())], names=["value"])
        out = io.BytesIO()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if not out.tell():
                    out.write(member(warcinfo(row[0], row[2])))
                out.write(member(warc_record("revisit" if row[8] else "response" if row[5] else "resource", *row)))
                if out.tell() >= ARCHIVE_BYTES:
                    yield file(out)
                    out = io.BytesIO()
        if out.tell():
            yield file(out)

    files = marked.select(*names).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``page_id, uri, record_id, record_type, payload_bytes, payload_digest, refers_id, payload`` of the
    records in the files; digests of payloads that are there are made anew and must agree. Of a revisit,
    ``payload_bytes`` is what its HTTP headers declare, null where they don't. Without ``payloads`` that
    column is left out."""
    schema = "page_id long, uri string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_id string" + ", payload binary" * payloads

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    page = header_value(head, b"X-Page-Id")
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    refers = headers.get("warc-refers-to", "").strip("<>") or None
                    size = len(payload)
                    if refers:
                        declared = header_value(head, b"Content-Length") or ""
                        size = int(declared) if declared.isdecimal() else None
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {headers['warc-record-id']} disagrees")
                    rows.append((None if page is None else int(page), headers["warc-target-uri"], headers["warc-record-id"].strip("<>"), headers["warc-type"], size, digest, refers, *([None if refers else payload] if payloads else [])))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def verdicts(found: DataFrame) -> DataFrame:
    """Rows of ``read_warc`` as ``page_id, payload_bytes, payload_digest, record_type, refers_to``: what a
    revisit refers to is looked up, and gives its size."""
    found = cut(found.select("page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_id"), "records")
    wanted = found.select(F.col("refers_id").alias("wanted")).where("wanted IS NOT NULL").distinct()
    targets = found.where("refers_id IS NULL").join(wanted, F.col("record_id") == F.col("wanted"), "left_semi")
    targets = targets.groupBy(F.col("record_id").alias("target_id")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("target_bytes"))
    size = F.coalesce("target_bytes", "payload_bytes").alias("payload_bytes")
    return found.join(targets, F.col("refers_id") == F.col("target_id"), "left").select("page_id", size, "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC read back: per page ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``."""
    spark = pages.sparkSession
    small_batches(spark)
    path = new_path(spark, "warc")
    write_warc(convert(arc_archives(pages)), path)
    return verdicts(read_warc(spark, path, payloads=False))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
