"""Legacy archives to WARC.

``convert_arc`` reads ARC archives of version 1 and 2: the version block names the fields of the header lines, and each
record's declared length says where the next header begins. It synthesises what WARC asks for: an identifier from the
header line and the content, an ISO 8601 date from the 14-digit one, a type, and SHA-1 digests of block and payload in
base32. ``write_warc`` turns later records with the payload of an earlier one into revisits; ``read_warc`` reads the
archives back.

Of records with equal payloads the one with the smallest sequence number (the page id) is a response, if the payload
has at least ``min_bytes``; smaller payloads are all responses. A null html is an empty payload; a null url becomes a
``urn:``, a null page id is kept as null and never chosen over another. An identifier also names the record's place, so
repeated rows are records of their own; those with the smallest page id are all responses. An ARC record cut off by the end of its file keeps what is there and is marked as truncated; a header line
that can't be read ends its archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import discard, materialize

ARC_BYTES = 4 << 20
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SEPARATOR = "\r\n\r\n"
#: Bytes of records written together, about, and most of such runs in a WARC file, so that a file fits a task that reads it.
RUN_BYTES, FILE_RUNS = 16 << 20, 8
_RECORD = "seq long, record_id string, uri string, date string, ip string, head binary, payload_bytes long, payload_digest string, block_digest string, truncated boolean"


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def arc_archives(pages: DataFrame) -> DataFrame:
    """(content binary): ARC archives holding ``pages`` (page_id, url, html), versions 1 and 2 in turn."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, parts, size = 0, [], 0

        def archive() -> pa.RecordBatch:
            version = 1 + turn % 2
            about = f"{version} 0 notelattice\n{FIELDS[version]}\n\n".encode()
            head = f"filedesc://pages-{turn}.arc 0.0.0.0 20240101000000 text/plain" + (" 200 - - 0 -" if version == 2 else "") + f" {len(about)}\n"
            return pa.RecordBatch.from_arrays([pa.array([b"".join([head.encode(), about, *parts])], pa.binary())], ["content"])

        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'-' if page is None else page}\r\n\r\n".encode() + body
                uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:x-page:{page}"
                date = time.strftime("%Y%m%d%H%M%S", time.gmtime(1_704_067_200 + (page or 0) % 31_536_000))
                line = f"{uri} 192.0.2.{(page or 0) % 254 + 1} {date} text/html" + (f" 200 {hashlib.md5(body).hexdigest()} - {size} pages-{turn}.arc" if turn % 2 else "") + f" {len(block)}\n"
                parts += [line.encode(), block, b"\n"]
                size += len(line) + len(block) + 1
                if size >= ARC_BYTES:
                    yield archive()
                    turn, parts, size = turn + 1, [], 0
        if parts:
            yield archive()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(render, "content binary")


def parse_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields, block, whether it is cut off) of each record after the version block."""
    stop = raw.find(b"\n")
    about = raw[:stop].split(b" ")
    if stop < 0 or not about[-1].isdigit():
        return
    at = stop + 1 + int(about[-1])
    names = raw[stop + 1 : at].split(b"\n")[1].decode("latin-1").split(" ")
    while at < len(raw):
        if raw[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        stop = raw.find(b"\n", at)
        if stop < 0:
            return
        # blanks can only stand in the URL, so fields are taken from the right
        values = raw[at:stop].decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            return
        size = int(values[-1])
        block = raw[stop + 1 : stop + 1 + size]
        yield dict(zip(names, values)), block, len(block) < size
        at = stop + 1 + size


def iso_date(arc: str) -> str:
    d = (arc + "00000101000000"[len(arc) :])[:14] if arc.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _sequence(head: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
    return int(found[1]) if found else None


def convert_arc(archives: DataFrame, payload: bool = True) -> DataFrame:
    """WARC fields of every record of ARC ``archives`` (content); without ``payload`` that column is left out."""
    schema = _RECORD + (", payload binary" if payload else "")
    types = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_(), *[pa.binary()] * payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for content in batch.column(0):
                number += 1
                rows: list[tuple] = []
                size = 0
                archive, place = hashlib.sha1(content.as_buffer()).digest(), 0
                for fields, block, cut in parse_arc(content.as_buffer().to_pybytes()):
                    at = block.find(b"\r\n\r\n")
                    head, body = (block[: at + 4], block[at + 4 :]) if at >= 0 and block.startswith(b"HTTP/") else (b"", block)
                    line = "\0".join([fields["URL"], fields["IP-address"], fields["Archive-date"]]).encode()
                    key = hashlib.sha1(line + b"\0" + hashlib.sha1(block).digest() + archive + b"%d %d %d" % (part, number, place)).digest()
                    place += 1
                    rows.append((_sequence(head), f"<urn:uuid:{uuid.UUID(bytes=key[:16], version=5)}>", fields["URL"], iso_date(fields["Archive-date"]), fields["IP-address"], head, len(body), digest(body), digest(block), cut, *([body] * payload)))
                    size += len(block)
                    if size >= ARC_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.mapInArrow(convert, schema)


def write_warc(archives: DataFrame, out: str, min_bytes: int = 0) -> None:
    """Convert ARC ``archives`` and write WARC files to the folder ``out``.

    Archives are written once and read twice, as a record's identifier names its place in them.
    """
    archives = materialize(archives, "arc")
    # grouped by two columns and joined by one, so the join deals both sides anew and hot digests can split
    first = convert_arc(archives, payload=False).where(F.col("payload_bytes") >= min_bytes)
    first = first.groupBy("payload_digest", "payload_bytes").agg(F.min(F.struct(F.col("seq").isNull().alias("none"), "seq", "record_id", "uri", "date")).alias("first"))
    records = convert_arc(archives).join(first.select("payload_digest", "first").hint("shuffle_hash"), "payload_digest", "left")

    def run(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([SEPARATOR.encode().join(records)], pa.binary())], ["records"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for k, r in enumerate(batch.drop_columns(["payload", "head"]).to_pylist()):
                head, body = batch.column("head")[k].as_buffer().to_pybytes(), batch.column("payload")[k].as_buffer().to_pybytes()
                origin = r["first"]
                again = origin is not None and origin["record_id"] != r["record_id"] and origin["seq"] != r["seq"]
                block = head if again else head + body
                lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Target-URI: {r['uri']}", f"WARC-Date: {r['date']}", f"WARC-IP-Address: {r['ip']}"]
                if again:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {origin['record_id']}", f"WARC-Refers-To-Target-URI: {origin['uri']}", f"WARC-Refers-To-Date: {origin['date']}"]
                if r["truncated"]:
                    lines.append("WARC-Truncated: length")
                lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{digest(block) if again else r['block_digest']}", "Content-Type: application/http; msgtype=response" if head else "Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
                rows.append("\r\n".join(lines).encode() + b"\r\n\r\n" + block)
                size += len(rows[-1])
                if size >= RUN_BYTES:
                    yield run(rows)
                    rows, size = [], 0
            if rows:
                yield run(rows)

    # the text sink writes the bytes of a string as they are; the separator after each record is WARC's own
    text = records.mapInArrow(render, "records binary").select(F.col("records").cast("string").alias("value"))
    text.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", FILE_RUNS).text(out)
    discard(archives)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\r\n\r\n", at)
        if stop < 0 or raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        lines = raw[at:stop].decode("utf-8").split("\r\n")[1:]
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(fields["content-length"])
        yield fields, raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, record_type, payload_bytes, payload_digest, refers_to_id) of every record in the files.

    A response's length and digest come from its payload as read, and must match its header; a revisit's come from its
    headers.
    """
    schema = "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(gzip.decompress(content.as_buffer().to_pybytes())):
                    at = block.find(b"\r\n\r\n")
                    head, body = (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") else (b"", block)
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "revisit":
                        length, found = int(re.search(rb"(?im)^Content-Length: (\d+)", head)[1]), said
                    else:
                        length, found = len(body), digest(body)
                        if found != said:
                            raise ValueError(f"{fields['warc-record-id']} has another payload than its digest says")
                    rows.append((_sequence(head), fields["warc-record-id"], fields["warc-type"], length, found, fields.get("warc-refers-to")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def page_records(pages: DataFrame, out: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC by way of ARC, read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    write_warc(arc_archives(pages), out, min_bytes)
    rows = materialize(read_warc(spark, out), "warc-records")
    origin = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_id", "refers_to"])
    return rows.join(origin, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
