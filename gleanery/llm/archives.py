"""Legacy ARC archives converted to WARC.

An ARC record is a header line and a payload of a declared length. Which fields the line
has depends on the version block at the head of the file: version 1 gives URL, IP,
date, type and length; version 2 adds result code, checksum, location, offset and file
name. The converter reads the line by its version, takes the payload by its length,
and makes a WARC/1.1 record of it: identifier (a name-based UUID, so that reruns agree),
timestamp, type and digests. The payload of an http address begins with the status line
and headers of the answer; these are split off, keep their status and type, and are not
part of the payload digest. Equal payloads become one response and revisits of it.

WARC files are written by Spark's text writer, one row of joined records to a file, with
the record separator as line separator. So a part file is a plain gzip-compressed WARC of
bounded size; it is read as a whole file and parsed by declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.llm.common import table
from gleanery.operators.lookup import lookup_join
from gleanery.session import scratch_dir, written

# Fixed values of the formats: fields of an ARC header line by version, in order.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
# Uncompressed bytes after which a WARC file ends; it is larger by one record at most.
FILE_BYTES = 32 << 20
NO_ADDRESS = "about:blank"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    code: str
    payload: bytes

    def answer(self) -> tuple[bytes | None, bytes]:
        """The head of the answer, if the payload has one, with CRLF line ends, and the body."""
        status = _STATUS.match(self.payload) if self.url[:7].lower() in ("http://", "https:/") else None
        end = status and re.compile(rb"\r?\n\r?\n").search(self.payload)
        if not end:
            return None, self.payload
        return b"\r\n".join(self.payload[: end.start()].splitlines()), self.payload[end.end() :]


_STATUS = re.compile(rb"HTTP/[0-9]+(?:\.[0-9]+)? [0-9]{3}[^0-9]")


def arc_header(line: bytes, version: int) -> dict[str, str]:
    """The fields of a header line. Fields are split from the right, so that an address
    with spaces stays whole."""
    names = ARC_FIELDS[version]
    values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdigit():
        raise ValueError(f"not an ARC version {version} header: {line[:200]!r}")
    return dict(zip(names, values))


def parse_arc(stream: io.BufferedIOBase, version: int = 1) -> Iterator[ArcRecord]:
    """All records of an ARC stream, uncompressed."""
    return (record for record, _, _ in arc_parts(stream, version))


def arc_parts(stream: io.BufferedIOBase, version: int = 1) -> Iterator[tuple[ArcRecord, bytes, int]]:
    """All records with their header lines and versions. A version block sets the version; it
    is not a record itself. Declared lengths are trusted; a short payload is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        fields = arc_header(line, 1 if line.startswith(b"filedesc:") else version)
        size = int(fields["length"])
        payload = stream.read(size)
        if len(payload) != size:
            raise ValueError(f"ARC record is cut short: {fields['url'][:200]}")
        if line.startswith(b"filedesc:"):
            version = int(payload.split(b" ", 1)[0])
            continue
        code = fields.get("code", "200")
        yield ArcRecord(fields["url"], fields["ip"], fields["date"], fields["type"], code, payload), line, version


def warc_date(date: str) -> str:
    """A 14-digit ARC date in ISO form; shorter ones are filled up, others are the epoch."""
    digits = re.fullmatch(r"[0-9]{4,14}", date)
    full = (date + "19700101000000"[len(date) :]) if digits else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


_CODES = {str(int(s)) for s in HTTPStatus}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same record gets the same identifier in every run."""
    name = hashlib.sha1(f"{page_id}:{digest}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def warc_record(arc: ArcRecord, page_id: int | None, first: int | None) -> bytes:
    """A response, or a revisit of page `first`, without the separator after it."""
    head, body = arc.answer()
    digest = base32_sha1(body)
    if head is None:
        reason = HTTPStatus(int(arc.code)).phrase if arc.code in _CODES else ""
        head = f"HTTP/1.1 {arc.code} {reason}\r\nContent-Type: {arc.mime}\r\nContent-Length: {len(body)}".encode()
    block = head + END if first is not None else head + END + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {warc_date(arc.date)}",
        f"WARC-Target-URI: {arc.url}",
        f"WARC-IP-Address: {arc.ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if first is not None:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        lines.append(f"WARC-Refers-To: {record_id(first, digest)}")
        lines.append(f"X-Refers-To-Page-Id: {first}")
    return "\r\n".join(lines).encode() + END + block


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) :
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("WARC record is cut short")
        yield headers, block


class _Gunzip(io.RawIOBase):
    """Decompresses bytes in steps, member after member."""

    def __init__(self, raw: bytes):
        self.raw, self.own = memoryview(raw), zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while len(self.raw):
            if self.own.eof:
                self.own = zlib.decompressobj(31)
            got = self.own.decompress(self.raw, len(buffer))
            self.raw = memoryview(self.own.unused_data if self.own.eof else self.own.unconsumed_tail)
            if got:
                buffer[: len(got)] = got
                return len(got)
        got = b"" if self.own.eof else self.own.decompress(b"", len(buffer))
        buffer[: len(got)] = got
        return len(got)


def _opened(raw: bytes) -> io.BufferedIOBase:
    return io.BufferedReader(_Gunzip(raw), 1 << 18) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def as_arc(pages: DataFrame, date: str = "20000101000000", ip: str = "0.0.0.0") -> DataFrame:
    """Pages as version-1 ARC records: page_id, digest (SHA-1 of the body, hex), version, arc.

    The payload is an answer, as archives hold it: of an http address a head and the html.
    White space and control characters in an address become %20; a null address is
    about:blank, a null html an empty body. Everything is done by column functions.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(NO_ADDRESS))
    head = F.when(F.rlike(url, F.lit("(?i)^https?:/")), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"))
    payload = F.concat(F.coalesce(head, F.lit("")).cast("binary"), body)
    size = F.octet_length(payload).cast("string")
    line = F.concat_ws(" ", url, F.lit(ip), F.lit(date), F.lit("text/html"), size)
    record = F.concat(F.concat(line, F.lit("\n")).cast("binary"), payload)
    return pages.select("page_id", F.sha1(body).alias("digest"), F.lit(1).alias("version"), record.alias("arc"))


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("record", pa.binary())])
    for rows in batches:
        found, size = [], 0
        columns = [rows.column(c) for c in ("page_id", "first", "version", "arc")]
        for page_id, first, version, raw in zip(*columns):
            for arc in parse_arc(io.BytesIO(raw.as_py()), version.as_py()):
                found.append(warc_record(arc, page_id.as_py(), first.as_py()))
                size += len(found[-1])
            if size > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], schema=kind)
                found, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], schema=kind)


def _joiner(file_bytes: int):
    """Records one after another, in rows that end behind `file_bytes`."""
    kind = pa.schema([("records", pa.binary())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        size = 0
        for rows in batches:
            for record in rows.column("record"):
                found.append(record.as_py())
                size += len(found[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(found)], pa.binary())], schema=kind)
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(found)], pa.binary())], schema=kind)

    return join


def convert(arcs: DataFrame) -> DataFrame:
    """WARC records (`record`, without separators) of ARC records.

    `arcs` has page_id, digest, version and arc. Of records with equal digests those with the least
    page_id are responses and the others revisits of it. Rows without a page_id are
    revisits if their payload has a row with one, else responses.
    """
    same = arcs.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("least"))
    same = written(same.where("n > 1 and least is not null").select("digest", "least"), "payloads")
    rows = lookup_join(arcs, same, "digest", "left")
    first = F.when(F.col("page_id").eqNullSafe(F.col("least")), F.lit(None)).otherwise(F.col("least"))
    return rows.select("page_id", first.alias("first"), "version", "arc").mapInArrow(_convert, "record binary")


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of `convert` as gzip-compressed WARC files, cut by the bytes of the
    records themselves: a file is longer than `file_bytes`, uncompressed, by one record at
    most."""
    joined = records.mapInArrow(_joiner(file_bytes), "records binary")
    writer = joined.select(F.col("records").cast("string").alias("value")).write
    writer = writer.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 1).text(path)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in READ.split(", ")]
    schema = pa.schema(list(zip(names, kinds)))
    for rows in batches:
        for raw in rows.column("content"):
            found = []
            for headers, block in parse_warc(_opened(raw.as_py())):
                _, _, payload = block.partition(END)
                declared = int(headers["x-payload-length"])
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != declared or base32_sha1(payload) != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} differs from its header")
                ids = [headers.get(k) for k in ("x-page-id", "x-refers-to-page-id")]
                page, first = (None if i is None else int(i) for i in ids)
                found.append((page, declared, digest, kind, first, headers["warc-target-uri"]))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`, payloads checked against headers."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(_read, READ)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole ARC files, plain or gzip: url, ip, date, mime, code, payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url", "ip", "date", "mime", "code"]
        schema = pa.schema([*((n, pa.string()) for n in names), ("payload", pa.binary())])
        for rows in batches:
            for raw in rows.column("content"):
                for arc in parse_arc(_opened(raw.as_py())):
                    yield pa.RecordBatch.from_pylist([vars(arc)], schema)

    fields = "url string, ip string, date string, mime string, code string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, fields)


def arc_rows(spark: SparkSession, path: str) -> DataFrame:
    """The records of whole ARC files as `convert` takes them: page_id, digest, version, arc.

    A record's number is a digest of its file and place in it, so reruns agree.
    """
    fields = "page_id long, digest string, version int, arc binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary()]
        schema = pa.schema(list(zip(("page_id", "digest", "version", "arc"), kinds)))
        for rows in batches:
            for file, raw in zip(rows.column("path").to_pylist(), rows.column("content")):
                for place, (arc, line, version) in enumerate(arc_parts(_opened(raw.as_py()))):
                    number = int.from_bytes(hashlib.sha1(f"{file}:{place}".encode()).digest()[:8], "big", signed=True)
                    digest = hashlib.sha1(arc.answer()[1]).hexdigest()
                    row = dict(zip(schema.names, (number, digest, version, line + arc.payload)))
                    yield pa.RecordBatch.from_pylist([row], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, fields)


def convert_files(spark: SparkSession, source: str, target: str) -> None:
    """Convert the ARC files below `source` to WARC files in `target`."""
    write_warc(convert(arc_rows(spark, source)), target)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Convert pages to WARC files and read these back: one row per page, see READ.

    Page ids may be null or repeat; each row is a record. An empty table gives no rows.
    """
    path = scratch_dir(pages.sparkSession, "warc")
    write_warc(convert(as_arc(pages)), path)
    return read_warc(pages.sparkSession, path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


# Bytes and digests by DuckDB's own sha1; base 32 from its bits.
OP9_SQL = """
with p as (
    select page_id, url, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h
    from pages),
b as (
    select h, list_aggregate(list_transform(range(1, 41), lambda k:
        lpad(bin(instr('0123456789abcdef', substr(h, k, 1)) - 1), 4, '0')), 'string_agg', '') as bits
    from (select distinct h from p)),
d as (
    select h, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(0, 5), lambda j:
            cast(substr(bits, 5 * k + j + 1, 1) as integer) * (16 >> j::integer)))::bigint, 1)),
        'string_agg', '') as payload_digest
    from b),
f as (select h, min(page_id) as first from p group by h)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
    case when page_id is distinct from first and first is not null then 'revisit' else 'response' end
        as record_type,
    case when page_id is distinct from first then first end as refers_to,
    coalesce(regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g'), 'about:blank') as url
from p join d using (h) join f using (h)
"""
