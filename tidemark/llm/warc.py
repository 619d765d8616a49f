r"""WARC archives: a writer with revisit records and a salvage reader.

The writer makes a response record of each page, its payload the html in UTF-8; of pages with equal payloads of at least
REVISIT_BYTES the one with the largest page_id is the response and the others are revisit records that refer to it. Archives
go out through Spark's text sink (a record's end, CR LF CR LF, is the line separator), so any file system of Spark's will do,
in files of about FILE_BYTES. The reader takes archives whole, plain or with a gzip member a record. Each record is checked:
version line, header, length, end mark, block digest. After a failed check the reader searches for the next gzip member or
version line at which a record passes, and logs the bytes in between as quarantined.

Defined results: a null html is an empty payload; a null url leaves out the target; a null page_id is written and read back
as null, and never is what others refer to; rows that repeat both page_id and payload are all responses; control characters
in a url are percent-encoded; an empty table gives archives without records and an empty result; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import scratch

from .common import bounded, by_batch, cut

REVISIT_BYTES, FILE_BYTES = 1000, 16 << 20
DATE = "1970-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_START = re.compile(rb"WARC/\d|\x1f\x8b\x08")
_PAGE = re.compile(r"<urn:tidemark:page:(-?\d+)>")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record without its end mark; with refers_to, a revisit record, which holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:tidemark:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Tidemark-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 64):
            rows = zip(*(c.to_pylist() for c in batch.slice(k, 64).columns))
            records = [make_record(i, url, payload, to) for i, url, payload, to in rows]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of pages in the folder path, which must not exist."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= REVISIT_BYTES, F.sha1("payload")))
    known = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    size = rows.agg(F.avg(F.length("payload"))).first()[0] or 0
    joined = rows.join(bounded(known.where("n > 1").select("digest", "last"), "copies"), "digest", "left")
    to = F.when(F.coalesce(F.col("id") != F.col("last"), F.col("last").isNotNull()), F.col("last"))
    records = by_batch(joined.select("id", "url", "payload", to.alias("to")), _written, "record binary")
    records = records.select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (size + 700)))).text(path)


def _header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    version = _VERSION.match(data, at)
    end = data.find(b"\r\n\r\n", at) if version else -1
    if end < 0:
        return None
    fields = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key = name.strip().lower().decode("latin-1")
        # A header cut short runs into the next record's: a line without a colon, or a field for the second time.
        if not colon or b"\r" in value or key in fields and key != "warc-concurrent-to":
            return None
        fields[key] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record at this spot and where it ends; None if a check fails."""
    if not (found := _header(data, at)):
        return None
    fields, begin = found
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    end = begin + int(fields["content-length"])
    block = data[begin:end]
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        return None
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest != _sha1(block):
        return None
    return fields, block, end + 4


def _member(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int] | None:
    """The records of the gzip member at this spot; None unless it is whole and all of them pass."""
    z = zlib.decompressobj(31)
    try:
        inner = z.decompress(memoryview(data)[at:])
    except zlib.error:
        return None
    if not z.eof:
        return None
    records, k = [], 0
    while k < len(inner):
        if not (got := _plain(inner, k)):
            return None
        records.append(got[:2])
        k = got[2]
    return records, len(data) - len(z.unused_data)


def _remains(data: bytes, at: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that pass in a gzip member that the file's end cuts off. What is damaged otherwise isn't trusted: bytes
    inflated before the damage shows may be wrong, and a block's digest says nothing of its header."""
    z = zlib.decompressobj(31)
    try:
        inner = z.decompress(memoryview(data)[at:])
    except zlib.error:
        return
    k = 0
    while not z.eof and (got := _plain(inner, k)):
        yield got[:2]
        k = got[2]


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """(offset, length, header, block) of each record in order; a quarantined gap has no header and its bytes as block.

    What passes in a gzip member that is cut off is recovered, with a length of 0 since the member's bytes are quarantined too.
    """
    at, gap = 0, None
    while at < len(data):
        if data[at : at + 3] == b"\x1f\x8b\x08":
            got = _member(data, at)
            records, end = got or ([], at)
        else:
            one = _plain(data, at)
            records, end, got = ([one[:2]], one[2], one) if one else ([], at, None)
        if got is None:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                for fields, block in _remains(data, at):
                    yield at, 0, fields, block
            gap = at if gap is None else gap
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, data[gap:at]
            gap = None
        for fields, block in records:
            yield at, end - at, fields, block
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, data[gap:]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


_SCHEMA = "file string, offset long, length long, record_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page(text: str | None) -> int | None:
    found = _PAGE.fullmatch(text or "")
    return int(found[1]) if found else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for offset, length, fields, block in salvage(content.as_py()):
                    if fields is None:
                        row = ["quarantined", None, None, None, None, None, block if with_payload else None]
                    else:
                        kind, payload = fields["warc-type"].lower(), payload_of(fields, block)
                        if kind == "revisit":
                            digest, n = fields.get("warc-payload-digest", ""), fields.get("tidemark-payload-length")
                            digest = base64.b32decode(digest[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", digest) else None
                            n = int(n) if n else None
                        else:
                            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                        row = [kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), n, digest, payload if with_payload else None]
                    rows.append([file.as_py(), offset, length, *row])
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives under path and, with record_type `quarantined`, for each gap."""
    files = spark.read.format("binaryFile").load(path)
    return by_batch(files.select("path", "content"), _read(with_payload), _SCHEMA)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """pages written to archives in the shared folder and read back: a record for each, or an error."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, **columns)
    found = cut(read(pages.sparkSession, path), "records")
    records, rows = found.where("record_type <> 'quarantined'").count(), pages.count()
    if records != rows:
        raise RuntimeError(f"{rows} pages were written and {records} records read back from {path}")
    return found
