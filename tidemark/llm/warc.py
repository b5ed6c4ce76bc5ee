"""Legacy ARC archives turned into WARC records with revisits, and WARC archives read back.

Archives live in the folders that Spark's own readers and writers reach: WARC files are written with the text writer (a
record's closing ``\\r\\n\\r\\n`` is the line separator) and read as binary files.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import discard, fresh_path, stored

LEAST_REVISIT = 100  # bytes of payload
ARC_BYTES = 4 << 20
PER_FILE = 1000  # records of a WARC file

# The header fields of both ARC versions, in the format's order.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"],
}


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    line += f" 200 - - 0 {name}" if version == 2 else ""
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    """One record; white space in the URL is percent-encoded, as the header is split at spaces."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    line = f"{url} 0.0.0.0 {date} text/html"
    line += f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record after the version block.

    The version block names the fields of all header lines; a record's block has the declared
    length. A header line with the wrong number of fields, a length that is no number or runs past the end raises ValueError.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at {at}")
        parts = data[at:end].decode("utf-8").split(" ")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no version block")
            length = int(parts[-1])
            lines = data[end + 1:end + 1 + length].decode().split("\n")
            version = int(lines[0].split(" ")[0])
            if version not in ARC_FIELDS or lines[1].split(" ") != ARC_FIELDS[version] or len(parts) != len(ARC_FIELDS[version]):
                raise ValueError(f"unknown version block at {at}")
            fields = ARC_FIELDS[version]
        else:
            if len(parts) != len(fields) or not parts[-1].isdigit() or end + 1 + int(parts[-1]) > len(data):
                raise ValueError(f"bad header line at {at}")
            length = int(parts[-1])
            yield at, dict(zip(fields, parts)), data[end + 1:end + 1 + length]
        at = end + 1 + length
        while data[at:at + 1] == b"\n":  # one by the format, more in the wild
            at += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; no head if the block is no HTTP response."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def _field(head: bytes, name: str) -> str | None:
    m = re.search(rb"\r\n" + name.encode() + rb": ?([^\r\n]*)", head)
    return m[1].decode() if m else None


ARCHIVES = "name string, data binary"
RECORDS = (
    "record_id string, page_id long, url string, date string, type string, head binary, payload binary, "
    "payload_bytes long, payload_digest string"
)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """ARC archives (name, data) of up to ``ARC_BYTES``, versions 1 and 2 by turns, a record for each page.

    ``pages`` has page_id, url and html. The block is an HTTP response that names the page in
    ``X-Page-Id`` (absent if null); its date counts seconds from 2024 by page_id.
    """
    start = dt.datetime(2024, 1, 1)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size, pieces = TaskContext.get().partitionId(), 0, 0, []

        def done():
            name = f"pages-{part:06d}-{k:06d}.arc"
            return pa.RecordBatch.from_pydict(
                {"name": pa.array([name]), "data": pa.array([b"".join(pieces)], pa.binary())}
            )

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                version = 1 + k % 2
                name = f"pages-{part:06d}-{k:06d}.arc"
                if not pieces:
                    pieces.append(arc_head(name, version, start.strftime("%Y%m%d%H%M%S")))
                    size = len(pieces[0])
                payload = (html or "").encode("utf-8")
                mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                date = (start + dt.timedelta(seconds=(page_id or 0) % (1 << 30))).strftime("%Y%m%d%H%M%S")
                pieces.append(arc_record(url or "", date, head.encode() + payload, version, name, size))
                size += len(pieces[-1])
                if size >= ARC_BYTES:
                    yield done()
                    k, size, pieces = k + 1, 0, []
        if pieces:
            yield done()

    return pages.select("page_id", "url", "html").mapInArrow(build, ARCHIVES)


def convert(archives: DataFrame) -> DataFrame:
    """WARC records of ARC archives (name, data).

    Identifier: a name-based UUID of archive and offset. Date: the 14 digits as ISO time. Type:
    ``response`` for HTTP blocks, ``resource`` for others. Digest: hex SHA-256 of the payload.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist()):
                rows = []
                for at, fields, block in arc_records(data):
                    head, payload = split_http(block)
                    page, d = _field(head, "X-Page-Id"), fields["Archive-date"].ljust(14, "0")
                    rows.append(
                        (
                            str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")), None if page is None else int(page),
                            fields["URL"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                            "response" if head else "resource", head, payload, len(payload),
                            hashlib.sha256(payload).hexdigest(),
                        )
                    )
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary(), pa.binary(), pa.int64(), pa.string()]
                names = [c.split()[0] for c in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.mapInArrow(run, RECORDS)


def with_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``records`` with refers_to (page) and refers_to_record.

    Of records with equal payloads of at least ``least`` bytes, the first by page_id (null last,
    then by record_id) stays a response, the others become revisits of it. The first of each digest
    is summed before the shuffle and joined back; a digest that fills the table is a skewed join key that Spark splits.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    first = (
        records.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("payload_digest"), "first.page_id", "first.record_id")
        .toDF("payload_digest", "refers_to", "refers_to_record")
    )
    joined = records.join(first, "payload_digest", "left")
    again = F.col("refers_to_record").isNotNull() & (F.col("refers_to_record") != F.col("record_id"))
    return joined.withColumns(
        {
            "type": F.when(again, "revisit").otherwise(F.col("type")),
            "refers_to": F.when(again, F.col("refers_to")),
            "refers_to_record": F.when(again, F.col("refers_to_record")),
        }
    )


def _warc_record(r: dict) -> bytes:
    revisit = r["type"] == "revisit"
    block = r["head"] if revisit else r["head"] + r["payload"]
    lines = [
        "WARC/1.1", f"WARC-Type: {r['type']}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {r['payload_bytes']}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:uuid:{r['refers_to_record']}>")
        if r["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {r['refers_to']}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Gzipped WARC files below ``path``, up to ``per_file`` records each."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256).to_pylist()
                yield pa.RecordBatch.from_pydict({"record": pa.array(map(_warc_record, rows), pa.binary())})

    lines = records.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file)
    writer.text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by its declared length."""
    stream = io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {stream.tell() - len(line)}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[name] = value
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("record ends early")
        yield fields, block


READ = "record_id string, page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def read_warc(spark, path: str) -> DataFrame:
    """The records of the archives below ``path``, parsed from their bytes.

    ``intact``: the block has its digest, and a response's payload has the length and the digest that its header states.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for f, block in warc_records(gzip.decompress(data.as_py())):
                    head, payload = split_http(block)
                    page, refers, kind = _field(head, "X-Page-Id"), f.get("X-Refers-To-Page-Id"), f["WARC-Type"]
                    size, digest = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:")
                    intact = f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
                    if kind != "revisit":
                        got = hashlib.sha256(payload).hexdigest()
                        intact, size, digest = intact and (size, digest) == (len(payload), got), len(payload), got
                    rows.append(
                        (
                            f["WARC-Record-ID"].removeprefix("<urn:uuid:").rstrip(">"), None if page is None else int(page),
                            f["WARC-Target-URI"], f["WARC-Date"], kind, size, digest,
                            None if refers is None else int(refers), intact,
                        )
                    )
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                names = [c.split()[0] for c in READ.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length long, content binary"
    )
    return files.load(path).select("content").mapInArrow(run, READ)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages (page_id, url, html) through ARC archives into WARC archives at ``path``, and read back.

    Null html is an empty payload, a null or empty URL is ``-``, a null page_id stays null. Payloads
    below ``LEAST_REVISIT`` bytes are all responses. Of rows that repeat a page_id and its payload one is the response.
    An empty table gives no records. Other columns are not carried.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    records = stored(convert(pages_to_arc(pages)), "records")
    write_warc(with_revisits(records), path)
    discard(records)
    return read_warc(spark, path)
