"""WARC archives in which equal payloads are stored once, the others as revisit records.

Headers (page_id, payload digest) are shuffled by digest, never payloads: the smallest
page_id of a digest stays the response, found by an aggregate that reduces before the
shuffle. The decision then meets the payloads, which are written to gzip archives, one
member per record. Reading back resolves revisits by the record id they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import forget, keep, map_batches, scratch
from cohortry.llm.rans import _publish

#: Bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are all stored.
LEAST_BYTES = 0
#: Archives carry no clock time, so that a repeated task writes the same bytes.
DATE = "1970-01-01T00:00:00Z"
SOFTWARE = "cohortry"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def _headers(lines: list[tuple[str, str]]) -> bytes:
    return CRLF.join([b"WARC/1.1", *[f"{k}: {v}".encode() for k, v in lines]]) + CRLF + CRLF


def _clean(url: str | None) -> str:
    """A header value: line breaks and other control characters would end it."""
    return "".join(c for c in url or "" if c >= " ")


def write_record(page_id: int | None, copy: int, url: str | None, payload: bytes, found: str, refers_to: tuple[int, int] | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of the response it refers to."""
    http = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF
    http += b"Content-Length: " + str(len(payload)).encode() + CRLF + CRLF
    block = http if refers_to else http + payload
    lines = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{found}"),
    ]
    if refers_to:
        lines += [("WARC-Refers-To", record_id(*refers_to)), ("WARC-Profile", PROFILE)]
    if page_id is not None:
        lines.append(("X-Page-Id", str(page_id)))
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_headers(lines) + block + CRLF + CRLF, 4, mtime=0)


def _info() -> bytes:
    body = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, SOFTWARE)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return gzip.compress(_headers(lines) + body + CRLF + CRLF, 4, mtime=0)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of every record of an archive, one member after the other."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        unzip, parts = zlib.decompressobj(wbits=31), []
        while not unzip.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            # In small steps: what follows the member is copied each time.
            parts.append(unzip.decompress(view[at : at + 4096]))
            at += 4096
        at = min(at, len(data)) - len(unzip.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(CRLF + CRLF)
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a record")
        headers = dict(line.split(": ", 1) for line in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def page_headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and bytes of every page."""
    schema = "page_id long, url string, html string, digest string, bytes long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [x or b"" for x in batch.column("html").cast(pa.binary()).to_pylist()]
        more = [pa.array([digest(x) for x in bodies]), pa.array([len(x) for x in bodies], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=["page_id", "url", "html", "digest", "bytes"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), schema, run)


def resolve(headers: DataFrame, at: str, least: int = LEAST_BYTES) -> DataFrame:
    """(row, first_page, first_row) of the records that revisit another; ``headers``: row, page_id, digest, bytes."""
    able = headers.where(F.col("bytes") >= least)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = able.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row"))
    # Stored, so that the join's sides are plain shuffles and a hot digest can be split.
    again = able.select("row", "digest").join(keep(first, f"{at}/first"), "digest")
    return keep(again.where("row != first_row").select("row", "first_page", "first_row"), f"{at}/again")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write every page as a record to archives under ``folder``; returns (file, n_records, n_revisits).

    Of pages with equal payloads of at least ``least`` bytes, the one with the smallest
    page_id is the response (null page_ids last; of repeated rows one), the others revisit
    it. Null html is an empty payload. An empty table writes no archive.
    """
    spark = pages.sparkSession
    at = scratch(spark, "warc")
    base = keep(page_headers(pages).withColumn("row", F.monotonically_increasing_id()), f"{at}/pages")
    rows = base.join(resolve(base.select("row", "page_id", "digest", "bytes"), at, least), "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_records: list[bytes] = []
        counts = [0, 0, 0]
        name = [None]
        done: list[tuple] = []

        def close() -> None:
            if open_records:
                file = f"pages-{name[0]:016x}.warc.gz"
                _publish(folder, file, _info() + b"".join(open_records))
                done.append((file, counts[0], counts[1]))
            open_records.clear()
            counts[:] = [0, 0, 0]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "page_id", "url", "digest", "first_page", "first_row")]
            bodies = [x or b"" for x in batch.column("html").cast(pa.binary()).to_pylist()]
            for row, page, url, found, first_page, first_row, body in zip(*columns, bodies, strict=True):
                if not open_records:
                    name[0] = row
                refers = (first_page, first_row) if first_row is not None else None
                open_records.append(write_record(page, row, url, body, found, refers))
                counts[0] += 1
                counts[1] += refers is not None
                counts[2] += len(open_records[-1])
                if counts[2] >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
            names=["file", "n_records", "n_revisits"],
        )

    columns = rows.select("row", "page_id", "url", "html", "digest", "first_page", "first_row")
    written = keep(columns.mapInArrow(run, "file string, n_records long, n_revisits long"), f"{folder}/_index")
    forget(spark, at)
    return written


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, html of every record; revisits carry no html.

    A revisit's payload is its response's: the record it refers to is joined to it. Digests
    of responses are checked against their payloads.
    """
    names = ["page_id", "record", "url", "record_type", "payload_digest", "target", "html"]
    schema = "page_id long, record string, url string, record_type string, payload_digest string, target string, html string"
    index = spark.read.parquet(f"{folder}/_index")
    out_schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"
    if index.isEmpty():
        return spark.createDataFrame([], out_schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(index, "file", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                out = []
                for headers, content in read_records(data):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    body = content.partition(CRLF + CRLF)[2]
                    found = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = headers["WARC-Type"] == "response"
                    if response and digest(body) != found:
                        raise ValueError("payload digest differs")
                    page = headers.get("X-Page-Id")
                    out.append((None if page is None else int(page), headers["WARC-Record-ID"], headers["WARC-Target-URI"], headers["WARC-Type"], found, headers.get("WARC-Refers-To"), body.decode() if response else None))
                    if len(out) == 500:
                        yield _records(out, names)
                        out = []
                if out:
                    yield _records(out, names)

    records = files.select("content").mapInArrow(run, schema)
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").select("page_id", "url", "record_type", "payload_digest", "target")
    originals = responses.select(F.col("record").alias("target"), F.col("page_id").alias("refers_to"), F.octet_length("html").cast("long").alias("payload_bytes"))
    joined = revisits.join(originals, "target")
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
    own = responses.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "refers_to": F.lit(None).cast("long")})
    return own.select(*columns).union(joined.withColumn("html", F.lit(None).cast("string")).select(*columns))


def _records(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] + [pa.string()] * 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
