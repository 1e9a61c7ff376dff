"""WARC archives: write records with segments and chunked framing, read them back whole.

Reading reassembles segments: continuation records are grouped by their origin identifier, ordered by
segment number, checked against the stated total length, and the chunked transfer framing is decoded.
A record in one piece is decoded where it is read; only segments are shuffled.
Archives are written by Spark's text writer (a record is bytes; the writer's line end is the record's
last byte; files are gzipped), so they may lie in any store that Spark reaches. A file ends after
FILE_RECORDS records of at most SEGMENT_BYTES and some headers each: 128 MB before compression.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_side

SEGMENT_BYTES = 4096
FILE_RECORDS = 4096
CHUNK_BYTES = 4096
#: Payloads below this size are never revisits.
REVISIT_BYTES = 1000
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
CHUNK_SIZE = re.compile(rb"[0-9A-Fa-f]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Decode chunked framing; extensions and trailers are skipped. Raises ValueError when it is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        stated = body[at:end].partition(b";")[0].strip(b" \t")
        if not CHUNK_SIZE.fullmatch(stated):
            raise ValueError("no chunk size")
        size, at = int(stated, 16), end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def quoted(page_id: int | str | None) -> str | None:
    """An identifier as a header and a record's identifier hold it: without colons, spaces and line ends."""
    return None if page_id is None else quote(str(page_id), safe="")


def record_id(page_id: int | str | None, digest: str) -> str:
    """The same for each record of a page's payload, so that a revisit can name its response."""
    return f"<urn:page:{quoted(page_id)}:{digest}>"


def id_kind(pages: DataFrame, id_col: str = "page_id") -> str:
    """How archives hold the identifiers: whole numbers as bigint, all others as their text."""
    return "bigint" if isinstance(pages.schema[id_col].dataType, T.IntegralType) else "string"


def page_records(page_id: int | str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | str | None, copy: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it needs.

    `copy` tells apart the segments of rows that repeat a page, whose records have the same identifier.
    """
    own = record_id(page_id, digest)
    about = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", quoted(page_id))]
    if kind == "revisit":
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Content-Type", "application/http;msgtype=response")]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:revisit:{copy}>"), *about, *more], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment)
    for number, start in enumerate(cuts, 1):
        part = block[start : start + segment]
        fields: list[tuple[str, object]] = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", own if number == 1 else f"<urn:segment:{copy}:{number}>")]
        if number == 1:
            fields += [*about, ("Content-Type", "application/http;msgtype=response")]
        else:
            fields.append(("WARC-Segment-Origin-ID", own))
        if len(cuts) > 1:
            fields += [("WARC-Segment-Number", number), ("Record-Copy", copy)]
            if number == len(cuts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield record(fields, part)


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """_page, _url, _payload, _digest, _kind, _refers_to: which record is the response of each large payload.

    Small payloads take no part in the join. The other side has a row per large payload that repeats;
    where these are many the pages are shuffled, and a payload that very many share is a hot key that
    AQE splits.
    """
    payload, kind = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary"), id_kind(pages, id_col)
    rows = pages.select(F.col(id_col).cast(kind).alias("_page"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    alone = lambda df: df.select("_page", "_url", "_payload", F.sha1("_payload").alias("_digest"), F.lit("response").alias("_kind"), F.lit(None).cast(kind).alias("_refers_to"))
    large = rows.filter(F.octet_length("_payload") >= REVISIT_BYTES).withColumn("_key", F.sha2("_payload", 256))
    first = large.groupBy("_key").agg(F.max("_page").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").drop("_copies")
    revisit = F.col("_first").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_first"))
    judged = large.join(small_side(materialize(first)), "_key", "left").select(
        "_page", "_url", "_payload", F.sha1("_payload").alias("_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("_kind"), F.when(revisit, F.col("_first")).alias("_refers_to"),
    )
    return judged.unionByName(alone(rows.filter(F.octet_length("_payload") < REVISIT_BYTES)))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT_BYTES) -> None:
    """Write a record (or segments) per row of pages under `path`.

    A null html is an empty payload; null ids and urls leave their fields out or empty. Identifiers may
    be of any type (see id_kind); the largest of those that are no numbers is the last as text. Repeated
    rows are written each. An empty table writes no record.
    """

    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for few in slices(batches):
            out = []
            for row in few.to_pylist():
                count += 1
                out += page_records(row["_page"], row["_url"], row["_payload"], row["_digest"], row["_kind"], row["_refers_to"], f"{run}-{part}-{count}", segment)
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["record"])

    records = with_roles(pages, id_col, url_col, html_col).mapInArrow(write, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


def opened(data: bytes) -> io.BufferedIOBase:
    """An archive's bytes as a stream; a gzipped archive, of one member or one per record, is opened as it is read."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one held at a time. Raises ValueError where one is not a record or is cut short."""
    while line := archive.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields = {}
        while (line := archive.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if not line:
            raise ValueError("header is cut short")
        if not fields.get("content-length", "").isdecimal():
            raise ValueError("no content length")
        size = int(fields["content-length"])
        block = archive.read(size)
        if len(block) < size:
            raise ValueError("record is cut short")
        yield fields, block


def assemble(number: list[int], total: int | None, blocks: list[bytes]) -> tuple[bytes, str | None]:
    """The payload of one response from its segments in order, and what is wrong with it."""
    block = b"".join(blocks)
    if number != list(range(1, len(number) + 1)):
        return b"", "segments are missing or repeated"
    if total is None and len(number) > 1 or total is not None and total != len(block):
        return b"", "total length differs"
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        try:
            body = dechunked(body)
        except ValueError as broken:
            return b"", str(broken)
    return body, None


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]+", text) else None


RECORD = "kind string, page bigint, refers_to bigint, stated string, payload binary, payload_bytes bigint, payload_digest string, problem string"
SEGMENT = "origin string, copy string, number int, total bigint, block binary"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def record_schema(ids: str) -> str:
    """RECORD with identifiers of that type."""
    return RECORD.replace("page bigint, refers_to bigint", f"page {ids}, refers_to {ids}")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names)


def _decoded(kind: str, page: int | None, refers_to: int | None, stated: str | None, numbers: list[int], total: int | None, blocks: list[bytes], payloads: bool) -> tuple:
    """One row of RECORD from a record's segments in order."""
    if kind == "revisit":
        return kind, page, refers_to, stated, None, None, None, None
    payload, problem = assemble(numbers, total, blocks)
    digest = hashlib.sha1(payload).hexdigest()
    if not problem and stated not in (None, digest):
        problem = "digest differs"
    return kind, page, refers_to, stated, payload if payloads else None, len(payload), digest, problem


def _page(text: str | None, ids: str) -> int | str | None:
    """An identifier from a header; `ids` is bigint or string. One that is no number is null among numbers."""
    return _number(text) if ids == "bigint" else unquote(text) if text is not None else None


def read_records(spark: SparkSession, path: str, payloads: bool = True, ids: str = "bigint") -> DataFrame:
    """A row per response, revisit and segment of the archives under `path`: RECORD (with identifiers as `ids`), then SEGMENT.

    Records in one piece are decoded here and have no `number`; of segments the block is handed on.
    Records of other types are left out. An archive that is broken gives the records before the
    break and a row that only tells the problem.
    """

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        try:
            for f, block in parse(opened(data)):
                kind, number = f.get("warc-type", ""), _number(f.get("warc-segment-number"))
                segment = number is not None or kind == "continuation"
                if not segment and kind not in ("response", "revisit"):
                    continue
                refers = f.get("warc-refers-to", "").removeprefix("<urn:page:").partition(":")[0]
                about = kind, _page(f.get("page-id"), ids), _page(refers if "warc-refers-to" in f else None, ids), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                total = _number(f.get("warc-segment-total-length"))
                if segment:
                    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id") or ""
                    yield (*about, None, None, None, None, origin, f.get("record-copy"), number or 0, total, block)
                else:
                    yield (*_decoded(*about, [1], total, [block], payloads), None, None, None, None, None)
        except (ValueError, EOFError, OSError) as broken:
            yield (*[None] * 7, f"{name.rpartition('/')[2]}: {broken}", None, None, None, None, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for row in rows(name, content.as_py()):
                    held.append(row)
                    if len(held) == 64:
                        yield _batch(held, schema)
                        held = []
                yield _batch(held, schema)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    schema = f"{record_schema(ids)}, {SEGMENT}"
    return files.mapInArrow(read, schema)


def reassemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD for each response and revisit of `records` (from read_records, evaluated twice).

    `problem` tells missing or repeated segments, a wrong total length, broken framing, a digest that
    differs from the stated one, or a broken archive; it is null for sound records and revisits.
    Segments of other record types are left out. An empty table gives an empty result.
    """
    whole = records.filter("number is null").select(*(x.split()[0] for x in RECORD.split(", ")))
    part = F.struct("number", "total", "kind", "page", "refers_to", "stated", "block")
    grouped = records.filter("number is not null").groupBy("origin", "copy").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # the segments of one record

    schema = record_schema(records.schema["page"].dataType.simpleString())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column(0)[i].as_py()
                first = parts[0]
                if first["kind"] in ("response", "continuation"):
                    about = "response", first["page"], first["refers_to"], first["stated"]
                    yield _batch([_decoded(*about, [p["number"] for p in parts], parts[-1]["total"], [p["block"] for p in parts], payloads)], schema)

    return whole.unionByName(grouped.select("parts").mapInArrow(join, schema))


def read_archives(spark: SparkSession, path: str, ids: str = "bigint") -> DataFrame:
    """Every response and revisit under `path`, reassembled."""
    return reassemble(read_records(spark, path, ids=ids))
