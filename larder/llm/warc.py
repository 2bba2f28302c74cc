"""WARC archives of fetched pages as a chunked record table, and the way back.

A record is stored as rows of at most ``chunk_bytes`` of its payload: record id, chunk number, the bytes, and the SHA-1 of
the payload up to and with this chunk. The first row also has the record's header, so the rows of a record, put end to
end, are a WARC record. Neither writing nor reading builds a whole record beside the page it came from: writing hands on views of the page
chunk by chunk, reading feeds chunk by chunk to one running digest per record and checks it against each row and the header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.skew import with_group
from larder.llm.words import utf8
from larder.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 16
ROWS_PER_BATCH = 64

CHUNKS = "record_id string, chunk_no int, last boolean, header binary, content binary, sha1 binary"
_ARROW_CHUNKS = pa.schema(
    [
        ("record_id", pa.string()),
        ("chunk_no", pa.int32()),
        ("last", pa.bool_()),
        ("header", pa.binary()),
        ("content", pa.binary()),
        ("sha1", pa.binary()),
    ]
)
RECORDS = "page_id long, source_url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, sha1, refers_to)`` of the pages whose payload another page with a larger id has too."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    keyed = keyed.filter(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes)).select("page_id", "sha1")
    groups = keyed.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("group_rows"))
    return with_group(keyed, groups.filter("group_rows > 1"), ["sha1"], pages.count()).filter("page_id < refers_to").distinct()


def archive_pages(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of one WARC record per page.

    ``pages``: ``page_id``, ``source_url`` and ``html`` (null: an empty payload); other columns are ignored. Of
    pages with equal payloads of at least ``least_bytes`` bytes, that with the largest id is a response, those with smaller ids are revisits
    of it without payload. Shorter payloads, pages without an id and repeated rows of one id are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    full = pages.select(
        F.col("page_id").cast("long"), F.col("source_url").cast("string"), html.alias("html"), F.sha1(html).alias("sha1")
    )
    decided = full.join(revisits(pages, least_bytes), ["page_id", "sha1"], "left")
    return decided.select("page_id", "source_url", "refers_to", "html").mapInArrow(partial(_write, chunk_bytes), CHUNKS)


def read_archive(chunks: DataFrame, records: int | None = None) -> DataFrame:
    """One row per record of :func:`archive_pages`.

    A payload that does not match its digest or length, or a record without one of its chunks, stops the job; with ``records``, the number
    that the archive must hold, so does a record that is missing as a whole. Records of one chunk are read where they lie, only the
    chunks of longer ones are brought together, in order.
    """
    if records is not None and (held := chunks.filter("last").count()) != records:
        raise ValueError(f"the archive holds {held} records instead of {records}")
    single = chunks.filter("chunk_no = 0 and last")
    longer = chunks.filter("not (chunk_no = 0 and last)").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return single.mapInArrow(_read, RECORDS).unionByName(longer.mapInArrow(_read, RECORDS))


def archived_pages(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write all pages to a new archive in the shared folder and read it back, one row per page.

    ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) are those of the full payload, also for revisits; ``refers_to`` is the page
    that a revisit points to. An empty table gives an empty archive and no rows.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive_pages(pages, least_bytes, chunk_bytes).write.parquet(f"{folder}/chunks", compression="zstd")
    # the number of records is part of the archive
    spark.createDataFrame([(pages.count(),)], "records long").coalesce(1).write.parquet(f"{folder}/count")
    return open_archive(spark, folder)


def open_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive that :func:`archived_pages` wrote, checked against the number kept with it."""
    records = spark.read.schema("records long").parquet(f"{folder}/count").first()["records"]
    return read_archive(spark.read.schema(CHUNKS).parquet(f"{folder}/chunks"), records)


def _escaped(address: str) -> str:
    """No line may end inside a header field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", address)


def _header(page_id, address, digest: bytes, size: int, refers_to) -> tuple[str, bytes]:
    code = base64.b32encode(digest).decode()
    record_id = f"urn:page:{'' if page_id is None else page_id}:{code}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Payload-Digest: sha1:{code}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {size if refers_to is None else 0}",
    ]
    if address is not None:
        lines.append(f"WARC-Target-URI: {_escaped(address)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}:{code}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return record_id, ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(chunk_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        data, offsets = utf8(batch.column("html"))
        page_ids, addresses, refers = (batch.column(c).to_pylist() for c in ("page_id", "source_url", "refers_to"))
        for k in range(batch.num_rows):
            payload = memoryview(data[offsets[k] : offsets[k + 1]])
            record_id, header = _header(page_ids[k], addresses[k], hashlib.sha1(payload).digest(), len(payload), refers[k])
            # rows of one id with one payload stay two records
            record_id = f"{record_id}:{uuid.uuid4().hex}" if len(payload) > chunk_bytes else record_id
            body = payload if refers[k] is None else payload[:0]
            running = hashlib.sha1()
            for no, low in enumerate(range(0, max(1, len(body)), chunk_bytes)):
                part = body[low : low + chunk_bytes]
                running.update(part)
                last = low + chunk_bytes >= len(body)
                rows.append((record_id, no, last, header if no == 0 else b"", bytes(part) + (b"\r\n\r\n" if last else b""), running.digest()))
                if len(rows) >= ROWS_PER_BATCH:
                    yield _batch(rows, _ARROW_CHUNKS)
                    rows = []
    if rows:
        yield _batch(rows, _ARROW_CHUNKS)


_ARROW_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("source_url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fields(header: bytes) -> dict[str, str]:
    version, *lines = header.decode().removesuffix("\r\n\r\n").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return dict(line.split(": ", 1) for line in lines)


def _page_of(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields, running, size, due = {}, None, 0, 0
    for batch in batches:
        rows = []
        for chunk_no, last, header, content, sha1 in zip(
            *(batch.column(c) for c in ("chunk_no", "last", "header", "content", "sha1")), strict=True
        ):
            if chunk_no.as_py() != due:
                raise ValueError("a chunk of a record is missing")
            if due == 0:
                fields, running, size = _fields(header.as_py()), hashlib.sha1(), 0
            due = 0 if last.as_py() else due + 1
            part = memoryview(content.as_buffer())
            part = part[:-4] if due == 0 else part
            running.update(part)
            size += len(part)
            if running.digest() != sha1.as_py():
                raise ValueError(f"record {fields['WARC-Record-ID']}: the content does not match the running digest")
            if due:
                continue
            code = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = fields["WARC-Type"]
            if size != int(fields["Content-Length"]) or kind == "response" and base64.b32encode(running.digest()).decode() != code:
                raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its header")
            refers = fields.get("WARC-Refers-To")
            rows.append(
                (
                    _page_of(fields["WARC-Record-ID"]),
                    fields.get("WARC-Target-URI"),
                    int(fields["X-Payload-Length"]),
                    code,
                    kind,
                    None if refers is None else _page_of(refers),
                )
            )
        yield _batch(rows, _ARROW_RECORDS)
    if due:
        raise ValueError(f"record {fields['WARC-Record-ID']}: its last chunk is missing")
