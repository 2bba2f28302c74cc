import base64
import hashlib

import pytest
from pyspark.errors import PythonException

from larder.llm.warc import archive_pages, archived_pages, read_archive

PAGES = "page_id long, source_url string, html string"
BIG = "".join(f"<p>{k} é</p>" for k in range(3000))
ROWS = [
    (1, "http://a.ch/", "<p>x</p>"), (2, "http://b.ch/", "<p>x</p>"), (3, "http://c.ch/ a\r\nWARC-Type: fake", BIG), (9, None, BIG), (4, "http://d.ch", None),
    (5, "http://e.ch", ""), (None, "http://f.ch", BIG), (7, "http://g.ch", "only"), (7, "http://g.ch", "only"), (7, "http://g2.ch", "other\r\n\r\n"),
]


def brute(rows, least):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "").encode() == data]
        last = max(same, default=None)
        revisit = i is not None and len(data) >= least and i < last
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 16), (1, 100), (5, 7)])
def test_round_trip(spark, least, chunk):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], PAGES + ", refers_to string")
    got = archived_pages(pages, least, chunk).drop("source_url").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ROWS, least)


def test_hot_payload_and_empty_table(spark):
    rows = [(k, f"http://x.ch/{k}", "same" if k % 3 else f"own {k}") for k in range(900)]
    pages = spark.createDataFrame(rows, PAGES)
    got = archived_pages(pages).drop("source_url").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 0)
    assert archived_pages(pages.limit(0)).count() == 0


def test_rows_are_a_warc_stream_with_running_digests(spark):
    pages = spark.createDataFrame([(3, "http://c.ch/", BIG)], PAGES)
    rows = sorted(archive_pages(pages, chunk_bytes=1000).collect(), key=lambda r: r.chunk_no)
    assert len(rows) > 10 and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    stream = b"".join(bytes(r.header) + bytes(r.content) for r in rows)
    head, body = stream.split(b"\r\n\r\n", 1)
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    assert body == BIG.encode() + b"\r\n\r\n" and int(fields[b"Content-Length"]) == len(BIG.encode())
    seen = hashlib.sha1()
    for r in rows:
        seen.update(bytes(r.content).removesuffix(b"\r\n\r\n") if r.last else bytes(r.content))
        assert bytes(r.sha1) == seen.digest()


def test_damage_is_noticed(spark):
    pages = spark.createDataFrame([(3, "http://c.ch/", BIG)], PAGES)
    chunks = archive_pages(pages, chunk_bytes=1000)
    for broken in (chunks.filter("chunk_no != 4"), chunks.selectExpr("record_id", "chunk_no", "last", "header", "reverse(content) as content", "sha1")):
        with pytest.raises(PythonException):
            read_archive(broken).collect()


def test_missing_ends_and_records_are_noticed(spark):
    pages = spark.createDataFrame([(3, "http://c.ch/", BIG), (4, "http://d.ch/", "kurz"), (5, "http://e.ch/", BIG[1:])], PAGES)
    chunks = archive_pages(pages, chunk_bytes=1000)
    long = "record_id like '%page:3:%'"
    for broken in (chunks.filter(f"not ({long} and last)"), chunks.filter(f"not ({long} and chunk_no = 0)"), chunks.filter(f"{long} and not last")):
        with pytest.raises(PythonException):
            read_archive(broken).collect()
    assert read_archive(chunks, 3).count() == 3
    with pytest.raises(ValueError):
        read_archive(chunks.filter("record_id not like '%page:4:%'"), 3)
