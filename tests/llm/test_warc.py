from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import zstandard
from compare import connect, difference
from tuneledger.llm import files, queries, warc
from tuneledger.session import fresh_dir

BIG, OTHER = "é" * 600, "z" * 1000
ROWS = [(1, "http://a/", BIG), (5, "http://b/\r\nX: y", BIG), (3, None, BIG), (4, "u", OTHER), (6, "u", "z" * 999),
        (7, "u", "z" * 999), (8, "u", None), (9, "u", ""), (None, "u", BIG), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 200),
        (11, "u", OTHER), (11, "u", OTHER), (12, "u", "y" * 3_000_000)]


@pytest.fixture
def pages(spark):
    def made(rows):
        schema = "page_id long, url string, html string, refers_to long, payload string, path string, digest string"
        return spark.createDataFrame([(*r, 1, "p", "q", "d") for r in rows], schema)
    return made


def expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = best.get(h) if i is not None and h in best and best[h] != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to))
    return Counter(out)


def digests(frame):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in frame.collect())


@pytest.mark.parametrize("frame_bytes", [1, 1000, 1 << 20])
def test_round_trip(spark, pages, frame_bytes):
    out = warc.archive(spark, pages(ROWS), fresh_dir, frame_bytes=frame_bytes, bundle_bytes=2000)
    assert digests(out) == expected(ROWS)
    body = {(r["page_id"], r["record_type"]): bytes(r["payload"]) for r in out.collect()}
    assert body[10, "response"] == ROWS[9][2].encode() and body[1, "revisit"] == b""


def test_look_up_and_foreign_reader(spark, pages):
    folder, index = fresh_dir(spark, "b"), fresh_dir(spark, "i")
    warc.write(pages(ROWS), folder, frame_bytes=1500).write.parquet(index)
    stored = spark.read.schema(warc.INDEX).parquet(index)
    asked = spark.createDataFrame([(5,), (3,), (3,), (99,), (None,)], "page_id long")
    found = {r["page_id"]: r for r in warc.look_up(stored, asked).collect()}
    assert set(found) == {3, 5} and bytes(found[5]["payload"]) == BIG.encode() and found[3]["refers_to"] == 5
    assert "\r" not in found[5]["url"] and found[3]["url"] is None
    for (path,) in stored.select("path").distinct().collect():
        raw = zstandard.ZstdDecompressor().stream_reader(files.read_file(path), read_across_frames=True).read()
        assert raw.startswith(b"WARC/1.1\r\n")


def test_empty(spark, pages):
    assert warc.archive(spark, pages([]), fresh_dir).count() == 0


def test_sql(spark, folder):
    found = queries.queries()["op6_warc"](spark, folder)
    assert difference(connect(folder), queries.oracle_sql()["op6_warc"], found) is None


def test_an_id_with_two_payloads(spark, pages):
    other = "b" * 1200
    rows = [(1, "u", BIG), (1, "u", other), (5, "u", BIG)]
    for some in (rows, [*rows, (6, "u", other)]):
        out = warc.archive(spark, pages(some), fresh_dir)
        assert digests(out) == expected(some)
        assert {bytes(r["payload"]) for r in out.collect() if r["record_type"] == "response"} == {BIG.encode(), other.encode()}
