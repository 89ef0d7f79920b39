"""WARC archives as seekable Zstandard bundles.

Pages with equal payloads of a least size are found by length and SHA-1 digest; the one with the largest id is
stored, the others become revisit records that name it. Each task writes bundles: records are grouped into
independent frames of a bounded size, and a seek table of all frames closes the bundle, in the skippable frame
that the seekable format defines, so any Zstandard reader still reads the bundle as one stream. The index maps
a record's id to bundle, frame, and place in the decompressed frame: reading one record costs the table, one
seek and one frame.

Defined results: a null payload is empty; a null page id is written without an id and is no target of
revisits, so such pages are all responses; rows that repeat a page id are written as records of their own, and
of equal payloads the one with the largest id and, among those, one arbitrary row is the response; control
characters in an address are percent-encoded, a null address is left out; an empty table gives no bundle.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneledger.llm import files

#: Bytes of records before compression at which a frame is closed, and of a bundle after compression.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
LEVEL = 3

# The seek table's frame, its footer, and the date that all records carry.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"

INDEX = ("page_id long, path string, frame int, offset long, length long, payload_bytes long, payload_digest string, "
         "record_type string, refers_to long")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit has the headers of its payload, but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Payload-Length", str(size)), ("Content-Type", "text/html; charset=utf-8")]
    if page_id is not None:
        head.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        head.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        payload = b""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head], f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and the place after it."""
    end = raw.index(b"\r\n\r\n", at)
    version, *lines = raw[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    size = int(head["Content-Length"])
    return head, raw[end + 4:end + 4 + size], end + 8 + size


class BundleWriter:
    """Frames of one bundle, and the places of the records in them."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self._zstd, self._least = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), frame_bytes
        self.frames: list[bytes] = []
        self._sizes: list[int] = []
        self._open, self._size, self.bytes = [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Append a record; its frame and its offset in the decompressed frame."""
        place = len(self.frames), self._size
        self._open.append(raw)
        self._size += len(raw)
        if self._size >= self._least:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self._open:
            self.frames.append(self._zstd.compress(b"".join(self._open)))
            self._sizes.append(self._size)
            self.bytes += len(self.frames[-1])
            self._open, self._size = [], 0

    def parts(self) -> list[bytes]:
        """The bundle: all frames, then the seek table."""
        self.close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self._sizes))
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return [*self.frames, struct.pack("<II", SKIPPABLE, len(table) + len(footer)), table, footer]


class Bundle:
    """A bundle opened for reading by frame."""

    def __init__(self, path: str):
        self._file, self._zstd = files.open_file(path), zstandard.ZstdDecompressor()
        size = self._file.size()
        self._file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self._file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {path}")
        self._file.seek(size - 9 - 8 * n)
        table = struct.unpack(f"<{2 * n}I", self._file.read(8 * n))
        self.places, at = [], 0
        for stored, whole in zip(table[::2], table[1::2]):
            self.places.append((at, stored, whole))
            at += stored

    def frame(self, number: int) -> bytes:
        at, stored, whole = self.places[number]
        self._file.seek(at)
        return self._zstd.decompress(self._file.read(stored), max_output_size=whole)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for number in range(len(self.places)):
            raw, at = self.frame(number), 0
            while at < len(raw):
                head, block, at = parse(raw, at)
                yield head, block


def _payload(payload: str) -> tuple[Column, Column]:
    """Size and digest of a payload."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    return F.length(body).cast("long").alias("size"), F.sha1(body).alias("digest")


def plan(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Payloads of ids that are revisits: ``page_id, size, digest, refers_to``. Pages with equal payloads meet as counts and ids only."""
    seen = pages.select(F.col(key).cast("long").alias("page_id"), *_payload(payload)).where(f"size >= {least_bytes} AND page_id IS NOT NULL")
    repeated = seen.groupBy("size", "digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    named = seen.join(repeated.where("n > 1").drop("n"), ["size", "digest"])
    return named.where("page_id <> refers_to").select("page_id", "size", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
          least_bytes: int = 1000, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages as bundles; the index, one row per record. Write the index before using it."""
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]
        path, bundle, rows = files.fresh_file(folder, ".warc.zst"), BundleWriter(frame_bytes), []

        def closed() -> pa.RecordBatch:
            files.write_file(path, *bundle.parts())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, address, text, refers_to in zip(*columns):
                body = (text or "").encode()
                digest = hashlib.sha1(body).hexdigest()
                raw = record(page_id, address, body, digest, len(body), refers_to)
                frame, offset = bundle.add(raw)
                rows.append((page_id, path, frame, offset, len(raw), len(body), digest,
                             "response" if refers_to is None else "revisit", refers_to))
                if bundle.bytes >= bundle_bytes:
                    yield closed()
                    path, bundle, rows = files.fresh_file(folder, ".warc.zst"), BundleWriter(frame_bytes), []
        if rows:
            yield closed()

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(payload).alias("payload"), *_payload(payload))
    # An id may come with several payloads, each with a plan of its own.
    return rows.join(plan(pages, key, payload, least_bytes), ["page_id", "size", "digest"], "left").select(
        "page_id", "url", "payload", "refers_to").mapInArrow(indexed, INDEX)


def _row(head: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(head[name][10:-1]) if name in head else None
    size, digest = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"][5:]
    if head["WARC-Type"] == "response" and (len(block), hashlib.sha1(block).hexdigest()) != (size, digest):
        raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
    return (number("WARC-Record-ID"), size, digest, head["WARC-Type"], number("WARC-Refers-To"),
            head.get("WARC-Target-URI"), block)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in RECORDS.split(", ")])


def read(index: DataFrame) -> DataFrame:
    """All records of the indexed bundles, frame by frame; the payload of each response is checked."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                found, size = [], 0
                for head, block in Bundle(path).records():
                    found.append(_row(head, block))
                    size += len(block)
                    if size >= FRAME_BYTES:
                        yield _records(found)
                        found, size = [], 0
                yield _records(found)

    cores = index.sparkSession.sparkContext.defaultParallelism
    return index.select("path").distinct().repartition(4 * cores).mapInArrow(rows, RECORDS)


def look_up(index: DataFrame, ids: DataFrame, key: str = "page_id") -> DataFrame:
    """Records of the given ids, each by one seek to its frame. Unknown and null ids give no row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None, None, b"")
        for batch in batches:
            found = []
            for path, frame, offset in zip(*(batch[c].to_pylist() for c in ("path", "frame", "offset"))):
                if opened[0] != path:
                    opened = (path, Bundle(path), None, b"")
                if opened[2] != frame:
                    opened = (path, opened[1], frame, opened[1].frame(frame))
                head, block, _ = parse(opened[3], offset)
                found.append(_row(head, block))
            yield _records(found)

    wanted = ids.select(F.col(key).cast("long").alias("page_id")).distinct()
    places = index.join(wanted, "page_id", "left_semi").select("path", "frame", "offset")
    return places.sortWithinPartitions("path", "frame", "offset").mapInArrow(rows, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, fresh_dir: Callable[[SparkSession, str], str], **parameters) -> DataFrame:
    """Write the bundles and their index to new shared folders and read every record back."""
    folder, index = fresh_dir(spark, "bundles"), fresh_dir(spark, "bundle-index")
    write(pages, folder, **parameters).write.parquet(index)
    return read(spark.read.schema(INDEX).parquet(index))
