"""Token-id shards with a minimal perfect hash index per shard.

Documents are range-partitioned by key, so that shards follow each other in ascending key order.
A task encodes its documents and writes shards of bounded size: the raw ids of all documents one
after the other, and an index. The index holds, without any hash chains, a minimal perfect hash
function from key to slot; a slot holds a fingerprint of its key and the first row of the key, and
the row table holds the place of each row in the payload. A look-up therefore costs one evaluation
of the function, one comparison and one seek. A key that the shard lacks fails on its fingerprint
except in one of 2**32 cases, and then on the stored key.

Ids are stored as unsigned integers of ``width`` bytes: 2 where the vocabulary allows it, else 4.

Defined results: a null text is an empty document; a null key sorts first, is stored and listed but
cannot be looked up; rows that repeat a key are all stored, next to each other, and a look-up
gives all of them; an empty table gives an empty manifest. Only the two named columns are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tuneledger.llm import files
from tuneledger.llm.words import word_encoder

MAGIC = b"TLIDS001"
#: Payload bytes at which a task starts its next shard.
SHARD_BYTES = 32 << 20
#: Bits per key of a level of the hash function; more bits, fewer levels.
LEVEL_LOAD = 2
MAX_LEVELS = 40

MANIFEST = "part int, shard int, path string, n_rows long, n_ids long, first_key long, last_key long"
ROWS = "key long, start long, n_tokens long, ids_crc32 long"


# --- minimal perfect hash -----------------------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit mix of unsigned keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Levels of bits: a key belongs to the first level where no other remaining key met it."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self._ranks, at = [], 0
        for bits in levels:
            self._ranks.append(at + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            at = int(self._ranks[-1][-1])
        self._rest_at = at

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct unsigned keys. Keys left after the last level (practically none) are kept sorted."""
        levels, left = [], keys.astype(np.uint64)
        while len(left) and len(levels) < MAX_LEVELS:
            size = max(8, LEVEL_LOAD * len(left))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or the slot of another key, for keys outside the built set."""
        keys = keys.astype(np.uint64)
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[left[hit]] = self._ranks[level][at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            found[left[hit]] = self._rest_at + at[hit]
        return found


# --- shards -------------------------------------------------------------------------------

def _write_shard(folder: str, keys: list[int | None], lengths: list[int], payload: list[bytes], width: int) -> str:
    nulls = sum(key is None for key in keys)
    known = np.array([key for key in keys if key is not None], dtype="<i8")
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<u8")
    distinct, first = np.unique(known, return_index=True)
    unsigned = distinct.view(np.uint64)
    function = PerfectHash.build(unsigned)
    slots = function.slots(unsigned)
    prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slots], rows[slots] = fingerprints(unsigned), first + nulls
    sections = [known.tobytes(), starts.tobytes(), prints.tobytes(), rows.tobytes(),
                *[np.packbits(bits).tobytes() for bits in function.levels], function.rest.astype("<u8").tobytes()]
    header = json.dumps({"width": width, "nulls": nulls, "rows": len(keys), "bits": [len(b) for b in function.levels],
                         "sections": [len(s) for s in sections]}).encode()
    path = files.fresh_file(folder, "")
    files.write_file(f"{path}.ids", MAGIC, *payload)
    files.write_file(f"{path}.index", MAGIC, len(header).to_bytes(8, "little"), header, *sections)
    return path


class Shard:
    """One shard opened for reading."""

    def __init__(self, path: str):
        raw = files.read_file(f"{path}.index")
        if raw[:8] != MAGIC:
            raise ValueError(f"not an index: {path}")
        size = int.from_bytes(raw[8:16], "little")
        header = json.loads(raw[16:16 + size])
        at, parts = 16 + size, []
        for length in header["sections"]:
            parts.append(raw[at:at + length])
            at += length
        self.width, self.nulls, self.rows = header["width"], header["nulls"], header["rows"]
        self.keys, self.starts = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u8").astype(np.int64)
        self._prints, self._first = np.frombuffer(parts[2], "<u4"), np.frombuffer(parts[3], "<u4").astype(np.int64)
        levels = [np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool)
                  for p, n in zip(parts[4:-1], header["bits"])]
        self._function = PerfectHash(levels, np.frombuffer(parts[-1], "<u8"))
        self._payload = files.open_file(f"{path}.ids")

    def row_of(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key by the hash function, -1 where the shard lacks the key."""
        slots = self._function.slots(keys.view(np.uint64))
        if not len(self._first):
            return np.full(len(keys), -1, np.int64)
        rows = np.where(slots >= 0, self._first[slots], -1)
        there = (slots >= 0) & (self._prints[slots] == fingerprints(keys.view(np.uint64)))
        there &= self.keys[np.maximum(rows - self.nulls, 0)] == keys
        return np.where(there, rows, -1)

    def last_row(self, key: int) -> int:
        """Row after the last one of a key."""
        return self.nulls + int(np.searchsorted(self.keys, key, side="right"))

    def ids(self, row: int) -> np.ndarray:
        """Ids of a row by one seek, as unsigned 32-bit integers."""
        self._payload.seek(len(MAGIC) + int(self.starts[row]) * self.width)
        raw = self._payload.read(int(self.starts[row + 1] - self.starts[row]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start in the shard and ids of every row, each found through its key."""
        for row in range(self.nulls):
            yield None, int(self.starts[row]), self.ids(row)
        first = self.row_of(self.keys)
        for place, key in enumerate(self.keys.tolist()):
            row = int(first[place])
            if row < 0:
                raise ValueError(f"key {key} is listed but not indexed")
            row += place + self.nulls - row if place and self.keys[place - 1] == key else 0
            yield key, int(self.starts[row]), self.ids(row)


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
          width: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode the documents, each followed by ``end_id``, and write the shards; the manifest, one row per shard.

    Equal keys are ordered by a hash of their text. The manifest must be written before it is used: every
    evaluation writes the shards anew.
    """
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        keys, lengths, payload, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            path = _write_shard(folder, keys, lengths, payload, width)
            known = [k for k in keys if k is not None] or [None]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "path": [path],
                "n_rows": [len(keys)], "n_ids": [sum(lengths)], "first_key": pa.array([known[0]], pa.int64()),
                "last_key": pa.array([known[-1]], pa.int64())})

        for batch in batches:
            for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                ids = np.frombuffer(encoder.encode(t), "<u4").astype(f"<u{width}").tobytes() + end
                keys.append(k)
                lengths.append(len(ids) // width)
                payload.append(ids)
                size += len(ids)
                if size >= shard_bytes:
                    yield closed()
                    number, size = number + 1, 0
                    keys, lengths, payload = [], [], []
        if keys:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    return rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie).mapInArrow(shards, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: key, ids before it in all shards, number of ids, crc32 of its ids.

    The starts of the shards are summed up over the manifest, which has a row per ``SHARD_BYTES``.
    """
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                found = [(k, base + s, len(i), zlib.crc32(i.tobytes())) for k, s, i in Shard(path).documents()]
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["key", "start", "n_tokens", "ids_crc32"])

    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return placed.select("path", "base").repartition(4 * cores).mapInArrow(rows, ROWS)


def look_up(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the rows of the given keys: ``key, ids``. Keys that no shard has, and null, give no row."""
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for batch in batches:
            found: list[tuple[int, list[int]]] = []
            for path, k in zip(batch["path"].to_pylist(), batch["key"].to_pylist()):
                if path not in shards:
                    shards = {path: Shard(path)}  # rows come sorted by shard: one is open at a time
                shard = shards[path]
                if (row := int(shard.row_of(np.array([k], np.int64))[0])) >= 0:
                    found += [(k, shard.ids(r).tolist()) for r in range(row, shard.last_row(k))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                ["key", "ids"])

    low, high, shards_of = manifest.agg(F.min("first_key"), F.max("last_key"), F.count("first_key")).first()
    # As many key ranges as shards: consecutive shards overlap at most twice as many ranges together.
    step = max(1, ((high or 0) - (low or 0)) // max(1, shards_of) + 1)
    ranged = lambda c: F.expr(f"({c} - {low or 0}L) div {step}L")
    directory = manifest.where("first_key IS NOT NULL").select("path", "first_key", "last_key", F.explode(
        F.sequence(ranged("first_key"), ranged("last_key"))).alias("range"))
    wanted = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("range", ranged("key"))
    placed = directory.join(wanted, "range").where(F.col("key").between(F.col("first_key"), F.col("last_key")))
    return placed.select("path", "key").sortWithinPartitions("path").mapInArrow(ids, "key long, ids array<long>")


def store_and_read(spark: SparkSession, docs: DataFrame, vocabulary: str, fresh_dir: Callable[[SparkSession, str], str],
                   **parameters) -> DataFrame:
    """Write the shards and their manifest to new shared folders and read every document back."""
    folder, manifest = fresh_dir(spark, "token-shards"), fresh_dir(spark, "token-manifest")
    write(docs, folder, vocabulary, **parameters).write.parquet(manifest)
    return read(spark.read.schema(MANIFEST).parquet(manifest))
