"""Packing of documents into sequences by exact complements, then best fit.

Only documents longer than a sequence are cut. The plan needs no documents, only the number of pieces of each
length, a list of at most ``capacity`` numbers that the driver holds. For the longest length that is left, the
gap beside it is filled exactly by one, two or three further pieces, found through the lengths and the sums of
two lengths that are available; a combination is used as often as its pieces last. What no combination
completes is placed by best fit: longest first, into the fullest sequence that still has room. The plan is a
list of slots for each length, each for a run of pieces; a piece finds its slot by its number among the
pieces of its length. Numbers are given without gathering a length in one task: pieces are counted by length
and chunk of keys, and numbered within them.

Defined results: a null text is an empty document, which holds its end id alone; rows that repeat a key are
packed as documents of their own; equal lengths are numbered by key, then piece; a null key sorts first; an
empty table gives no piece. Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tuneledger.llm.words import word_encoder

CAPACITY = 2048
#: Pieces that are numbered together, on average.
CHUNK_PIECES = 1000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"


def cut(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
        capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``tie`` tells rows with equal keys apart, ``ids`` holds the ids where wanted."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for k, t, tie in zip(*(batch[c].to_pylist() for c in ("key", "text", "tie"))):
                ids = encoder.encode(t) + end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((k, i, at // 4, len(part) // 4, zlib.crc32(part), tie, part))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "tie"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in columns[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("tie"))
    return rows.mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


class Plan:
    """Slots for the pieces of each length: from piece number ``since`` on, sequence and offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.used: dict[int, int] = dict.fromkeys(self.left, 0)
        self.slots: dict[int, list[tuple[int, int, int]]] = {n: [] for n in self.left}
        self.capacity, self.sequences = capacity, 0
        self._index(self.left)
        self._complete()
        self._best_fit()

    def _index(self, lengths) -> None:
        """Available lengths as bits, and as bits of their complements: a shift of these gives all pairs of a sum."""
        self._single = sum(1 << n for n in lengths)
        self._complement = sum(1 << (self.capacity - n) for n in lengths)

    def _spend(self, n: int) -> int:
        """Take a length out of the index; what is left of it."""
        self._single &= ~(1 << n)
        self._complement &= ~(1 << (self.capacity - n))
        return self.left.pop(n)

    def _place(self, lengths: tuple[int, ...], times: int) -> int:
        """``times`` sequences that begin with these lengths; the number of the first."""
        first, at = self.sequences, 0
        for n in lengths:
            self._slot(n, first, at, times)
            at += n
        self.sequences += times
        return first

    def _slot(self, n: int, sequence: int, at: int, times: int) -> None:
        self.slots[n].append((self.used[n], sequence, at))
        self.used[n] += times
        self.left[n] -= times
        if not self.left[n]:
            self._spend(n)

    def _times(self, lengths: tuple[int, ...]) -> int:
        """How often a combination can be taken."""
        return min(self.left.get(n, 0) // lengths.count(n) for n in lengths)

    def _filled(self, begun: tuple[int, ...], gap: int, most: int) -> tuple[int, ...] | None:
        """The lengths begun, with the pair that fills the gap and whose larger length, at most ``most``, is largest."""
        larger = self._single & (self._complement >> (self.capacity - gap)) & ((1 << (min(most, gap) + 1)) - 1)
        while larger:
            n = larger.bit_length() - 1
            if 2 * n < gap:
                return None
            if self._times(whole := (*begun, n, gap - n)) > 0:
                return whole
            larger ^= 1 << n
        return None

    def _filling(self, longest: int) -> tuple[int, ...] | None:
        """A combination of the longest piece that fills a sequence exactly: alone, with one, two or three more."""
        gap = self.capacity - longest
        if not gap:
            return (longest,)
        if self._times((longest, gap)) > 0:
            return longest, gap
        if pair := self._filled((longest,), gap, gap):
            return pair
        thirds = self._single & ((1 << gap) - 1)
        while thirds and 3 * (third := thirds.bit_length() - 1) >= gap:
            if triple := self._filled((longest, third), gap - third, third):
                return triple
            thirds ^= 1 << third
        return None

    def _complete(self) -> None:
        """Take exact combinations, the longest length first; set aside lengths that no combination completes."""
        aside: dict[int, int] = {}
        while self._single:
            longest = self._single.bit_length() - 1
            if filling := self._filling(longest):
                self._place(filling, self._times(filling))
            else:
                aside[longest] = self._spend(longest)
        self.left = aside
        self._index(aside)

    def _best_fit(self) -> None:
        """Place what is left, the longest first, into the fullest sequence with room; runs are placed together."""
        rooms: list[int] = []  # sorted rooms of runs of sequences
        runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)

        def opened(room: int, first: int, times: int) -> None:
            if room not in runs:
                rooms.insert(bisect_left(rooms, room), room)
                runs[room] = []
            runs[room].append((first, times))

        while self._single:
            n = self._single.bit_length() - 1
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = min(self.capacity // n, self.left[n])
                times = self.left[n] // each
                opened(self.capacity - each * n, self._place((n,) * each, times), times)
                continue
            room = rooms[at]
            first, there = runs[room].pop()
            times = min(there, self.left[n])
            self._slot(n, first, self.capacity - room, times)
            if times < there:
                runs[room].append((first + times, there - times))
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            if room > n:
                opened(room - n, first, times)


def place(pieces: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """Sequence and offset of every piece. The pieces are read three times: give them as a written table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity)
    chunks = max(1, sum(counts.values()) // chunk_pieces)
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(chunks)))
    # A length has as many rows here as there are chunks, at most one for a thousand pieces.
    sizes = chunked.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "tie")
    kept = [c for c in pieces.columns if c != "tie"]
    numbered = chunked.withColumn("number", F.row_number().over(within) - 1).join(bases, ["length", "chunk"]).select(
        *kept, (F.col("base") + F.col("number")).alias("number"))
    slots = {n: np.array(s, dtype=np.int64).T for n, s in plan.slots.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                since, first, at = slots[int(n)]
                run = np.searchsorted(since, number[rows], side="right") - 1
                sequence[rows], offset[rows] = first[run] + number[rows] - since[run], at[run]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(sequence), pa.array(offset)],
                                             [*kept, "sequence_id", "offset"])

    schema = pieces.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(placed, schema)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, fresh_dir: Callable[[SparkSession, str], str],
         capacity: int = CAPACITY, **columns) -> DataFrame:
    """Cut and place all documents; the pieces go through a new shared folder."""
    folder = fresh_dir(spark, "pieces")
    cut(docs, vocabulary, capacity=capacity, **columns).write.parquet(folder)
    return place(spark.read.schema(PIECES).parquet(folder), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences of placed pieces that carry ``ids``: their ids, and the first offset of each document."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"))
