"""Importance resampling towards a target: documents drawn without replacement by how much their n-grams favour it.

Features are the runs of one and two words of a text, dealt into a fixed number of buckets by their checksum. The
log-ratio of a bucket's share of the target texts to its share of all documents is its gain, a document weighs the
mean gain of its features, and a Gumbel number from the hash of its id makes the highest scores a weighted draw.

- Counting and weighing work on whole Arrow batches as arrays of bytes: words are found by a table of bytes, and the
  checksums of all words of a batch advance together, one byte of each a step. Counts are summed in each task before
  the shuffle, so a frequent word costs one row per task; one number per bucket goes to the driver, a fixed size.
- The draw looks for the key of the last document drawn, not for a sorted table. Each task tells the median and the
  number of the keys that are left in each of its chunks; the median of these medians, weighted by the numbers, has
  at least a quarter of what is left on either side, so each round discards that much, until few enough are left to sort.
  A folder of keys is written anew when most of it is discarded, so all rounds together read a small multiple of the keys.
- Only the winners are sorted, by range, and numbered from the row counts of the ranges.

Defined cases, for ``documents`` and target alike: a null or empty text has no word and no feature and weighs 0;
equal rows are drawn one by one; rows of one id and unlike texts with equal scores come in the order of their numbers
of features; a null id is hashed as an empty one and comes after all others; empty tables give empty results, an empty
target makes all gains equal up to rounding by bucket counts; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneledger.llm.checksum_sql import CRC_TABLE, crc32

#: Buckets of features, the share drawn in percent, and the words that a document must have to be drawn.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7

#: Bytes of text worked on at once (a longer text counts as one); bytes of a word that advance with those of others.
_PIECE, _LOCKSTEP = 2 << 20, 64
#: Keys of a chunk whose median a task tells; keys left that the driver sorts.
_CHUNK, _FEW = 1_000_000, 4_096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = True
for _first, _last in ("09", "az", "AZ"):
    _IN_WORD[ord(_first):ord(_last) + 1] = True


def _byte_remainders() -> np.ndarray:
    """CRC-32 of single bytes by its reflected polynomial."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & 1, (found >> 1) ^ np.uint32(0xEDB88320), found >> 1)
    return found


_REMAINDERS = _byte_remainders()


def _advanced(data: np.ndarray, start: np.ndarray, length: np.ndarray, register: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each word, all words together."""
    order = np.argsort(-np.minimum(length, _LOCKSTEP), kind="stable")
    at, left, out = start[order], length[order], register[order]
    short = np.minimum(left, _LOCKSTEP)
    for step in range(int(short[0]) if len(short) else 0):
        live = int(np.searchsorted(-short, -step, "left"))
        now = out[:live]
        out[:live] = _REMAINDERS[(now ^ data[at[:live] + step]) & 255] ^ (now >> np.uint32(8))
    for k in np.flatnonzero(left > _LOCKSTEP):
        rest = data[at[k] + _LOCKSTEP:at[k] + left[k]].tobytes()
        out[k] = zlib.crc32(rest, int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    found = np.empty_like(out)
    found[order] = out
    return found


def hashed(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, checksum of each feature, words per text) of texts that lie one behind the other.

    ``data`` are their UTF-8 bytes, ``ends`` the place behind the last byte of each.
    """
    texts = len(ends)
    data = _LOWER[data]
    inside = _IN_WORD[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    borders = ends[(ends > 0) & (ends < len(data))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    owner = np.searchsorted(ends, start, "right")
    words = np.bincount(owner, minlength=texts)
    fresh = np.full(len(start), 0xFFFFFFFF, np.uint32)
    single = _advanced(data, start, length, fresh)
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    before = single[second - 1]
    spaced = _REMAINDERS[(before ^ np.uint32(32)) & 255] ^ (before >> np.uint32(8))
    double = _advanced(data, start[second], length[second], spaced)
    return np.concatenate([owner, owner[second]]), ~np.concatenate([single, double]), words


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, ends) of runs of texts with some two megabytes each."""
    whole = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(whole):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + _PIECE, "right")) - 1)
        yield row, stop, data[ends[row]:ends[stop]], ends[row + 1:stop + 1] - ends[row]
        row = stop


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Features per bucket over all texts: one row for each bucket that occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, ends in _pieces(batch.column(0)):
                seen += np.bincount(hashed(data, ends)[1] % buckets, minlength=buckets)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(seen[held])], ["bucket", "n"])

    counted = texts.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, buckets: int) -> list[int]:
    """Counts as a list by bucket: one number for each of a fixed number of buckets."""
    found = [0] * buckets
    for row in counts.collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(source: list[int], target: list[int]) -> list[int]:
    """Floored thousandths of the log-ratio of a bucket's smoothed shares."""
    buckets, whole, wanted = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(((t + 1) * (whole + buckets)) / ((s + 1) * (wanted + buckets))))
            for s, t in zip(source, target)]


def _chance(key: int | None, seed: int) -> int:
    """A Gumbel number in thousandths from the hash of an id."""
    name = f"{seed}:{'' if key is None else key}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Numbers of words and features, weight and score of each document."""
    values, buckets = np.array(gain, np.int64), len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, features, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, stop, data, ends in _pieces(batch.column(1)):
                owner, checksum, n = hashed(data, ends)
                words[row:stop] = n
                features[row:stop] = np.bincount(owner, minlength=stop - row)
                # Sums of whole numbers far below 2 ** 53, hence exact.
                total[row:stop] = np.bincount(owner, values[checksum % buckets], stop - row).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            chance = np.array([_chance(k, seed) for k in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (words, features, weight, weight + chance))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    chosen = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return chosen.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


#: The order of the draw as four whole numbers, the best first; rows that agree in them agree in all columns.
_ORDER = ("less", "unnamed", "named", "size")


def _order() -> list[Column]:
    return [(-F.col("score")).alias("less"), F.col("doc_id").isNull().cast("long").alias("unnamed"),
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("named"), F.col("n_features").alias("size")]


def _before(keys: np.ndarray, other: tuple[int, ...]) -> np.ndarray:
    """Which rows of four columns come before a key."""
    less, same = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    for column, value in zip(keys.T, other):
        less |= same & (column < value)
        same &= column == value
    return less


def _middle(keys: np.ndarray) -> tuple[int, ...]:
    """The lower median of keys, which moves behind no more than it must sort."""
    return tuple(int(x) for x in keys[np.lexsort(keys.T[::-1])[(len(keys) - 1) // 2]])


def _parted(keys: DataFrame, above: tuple | None, below: tuple | None, pivot: tuple | None) -> list[tuple[list, int, list]]:
    """For each chunk of each task: (size, median) before the pivot, the number equal to it, (size, median) behind it.

    Only keys between ``above`` and ``below`` count; without a pivot all of them lie behind it.
    """
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.zeros((0, len(_ORDER)), np.int64)
            first = _before(rows, pivot) if pivot else np.zeros(len(rows), bool)
            equal = (rows == np.array(pivot)).all(axis=1) if pivot else np.zeros(len(rows), bool)
            sides = [rows[first], rows[~first & ~equal]]
            row = [x for side in sides for x in (len(side), *(_middle(side) if len(side) else (0,) * len(_ORDER)))]
            return pa.RecordBatch.from_arrays([pa.array([[*row, int(equal.sum())]], pa.list_(pa.int64()))], ["told"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
            if above:
                rows = rows[~_before(rows, above) & (rows != np.array(above)).any(axis=1)]
            if below:
                rows = rows[_before(rows, below)]
            held.append(rows)
            size += len(rows)
            if size >= _CHUNK:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    width = len(_ORDER) + 1
    found = [row["told"] for row in keys.select(*_ORDER).mapInArrow(part, "told array<long>").collect()]
    return [(told[:width], told[-1], told[width:2 * width]) for told in found]


def weighted_median(medians: list[list[int]]) -> tuple[int, ...]:
    """Of (size, median) pairs the median that has half of all sizes up to it."""
    half, seen = sum(size for size, *_ in medians) / 2, 0
    for size, *key in sorted(medians, key=lambda m: m[1:]):
        seen += size
        if size and seen >= half:
            return tuple(key)
    raise ValueError("no keys")


def cutoff(spark: SparkSession, keys: DataFrame, place: int, fresh: Callable[[str], str], few: int = _FEW) -> tuple[int, ...]:
    """The key at a place (from 1) of the order, by weighted medians of medians.

    ``keys`` has the four columns of the order and is read again each round, so it should be a written folder.
    """
    above = below = pivot = None
    parts = _parted(keys, above, below, pivot)
    left = held = sum(side[0] for _, _, side in parts)
    medians = [side for _, _, side in parts]
    while left > few:
        pivot = weighted_median(medians)
        parts = _parted(keys, above, below, pivot)
        first, equal = sum(side[0] for side, _, _ in parts), sum(n for _, n, _ in parts)
        if first < place <= first + equal:
            return pivot
        if place <= first:
            below, left, medians = pivot, first, [side for side, _, _ in parts]
        else:
            above, place, left = pivot, place - first - equal, left - first - equal
            medians = [side for _, _, side in parts]
        if 4 * left < held and left > few:
            folder = fresh("keys-left")
            _between(keys, above, below).write.parquet(folder)
            keys, held = spark.read.parquet(folder), left
    rest = sorted(tuple(row) for row in _between(keys, above, below).select(*_ORDER).collect())
    return rest[place - 1]


def _at(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(value).cast("long").alias(name) for name, value in zip(_ORDER, key)])


def _between(keys: DataFrame, above: tuple | None, below: tuple | None) -> DataFrame:
    here = F.struct(*_ORDER)
    keys = keys if above is None else keys.where(here > _at(above))
    return keys if below is None else keys.where(here < _at(below))


def _numbered(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Rows in the order of the draw with their ranks: sorted by range, each range numbered from where the last one ended."""
    place = F.monotonically_increasing_id()
    rows.orderBy(*_ORDER).withColumns({"range": F.shiftright(place, 33), "nth": place.bitwiseAND((1 << 33) - 1)}).write.parquet(folder)
    written = spark.read.parquet(folder)
    # One count per range, of which there are as many as shuffle partitions.
    sizes = sorted((row["range"], row["n"]) for row in written.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "range long, start long")
    return written.join(first, "range").withColumn("rank", F.col("start") + F.col("nth") + 1)


def resample(
        spark: SparkSession, docs: DataFrame, target: DataFrame, fresh_dir: Callable[[SparkSession, str], str],
        key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
        least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with its number of features, weight and score, and its rank if it is drawn."""
    def fresh(label: str) -> str:
        return fresh_dir(spark, label)

    source = _collected(bucket_counts(docs, text, buckets), buckets)
    gain = gains(source, _collected(bucket_counts(target, target_text, buckets), buckets))
    folder = fresh("resampling-scores")
    scored(docs, gain, key, text, seed).write.parquet(folder)
    rows = spark.read.parquet(folder).select("*", *_order())
    long_enough = F.col("n_words") >= least_words
    candidates = rows.where(long_enough)
    drawn = percent * candidates.count() // 100
    columns = ("doc_id", "n_features", "weight", "score")
    unranked = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return rows.select(*columns, unranked)
    last = _at(cutoff(spark, candidates.select(*_ORDER), drawn, fresh))
    wins = long_enough & (F.struct(*_ORDER) <= last)
    # Rows that agree with the last one in everything may be too many: the ranks beyond the share are not given.
    winners = _numbered(spark, rows.where(wins), fresh("resampling-winners"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return winners.select(*columns, rank).unionByName(rows.where(~wins).select(*columns, unranked))


def sql() -> str:
    """The draw as DuckDB SQL on ``documents`` and ``benchmark``."""
    letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    features = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return f"""
WITH {CRC_TABLE},
worded AS (SELECT doc_id, {words} AS words FROM documents),
wanted AS (SELECT {words} AS words FROM benchmark),
featured AS (SELECT row_number() OVER () AS row, doc_id, len(words) AS n_words, {features} AS features FROM worded),
source AS (SELECT row, unnest(features) AS feature FROM featured),
target AS (SELECT unnest({features}) AS feature FROM wanted),
dealt AS (SELECT feature, {crc32("feature")} % {BUCKETS} AS bucket
    FROM (SELECT feature FROM source UNION SELECT feature FROM target), crc_table),
s AS (SELECT bucket, count(*) AS n FROM source JOIN dealt USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN dealt USING (feature) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM source) AS s, (SELECT count(*) FROM target) AS t),
gained AS (SELECT b.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + {BUCKETS}))
        / ((coalesce(s.n, 0) + 1)::DOUBLE * (totals.t + {BUCKETS}))))::BIGINT AS gain
    FROM (SELECT unnest(range({BUCKETS})) AS bucket) b CROSS JOIN totals LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM source JOIN dealt USING (feature) JOIN gained USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, n_words, len(features)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM featured LEFT JOIN weighed USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER () AS candidates
    FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * candidates // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row)"""
