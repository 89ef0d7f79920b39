"""Likelihood of texts under a lattice of subwords, and under single words as the base.

The vocabulary of pieces exists; only the score of each piece is learned here. Each distinct training word is
cut once by the vocabulary's own merges, and its pieces count as often as the word; a piece's score is the
logarithm of its smoothed share. A word, written as bytes after a blank, has as many readings as there are ways
to cut it into pieces, and each byte is a piece, so there is always one. Its probability is the sum over all of
them, found by a forward recursion in log space from left to right. A text's probability is the product over
its words and one end of text.

Words are counted within tasks first. Every distinct word of the corpus, learned or held out, becomes one row
with its count and its two scores. The most frequent words, a bounded number, are known to every task and never
shuffled; the others meet their scores in a join on the word, and are added up per document.

Defined results: a null or empty text has its end only; words are cut at ASCII white space and A-Z are
lower-cased; a word of any length is read whole; rows that repeat a key are scored one by one if their texts
differ, and are equal rows otherwise; a null key is held out and stays null; without training text all counts
are 0, and base scores are the logarithm of one over the one unseen token; an empty table stays empty. Only the
two named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneledger.llm.bpe_stream import merges_of

#: Words that every task knows.
FREQUENT = 50_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Bytes up to which words are read together, by length.
SHORT = 24
END = b"\n"  # no word holds white space
LOG10 = math.log(10)

COUNTS = "word binary, n long"
SCORES = "word binary, n long, base double, score double"


def words(text: str | None) -> list[bytes]:
    """The words of a text; of bytes, so A-Z alone are lower-cased and ASCII white space alone separates."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(key: str = "doc_id"):
    """Documents that nothing is learned from; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(True))


class Lattice:
    """Scores of pieces, and the log probability of words over all their readings."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        powers = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(self.longest + SHORT + 2)]
        self._powers = np.array(powers, np.uint64)
        self._inverse = np.array([pow(p, -1, 1 << 64) for p in powers], np.uint64)
        short = [p for p in pieces if len(p) <= SHORT + 1]
        keys = np.array([self._key(np.frombuffer(p, np.uint8)[None])[0, -1] for p in short], np.uint64)
        self._tables = {}
        for size in {len(p) for p in short}:
            some = [i for i, p in enumerate(short) if len(p) == size]
            order = np.argsort(keys[some])
            self._tables[size] = (keys[some][order], np.array([pieces[short[i]] for i in some])[order])

    def _key(self, letters: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of rows of bytes: sums of mixed letters times powers."""
        with np.errstate(over="ignore"):
            mixed = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            terms = mixed * self._powers[:letters.shape[1]]
            return np.cumsum(terms, axis=1, dtype=np.uint64)

    def _together(self, letters: np.ndarray) -> np.ndarray:
        """Forward recursion for rows of equal length."""
        rows, length = letters.shape
        sums = np.concatenate([np.zeros((rows, 1), np.uint64), self._key(letters)], axis=1)
        ahead = np.full((rows, length + 1), -np.inf)
        ahead[:, 0] = 0
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                if size not in self._tables:
                    continue
                keys, scores = self._tables[size]
                with np.errstate(over="ignore"):
                    # Shifted to the place of a beginning by the inverse power, so that places do not matter.
                    key = (sums[:, end] - sums[:, end - size]) * self._inverse[end - size]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == key)
                if len(hit):
                    ahead[hit, end] = np.logaddexp(ahead[hit, end], ahead[hit, end - size] + scores[at[hit]])
        return ahead[:, -1]

    def _long(self, word: bytes) -> float:
        """The same for one word of any length, keeping the last ``longest`` values."""
        pieces, longest = self.pieces, self.longest
        ahead = [0.0]
        for end in range(1, len(word) + 1):
            first = max(0, end - longest)
            found = [ahead[start - end] + pieces[p] for start in range(first, end) if (p := word[start:end]) in pieces]
            most = max(found)
            ahead.append(most + math.log(sum(math.exp(f - most) for f in found)))
            if len(ahead) > longest + 1:
                del ahead[0]
        return ahead[-1]

    def scores(self, some: list[bytes]) -> np.ndarray:
        """Natural logarithms of the probabilities of words."""
        found, by_length = np.empty(len(some)), {}
        for i, word in enumerate(some):
            by_length.setdefault(len(word) + 1, []).append(i)
        for length, places in by_length.items():
            if length > SHORT + 1:
                for i in places:
                    found[i] = self._long(b" " + some[i])
            else:
                letters = np.frombuffer(b"".join([b" " + some[i] for i in places]), np.uint8).reshape(len(places), length)
                found[places] = self._together(letters)
        return found


def _stored(spark: SparkSession, frame: DataFrame, folder: str) -> DataFrame:
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def _counted(texts: DataFrame) -> DataFrame:
    """Every distinct word of the corpus and its count in training texts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text, out in zip(batch["text"].to_pylist(), batch["held_out"].to_pylist()):
                if out:
                    counts.update(dict.fromkeys(words(text), 0))
                else:
                    counts.update(words(text))
                    counts[END] += 1
                if len(counts) > COUNTED:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return texts.select("text", "held_out").mapInArrow(rows, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(counted: DataFrame, vocabulary: str) -> dict[bytes, float]:
    """Scores of all pieces of the vocabulary; the driver gets one count per piece."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(vocabulary)
        counts = np.zeros(max(merges.bytes_of) + 1, np.int64)
        for batch in batches:
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                for piece in merges.encode(b" " + word):
                    counts[piece] += n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["piece", "n"])

    learned = counted.where((F.col("n") > 0) & (F.col("word") != F.lit(END)))
    counts = {r["piece"]: r["n"] for r in learned.mapInArrow(rows, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    bytes_of = merges_of(vocabulary).bytes_of
    total = sum(counts.values()) + 0.5 * len(bytes_of)
    scores: dict[bytes, float] = {}
    for i, piece in bytes_of.items():
        scores[piece] = max(scores.get(piece, -math.inf), math.log((counts.get(i, 0) + 0.5) / total))
    return scores


def score(spark: SparkSession, docs: DataFrame, vocabulary: str, fresh_dir: Callable[[SparkSession, str], str],
          key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are log10."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(key).alias("held_out"))
    counted = _stored(spark, _counted(texts), fresh_dir(spark, "word-counts"))
    totals = counted.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"),
                         F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
    train_tokens, distinct, ends = totals["n"] or 0, totals["v"] or 0, totals["ends"] or 0
    whole = train_tokens + 0.5 * (distinct + 1)
    lattice_pieces = spark.sparkContext.broadcast(_pieces(counted, vocabulary))  # one number per piece of the vocabulary

    end_log10 = math.log10((ends + 0.5) / whole)
    go_on = math.log10(max(1 - 10**end_log10, 1e-9))  # after each word the text ends or goes on

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(lattice_pieces.value)
        for batch in batches:
            base = np.log10((batch["n"].to_numpy() + 0.5) / whole)
            yield pa.RecordBatch.from_arrays(
                [batch["word"], batch["n"], pa.array(base), pa.array(lattice.scores(batch["word"].to_pylist()) / LOG10 + go_on)],
                ["word", "n", "base", "score"])

    known = _stored(spark, counted.where(F.col("word") != F.lit(END)).mapInArrow(scored, SCORES), fresh_dir(spark, "word-scores"))
    top = known.where("n > 0 AND length(word) <= 64").orderBy(F.col("n").desc(), "word").limit(frequent).toArrow()
    # At most ``frequent`` words of at most 64 bytes.
    shared = spark.sparkContext.broadcast({w: (b, s) for w, b, s in zip(*(top[c].to_pylist() for c in ("word", "base", "score")))})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document its own row, which has the frequent words' sums and no word, and a row for each other word."""
        common = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
                n, met, base, log10, rest = 1, int(ends > 0), end_log10, end_log10, {}
                for word in words(text):
                    n += 1
                    if (told := common.get(word)) is not None:
                        met, base, log10 = met + 1, base + told[0], log10 + told[1]
                    else:
                        rest[word] = rest.get(word, 0) + 1
                rows.append((row, None, n, met, base, log10))
                rows += [(row, word, times, 0, 0.0, 0.0) for word, times in rest.items()]
                if len(rows) > 100_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "word", "times", "met", "base", "score"])

    # A row's number is a hash of its key and text: the same in every evaluation, equal for equal rows only.
    numbered = texts.withColumn("row", F.xxhash64(F.struct(F.col("doc_id").cast("string"), "text")))
    parts = numbered.select("row", "text").mapInArrow(split, "row long, word binary, times int, met long, base double, score double")
    parts = _stored(spark, parts, fresh_dir(spark, "word-parts"))
    own = parts.where("word IS NULL").select("row", F.col("times").cast("long").alias("n_tokens"), F.col("met").alias("n_known"), "base", "score").dropDuplicates(["row"])
    rare = parts.where("word IS NOT NULL").select("row", "word", "times")
    told = known.select("word", "n", F.col("base").alias("base_one"), F.col("score").alias("score_one"))
    copies = numbered.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    sums = rare.join(told, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("times") * F.col("base_one")).alias("base_rare"), F.sum(F.col("times") * F.col("score_one")).alias("score_rare"))
    # Equal rows have added up their words as often as there are copies.
    per = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    found = own.join(sums, "row", "left").join(copies, "row")
    return numbered.select("doc_id", "held_out", "row").join(found, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.round(per("known_rare")).cast("long")).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + per("base_rare")).alias("base_score"),
        (F.col("score") + per("score_rare")).alias("score"))
