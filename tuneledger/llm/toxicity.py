"""Toxicity by the nearest labelled examples, found exactly through a block-max inverted index.

A text is a bag of terms: its lower-cased words, and the first letters of longer ones, which stand for a word
with any ending. All terms of a bounded sample of labelled examples count, those of clean ones included: their
document frequencies among the examples, the collection that is searched, give TF-IDF weights, times what the term tells of the label in the sample
(log-likelihood ratio of either direction, relative to nothing but the sample, so few labels need no other bound).
Examples become unit vectors; equal vectors are one entry that carries its numbers of either label. The inverted
index lists the entries of a term, and the greatest weight of the term in each block of entries. The most common terms are
dense columns that many queries meet in one product; of the others a query sums the lists of the heaviest, then bounds
what is left block by block, and finishes only the entries that may still be among the k best: the neighbours are
exactly those of a full comparison.

Neighbours vote with their similarity as weight, and the share of examples of each label in the sample has one
vote, so a text without any known term gets that share. Votes become probabilities by isotonic regression on
the examples themselves, each judged without itself. The evidence of a score is the ids of its neighbours.

Defined results: null and empty texts have no term and get the probability of such examples; very long texts
are read whole; equal similarities are taken by least entry number, which follows the least example id; rows
that repeat a key are scored each; without any labelled example every score is 0.0; an empty table stays empty.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import pickle
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tuneledger.llm.held import held, release

#: Bound of the model: labelled examples.
EXAMPLES = 6_000
#: Words whose terms a worker keeps; at more it starts anew.
KEPT_WORDS = 300_000
NEIGHBOURS, BLOCK = 15, 64
#: Terms that may have a dense column, those of one entry in so many; texts whose queries meet them together.
COMMON, IN_ONE_OF, TOGETHER = 1536, 16, 256
#: More than single precision can lose of a sum of unit vectors, for each of its terms.
LOSS = 2.0 ** -23
#: Postings per entry that are summed straight away: to bound fewer would cost as much.
STRAIGHT = 32
STEMS = (4, 5, 6)
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
#: UTF-8 with ASCII characters that are no letters as spaces; no word holds one.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_POSTING = np.dtype([("entry", np.int32), ("weight", np.float32)])
_RAMP = np.arange(1 << 17)


def words_of(text: str | None) -> Counter:
    """The words of a text, its longest runs of letters in lower case, and their counts."""
    spaced = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED)
    words = Counter(spaced.decode("utf-8", "surrogatepass").split())
    for piece in [p for p in words if not p.isalpha()]:  # those with other than ASCII characters that are no letters
        n = words.pop(piece)
        for word in _WORD.findall(piece):
            words[word] += n
    return words


def terms(text: str | None) -> Counter:
    """The terms of a text and their counts."""
    words = words_of(text)
    found = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                found[word[:size] + "*"] += n
    return found


def _tells(both: int, with_term: int, positive: int, total: int) -> float:
    """Log-likelihood ratio of a term and the label."""
    table = ((both, with_term - both), (positive - both, total - positive - with_term + both))
    ratio = 0.0
    for row, of_row in zip(table, (with_term, total - with_term)):
        for n, of_column in zip(row, (positive, total - positive)):
            if n:
                ratio += 2 * n * math.log(n * total / (of_row * of_column))
    return max(ratio, 0.0)


def chosen_terms(examples: list[tuple[Counter, int]]) -> list[str]:
    """All terms of the examples."""
    return sorted({t for found, _ in examples for t in found})


def _lists(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the list of each key starts, and the end of the last; ``keys`` are sorted."""
    return np.searchsorted(keys, np.arange(n + 1))


def _joined(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists ``which``, one after the other, and their lengths."""
    lengths = starts[which + 1] - starts[which]
    ends = np.cumsum(lengths)
    places = np.repeat(starts[which] - (ends - lengths), lengths)
    places += _RAMP[:len(places)] if len(places) <= len(_RAMP) else np.arange(len(places))
    return places, lengths


class Index:
    """Entries of terms and their weights, by entry and by term; the greatest weight of each term and block.

    ``vectors`` is a matrix, or a list of term numbers and weights of each entry. Weights are kept in single
    precision, sums are taken in double. The most common terms lie as columns of numbers, so that many queries meet
    them in one product; only the other terms have lists.
    """

    def __init__(self, vectors: np.ndarray | list[tuple[np.ndarray, np.ndarray]], positives: np.ndarray, totals: np.ndarray,
                 ids: list[int], block: int = BLOCK, width: int = 0):
        if isinstance(vectors, np.ndarray):
            width, rows = vectors.shape[1] if vectors.ndim == 2 else 0, [(np.flatnonzero(v), v[v != 0]) for v in vectors]
        else:
            rows = vectors
        order = sorted(range(len(rows)), key=lambda r: rows[r][0][rows[r][1].argmax()] if len(rows[r][0]) else -1)
        if isinstance(vectors, np.ndarray):
            self.vectors = vectors[order].astype(np.float32)
        self.positives, self.totals, self.ids, self.block, self.width = positives[order], totals[order], [ids[i] for i in order], block, width
        self.row_starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in order])]).astype(np.int64)
        self.row_terms = np.concatenate([rows[i][0] for i in order] or [[]]).astype(np.int32)
        self.row_weights = np.concatenate([rows[i][1] for i in order] or [[]]).astype(np.float32)
        self._invert()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("positives", "totals", "ids", "block", "width", "row_starts", "row_terms", "row_weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._invert()

    def _invert(self) -> None:
        """Columns and lists by term, which follow from those by entry and are not sent to tasks."""
        width, sizes = self.width, np.bincount(self.row_terms, minlength=self.width)
        common = np.argsort(-sizes, kind="stable")[:COMMON]
        common = common[sizes[common] * IN_ONE_OF >= max(len(self.ids), IN_ONE_OF)]
        self.column = np.full(width, -1, np.int32)
        self.column[common] = np.arange(len(common))
        entries, columns = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.row_starts)), self.column[self.row_terms]
        self.dense = np.zeros((len(self.ids), len(common)), np.float32)
        self.dense[entries[columns >= 0], columns[columns >= 0]] = self.row_weights[columns >= 0]
        rare = np.flatnonzero(columns < 0)
        rare = rare[np.argsort(self.row_terms[rare], kind="stable")]
        terms_, self.postings = self.row_terms[rare], np.empty(len(rare), _POSTING)
        self.postings["entry"], self.postings["weight"] = entries[rare], self.row_weights[rare]
        del entries, columns, rare
        self.starts = _lists(terms_, width)
        blocks = self.postings["entry"] // self.block
        first = np.flatnonzero(np.concatenate([[True], (terms_[1:] != terms_[:-1]) | (blocks[1:] != blocks[:-1])])) if len(terms_) else np.empty(0, int)
        self.block_starts, self.blocks = _lists(terms_[first], width), blocks[first]
        self.block_most = np.maximum.reduceat(self.postings["weight"], first) if len(first) else np.empty(0, np.float32)
        self.most, self._asked = np.zeros(width), np.zeros(width)
        np.maximum.at(self.most, terms_, self.postings["weight"])

    def row(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of an entry."""
        at = slice(self.row_starts[number], self.row_starts[number + 1])
        return self.row_terms[at].astype(np.int64), self.row_weights[at].astype(float)

    def entry(self, number: int) -> dict[int, float]:
        """The vector of an entry."""
        which, weight = self.row(number)
        return dict(zip(which.tolist(), weight.tolist()))

    def _sums(self, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at, lengths = _joined(self.starts, which)
        some = self.postings.view(np.int64).take(at).view(_POSTING)  # entry and weight in one go
        return np.bincount(some["entry"], some["weight"] * np.repeat(weight, lengths), len(self.ids))

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[int, float]]:
        """The k entries most similar to a unit query, with their similarity; none of similarity 0.

        ``without`` names an entry that counts one example less: it is left out if it has no other.
        """
        return self.search(np.array(list(query), np.int64), np.array(list(query.values()), float), k, without)

    def common(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms, those with columns, add to the similarity of each query and entry, in single precision."""
        asked = np.zeros((len(queries), self.dense.shape[1]), np.float32)
        for row, (which, weight) in enumerate(queries):
            column = self.column[which]
            asked[row, column[column >= 0]] = weight[column >= 0]
        return asked @ self.dense.T

    def _finished(self, entries: np.ndarray, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The similarities of a query and some entries, in double precision."""
        at, sizes = _joined(self.row_starts, entries)
        asked = self._asked
        asked[which] = weight
        sums = np.bincount(np.repeat(np.arange(len(entries)), sizes), self.row_weights[at] * asked[self.row_terms[at]], len(entries))
        asked[which] = 0.0
        return sums

    def search(self, which: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1,
               common: np.ndarray | None = None) -> list[tuple[int, float]]:
        """As :meth:`nearest`, of term numbers and weights; ``common`` is the query's row of :meth:`common`, if it is known.

        Of the other terms the heaviest are summed first; the block maxima tell what the rest can add to an entry, and
        only entries that may still be among the k best are finished. What single precision may have lost of a sum is
        allowed for, and the finished sums, in double precision, decide.
        """
        n = len(self.ids)
        if not len(which) or not n:
            return []
        rough = (self.common([(which, weight)])[0] if common is None else common).astype(float)
        columns = self.column[which]
        rare = columns < 0
        lost = LOSS * (len(which) - int(rare.sum()) + 4)
        some, heavy = which[rare], weight[rare]
        lengths = self.starts[some + 1] - self.starts[some]
        cut = len(some)
        if lengths.sum() > STRAIGHT * n:
            order = np.argsort(-heavy * self.most[some], kind="stable")
            some, heavy, lengths = some[order], heavy[order], lengths[order]
            cut = int(np.searchsorted(np.cumsum(lengths), 4 * n, side="right"))
        summed = self._sums(some[:cut], heavy[:cut])
        scores = rough + summed
        bounds, left = scores, int(lengths[cut:].sum())
        if left:
            at, sizes = _joined(self.block_starts, some[cut:])
            more = np.bincount(self.blocks[at], self.block_most[at] * np.repeat(heavy[cut:], sizes), -(-n // self.block))
            bounds = scores + np.repeat(more, self.block)[:n]
        gone = without if without >= 0 and self.totals[without] <= 1 else -1

        def still() -> np.ndarray:
            """Entries that may be among the k best."""
            if gone >= 0:
                scores[gone] = bounds[gone] = 0.0
            least = np.partition(scores, n - k)[n - k] if n > k else 0.0
            return np.flatnonzero((bounds >= least - 2 * lost) & (bounds > 0))

        open_ = still()
        if left and int((self.row_starts[open_ + 1] - self.row_starts[open_]).sum()) >= left:
            summed += self._sums(some[cut:], heavy[cut:])
            scores = bounds = rough + summed
            left, open_ = 0, still()
        if left:
            sums = self._finished(open_, which, weight)
        else:  # only what the columns add is in single precision; equal entries get equal sums
            asked = np.zeros(self.dense.shape[1])
            asked[columns[~rare]] = weight[~rare]
            sums = summed[open_] + (self.dense[open_] * asked).sum(axis=1)
        best = np.argsort(-sums, kind="stable")[:k]
        return [(e, s) for e, s in zip(open_[best].tolist(), sums[best].tolist()) if s > 0]


class _Words:
    """Term numbers of words, worked out once per word; a word's numbers lie one behind the other, between two starts.

    ``number`` gives the number of a term, or None for one that does not count. Words without any share the first place.
    """

    def __init__(self, number: Callable[[str], int | None]):
        self.number = number
        self._forget()

    def _forget(self) -> None:
        self._kept: dict[str, int] = {}
        self._stems: dict[str, tuple[int, ...]] = {}
        self._starts, self._terms = array("q", [0, 0]), array("i")

    def _stems_of(self, word: str) -> tuple[int, ...]:
        found, number = [], self.number
        for size in STEMS:
            if len(word) <= size:
                break
            if (n := number(word[:size] + "*")) is not None:
                found.append(n)
        return tuple(found)

    def _learn(self, words: list[str]) -> None:
        kept, stems, starts, numbers, number = self._kept, self._stems, self._starts, self._terms, self.number
        for word in words:
            if len(word) > STEMS[-1]:  # what begins alike has the same stems
                if (of := stems.get(first := word[:STEMS[-1]])) is None:
                    of = stems[first] = self._stems_of(word)
            else:
                of = self._stems_of(word)
            if (n := number(word)) is not None:
                numbers.append(n)
            elif not of:
                kept[word] = 0
                continue
            numbers.extend(of)
            kept[word] = len(starts) - 1
            starts.append(len(numbers))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of a text, ascending, and how often each occurs: those of :func:`terms`."""
        words = words_of(text)
        if len(self._kept) > KEPT_WORDS:
            self._forget()
        found = list(map(self._kept.get, words))
        if None in found:
            self._learn([w for w, place in zip(words, found) if place is None])
            found = [self._kept[w] if place is None else place for w, place in zip(words, found)]
        if not self._terms or not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.array(found, np.int64)
        at, sizes = _joined(np.frombuffer(self._starts, np.int64), places)
        which, place = np.unique(np.frombuffer(self._terms, np.int32)[at], return_inverse=True)
        n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
        return which.astype(np.int64), np.bincount(place, n, len(which)).astype(np.int64)


class Model:
    """Terms, weights, index and calibration, fitted on a bounded sample."""

    def __init__(self, examples: list[tuple[int, Counter, int]], vocabulary: list[str], frequency: dict[str, int] | None = None,
                 documents: int | None = None):
        """``frequency`` counts the texts of each term among ``documents`` texts; without them the examples are counted."""
        self.vocabulary = {t: i for i, t in enumerate(vocabulary)}
        positive, total = sum(e[2] for e in examples), len(examples)
        self.base = positive / total if total else 0.0
        seen, both = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        for _, found, label in examples:
            which = self._numbers(found)[0]
            seen[which] += 1
            if label:
                both[which] += 1
        held = seen if frequency is None else [frequency.get(t, 0) for t in vocabulary]
        documents = total if documents is None else documents
        self.idf = np.array([(math.log((documents + 1) / (n + 1)) + 1) * (_tells(b, s, positive, total) if s else 0)
                             for n, b, s in zip(map(int, held), both.tolist(), seen.tolist())])
        self._words = _Words(self.vocabulary.get)
        entries: dict[bytes, list] = {}
        for key, found, label in sorted(examples, key=lambda e: e[0]):
            which, weights = self._unit(*self._numbers(found))
            which, weights = which.astype(np.int32), weights.astype(np.float32)
            name = hashlib.sha256(which.tobytes() + weights.tobytes()).digest() if len(which) else b""
            entry = entries.setdefault(name, [key, 0, 0, (which, weights)])
            entry[1] += label
            entry[2] += 1
        known = [e for name, e in entries.items() if name]
        self.index = Index([e[3] for e in known], np.array([e[1] for e in known], float), np.array([e[2] for e in known], float),
                           [e[0] for e in known], width=len(vocabulary))
        blank = entries.get(b"")
        del entries, known
        self._calibrate(blank)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_words", "vocabulary")} | {"terms": "\n".join(self.vocabulary)}

    def __setstate__(self, state: dict) -> None:
        names = state.pop("terms")
        self.__dict__.update(state)
        self.vocabulary = {t: i for i, t in enumerate(names.split("\n"))} if names else {}
        self._words = _Words(self.vocabulary.get)

    def _numbers(self, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of a bag, ascending, and how often each occurs; terms outside the vocabulary are left out."""
        some = [(self.vocabulary[t], n) for t, n in found.items() if t in self.vocabulary]
        pairs = np.array(some, np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        return pairs[:, 0], pairs[:, 1]

    def _unit(self, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of the weights of term counts; terms of weight 0 are absent."""
        raw = (1 + np.log(n)) * self.idf[which]
        some = raw > 0
        which, raw = which[some], raw[some]
        return which, raw / math.sqrt(float(raw @ raw)) if len(raw) else raw

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the known terms of a text, as a unit vector; terms of weight 0 are absent."""
        return self._unit(*self._words.counts(text))

    def _vote(self, near: list[tuple[int, float]], without: tuple[int, int] = (-1, 0)) -> float:
        votes, weight = self.base, 1.0
        for entry, similarity in near:
            positive, total = self.index.positives[entry], self.index.totals[entry]
            if entry == without[0]:
                positive, total = positive - without[1], total - 1
            votes, weight = votes + similarity * positive, weight + similarity * total
        return votes / weight

    def _calibrate(self, blank: list | None) -> None:
        """Isotonic regression of labels on votes, each entry judged without one of its examples."""
        points: list[tuple[float, float, float]] = []  # vote, positives, examples
        rows, entries = (), len(self.index.ids)
        for entry in range(entries):
            if entry % TOGETHER == 0:
                rows = [self.index.row(e) for e in range(entry, min(entry + TOGETHER, entries))]
                common = self.index.common(rows)
            near = self.index.search(*rows[entry % TOGETHER], without=entry, common=common[entry % TOGETHER])
            positive, total = float(self.index.positives[entry]), float(self.index.totals[entry])
            for label, n in ((1, positive), (0, total - positive)):
                if n:
                    points.append((self._vote(near, (entry, label)), label * n, n))
        pools: list[list[float]] = []
        for vote, positive, n in sorted(points):
            pools.append([vote, positive, n])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, positive, n = pools.pop()
                pools[-1][1] += positive
                pools[-1][2] += n
        self.steps = np.array([p[0] for p in pools])
        # Half an example of the base rate keeps a pool of few examples from certainty.
        self.levels = np.array([(p[1] + 0.5 * self.base) / (p[2] + 0.5) for p in pools])
        self.blank = (blank[1] + 0.5 * self.base) / (blank[2] + 0.5) if blank else self.base

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Probability of label 1, and the ids of the examples that it rests on."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """As :meth:`score`, of many texts; equal ones are looked up once."""
        found: dict[str, tuple[float, list[int]]] = {}
        once = list(dict.fromkeys(t or "" for t in texts))
        for first in range(0, len(once), TOGETHER):
            some = once[first:first + TOGETHER]
            queries = [self.query(t) for t in some]
            for t, query, common in zip(some, queries, self.index.common(queries)):
                near = self.index.search(*query, common=common)
                if not near or not len(self.steps):
                    found[t] = float(self.blank), []
                    continue
                at = int(np.searchsorted(self.steps, self._vote(near), side="right")) - 1
                found[t] = float(self.levels[max(at, 0)]), [self.index.ids[e] for e, _ in near]
        return [found[t or ""] for t in texts]


class Fitted:
    """A model as the packed bytes that a task made of it: the driver hands them on and opens them only to score texts itself."""

    def __init__(self, data: bytes):
        self.data, self.name = data, hashlib.sha256(data).hexdigest()

    def score(self, text: str | None) -> tuple[float, list[int]]:
        return _opened(self.name, self.data).score(text)


def _packed(model: Model) -> bytes:
    return zlib.compress(pickle.dumps(model, pickle.HIGHEST_PROTOCOL), 1)


def _unpacked(data: bytes) -> Model:
    return pickle.loads(zlib.decompress(data))


def _opened(name: str, data: bytes) -> Model:
    """The model of some bytes; the last one stays open until another operator needs the room."""
    return held(f"toxicity {name}", lambda: _unpacked(data))


class _Sent:
    """Packed bytes that arrive as the model itself, so that a worker keeps none of them beside it; Spark's workers drop
    a broadcast value at the first task that does not use it."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self) -> tuple:
        return _unpacked, (self.data,)


class _Bag:
    """The counts of a text's terms as two arrays; the terms' names are kept once for all texts."""

    __slots__ = ("_names", "_which", "_n")

    def __init__(self, counts: tuple[np.ndarray, np.ndarray], names: list[str]):
        self._names, self._which, self._n = names, counts[0].astype(np.int32), counts[1].astype(np.int32)

    def __iter__(self) -> Iterator[str]:
        return map(self._names.__getitem__, self._which.tolist())

    def items(self) -> Iterator[tuple[str, int]]:
        return zip(self, self._n.tolist())


def held_out(key: str = "doc_id"):
    """Documents whose labels are never learned from; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        examples: int = EXAMPLES) -> Fitted:
    """Fit on at most ``examples`` labelled documents outside the held-out part, those of least key hash.

    One task makes the model of that sample; the driver gets its bytes. Of several labels of one id the greater
    counts, of several texts the least.
    """
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(examples)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Texts of a bounded number of ids, each once.
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        numbers, names = {}, []
        words = _Words(lambda t: numbers.setdefault(t, len(numbers)))
        bags = [(i, _Bag(words.counts(t), names), y) for batch in batches for i, y, t in zip(*(c.to_pylist() for c in batch.columns))]
        names.extend(numbers)
        del words, numbers
        yield pa.RecordBatch.from_arrays([pa.array([_packed(Model(bags, sorted(names)))], pa.binary())], ["model"])

    made = rows.select("id", "label", "text").repartition(1).mapInArrow(learn, "model binary").first()
    return Fitted(bytes(made["model"]) if made else _packed(Model([], [])))


def score(docs: DataFrame, model: Fitted, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, ``held_out``, ``score``, ``predicted`` and ``evidence`` (ids of the neighbours)."""
    shared = docs.sparkSession.sparkContext.broadcast(_Sent(model.data))  # bounded by EXAMPLES texts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([f[0] for f in found], pa.float64()),
                 pa.array([int(f[0] >= threshold) for f in found], pa.int32()),
                 pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence"])

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    return wanted.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def keep(docs: DataFrame, model: Fitted, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(_Sent(model.data))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([p < threshold for p, _ in shared.value.scores(batch[text].to_pylist())], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
