"""Personal data by patterns, and terms that give it away by co-occurrence in the corpus.

Base spans are e-mail and IP addresses, card and telephone numbers. Each value is a protected entity. A term
reveals it as far as knowing the term makes the entity likelier: the pointwise mutual information of the two,
estimated from the documents that hold the term, the entity, and both. It is compared with the information of
the entity itself: a term discloses an entity if it gives ``DISCLOSED`` of it. The entity's probability given the
term is smoothed by ``PRIOR`` observations at its probability in the corpus, so a value of one document is judged
like any other; copies of a text are one observation. In every document that holds an entity, each occurrence of
a term that discloses it becomes a span, too: one of digits is generalised to zeros or to their number, any other is removed.

Counts are over all documents. Entities of the same documents have the same counts with every term and are one
class, so a document with a thousand addresses of its own pairs its terms once. A pair is made only if the term
is rare enough to disclose the class at best, which is exact. Only terms of documents with an entity are counted
in the corpus; tasks test them against a bitmap of fixed size, in which unrelated terms may meet by chance, and
the exact table decides afterwards.

Defined results: a null text is empty; matches that fail their check are dropped and not tried again; base spans
of different kinds may overlap; a term that overlaps a base span is not
added; rows that repeat a key are treated one by one, each with its own number in the work tables; an
empty table stays empty. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneledger.llm.held import release

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")

#: Observations that the prior counts as; share of an entity's information that discloses it.
PRIOR, DISCLOSED = 0.5, 0.9
#: Bits of the map of terms that are counted.
BITMAP = 1 << 20
#: Terms whose counts a task keeps before it hands them on.
KEPT_TERMS = 500_000


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, looked for at each @, which every match holds."""
    since, at = 0, text.find("@")
    while at >= 0:
        # A local part longer than this begins further left; only then the whole left side is read.
        left = max(since, at - 256)
        local = _LOCAL.search(text, left, at)
        if local and local.start() == left > since:
            local = _LOCAL.search(text, since, at)
        if local and (match := EMAIL.match(text, local.start())):
            yield match.span()
            since = match.end()
        at = text.find("@", max(since, at + 1))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind; places are code points, the end exclusive."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text) if text.count(".") > 2 else ():
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _entity(text: str, kind: str, start: int, end: int) -> str:
    """The value that a span stands for: lower case, numbers without separators."""
    value = text[start:end].lower()
    return f"{kind}:{value if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Lower-cased terms that overlap no base span, and their places; ``spans`` are ordered by start."""
    k, reached = 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            reached = max(reached, spans[k][2])
            k += 1
        if reached <= m.start():
            yield m[0].lower(), *m.span()


def _bit(term: str) -> int:
    return xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass")) % BITMAP


def _bearing(texts: DataFrame) -> DataFrame:
    """The rows that hold an entity: number, hash of the text, text, and its entities."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [(r, c, t, list(dict.fromkeys(_entity(t, *s) for s in spans)))
                     for r, c, t in zip(*(batch[n].to_pylist() for n in ("row", "copy", "text"))) if (spans := base_spans(t))]
            r, c, t, e = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(t, pa.string()), pa.array(e, pa.list_(pa.string()))],
                ["row", "copy", "text", "entities"])

    return texts.mapInArrow(rows, "row long, copy long, text string, entities array<string>")


def _terms(copies: DataFrame) -> DataFrame:
    """``copy, times, term``: the distinct terms of each text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n, t in zip(*(batch[x].to_pylist() for x in ("copy", "times", "text"))):
                found = list(dict.fromkeys(term for term, _, _ in free_terms(t, base_spans(t))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(found), pa.int64()), pa.array([n] * len(found), pa.int64()), pa.array(found, pa.string())],
                    ["copy", "times", "term"])

    return copies.select("copy", "times", "text").mapInArrow(rows, "copy long, times long, term string")


def _bitmap(copies: DataFrame) -> np.ndarray:
    """The bits of all terms of these texts. The driver gets at most ``BITMAP / 64`` words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP, np.uint8)
        for batch in batches:
            for t in batch["text"].to_pylist():
                bits[[_bit(term) for term in {w.lower() for w in _TERM.findall(t)}]] = 1
        words = np.packbits(bits).view(np.int64)
        there = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(words[there])], ["at", "word"])

    words = np.zeros(BITMAP // 64, np.int64)
    for r in copies.select("text").mapInArrow(rows, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        words[r["at"]] = r["word"]
    return words.view(np.uint8)


def _frequency(texts: DataFrame, bits: bytes) -> DataFrame:
    """``term, n_term``: documents that hold a term, of those in the bitmap; one row with a null term counts all."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8))
        known: dict[str, str | None] = {}
        counts: Counter = Counter()

        def closed() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["term", "n"])
            counts.clear()
            return done

        for batch in batches:
            counts[None] += len(batch)
            for t in batch["text"].to_pylist():
                held = set()
                for word in set(_TERM.findall(t)) if t else ():
                    if word not in known:
                        if len(known) > KEPT_TERMS:
                            known.clear()
                        term = word.lower()
                        known[word] = term if wanted[_bit(term)] else None
                    held.add(known[word])
                held.discard(None)
                counts.update(held)
            if len(counts) > KEPT_TERMS:
                yield closed()
        yield closed()

    return texts.select("text").mapInArrow(rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _stored(spark: SparkSession, frame: DataFrame, folder: str) -> DataFrame:
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def _tells(evidence: Column | str, n_both: Column | str, share: Column, prior: float, disclosed: float) -> Column:
    """Whether a term in ``n_term`` documents gives ``disclosed`` of the information of an entity.

    PMI(term; entity) = log(P(entity | term) / P(entity)); information of the entity = -log(P(entity)). Documents with the
    term are scaled to distinct observations before the prior is added.
    """
    evidence, n_both = (F.col(c) if isinstance(c, str) else c for c in (evidence, n_both))
    given = (evidence + prior * share) / (evidence * F.col("n_term") / n_both + prior)
    return F.log(given / share) >= -disclosed * F.log(share) - 1e-12


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a number that the same row has in every evaluation: a hash of key and text, equal for equal rows.

    ``copy`` is a hash of the text alone.
    """
    whole = F.struct(F.col(key).cast("string"), F.col(text))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(whole).alias("row"),
                       F.xxhash64(F.col(text)).alias("copy"))


def disclosing(spark: SparkSession, texts: DataFrame, copies: DataFrame, fresh_dir: Callable[[SparkSession, str], str],
               prior: float = PRIOR, disclosed: float = DISCLOSED) -> DataFrame:
    """``copy, terms``: the terms of each text that give away an entity that it holds."""
    nothing = spark.createDataFrame([], "copy long, terms array<string>")
    bits = _bitmap(copies)
    if not bits.any():
        return nothing
    frequency = _stored(spark, _frequency(texts, bits.tobytes()), fresh_dir(spark, "frequency"))
    n_all = frequency.where("term IS NULL").first()["n_term"]
    share = F.col("n_entity") / float(n_all)
    holders = copies.select("copy", "times", F.explode("entities").alias("entity"))
    # Two sums of hashes name the set of texts of an entity.
    entities = holders.groupBy("entity").agg(F.sum("times").alias("n_entity"), F.bit_xor(F.xxhash64("copy")).alias("a"),
                                             F.bit_xor(F.xxhash64("copy", F.lit(1))).alias("b")).where(F.col("n_entity") < n_all)
    held = _stored(spark, holders.join(entities, "entity").select("copy", "n_entity", "a", "b").distinct(), fresh_dir(spark, "classes"))
    # At best a term stands with the entity wherever either stands, and each such document is an observation.
    best = F.least("n_entity", "n_term")
    most = held.agg(F.max((F.col("n_entity") + prior * share) / F.pow(share, F.lit(1 - disclosed)))).first()[0]
    if most is None:
        return nothing
    rare = frequency.where(F.col("term").isNotNull() & (F.col("n_term") <= most))
    pairs = _stored(spark, _terms(copies).join(rare, "term").join(held, "copy").where(_tells(best, best, share, prior, disclosed)),
                    fresh_dir(spark, "pairs"))
    seen = pairs.groupBy("a", "b", "n_entity", "term", "n_term").agg(F.count(F.lit(1)).alias("evidence"), F.sum("times").alias("n_both"))
    told = seen.where(_tells("evidence", "n_both", share, prior, disclosed)).select("a", "b", "n_entity", "term")
    return pairs.join(told, ["a", "b", "n_entity", "term"]).groupBy("copy").agg(F.collect_set("term").alias("terms"))


def added_spans(spark: SparkSession, texts: DataFrame, fresh_dir: Callable[[SparkSession, str], str], **parameters) -> DataFrame:
    """``row, terms``: places of disclosing terms, in order."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, terms in zip(batch["text"].to_pylist(), batch["terms"].to_pylist()):
                wanted = set(terms)
                found.append([{"start": a, "end": b} for term, a, b in free_terms(t, base_spans(t)) if term in wanted])
            yield pa.RecordBatch.from_arrays(
                [batch["copy"], pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["copy", "terms"])

    bearing = _stored(spark, _bearing(texts.select("row", "copy", "text")), fresh_dir(spark, "bearing"))
    copies = _stored(spark, bearing.groupBy("copy").agg(F.count(F.lit(1)).alias("times"), F.first("text").alias("text"),
                                                        F.first("entities").alias("entities")), fresh_dir(spark, "copies"))
    told = disclosing(spark, texts, copies, fresh_dir, **parameters)
    placed = copies.join(told, "copy").select("copy", "text", "terms").mapInArrow(places, "copy long, terms array<struct<start:int,end:int>>")
    added = bearing.select("row", "copy").distinct().join(placed, "copy").select("row", "terms")
    return _stored(spark, added, fresh_dir(spark, "terms"))


def _all_spans(text: str | None, terms: list | None) -> list[tuple[str, int, int]]:
    spans = [*base_spans(text), *[("term", p["start"], p["end"]) for p in terms or ()]]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(spark: SparkSession, docs: DataFrame, fresh_dir: Callable[[SparkSession, str], str], key: str = "doc_id",
         text: str = "text", **parameters) -> DataFrame:
    """Per document: counts of each base kind, digest of the base spans, and all spans as text."""
    texts = _numbered(docs, key, text)
    added = added_spans(spark, texts, fresh_dir, **parameters)
    based = _stored(spark, texts.mapInArrow(_based, "doc_id long, row long, spans string"), fresh_dir(spark, "spans"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, base, terms in zip(*(batch[c].to_pylist() for c in ("doc_id", "spans", "terms"))):
                spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                kinds = Counter(k for k, _, _ in spans)
                whole = sorted([*spans, *[("term", p["start"], p["end"]) for p in terms or ()]],
                               key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                found.append((i, *[kinds[k] for k in KINDS[:4]], hashlib.sha256(base.encode()).hexdigest(), _written(whole)))
            columns = list(zip(*found)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans"])

    return based.join(added, "row", "left").select("doc_id", "spans", "terms").mapInArrow(
        rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _based(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row"], pa.array([_written(base_spans(t)) for t in batch["text"].to_pylist()], pa.string())],
            ["doc_id", "row", "spans"])


def sanitised(text: str | None, terms: list | None) -> str | None:
    """The text with each span replaced: base kinds by their name, terms of digits by zeros, other terms by [...].

    Where zeros would join with each other or with the digits beside them to a new value of a base kind, the terms
    of digits of this text are replaced by their number of digits instead, which holds no sign that a pattern could join.
    A value that only shows when its neighbour is gone is replaced, too.
    """
    spans = _all_spans(text, terms)
    if not spans:
        return text

    def replaced(digits: Callable[[int], str]) -> str:
        parts, at = [], 0
        for kind, start, end in spans:
            if start < at:  # overlaps the span before: the rest of it goes, too
                at = max(at, end)
                continue
            word = text[start:end]
            parts += [text[at:start], f"[{kind}]" if kind != "term" else digits(len(word)) if word.isdigit() else "[...]"]
            at = end
        return "".join([*parts, text[at:]])

    zeros = replaced(lambda n: "0" * n)
    if not base_spans(zeros):
        return zeros
    # A longer run of digits that was no value may leave one when a part of it goes.
    done = replaced(lambda n: f"[{n} digits]")
    return sanitised(done, None) if base_spans(done) else done


def sanitise(spark: SparkSession, docs: DataFrame, fresh_dir: Callable[[SparkSession, str], str], key: str = "doc_id",
             text: str = "text", **parameters) -> DataFrame:
    """The documents with all their columns and sanitised texts."""
    added = added_spans(spark, _numbered(docs, key, text), fresh_dir, **parameters)
    whole = F.struct(F.col(key).cast("string"), F.col(text))
    names = docs.columns
    here = docs.withColumn("_row", F.xxhash64(whole)).join(added.withColumnRenamed("row", "_row").withColumnRenamed("terms", "_terms"), "_row", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([sanitised(t, p) for t, p in zip(batch[text].to_pylist(), batch["_terms"].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else batch[c] for c in names], names)

    return here.select(*names, "_terms").mapInArrow(rows, docs.schema)
