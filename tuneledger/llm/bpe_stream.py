"""Byte-pair encoding and decoding as streams of bounded memory.

A merge list decides how far to the right of a token one must look to know that it stays. The token of a
merge (y, z) may lose an end of z to a merge of higher priority with what follows; whether that merge happens
may depend, through yet higher priorities, on what comes after it, and so on. Priorities fall along such a
chain, so one pass through the merges in their order finds the longest one (``Merges.lookahead``). An encoder
therefore keeps the bytes that are not yet decided, and emits every token that ends at least the lookahead
before the end of what it has read. A text is cut into words by the tokenizer's pattern first; a word that is
known to go on is handed to the encoder as it comes, so a word of any length needs the same memory.

Decoding keeps the bytes of an unfinished character only; bytes that are no UTF-8 become U+FFFD.

Defined results: a null text is an empty one and gives no id; the name of a special token in a text is that
token; every row is encoded by itself, so repeated rows and ties give equal results; null keys stay null; an
empty table stays empty. Only the two named columns are read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tuneledger.llm.words import byte_characters

#: Words whose ids a worker keeps; at more it starts anew. Longer words than these bytes are not kept.
KEPT_WORDS, KEPT_BYTES = 500_000, 64
#: Characters that a text is read in.
CHUNK = 1 << 16

# Code points, first and last of each range, that are letters or numbers in newer versions of Unicode than
# that of the tokenizers library, which takes them for other signs.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D,
    0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1,
    0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475,
    0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123,
    0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0,
    0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: Characters after a match that may still change it: those of the longest contraction.
UNDECIDED = 3

_NEWER_SET = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"
_NEWER_SIGNS = regex.compile(_NEWER_SET)


def _patterns(letter: str, number: str, other: str) -> tuple[regex.Pattern, list[regex.Pattern]]:
    """The words of the byte-level tokenizer, and the runs that make a word long: letters, numbers, other signs, white space."""
    # Fixed value: the words of the byte-level tokenizer.
    words = rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?{other}+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+"
    runs = (f"{letter}+", f"{number}+", f"{other}+", r"\p{White_Space}+")
    return regex.compile(words, regex.V1), [regex.compile(run, regex.V1) for run in runs]


#: For plain texts, and for texts with signs that the library sees otherwise.
PATTERNS = (
    _patterns(r"\p{L}", r"\p{N}", r"[^\p{White_Space}\p{L}\p{N}]"),
    _patterns(rf"[\p{{L}}--{_NEWER_SET}]", rf"[\p{{N}}--{_NEWER_SET}]", rf"[^\p{{White_Space}}[[\p{{L}}\p{{N}}]--{_NEWER_SET}]]"),
)


def _has_newer(text: str) -> bool:
    """Whether a text holds a sign that the library sees otherwise; nearly all texts have none."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _NEWER_SIGNS.search(text) is not None
    return False


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """A vocabulary and its merges in order of priority, read from the tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            described = json.load(source)
        model = described["model"]
        byte_of = {c: b for b, c in byte_characters().items()}
        vocabulary = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(map(byte_of.__getitem__, t)) for t, i in vocabulary.items()}
        self.special: dict[str, int] = {a["content"]: a["id"] for a in described["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [vocabulary[c] for _, c in sorted(byte_characters().items())]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for priority, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[vocabulary[left], vocabulary[right]] = priority, vocabulary[left + right]
        self.longest = max(map(len, self.bytes_of.values()))

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes after a token that suffice to know that it stays.

        ``needed[s]`` lists, for merges whose left token is ``s``, their priority and the longest chain so far.
        """
        made: dict[int, tuple[int, int]] = {}  # token: the priority that makes it, its right part
        needed: dict[int, tuple[list[int], list[int]]] = {}
        longest = 0
        for (left, right), (priority, whole) in self.merged.items():
            chain, token, before = 0, right, priority
            while True:  # the token and every end of it, each until the merge that takes it into the next larger one
                if token in needed:
                    priorities, chains = needed[token]
                    if at := bisect_left(priorities, before):
                        chain = max(chain, chains[at - 1])
                if token not in made:
                    break
                before, token = made[token]
            chain += len(self.bytes_of[right])
            longest = max(longest, chain)
            priorities, chains = needed.setdefault(left, ([], []))
            priorities.append(priority)
            chains.append(max(chain, chains[-1] if chains else 0))
            made.setdefault(whole, (priority, right))
        return longest

    def encode(self, word: bytes) -> list[int]:
        """Tokens of a whole word: the merge of highest priority first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > KEPT_BYTES:
            return self._encode_long(ids)
        merged = self.merged
        while len(ids) > 1:
            best, at = None, 0
            for i, pair in enumerate(zip(ids, ids[1:])):
                if (found := merged.get(pair)) and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at:at + 2] = [best[1]]
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        merged, end = self.merged, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(end - 1) if (found := merged.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        gone = [False] * end
        while heap:
            _, whole, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= end or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = whole, True, after[j]
            if after[j] < end:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (found := merged.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (*found, a, ids[a], ids[b]))
        return [t for t, out in zip(ids, gone) if not out]


class WordStream:
    """Tokens of one word that comes in parts; keeps only undecided bytes."""

    def __init__(self, merges: Merges):
        self._merges, self._held = merges, b""
        self._least = 4 * (merges.lookahead + merges.longest)

    def feed(self, part: bytes) -> list[int]:
        found: list[int] = []
        for at in range(0, len(part), self._least):
            self._held += part[at:at + self._least]
            if len(self._held) >= self._least:
                decided, kept = len(self._held) - self._merges.lookahead, 0
                for token in self._merges.encode(self._held):
                    if kept + len(self._merges.bytes_of[token]) > decided:
                        break
                    kept += len(self._merges.bytes_of[token])
                    found.append(token)
                self._held = self._held[kept:]
        return found

    def close(self) -> list[int]:
        held, self._held = self._held, b""
        return self._merges.encode(held)


class Encoder:
    """Ids of a text that comes in parts, as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: Merges, kept: dict[str, bytes] | None = None):
        self._merges, self._kept = merges, {} if kept is None else kept
        self._newer = False
        names = sorted(merges.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._name = max(map(len, names), default=0)
        self._text, self._open, self._run = "", None, None

    def _whole(self, word: str) -> bytes:
        if (ids := self._kept.get(word)) is None:
            raw = word.encode()
            if len(raw) > KEPT_BYTES:
                stream = WordStream(self._merges)
                return np.array(stream.feed(raw) + stream.close(), "<u4").tobytes()
            if len(self._kept) > KEPT_WORDS:
                self._kept.clear()
            ids = self._kept[word] = np.array(self._merges.encode(raw), "<u4").tobytes()
        return ids

    def _close_run(self) -> bytes:
        stream, self._open, self._run = self._open, None, None
        return np.array(stream.close(), "<u4").tobytes()

    def _words(self, text: str, last: bool) -> tuple[bytes, str]:
        """Ids of the decided words, and the text that is still undecided."""
        found, at = [], 0
        word, runs = PATTERNS[self._newer]
        if self._open is not None:  # inside a word that began earlier
            run = runs[self._run].match(text)
            at = run.end() if run else 0
            if self._run == 3:  # white space before a word leaves its last character to the word
                at -= bool(at) and not (last and at == len(text))
            elif at == len(text) and not last:
                at = max(0, at - 1)
            found.append(np.array(self._open.feed(text[:at].encode()), "<u4").tobytes())
            if not last and (len(text) - at <= UNDECIDED or (run and run.end() == len(text))):
                return b"".join(found), text[at:]
            found.append(self._close_run())
        if last:
            return b"".join([*found, *map(self._whole, word.findall(text, at))]), ""
        decided = len(text) - UNDECIDED
        for match in word.finditer(text, at):
            if match.end() > decided:
                break
            found.append(self._whole(match.group()))
            at = match.end()
        rest = text[at:]
        if len(rest) > KEPT_BYTES + UNDECIDED:  # one long word reaches the end: hand on what is certain of it
            lead = 1 if rest[0] == " " and not rest[1].isspace() else 0
            self._run = next(k for k, r in enumerate(runs) if r.match(rest, lead))
            self._open = WordStream(self._merges)
            cut = len(rest) - UNDECIDED
            found.append(np.array(self._open.feed(rest[:cut].encode()), "<u4").tobytes())
            rest = rest[cut:]
        return b"".join(found), rest

    def _pieces(self, last: bool) -> Iterator[bytes]:
        while self._special and (name := self._special.search(self._text)):
            yield self._words(self._text[:name.start()], True)[0]
            yield np.array([self._merges.special[name.group()]], "<u4").tobytes()
            self._text = self._text[name.end():]
        text, held = self._text, ""
        if not last and self._special:  # the end may begin a special token's name
            most = max((n for n in range(1, self._name) if any(s.startswith(text[-n:]) for s in self._merges.special)),
                       default=0) if text else 0
            text, held = text[:len(text) - most], text[len(text) - most:]
        ids, rest = self._words(text, last)
        self._text = rest + held
        yield ids

    def feed(self, part: str) -> bytes:
        self._newer = self._newer or _has_newer(part)
        self._text += part
        return b"".join(self._pieces(False))

    def close(self) -> bytes:
        ids, self._newer = b"".join(self._pieces(True)), False
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, read in chunks; null counts as empty."""
        text = text or ""
        if len(text) <= CHUNK:
            self._text, self._newer = text, _has_newer(text)
            return self.close()
        return b"".join([*[self.feed(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)], self.close()])


class Decoder:
    """Text of ids that come in parts."""

    def __init__(self, merges: Merges):
        self._bytes_of = merges.bytes_of
        self._text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._text.decode(b"".join([self._bytes_of[i] for i in ids]))

    def close(self) -> str:
        return self._text.decode(b"", True)


@functools.lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    """One merge list per worker and vocabulary."""
    return Merges(path)


@functools.lru_cache(maxsize=2)
def kept_words(path: str) -> dict[str, bytes]:
    """The words that a worker keeps."""
    return {}


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: key, number of ids, digests of ids and of decoded text, ``ids`` where wanted."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(vocabulary)
        encoder = Encoder(merges, kept_words(vocabulary))
        for batch in batches:
            found: list[tuple] = []
            for t in batch["text"].to_pylist():
                raw = encoder.encode(t)
                ids, decoder, digest = np.frombuffer(raw, "<u4"), Decoder(merges), hashlib.sha256()
                for at in range(0, len(ids), CHUNK):
                    digest.update(decoder.feed(ids[at:at + CHUNK].tolist()).encode())
                digest.update(decoder.close().encode())
                found.append((len(ids), hashlib.sha256(raw).hexdigest(), digest.hexdigest(), ids))
            n, ids_sha, text_sha, ids = list(zip(*found)) or [()] * 4
            arrays = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return wanted.mapInArrow(rows, RESULT + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of encoded documents: ``doc_id, text``; a null list is an empty text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(vocabulary)
        for batch in batches:
            texts = []
            for some in batch["ids"].to_pylist():
                decoder = Decoder(merges)
                texts.append(decoder.feed(some or ()) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    wanted = encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return wanted.mapInArrow(rows, "doc_id long, text string")
