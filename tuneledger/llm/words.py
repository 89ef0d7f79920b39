"""Token ids of texts by the tokenizers library, with the ids of repeated words kept.

The word tokenizer cuts a normalised text into words and encodes each on its own. Texts of plain
Latin letters are cut here, and the library encodes each distinct word once; any other text goes
through the library whole. Both give the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces whose ids one worker keeps; at more it starts anew.
KEPT_PIECES = 600_000

# Characters that normalisation only lower-cases, and the tokenizer's word pattern on them.
_PLAIN = frozenset(map(chr, (*b"\t\n\r", *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))) | set("‘’“”–—…")
_WORD = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\r a-zß-öø-ÿ0-9]+")


def byte_characters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself where printable, else the next from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        self._shown = byte_characters()

    def _word_ids(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(self._shown.__getitem__, word.encode()))
        return np.array([t.id for t in self._tokenizer.model.tokenize(shown)], dtype="<u4").tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        words = self._words
        found = []
        for word in _WORD.findall(piece):
            if (ids := words.get(word)) is None:
                ids = words[word] = self._word_ids(word)
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null counts as empty. A special token's name in a text is that token."""
        if not text:
            return b""
        if "<|" in text or not _PLAIN.issuperset(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        split, kept = text.lower().split(), self._pieces
        try:
            return b"".join([kept[piece] for piece in split])
        except KeyError:
            for store in (self._pieces, self._words):
                if len(store) > KEPT_PIECES:
                    store.clear()
            for piece in split:
                if piece not in kept:
                    kept[piece] = self._piece_ids(piece)
            return b"".join([kept[piece] for piece in split])


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    return WordEncoder(path)
