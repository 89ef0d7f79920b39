from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import BYTES, EDGES
from tuneledger.llm import bpe_stream
from tuneledger.llm.bpe_stream import Decoder, Encoder, Merges, WordStream


@pytest.fixture(scope="module")
def merges(vocabulary):
    return bpe_stream.merges_of(vocabulary(BYTES))


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTES))


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


ALPHABETS = ["abcdefghij thesr'lvm", "  \n\t\r\x0b\x0c\x1c\x85\xa0a", "the and ing of", "éèçßü中文字かな𝔘𝕏 a",
             "!?.,;:-'()[] ll've", "0123456789 x", "aA ​ 　", "aaaaaaab", "<|endoftext|>ab "]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_as_the_library_whole_and_in_parts(alphabet, merges, library):
    rnd = random.Random(alphabet)
    for _ in range(300):
        parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 3, 20, 200]))) for _ in range(rnd.randint(1, 5))]
        if "endof" in alphabet and rnd.random() < 0.5:
            parts.insert(1, "<|endoftext|>")
        text = "".join(parts)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(Encoder(merges).encode(text)) == want, text
        stream = Encoder(merges)
        assert ids(b"".join([*map(stream.feed, parts), stream.close()])) == want, parts
        decoder = Decoder(merges)
        assert "".join([*(decoder.feed([i]) for i in want), decoder.close()]) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("word", ["a" * 30_000, " " * 9_000 + "b", "ab" * 9_000, "!" * 8_000 + " x", "é" * 7_000, "7" * 9_000,
                                  "thethethe" * 2_000, "\n" * 5_000, "x" + "\n " * 4_000 + "y", "中" * 4_000])
def test_long_words_stream_in_small_memory(word, merges, library):
    want, stream = library.encode(word, add_special_tokens=False).ids, Encoder(merges)
    got = b""
    for at in range(0, len(word), 700):
        got += stream.feed(word[at:at + 700])
        held = len(stream._text) + (len(stream._open._held) if stream._open else 0)
        assert held < 5 * (merges.lookahead + merges.longest) + 700
    assert ids(got + stream.close()) == want


def test_tokens_that_end_before_the_lookahead_stay(merges):
    rnd = random.Random(5)
    pool = [merges.bytes_of[i] for i in merges.bytes_of]
    for _ in range(300):
        word = b"".join(rnd.choice(pool) for _ in range(rnd.randint(2, 60)))
        whole = merges.encode(word)
        cut = rnd.randint(0, len(word))
        at = 0
        for token, other in zip(merges.encode(word[:cut]), whole):
            at += len(merges.bytes_of[token])
            if at + merges.lookahead > cut:
                break
            assert token == other
        stream = WordStream(merges)
        assert stream.feed(word) + stream.close() == whole


def test_lookahead_is_small_and_follows_chains(merges, tmp_path):
    import json

    assert 0 < merges.lookahead < 2_000
    shown = {c: i for i, (_, c) in enumerate(sorted(bpe_stream.byte_characters().items()))}
    pairs = ["c d", "b c", "a b"]  # d decides c, c decides b, b decides a
    vocabulary = shown | {p.replace(" ", ""): 256 + i for i, p in enumerate(pairs)}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": vocabulary, "merges": pairs}, "added_tokens": []}))
    small = Merges(str(path))
    assert small.lookahead == 3
    name = {i: t for t, i in vocabulary.items()}
    assert [name[i] for i in small.encode(b"abc")] == ["a", "bc"] and [name[i] for i in small.encode(b"abcd")] == ["ab", "cd"]


def test_bytes_that_are_no_text(merges):
    broken = [merges.byte_ids[b] for b in b"a\xe4\xb8\xff\xc3"]
    decoder = Decoder(merges)
    assert "".join([*(decoder.feed([i]) for i in broken), decoder.close()]) == b"a\xe4\xb8\xff\xc3".decode("utf-8", "replace")


def test_edges_and_corpus(spark, documents, corpus, vocabulary, library):
    for frame in (documents(EDGES), corpus):
        rows = bpe_stream.round_trip(frame, vocabulary(BYTES)).collect()
        want = []
        for r in frame.collect():
            found = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(found, skip_special_tokens=False)
            want.append((r["doc_id"], len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe_stream.round_trip(documents([]), vocabulary(BYTES)).count() == 0


def test_ids_decode_to_the_texts(spark, corpus, vocabulary):
    encoded = bpe_stream.round_trip(corpus, vocabulary(BYTES), with_ids=True)
    got = {r["doc_id"]: r["text"] for r in bpe_stream.decode(encoded, vocabulary(BYTES)).collect()}
    assert got == {r["doc_id"]: r["text"] for r in corpus.collect()}


def test_every_code_point_beside_a_letter_and_a_digit(vocabulary):
    """Words are cut as the library cuts them, whatever version of Unicode either side knows."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(BYTES))
    merges, kept = bpe_stream.merges_of(vocabulary(BYTES)), {}
    step = 2_048
    for first in range(0, 0x110000, step):
        signs = [chr(c) for c in range(first, first + step) if not 0xD800 <= c < 0xE000]
        if signs:
            text = "".join(f"a{c}1{c}!{c} {c}" for c in signs)
            encoder = bpe_stream.Encoder(merges, kept)
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(first)
            kept.clear()


def test_newer_signs_in_long_and_broken_texts(vocabulary):
    from tokenizers import Tokenizer

    library, merges = Tokenizer.from_file(vocabulary(BYTES)), bpe_stream.merges_of(vocabulary(BYTES))
    for text in ("\U0001dfda鰼", "a" * 70_000 + "՘b" * 40_000, "\U0001dfda" * 70_000 + " x", "中" * 66_000 + "\U0001e4d0" * 300):
        assert np.frombuffer(bpe_stream.Encoder(merges).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
