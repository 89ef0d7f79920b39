from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest_llm import EDGES, WORDS
from tuneledger.llm import token_store
from tuneledger.llm.token_store import MANIFEST, PerfectHash
from tuneledger.session import fresh_dir


def expected(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return {(k, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for k, x in rows}


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_the_hash_is_perfect_and_minimal(n):
    keys = np.random.default_rng(3).choice(1 << 40, n, replace=False).astype(np.uint64)
    slots = PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(n))


def test_levels_run_out(monkeypatch):
    monkeypatch.setattr(token_store, "MAX_LEVELS", 1)
    keys = np.arange(1000, dtype=np.uint64)
    assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(1000))


def test_edges_round_trip(spark, documents, vocabulary):
    out = token_store.store_and_read(spark, documents(EDGES), vocabulary(WORDS), fresh_dir, shard_bytes=1000).collect()
    assert {(r["key"], r["ids_crc32"]) for r in out} == expected(EDGES, vocabulary(WORDS))
    assert len(out) == len(EDGES)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    by_start = [r["key"] for r in sorted(out, key=lambda r: r["start"])]
    assert by_start == [None, *sorted(k for k in by_start if k is not None)]


def test_whole_corpus_and_look_up(spark, corpus, vocabulary):
    manifest = fresh_dir(spark, "m")
    token_store.write(corpus, fresh_dir(spark, "s"), vocabulary(WORDS), shard_bytes=20_000).write.parquet(manifest)
    stored = spark.read.schema(MANIFEST).parquet(manifest)
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert {(r["key"], r["ids_crc32"]) for r in token_store.read(stored).collect()} == expected(rows, vocabulary(WORDS))
    asked = spark.createDataFrame([(5,), (5,), (17,), (10**12,), (-4,), (None,)], "doc_id long")
    found = {r["key"]: r["ids"] for r in token_store.look_up(stored, asked).collect()}
    assert set(found) == {5, 17}
    wanted = expected([r for r in rows if r[0] in (5, 17)], vocabulary(WORDS))
    assert {(k, zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in found.items()} == wanted


def test_empty_table(spark, documents, vocabulary):
    assert token_store.store_and_read(spark, documents([]), vocabulary(WORDS), fresh_dir).count() == 0
