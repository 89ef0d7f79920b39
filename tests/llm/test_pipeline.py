from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from test_minhash_dedup import brute as near_copies
from test_pii import brute as personal
from test_quality import brute as measured
from tuneledger.llm import minhash_dedup, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, each written and read again."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_against_brute_force(spark, kept):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    raw, good, civil, single, clean = texts(docs), *map(texts, kept[:4])
    assert all(f.columns == docs.columns for f in kept[:4])
    assert set(good) <= {i for i, t in raw.items() if not measured(t)[-1]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    lost = [i for i, t in raw.items() if i not in good and labels.get(i) == 1 and not measured(t)[-1]]
    assert len(lost) <= 2

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(kept[0], labels)
    assert set(civil) == {i for i, t in good.items() if model.score(t)[0] < toxicity.THRESHOLD}
    assert civil == {i: good[i] for i in civil}

    _, component = near_copies(list(civil.items()), minhash_dedup.PERCENT)
    assert single == {i: civil[i] for i in civil if component[i] == i}
    assert set(clean) == set(single)
    assert not any(k in ("email", "card", "phone") for t in clean.values() for k, _, _ in personal(t))
    assert all(clean[i] == t for i, t in single.items() if not personal(t))


def test_every_kept_document_is_packed(spark, kept):
    pieces = kept[4].collect()
    assert {r["doc_id"] for r in pieces} == set(texts(kept[3]))
    at = Counter()
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 2048


def test_run_gives_the_same(spark, kept):
    whole = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in queries.queries()["pipeline"](spark, FOLDER).collect())
    assert whole == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in kept[4].collect())


def test_empty_documents(spark, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
