from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import EDGES
from tuneledger.llm import queries, toxicity
from tuneledger.llm.toxicity import Index, Model, chosen_terms, terms


@pytest.mark.parametrize("straight", [0, 32])
@pytest.mark.parametrize("seed", range(6))
def test_neighbours_are_those_of_a_full_comparison(seed, straight, monkeypatch):
    monkeypatch.setattr(toxicity, "STRAIGHT", straight)
    rnd = np.random.default_rng(seed)
    n, width = int(rnd.integers(1, 300)), 12
    vectors = rnd.random((n, width)) * (rnd.random((n, width)) < 0.3)
    vectors = vectors[vectors.any(axis=1)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index = Index(vectors, np.zeros(len(vectors)), np.ones(len(vectors)), list(range(len(vectors))), block=8)
    for _ in range(30):
        query = rnd.random(width) * (rnd.random(width) < 0.4)
        if not query.any():
            continue
        query /= np.linalg.norm(query)
        whole = index.vectors @ query
        order = sorted((i for i in range(len(whole)) if whole[i] > 0), key=lambda i: (-round(whole[i], 10), i))[:15]
        got = index.nearest({int(i): float(query[i]) for i in np.flatnonzero(query)})
        assert np.allclose([s for _, s in got], [whole[i] for i in order])
        assert {e for e, s in got if s > whole[order[-1]] + 1e-9} == {i for i in order if whole[i] > whole[order[-1]] + 1e-9}


def small_model():
    rows = [(i, terms(f"plain w{'abcdefgh'[i % 8]} text"), 0) for i in range(200)]
    rows += [(1000 + i, terms("nasty plain text"), 1) for i in range(40)] + [(2000 + i, terms("rudestein text"), 1) for i in range(20)]
    rows += [(3000 + i, terms(f"rude{'klmnopqr'[i % 8]}xen text"), 1) for i in range(20)]
    vocabulary = chosen_terms([(c, y) for _, c, y in rows])
    frequency = Counter(t for _, c, _ in rows for t in c)
    return Model(rows, vocabulary, frequency, len(rows)), vocabulary


def test_terms_that_tell_decide():
    model, vocabulary = small_model()
    assert {"nasty", "nast*"} & set(vocabulary) and any(t.startswith("rude") and t.endswith("*") for t in vocabulary)
    assert model.score("a nasty thing")[0] > 0.8 > 0.2 > model.score("a plain thing")[0]
    assert model.score("rudezzz thing")[0] > 0.8
    assert model.score(None) == model.score("") == model.score("unseen words only")
    score, evidence = model.score("nasty")
    assert evidence and all(i >= 1000 for i in evidence)
    assert 0 <= score <= 1 and model.score("nasty " * 100_000)[0] > 0.8


def test_no_examples(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents(EDGES), labels)
    rows = toxicity.score(documents(EDGES), model).collect()
    assert len(rows) == len(EDGES) and {r["score"] for r in rows} == {0.0}
    kept = toxicity.keep(documents(EDGES), model)
    assert kept.count() == len(EDGES) and kept.columns == documents([]).columns
    assert toxicity.score(documents([]), model).count() == 0


def test_odd_labels(spark, documents):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (6, None), (7, 5), (10, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(documents(EDGES), toxicity.fit(documents(EDGES), labels)).collect()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_whole_query_against_a_full_comparison(spark):
    """Every score of the fitted model again: similarities to all examples, votes and calibrated levels by the formula."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fitted = toxicity.fit(docs, labels)
    model = toxicity._opened(fitted.name, fitted.data)
    index, found = model.index, {r["doc_id"]: r for r in toxicity.score(docs, fitted).collect()}
    rows = [index.entry(e) for e in range(len(index.ids))]
    for r in docs.collect()[::7]:
        counts = Counter({t: n for t, n in terms(r["text"]).items() if t in model.vocabulary})
        raw = {model.vocabulary[t]: (1 + np.log(n)) * model.idf[model.vocabulary[t]] for t, n in counts.items()}
        norm = np.sqrt(sum(w * w for w in raw.values())) or 1.0
        whole = [sum(w * row.get(t, 0.0) for t, w in raw.items()) / norm for row in rows]
        near = sorted((e for e in range(len(rows)) if whole[e] > 0), key=lambda e: (-round(whole[e], 12), e))[:toxicity.NEIGHBOURS]
        weight = 1 + sum(whole[e] * index.totals[e] for e in near)
        vote = (model.base + sum(whole[e] * index.positives[e] for e in near)) / weight
        level = model.levels[max(int(np.searchsorted(model.steps, vote + 1e-12, side="right")) - 1, 0)] if near else model.blank
        assert found[r["doc_id"]]["score"] == pytest.approx(float(level), abs=1e-9)
        assert np.allclose(sorted(whole[index.ids.index(i)] for i in found[r["doc_id"]]["evidence"]), sorted(whole[e] for e in near))


def test_rows_of_one_id_do_not_depend_on_their_order(spark, documents):
    labels = spark.createDataFrame([(n, n % 2) for n in range(30)] + [(3, 0)], "doc_id long, toxic int")
    rows = [(n, ("nasty words" if n % 2 else "plain words") + f" {n}") for n in range(30)] + [(4, "another text"), (4, "a text")]
    one, two = (toxicity.fit(documents(r), labels) for r in (rows, rows[::-1]))
    assert all(one.score(t) == two.score(t) for _, t in rows)


def test_terms_of_few_examples_count():
    rows = [(i, terms(f"plain w{'abcdefgh'[i % 8]} text"), 0) for i in range(60)]
    rows += [(100 + i, terms(f"{'klm'[i]} grobian"), 1) for i in range(3)]
    model = Model(rows, chosen_terms([(c, y) for _, c, y in rows]), Counter(t for _, c, _ in rows for t in c), len(rows))
    assert model.score("ein grobian")[0] >= toxicity.THRESHOLD > model.score("a plain thing")[0]
    assert model.score("ein grobian")[1] and model.score("a plain thing")[1]


def test_held_out_documents_of_every_language(spark):
    folder = "/root/testdata/sf0.1"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.queries()["op8_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").join(
        lang, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    toxic, found = Counter(r["lang"] for r in rows if r["toxic"]), Counter(r["lang"] for r in rows if r["toxic"] and r["predicted"])
    print(hit / sum(r["predicted"] for r in rows), hit / sum(toxic.values()), toxic, found)
    assert hit / sum(r["predicted"] for r in rows) >= 0.9 and hit / sum(toxic.values()) >= 0.9
    assert all(found[k] / n >= 0.6 for k, n in toxic.items())


def test_words_are_those_of_the_pattern():
    texts = ["", None, "ΑΣ Σ. ΑΣ'x İstanbul ǅ a\x1cb a\x85b a\xa0b x²y ½ Ⅷa a_b 12ab3c \ud800z x\u0301y “foo”…bar—baz, foo 中文、字 ªº ٣a",
             "".join(chr(c) + "a " for c in range(0x30000))]
    for text in texts:
        assert toxicity.words_of(text) == Counter(toxicity._WORD.findall((text or "").lower()))


def test_neighbours_are_finished_by_columns_and_lists_alone(monkeypatch):
    """Where all lists are summed, no entry is read whole again."""
    rnd = np.random.default_rng(3)
    vectors = rnd.random((100, 30)) * (rnd.random((100, 30)) < np.linspace(0.02, 0.5, 30))
    vectors = vectors[vectors.any(axis=1)] / np.linalg.norm(vectors[vectors.any(axis=1)], axis=1, keepdims=True)
    index = Index(vectors, np.zeros(len(vectors)), np.ones(len(vectors)), list(range(len(vectors))))
    assert 0 < index.dense.shape[1] < 30 and len(index.postings)
    monkeypatch.setattr(Index, "_finished", lambda *a: pytest.fail("an entry was read whole"))
    for query in vectors:
        got = index.nearest({int(i): float(query[i]) for i in np.flatnonzero(query)})
        assert np.allclose([s for _, s in got], sorted(index.vectors @ query, reverse=True)[:len(got)], atol=1e-6)
