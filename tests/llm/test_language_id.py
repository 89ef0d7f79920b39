from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from conftest_llm import EDGES
from tuneledger.llm import language_id, queries
from tuneledger.llm.language_id import SPAN, UNKNOWN, Model
from tuneledger.session import fresh_dir


def plain(model, text):
    """Mean probabilities by the definition: every byte on its own, in double precision."""
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    total = np.zeros(len(model.names))
    soft = lambda x: x / (1 + np.abs(x))
    for at in range(0, len(data), SPAN):
        span = data[at:at + SPAN]
        symbols = span + [256] * (SPAN - len(span))

        def states(layer, order):
            units, h, found = layer.states.shape[1], np.zeros(layer.states.shape[1]), {}
            for k in order:
                x, u = layer.inputs[:, symbols[k]].astype(float), layer.states.astype(float) @ h
                z, r = .5 + .5 * soft(x[:units] + u[:units]), .5 + .5 * soft(x[units:2 * units] + u[units:2 * units])
                n = soft(x[2 * units:] + r * (u[2 * units:] + layer.bias[:, 0]))
                h = found[k] = (1 - z) * n + z * h
            return found

        one, two = states(model.ahead, range(SPAN)), states(model.back, range(SPAN - 1, -1, -1))
        for k in range(len(span)):
            e = np.exp(model.label.astype(float) @ np.concatenate([one[k], two[k], [1]]))
            total += e / e.sum()
    return total / max(1, len(data))


@pytest.fixture(scope="module")
def model():
    return Model.fresh(["xx", "yy", "zz"], seed=4)


def test_gradients_against_differences():
    model = Model.fresh(["a", "b"], units=3, seed=1, kind=np.float64)
    draw = np.random.default_rng(0)
    spans = draw.integers(97, 105, (5, SPAN))
    spans[1, 20:], spans[2, 1:] = 256, 256
    truth = np.array([0, 1, 1, 0, 1])
    _, slopes = model.gradients(spans, truth)
    for weights, slope in zip(model.weights(), slopes):
        for _ in range(12):
            at = tuple(draw.integers(0, n) for n in weights.shape)
            kept, tops = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = kept + step
                tops.append(model.gradients(spans, truth)[0])
            weights[at] = kept
            assert slope[at] == pytest.approx((tops[0] - tops[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_pooled_against_every_byte(model, monkeypatch):
    monkeypatch.setattr(language_id, "SIDE_BY_SIDE", 5)
    texts = ["", "a", "Ünïcode 中文 " * 30, "x" * SPAN, "y" * (SPAN + 1), "words and Words. " * 50]
    data = [t.encode() for t in texts]
    found = model.pooled(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data]))
    assert np.allclose(found, [plain(model, t) for t in texts], atol=1e-5)


def test_every_byte_has_a_label(model):
    labels = model.positions("Straße " * 40)
    assert len(labels) == 40 * 8 and set(labels) <= set(model.names) and model.positions("") == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_accuracy_on_held_out_rows(spark, sf):
    folder = f"/root/testdata/{sf}"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op11_language_id(spark, folder).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    by_language: dict[str, list[bool]] = {}
    for r in rows:
        if r.held_out:
            by_language.setdefault(truth[r.doc_id], []).append(r.lang_pred == truth[r.doc_id])
    assert all(np.mean(right) >= 0.9 for right in by_language.values())
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = language_id.held_out()
    names, chosen = language_id.sample(docs.where(~held))
    texts = {r.text for r in docs.where(~held).collect()}
    assert names[0] == "en" and all(any(r.part in t for t in texts) for r in chosen.collect())
    per = {r["name"]: r["count"] for r in chosen.groupBy("name").count().collect()}
    assert set(per) == set(names)


def test_edges(spark, model):
    rows = [*EDGES, (20, "12345 $$$"), (21, "ß"), (22, "中文")]
    schema = "doc_id long, text string, lettered boolean, score double, held_out int, lang string"
    docs = spark.createDataFrame([(i, t, None, 9.0, 9, None) for i, t in rows], schema)
    found = sorted(((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language_id.identify(docs, model).collect()), key=str)
    expected = []
    for i, t in rows:
        if t and re.search(r"[^\W\d_]", t):
            chance = plain(model, t[:SPAN * 20] if len(set(t[::SPAN])) == 1 else t) if len(t) < 5_000 else None
            expected.append((i, chance))
        else:
            expected.append((i, UNKNOWN))
    assert len(found) == len(expected)
    by_id = {}
    for i, name, score in found:
        by_id.setdefault(i, set()).add((name, score))
    for i, chance in expected:
        if isinstance(chance, str):
            assert by_id[i] == {(UNKNOWN, 0.0)}
        elif chance is not None:
            ((name, score),) = by_id[i]
            assert name == model.names[int(chance.argmax())] and score == pytest.approx(chance.max(), abs=1e-3)
        else:
            assert {name for name, _ in by_id[i]} <= set(model.names)
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_nothing_or_one_language_learned(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "words", None), (2, None, "en"), (3, "", "en")], schema)
    assert language_id.fit(spark, none, fresh_dir) is None
    assert {(r.lang_pred, r.score) for r in language_id.identify(none, None).collect()} == {(UNKNOWN, 0.0)}
    one = spark.createDataFrame([(1, "some words", "en"), (1, "some words", "en"), (None, "!", "en")], schema)
    found = language_id.identify(one, language_id.fit(spark, one, fresh_dir)).collect()
    assert sorted((r.lang_pred, round(r.score, 5)) for r in found) == [("en", 1.0), ("en", 1.0), (UNKNOWN, 0.0)]


def test_sample_is_bounded_and_takes_copies_once(spark):
    rows = spark.range(3_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    names, chosen = language_id.sample(rows, per_language=50)
    per = {r["name"]: r["count"] for r in chosen.groupBy("name").count().collect()}
    assert set(names) == {"a", "b"} and max(per.values()) <= 50 and min(per.values()) >= 25
    assert chosen.count() == chosen.select("name", "hash").distinct().count()
