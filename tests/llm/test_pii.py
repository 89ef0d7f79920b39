from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest_llm import EDGES
from tuneledger.llm import pii
from tuneledger.session import fresh_dir

SAMPLES = ["write to a.b@x-y.co.uk. or @b@c.d", "a@b@c.d.e.", "1.2.3.4.5 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
           "+1 (555) 123-4567 +12 +49 30 1234567890123456", "x@y z@w.q", "5555555555554444 +5555555555554444", "....@a.b", "é1@b.cü"]


def brute(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans():
    rnd = random.Random(2)
    made = ["".join(rnd.choice("ab.@-+ 0123456789()") for _ in range(rnd.randint(0, 80))) for _ in range(4000)]
    for text in [*SAMPLES, *made, "a" * 600 + "@b.c", None, ""]:
        assert pii.base_spans(text) == brute(text), text


def test_edges_and_corpus(spark, documents, corpus):
    for frame in (documents([*EDGES, *((100 + i, t) for i, t in enumerate(SAMPLES))]), corpus):
        rows = pii.find(spark, frame, fresh_dir).collect()
        want = []
        for r in frame.collect():
            base = brute(r["text"])
            want.append((r["doc_id"], *[sum(k == kind for k, _, _ in base) for kind in pii.KINDS[:4]],
                         hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
        assert all(s in r["spans"] for r in rows for s in [""])
    assert pii.find(spark, documents([]), fresh_dir).count() == 0


@pytest.fixture
def telling(documents):
    """A nickname stands near one address only; common words stand near all."""
    rnd, rows = random.Random(4), []
    for i in range(60):
        filler = " ".join(f"w{rnd.randrange(40)}" for _ in range(6))
        rows.append((i, f"{filler} contact zorblax at {'z@zor.org'} today 4711" if i < 6 else f"{filler} contact at mail{i}@x.org today"))
    rows += [(100 + i, f"contact today w{i}") for i in range(40)]
    return documents(rows)


def test_terms_that_give_an_entity_away(spark, telling):
    for r in pii.find(spark, telling, fresh_dir).collect():
        text = next(t["text"] for t in telling.collect() if t["doc_id"] == r["doc_id"])
        terms = {text[int(a):int(b)] for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"}
        if r["doc_id"] < 6:
            assert {"zorblax", "4711"} <= terms and not {"contact", "today"} & terms
        else:
            assert not terms


def test_sanitised_texts(spark, telling):
    out = pii.sanitise(spark, telling, fresh_dir)
    assert out.columns == telling.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "contact [...] at [email] today 0000" in texts[0] and "contact at [email] today" in texts[9] and texts[100] == "contact today w0"
    assert len(texts) == 100


def test_copies_are_one_piece_of_evidence(spark, documents):
    rows = [(i, "rarely seen phrase with q@q.org inside it") for i in range(20)] + [(50 + i, f"text {i}") for i in range(20)]
    assert not any("term" in r["spans"] for r in pii.find(spark, documents(rows), fresh_dir).collect())


def term_spans(spark, frame):
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    return {r["doc_id"]: [text[r["doc_id"]][int(a):int(b)] for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "term"]
            for r in pii.find(spark, frame, fresh_dir).collect()}


def test_values_of_one_or_two_documents(spark, documents):
    rows = [(i, f"please write or ask to us about w{i % 9}") for i in range(200)]
    rows += [(300, "please write to zorblax about a@a.org"), (301, "please ask quux about b@b.org"), (302, "write to quux or b@b.org")]
    found = term_spans(spark, documents(rows))
    assert found[300] == ["zorblax"] and found[301] == found[302] == ["quux"]
    assert not any({"please", "write", "or", "ask", "to", "about"} & set(t) for t in found.values())


def test_terms_far_from_their_value(spark, documents):
    far = " ".join(f"w{i % 9}" for i in range(60))
    rows = [(i, f"{far} signed by mail{i}@x.org") for i in range(200)]
    rows += [(300, f"Zorblax {far} a@a.org {far} zorblax, {'y' * 300}"), (301, f"a@a.org {far} ZORBLAX"), (302, far)]
    found = term_spans(spark, documents(rows))
    assert found[300] == ["Zorblax", "zorblax", "y" * 300] and found[301] == ["ZORBLAX"] and not found[302] and not found[0]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, documents(rows), fresh_dir).collect()}
    assert texts[301] == f"[email] {far} [...]" and texts[302] == far


def test_pairs_against_brute_force(spark, documents):
    rnd = random.Random(9)
    rows = [(i, " ".join([f"t{int(rnd.paretovariate(0.6))}" for _ in range(12)] + [f"v{rnd.randrange(60)}@v.org" for _ in range(rnd.randrange(3))]))
            for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(4)]
    values = {i: {t[a:b] for _, a, b in pii.base_spans(t)} for i, t in rows}
    words = {i: {w for w in t.split() if "@" not in w} for i, t in rows}
    held = {i: {*words[i], *re.findall("[a-z0-9]+", t)} for i, t in rows}
    found, marked = term_spans(spark, documents(rows)), 0
    for i, t in rows:
        want = set()
        for v in values[i]:
            share = sum(v in x for x in values.values()) / len(rows)
            for w in words[i]:
                both = [k for k in values if v in values[k] and w in held[k]]
                evidence, n_term = len({dict(rows)[k] for k in both}), sum(w in x for x in held.values())
                given = (evidence + pii.PRIOR * share) / (evidence * n_term / len(both) + pii.PRIOR)
                if given >= share ** (1 - pii.DISCLOSED):
                    want.add(w)
        assert set(found[i]) == want
        marked += len(want)
    assert marked


def test_zeros_never_join_to_a_new_value():
    def places(text, words):
        return [{"start": m.start(), "end": m.end()} for w in words for m in re.finditer(rf"\b{w}\b", text)]

    text = "a@b.cd room 4711 and 1234567890123456"
    assert pii.sanitised(text, places(text, ["4711"])) == "[email] room 0000 and 1234567890123456"
    rnd = random.Random(8)
    for _ in range(2000):
        words = ["".join(rnd.choice("0123456789") for _ in range(rnd.choice([1, 2, 4, 8, 16]))) for _ in range(5)]
        text = "x@y.zz " + "".join(w + rnd.choice([" ", "-", ".", " .. ", " a "]) for w in words)
        spans = pii.base_spans(text)
        terms = [{"start": a, "end": b} for t, a, b in pii.free_terms(text, spans) if rnd.random() < 0.6]
        assert not pii.base_spans(pii.sanitised(text, terms)), (text, terms)
