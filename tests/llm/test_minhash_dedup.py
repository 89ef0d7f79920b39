from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest_llm import EDGES
from pyspark.sql import functions as F
from tuneledger.llm import minhash_dedup
from tuneledger.llm.components import components
from tuneledger.session import fresh_dir


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def least_names(nodes, links):
    name = {n: n for n in nodes}

    def root(n):
        while name[n] != n:
            name[n] = name[name[n]]
            n = name[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        name[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, percent):
    sets = {i: brute_set(t) for i, t in rows}
    ids, links = sorted(i for i in sets if i is not None), []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, least_names(ids, links)


def agrees(out, rows, percent):
    size, component = brute(rows, percent)
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"]) == (size[r["doc_id"]], component[r["doc_id"]]), r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_chains_and_boilerplate(spark, documents, percent):
    rnd = random.Random(percent)
    rows, base = [], [f"b{i}" for i in range(300)]
    rows += [(i, edited(rnd, base, rnd.randint(0, 9))) for i in range(60)]  # links around the threshold
    chain = [f"c{i}" for i in range(200)]
    for i in range(60, 90):  # each links with the next only
        rows.append((i, " ".join(chain)))
        for _ in range(2):
            chain[rnd.randrange(200)] = f"d{rnd.randrange(10**6)}"
    shared = " ".join(f"s{i}" for i in range(100))
    rows += [(i, shared + " " + " ".join(f"x{i}_{k}" for k in range(40))) for i in range(90, 120)]  # alike, but no links
    rows += [(i, "exact copy of this very text here") for i in range(120, 130)]
    rnd.shuffle(rows)
    agrees(minhash_dedup.classes(spark, documents(rows), fresh_dir, percent=percent).collect(), rows, percent)


def test_edges(spark, documents):
    agrees(minhash_dedup.classes(spark, documents(EDGES), fresh_dir).collect(), EDGES, 80)
    assert minhash_dedup.classes(spark, documents([]), fresh_dir).count() == 0
    twice = documents([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g"), (3, "h i j k l m n")])
    assert {(r["doc_id"], r["component_id"]) for r in minhash_dedup.classes(spark, twice, fresh_dir).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_corpus(spark, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    agrees(minhash_dedup.classes(spark, corpus, fresh_dir, percent=85).collect(), rows, 85)


def test_one_of_each_group_stays(spark, documents):
    kept = minhash_dedup.keep_one(spark, documents([(4, "p q r s t u"), (2, "P q r s t u"), (3, "v w x y z a"), (9, None)]), fresh_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9] and kept.columns == documents([]).columns


def test_sketches_fill_and_agree_as_often_as_sets_are_similar():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 50, 3000)]
    found = minhash_dedup.sketches([*sets, np.empty(0, np.uint64)], 120)
    assert (found[:-1] != minhash_dedup._FULL).all() and (found[-1] == minhash_dedup._FULL).all()
    pool = rnd.integers(0, 2**63, 1500).astype(np.uint64)
    for share in (200, 500, 900):  # common shingles of 1000 each
        agree = []
        for k in range(30):
            some = minhash_dedup._mixed(pool, 1000 + k)
            a, b = np.unique(some[:1000]), np.unique(np.concatenate([some[:share], some[1000:][:1000 - share], _more(k, share)]))
            x = minhash_dedup.sketches([a, b], 120)
            agree.append((x[0] == x[1]).mean())
        assert abs(np.mean(agree) - share / (2000 - share)) < 0.03


def _more(k, share):
    return minhash_dedup._mixed(np.arange(max(0, 500 - share), dtype=np.uint64), 5000 + k)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [
        (rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7), (999, 998), (999, 998)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(links, "a long, b long"), fresh_dir).collect()}
    assert got == least_names(nodes, links)
    assert components(spark, spark.createDataFrame([], "a long, b long"), fresh_dir).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_classes_left_out_have_no_link(spark, percent):
    rnd = random.Random(percent)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(rnd, base[:rnd.randint(135, 150)], rnd.randint(0, 8)) for _ in range(80)]
    found = {i: minhash_dedup.shingles(t) for i, t in enumerate(texts)}
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in found.items()], "id long, hashes binary")
    members = spark.createDataFrame([(b, i, len(s)) for i, s in found.items() for b in (1, 2 + i % 2)], "bucket long, id long, n long")
    left = {r["id"] for r in minhash_dedup.may_link(members, sets, percent).collect()}
    linked = set()
    for a in found:
        for b in range(a):
            both = len(np.intersect1d(found[a], found[b]))
            if 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
                linked |= {a, b}
    assert linked <= left < set(found)


def around(rnd, n_words, n, least, most):
    """Sets of edited texts, and of a second family that changed a passage of the first."""
    base = [f"b{i}" for i in range(n_words)]
    other = [*base[:n_words // 2], *[f"o{i}" for i in range(n_words // 20)], *base[n_words // 2 + n_words // 20:]]
    texts = [edited(rnd, (base, other)[i % 2][:rnd.randint(n_words * 9 // 10, n_words)], rnd.randint(least, most)) for i in range(n)]
    return dict(enumerate(minhash_dedup.shingles(t) for t in texts))


@pytest.mark.parametrize("percent", [80, 85])
def test_links_meet_in_what_sets_them_apart(spark, percent):
    rnd = random.Random(percent)
    found = around(rnd, 200, 90, 0, 7)
    sets = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in found.items()], "id long, hashes binary")
    members = spark.createDataFrame([(1, i) for i in found], "bucket long, id long")
    seen = minhash_dedup.apart(members, sets, percent)
    hub = minhash_dedup.hubs(seen)
    of, size = hub.first(), {r["id"]: r["e"] for r in seen.collect()}

    def link(a, b):
        both = len(np.intersect1d(found[a], found[b]))
        return 100 * both >= percent * (len(found[a]) + len(found[b]) - both)

    near = {i for i in found if size[i] + of["least"] <= 0}
    assert all(i == of["hub"] or link(i, of["hub"]) for i in near) and 0 < len(near) < len(found)
    rows = minhash_dedup.meeting(seen, hub, percent)
    one = rows.select(*[F.col(c).alias(f"{c}_one") for c in rows.columns])
    kind = "((far AND far_one AND among AND among_one) OR (far AND alone AND NOT far_one AND among_one))"
    met = {frozenset((r["id"], r["id_one"])) for r in rows.join(one, F.expr(
        f"hash = hash_one AND id <> id_one AND {kind} AND {minhash_dedup.meets(percent)}")).collect()}
    pairs = {frozenset((a, b)) for a in found for b in found if a != b and not {a, b} <= near}
    links = {p for p in pairs if link(*p)}
    assert links <= met < pairs and links


def test_group_around_the_threshold(spark, documents):
    rnd = random.Random(3)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(150):
        rows.append((i, edited(rnd, base, rnd.randint(1, 4))))
    for i in range(150, 160):  # links of one another, not of most others
        rows.append((i, edited(rnd, rows[7][1].split(), 1 + i % 2)))
    rnd.shuffle(rows)
    agrees(minhash_dedup.classes(spark, documents(rows), fresh_dir, percent=85).collect(), rows, 85)


def test_an_id_with_several_texts(spark, documents):
    words = [f"w{i}" for i in range(60)]
    a, b, c = "p q r s t u v", " ".join(words), " ".join([*words[:59], "other"])
    rows = [(3, a), (8, a), (8, b), (1, "k l m n o p"), (1, "e f g h i j"), (2, "e f g h i j"), (20, c)]
    kept = minhash_dedup.keep_one(spark, documents(rows), fresh_dir)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([rows[0], rows[2], rows[3], rows[4]])
    both = documents([(1, "x y z a b c"), (1, b), (2, c), (3, "x y z a b c"), (1, a), (4, a)])
    assert {(r["doc_id"], r["component_id"]) for r in minhash_dedup.classes(spark, both, fresh_dir).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_one_of_equal_rows_stays(spark, documents):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (6, None), (6, None), (None, "a b c d e f")]
    kept = minhash_dedup.keep_one(spark, documents(rows), fresh_dir)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, rows[0][1]), (4, rows[0][1]), (6, ""), (6, "")]
    assert kept.columns == documents([]).columns
