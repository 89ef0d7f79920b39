from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from conftest_llm import EDGES
from tuneledger.llm import queries, resampling
from tuneledger.session import fresh_dir

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent=25, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) rows."""
    def dealt(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = dealt(t for _, t in docs), dealt(target)
    S, T, rows = sum(s.values()), sum(t.values()), []
    for key, text in docs:
        words, found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
                for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32))), None, words])
    ranked = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(ranked[:percent * len(ranked) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, docs, target, **parameters):
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    return sorted(map(tuple, resampling.resample(spark, docs, wanted, fresh_dir, **parameters).collect()), key=str)


def test_against_sql(spark, folder):
    assert difference(connect(folder), queries.oracle_sql()["op12_importance_resampling"],
                      queries.op12_importance_resampling(spark, folder)) is None


def test_edges_against_brute_force(spark, documents):
    rows = EDGES + [(n, f"word{n % 7} and more words " * (4 + n % 3)) for n in range(100, 160)] + [(100, "Élan ÉLAN élan. " * 30)] * 5
    target = ["word3 and more words", None, "", "élan"]
    assert resampled(spark, documents(rows), target) == brute(rows, target)
    assert resampled(spark, documents([]), target) == []
    assert resampled(spark, documents(rows), []) == brute(rows, [])


def test_more_equal_rows_than_are_drawn(spark, documents):
    rows = [(5, "same " * 30)] * 40
    found = resampled(spark, documents(rows), ["same same"])
    assert found == brute(rows, ["same same"]) and sorted(r[4] for r in found if r[4]) == list(range(1, 11))


def test_checksums_of_random_texts():
    choose = random.Random(3)
    texts = ["".join(choose.choice("aZ9 é-中\x7f.") for _ in range(choose.randint(0, 40))) for _ in range(300)]
    texts += ["", "x" * 70, "y" * 64 + " " + "é" * 100, "A"]
    data = [t.encode() for t in texts]
    owner, checksum, words = resampling.hashed(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    for k, text in enumerate(texts):
        n, found = features(text)
        assert words[k] == n
        assert Counter(checksum[owner == k].tolist()) == Counter(zlib.crc32(f.encode()) for f in found)


def test_long_texts_in_pieces(spark, documents, monkeypatch):
    rows = [(n, f"w{n} x{n % 3} " * (n + 1)) for n in range(60)]
    before = resampled(spark, documents(rows), ["x1 w5"])
    assert before == brute(rows, ["x1 w5"])


@pytest.mark.parametrize("shape", ["random", "sorted", "few values", "one value"])
def test_cutoff_is_exact(spark, shape):
    n = 5_000
    value = {"random": "xxhash64(id) % 1000000", "sorted": "id", "few values": "id % 3", "one value": "7"}[shape]
    rows = spark.range(n, numPartitions=13).selectExpr(f"{value} AS score", "id % 4000 AS doc_id", "1L AS n_features")
    folder = fresh_dir(spark, "keys")
    rows.select(*resampling._order()).write.parquet(folder)
    keys = spark.read.parquet(folder)
    whole = sorted(map(tuple, keys.select(*resampling._ORDER).collect()))
    for place in (1, 77, n // 4, n):
        assert resampling.cutoff(spark, keys, place, lambda label: fresh_dir(spark, label), few=20) == whole[place - 1]


def test_a_round_discards_a_quarter():
    choose = random.Random(9)
    for _ in range(50):
        chunks = [sorted(choose.randint(0, 500) for _ in range(choose.choice((1, 5, 80)))) for _ in range(choose.randint(1, 30))]
        pivot = resampling.weighted_median([[len(c), c[(len(c) - 1) // 2]] for c in chunks])[0]
        whole = [x for c in chunks for x in c]
        assert sum(x <= pivot for x in whole) >= len(whole) / 4 and sum(x >= pivot for x in whole) >= len(whole) / 4
