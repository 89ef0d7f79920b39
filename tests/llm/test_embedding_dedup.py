from __future__ import annotations

import numpy as np
import pytest
from tuneledger.llm import embedding_dedup
from tuneledger.session import fresh_dir


def brute(rows, cosine=0.95):
    n = len(rows)
    name = list(range(n))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i
    links = [0] * n
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v in rows]
    for i in range(n):
        for j in range(i + 1, n):
            if good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    a, b = root(i), root(j)
                    name[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted([(k, links[i], least.get(root(i))) for i, (k, _) in enumerate(rows)], key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(k, v, 1, "r") for k, v in rows], "vec_id long, embedding array<float>, label int, row string")
    out = embedding_dedup.classes(spark, frame, fresh_dir).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out)
    return sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in out], key=str)


@pytest.mark.parametrize("cell, chunk", [(2048, 1024), (8, 16)])
def test_clusters_around_the_threshold(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rnd = np.random.default_rng(cell)
    rows = [(i, rnd.standard_normal(16).tolist()) for i in range(60)]
    for c in range(4):
        center = rnd.standard_normal(16)
        rows += [(100 * (c + 1) + i, (center + rnd.standard_normal(16) * rnd.uniform(0, 0.35)).tolist()) for i in range(40)]
    rows = [(k, np.array(v, np.float32).tolist()) for k, v in rows]
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    v = [0.25, -1.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 1.0, 0.0]), (6, [None, 1.0, 1.0]),
            (9, v), (8, v), (8, v), (None, v), (10, [2 * x for x in v]), (11, [1e-30, 0.0, 0.0]), (12, [1e30, 0.0, 0.0]), (13, [1.0]), (14, [2.0]), (15, [-1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_corpus(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_shares_cover_the_distance():
    for width in (1, 7, 16, 64, 100):
        parts = embedding_dedup.blocks(width)
        assert [i for b in parts for i in range(b.start, b.stop)] == list(range(width))
        assert embedding_dedup.shares(width, 0.95).sum() >= 0.1
        turn = embedding_dedup.rotation(width)
        assert np.allclose(turn @ turn.T, np.eye(width))
