import math

import numpy as np

from tests.llm import brute
from tidewatch.llm import topk


def run(spark, vectors, **more):
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(5)
    out = {}
    for r in topk.top_k(table, **more).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in out.items()}


def integers(vectors):
    return [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors]


def test_random_vectors(spark, monkeypatch):
    random = np.random.default_rng(1)
    for shape in ("dense", "sparse", "ties", "negative"):
        x = random.normal(size=(700, 12)) / 4
        if shape == "sparse":
            x[random.random(x.shape) < 0.8] = 0
        if shape == "ties":
            x = np.round(x) / 1024
        if shape == "negative":
            x = -abs(x) * np.where(np.arange(700) % 100 == 0, -1, 1)[:, None]
        vectors = [(i, [float(a) for a in v]) for i, v in enumerate(x.astype(np.float32))]
        monkeypatch.setattr(topk, "SHARD", 64)
        monkeypatch.setattr(topk, "BLOCK", 3)
        assert run(spark, vectors) == brute.top_k(integers(vectors), 10, 100), shape


def test_too_many_queries_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(topk, "GROUPS", 3)
    random = np.random.default_rng(2)
    vectors = [(i, [float(a) for a in v]) for i, v in enumerate(random.normal(size=(300, 8)).astype(np.float32))]
    assert run(spark, vectors, k=4, every=10) == brute.top_k(integers(vectors), 4, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0]), (100, [-0.0001, 1.0]), (200, None), (300, [2.0])]
    got = run(spark, vectors)
    assert got == {0: [(1, 1024 * 512), (100, -1024)], 100: [(1, 512 * 1024 - 512), (0, -1024)], 300: [(7, 2048 * 1024)]}


def test_repeated_ids(spark):
    vectors = [(0, [2.0]), (0, [1.0]), (1, [1.0]), (1, [1.0]), (1, [3.0])]
    assert run(spark, vectors) == {0: [(1, 3 << 20), (1, 1 << 20), (1, 1 << 20)]}


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert run(spark, [(100, [1.0])]) == {}
