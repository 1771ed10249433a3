import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import topk


def brute(rows, k=5):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i % 50 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), j) for m, j, x in ok if m != n and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, v string")
    return sorted(map(tuple, topk.top_k(df, 5, F.col("vec_id") % 50 == 0).collect()))


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted(map(tuple, topk.top_k(df, 5, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_prune_and_stay_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "TASK_ROWS", 300)
    monkeypatch.setattr(topk, "PACK", 50)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, 6)) * 40
    rows = [(i, (centers[rng.integers(8)] + rng.normal(size=6) * 0.2).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    vec = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vec(4)) for i in range(0, 120)]
    rows += [(None, vec(4)), (50, None), (100, [1.0, None, 0.0, 0.0]), (150, [float("nan")] * 4), (200, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (250, []), (251, []), (300, vec(2)), (301, vec(2)), (350, [1e9, -1e9, 1e9, 3.0]), (351, [1e9] * 4)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, []) == []


def test_many_lengths_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "LENGTHS", 2)
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "TASK_ROWS", 7)
    rng = random.Random(6)
    rows = [(50 * i if i % 3 == 0 else i, [rng.uniform(-1, 1) * rng.choice([1, 1e7, 1e12]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7] * 30)]
    assert run(spark, rows) == brute(rows)
