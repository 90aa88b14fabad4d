from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import maxscore

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, v int, uid string"


EMPTY = (np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))


def direct(rows, k=5):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (q, a) in enumerate(rows):
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), d is None, d or 0) for m, (d, b) in enumerate(rows) if m != n)
            out += [(q, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(scored[:k])]
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, e, 1, 0.5, 3, "x") for i, e in rows], SCHEMA)
    out = maxscore.top_k(maxscore.quantised(df), F.col("vec_id") % 50 == 0, **how)
    return [tuple(r) for r in out.collect()]


def key(rows):
    return sorted((q, r, s, d is None, d or 0) for q, r, d, s in rows)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ties"])
def test_blocks_of_rows_and_queries(spark, monkeypatch, kind):
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    pick = random.Random(1)
    one = {"dense": lambda: pick.gauss(0, 0.2), "sparse": lambda: pick.choice([0.0] * 9 + [pick.random()]), "ties": lambda: pick.choice([0.0, 0.25])}[kind]
    rows = [(i, [one() for _ in range(12)]) for i in range(400)]
    assert key(found(spark, rows, shard_rows=90, query_bytes=3 * 12 * 8)) == key(direct(rows))


def test_pruning_is_exact_and_prunes():
    pick = np.random.default_rng(3)
    weights = (pick.zipf(1.7, (20, 3000)) % 400) * pick.choice([0, 1, -1], (20, 3000))
    shard = maxscore.Shard(weights.astype(np.int64), np.arange(3000), np.float64)
    for n in range(30):
        q = weights[:, n]
        scores, _, rows = shard.search(q, n, 5, np.arange(3000), np.zeros(3000, bool), EMPTY)
        want = sorted((-int(s), i) for i, s in enumerate(q @ weights) if i != n)[:5]
        assert sorted((-int(s), int(i)) for i, s in zip(rows, scores)) == want


def test_zero_queries_and_equal_vectors(spark):
    rows = [(i, [0.0] * 4 if i % 50 == 0 else [0.5, -0.25, 0.5, 0.0]) for i in range(5000)]
    assert key(found(spark, rows)) == key(direct(rows))
    equal = [(i, [0.25, 0.5]) for i in range(3000)]
    assert key(found(spark, equal)) == key(direct(equal))


def test_any_columns_of_the_result(spark, small):
    vectors = maxscore.quantised(spark.read.parquet(f"{small}/embeddings.parquet"))
    out = maxscore.top_k(vectors, F.col("vec_id") % 50 == 0)
    whole = out.collect()
    assert out.count() == len(whole) and sorted(r.rank for r in out.select("rank").collect()) == sorted(r.rank for r in whole)


def test_odd_rows(spark):
    rows = [(0, [1.0, -1.0, 0.5]), (50, [2.0]), (50, [2.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf"), 1.0]), (None, [0.5, 0.5]), (100, []), (7, [0.001, 0.0, 3.9])]
    assert key(found(spark, rows)) == key(direct(rows))
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + i), -float(2**20), 1.0]) for i in range(4)]  # products beyond 2^53
    assert key(found(spark, rows)) == key(direct(rows))
