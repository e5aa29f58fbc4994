"""Exact top-k by the three phases against all inner products in whole numbers."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitewise.llm import exact_search
from sitewise.llm.exact_search import Best, exact_top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, queries, k):
    """Sorted (query_id, rank, vec_id, score)."""
    def fine(v):
        return v and all(c is not None and math.isfinite(c) for c in v)

    def whole(v):
        return [math.floor(1024 * float(np.float32(c))) for c in v]

    held = [(i, whole(v)) for i, v, *_ in rows if i is not None and fine(v)]
    out = []
    for i, v in [(i, whole(v)) for i, v, *_ in queries if i is not None and fine(v)]:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in held if j != i and len(w) == len(v))
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.offer(np.array([0, 0, 0, 1]), np.array([5, 5, 7, 1]), np.array([9, 3, 4, 2]), np.array([1, 2, 3, 4]))
    assert best.rows[0].tolist() == [0, 0, 1] and best.rows[2].tolist() == [4, 3, 2] and best.floor.tolist() == [5, exact_search.NONE]


@pytest.mark.parametrize("lists", [1, 2, 5, 99])
def test_against_all_products(spark, monkeypatch, lists):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=9) * rng.choice([0.01, 1, 3])).astype("float32").tolist(), 0) for i in range(700)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    queries = table.where("vec_id % 20 = 0")
    monkeypatch.setattr(exact_search, "TILE", 64)
    monkeypatch.setattr(exact_search, "BLOCK_QUERIES", 6)
    monkeypatch.setattr(exact_search, "PASS_BLOCKS", 2)
    got = sorted(map(tuple, exact_top_k(table, queries, lists=lists).collect()))
    assert got == brute(rows, rows[::20], 10)
    assert sorted(map(tuple, exact_top_k(table, queries, k=3).collect())) == brute(rows, rows[::20], 3)


def test_copies_ties_and_negative_scores(spark):
    rng = np.random.default_rng(8)
    one = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, one, 0) for i in range(1, 400)] + [(1000 + i, rng.integers(-2, 3, 4).astype(float).tolist(), 0) for i in range(200)]
    rows += [(0, one, 0), (500, [-c for c in one], 0), (600, [0.0] * 4, 0), (5, one, 0), (600, [0.0] * 4, 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted(map(tuple, exact_top_k(table, table.where("vec_id % 100 = 0")).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 0), (1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("-inf"), 1.0], 0), (None, [9.0, 9.0], 0),
        (100, [1.0, 1.0, 1.0], 0), (6, [2.0, 0.5, 1.0], 0), (7, [-1.0, 2.0], None), (200, [1.0], 0), (300, None, 0), (8, [1e-9, -1e-9], 0),
    ]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"query_id": F.lit("x"), "x": F.lit(1), "score": F.lit(2), "place": F.lit(3)})
    got = exact_top_k(table, table.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert exact_top_k(table.limit(0), table.limit(0)).count() == 0 and exact_top_k(table, table.limit(0)).count() == 0 and exact_top_k(table.limit(0), table).count() == 0


def test_large_components(spark):
    kind = "vec_id bigint, embedding array<double>"
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-(2**17), 2**17, 3)).astype(float).tolist()) for i in range(40)]
    table = spark.createDataFrame(rows, kind)
    want = []
    for i, v in rows[::10]:
        scored = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:10])]
    assert sorted(map(tuple, exact_top_k(table, table.where("vec_id % 10 = 0")).collect())) == sorted(want)
    with pytest.raises(Exception, match="no long holds"):
        exact_top_k(spark.createDataFrame([(1, [1e9]), (100, [1e9])], kind), spark.createDataFrame([(100, [1e9])], kind)).collect()
