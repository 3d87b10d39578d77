"""Exact top-k against brute force in whole numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidelattice.llm import pivot_search

SCHEMA = "vec_id long, embedding array<float>, label int, row long, pivot int, d double, bin long, kth double, score long"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 0.5, 4, 0.5, 6) for i, v in rows], SCHEMA)


def whole(v, as_float=True):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(64 * x) for x in v]


def expected(rows, k, ask=lambda i: i is not None and i % 20 == 0):
    """Sorted rows; a repeated id asks once per row."""
    import numpy as np

    held = [(i, whole([float(np.float32(x)) if x is not None else None for x in v] if v is not None else None)) for i, v in rows]
    held = [(i, v) for i, v in held if v is not None]
    out = []
    for n, (qid, q) in enumerate(held):
        if not ask(qid):
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), i is None, i or 0, i) for m, (i, v) in enumerate(held) if m != n]
        out += [(qid, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(spark, rows, k=20, **how):
    out = pivot_search.top_inner_products(make(spark, rows), F.col("vec_id") % 20 == 0, k, **how)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(seed, n, dims, clusters=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"pivots": 5, "annulus": 16, "bin_rows": 40, "queries_a_copy": 7}, {"pivots": 1, "annulus": 300}])
def test_equal_to_brute_force(spark, how):
    rows = vectors(1, 500, 12)
    assert found(spark, rows, **how) == expected(rows, 20)


def test_bounds_leave_work_out(spark):
    """Far clusters are passed over, and the result stays exact."""
    rows = vectors(3, 600, 8, clusters=20)
    table = pivot_search.whole_vectors(make(spark, rows), "vec_id", "embedding")
    index = pivot_search.fit_index(table, 20)
    annuli = pivot_search.annuli(table, index, F.col("vec_id") % 20 == 0, 5, 32, 1)
    asked, seen = annuli.agg(F.sum("q_n")).first()[0], []
    original = pivot_search._scores
    held = [(r["pivot"], r["lo"], r["hi"], pivot_search._longs(r["ids"]), pivot_search._longs(r["rows"]), pivot_search._matrix(r["vectors"], r["n"])) for r in annuli.collect()]
    for r in annuli.where("q_n > 0").collect():
        q = pivot_search._matrix(r["q_vectors"], r["q_n"])
        kth = pivot_search.np.frombuffer(r["q_kth"], "<f8")
        try:
            pivot_search._scores = lambda a, b: seen.append(len(a)) or original(a, b)
            pivot_search._answer(index, held, 5, pivot_search._longs(r["q_rows"]), pivot_search._longs(r["q_ids"]), q, kth)
        finally:
            pivot_search._scores = original
    assert sum(seen) < asked * len(held) * 0.8


def test_ties_copies_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(100)]  # a third and more are one vector
    rows += [(100 + i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)]
    rows += [(20, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(300, None), (320, [None, 1.0, 2.0]), (340, [float("nan"), 0.0, 0.0]), (360, [float("inf"), 0.0, 0.0]), (380, []), (400, [0.0, 0.0, 0.0]), (420, [1.0])]
    rows += [(-20, [-0.01, 0.999, 0.3]), (-7, [-1.0, -1.0, -1.0])]
    for how in ({}, {"pivots": 3, "annulus": 8, "bin_rows": 16}):
        assert found(spark, rows, **how) == expected(rows, 20)


def test_numbers_beyond_exact_doubles(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e9, -3e8, 1.5, 2e7]) * rng.random() for _ in range(4)]) for i in range(80)]
    rows += [(100, [3e38, 3e38, 0.0, 0.0]), (120, [-3e38, 1.0, 0.0, 0.0])]
    assert found(spark, rows, annulus=8) == expected(rows, 20)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(20, None)]) == []
    assert found(spark, [(20, [1.0])]) == []
    rows = [(20, [1.0]), (1, [2.0]), (40, [0.5])]
    assert found(spark, rows) == expected(rows, 20)
