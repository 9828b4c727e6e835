import math

import numpy as np
import pytest

from kbflow.llm import metric_tree as M


def slow(rows, k=5, every=50):
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in own]
    out = []
    for i, q in ints:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "ties", "wide", "clustered"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    x = {"unit": x / np.linalg.norm(x, axis=1, keepdims=True), "ties": np.round(x), "wide": x * 10.0 ** rng.integers(-3, 9, (700, 1)), "clustered": np.repeat(x[:7], 100, axis=0) + 1e-2 * x}[kind]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, M.top_k(frame, tree=128, block=6).collect()))
    low, high = -(1 << 63), (1 << 63) - 1
    assert got == [(a, b, c, max(low, min(high, d))) for a, b, c, d in slow(rows)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [inf, 0.0]), (200, [None, 1.0]), (None, [9.0, 9.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (250, []), (251, []), (3, [-1e3, 5.0]), (0, [1.0, 2.0]), (300, [1e12, 1e12])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, dim string")
    got = sorted(map(tuple, M.top_k(frame).collect()))
    high = (1 << 63) - 1
    assert got == [(a, b, c, max(-high - 1, min(d, high))) for a, b, c, d in slow(rows)]
    assert M.top_k(frame.limit(0)).collect() == []
    assert M.top_k(frame.where("vec_id = 1")).collect() == []


def test_as_sql(same):
    same(M.op10_metric_tree, M.SQL, "/root/testdata/sf0.01", ["embeddings"])
