"""Exact top-k against all scores."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from prefloom.llm import topk


def brute(rows, k=5, every=50):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vec = [(i, [math.floor(256 * x) for x in map(float, v)]) for i, v in ok]
    asked = {}
    for i, v in sorted(ok, key=lambda r: (r[0], r[1])):
        if i % every == 0:
            asked.setdefault(i, [math.floor(256 * x) for x in map(float, v)])
    out = []
    for q, x in asked.items():
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vec if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts) if rows else spark.createDataFrame([], "vec_id long, embedding array<float>, label int")


def f32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_with_ties(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f32([rnd.choice([-1.5, -0.25, 0.0, 0.3, 1.0, rnd.gauss(0, 1)]) for _ in range(6)])) for i in range(400)]
    rows += [(1000 + i, f32([1.0] * 6)) for i in range(200)] + [(50, f32([1.0] * 6)), (1000, f32([1.0] * 6)), (1001, f32([1.0] * 6))]
    got = sorted(tuple(r) for r in topk.query(frame(spark, [(i, v, 0) for i, v in rows])).collect())
    assert got == brute(rows)


def test_rows_without_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, f32([1, 2])), (50, f32([nan, 1])), (100, None), (150, f32([1, None])), (200, []), (250, f32([3, -1])), (1, f32([inf, 1])), (2, f32([0.5, 0.5])), (3, f32([1, 1, 1])),
            (None, f32([9, 9])), (4, []), (5, f32([-0.001, 0.001])), (300, f32([1, 1, 1, 1])), (350, f32([1e6, 1e6])), (7, f32([-1e6, 1e6]))]
    got = sorted(tuple(r) for r in topk.query(frame(spark, [(i, v, 0) for i, v in rows])).collect())
    assert got == brute(rows)


def test_huge_values_are_exact_or_held(spark):
    rows = [(0, f32([3e7, 1.0])), (1, f32([3e7, 2.0])), (2, f32([3e7, 3.0])), (50, f32([1e30, 0])), (3, f32([-1e30, 0]))]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.query(frame(spark, [(i, v, 0) for i, v in rows])).collect()}
    exact = {(q, i): s for q, _, i, s in brute(rows)}
    assert all(got[k] == max(-(1 << 61), min(1 << 61, s)) for k, s in exact.items())


def test_blocks(spark):
    rnd = random.Random(7)
    rows = [(i, f32([rnd.gauss(0, 1) for _ in range(4)]), 0) for i in range(300)]
    df = frame(spark, rows)
    got = topk.top_k(df, df.filter("vec_id % 3 = 0"), k=7, block=10).collect()
    assert sorted(tuple(r) for r in got) == brute([(i, v) for i, v, _ in rows], 7, 3)
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r["rank"])
    assert all(sorted(v) == list(range(1, 8)) for v in by.values())


def test_empty(spark):
    assert topk.query(frame(spark, [])).collect() == []
    assert topk.query(frame(spark, [(0, [1.0], 0)])).collect() == []
