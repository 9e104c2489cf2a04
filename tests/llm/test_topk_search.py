"""Exact top-k by sorted lists against plain inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from recordgate.llm.topk_search import Lists, best_of_bucket, top_k

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()), T.StructField("block", T.LongType()), T.StructField("score", T.LongType())])


def plain(rows, asked, k, scale=256):
    """Brute force on Python's whole numbers."""
    fit = [(i, [math.floor(max(min(v * scale, 2.0**62), -(2.0**62))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q in {i for i, _ in fit if i in asked}:
        best = {}
        for _, x in (r for r in fit if r[0] == q):
            for i, y in fit:
                if i != q and len(x) == len(y):
                    s = min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1)
                    best[i] = max(best.get(i, s), s)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k])]
    return sorted(out)


def found(spark, rows, asked, k, **more):
    df = spark.createDataFrame([(i, x, "x", 0, 0) for i, x in rows], VECTORS)
    return sorted(map(tuple, top_k(df, df.where(df.vec_id.isin(sorted(asked))), k, **more).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("case", ["plain", "ties", "repeats", "huge", "lengths"])
def test_equals_brute_force(spark, case):
    r = random.Random(case)
    vector = lambda d: [r.gauss(0, 1) for _ in range(d)]
    rows = [(i, vector(8)) for i in range(300)]
    if case == "ties":
        rows = [(i, [float(r.randint(-1, 1)) for _ in range(4)]) for i in range(300)]
    if case == "repeats":
        rows += rows[:50] + [(i, vector(8)) for i in range(50)]
    if case == "huge":
        rows = [(i, [v * 10 ** r.choice([0, 9, 17, 200]) for v in vector(5)]) for i in range(200)]
    if case == "lengths":
        rows = [(i, vector(i % 4)) for i in range(100)]
    asked = {i for i, _ in rows if i % 20 == 0}
    assert found(spark, rows, asked, 5, block=8, bucket=64) == plain(rows, asked, 5)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.5]), (7, []), (8, [])]
    asked = {0, 1, 2, 3, 4, 5, 6, 7}
    assert found(spark, rows, asked, 5) == plain(rows, asked, 5)
    assert found(spark, [], {1}, 5) == []
    assert found(spark, rows, {99}, 5) == []
    assert found(spark, [(0, [1.0])], {0}, 5) == []


def test_lists_are_not_read_to_their_ends():
    """On vectors in clusters reading stops before the lists end, and the best are the same as by all products."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (20, 6))
    y = np.floor(256 * (centres[r.integers(0, 20, 3000)] + r.normal(0, 0.1, (3000, 6)))).astype(np.int64)
    lists, ids, depths = Lists(np.arange(3000), y), np.arange(3000, 3040), []
    read = lists.read
    lists.read = lambda depth, kind: depths.append(depth) or read(depth, kind)
    x = y[:40]
    a, _, score = best_of_bucket(lists, ids, x, 5)
    assert max(depths) < 3000
    assert (score.reshape(40, 5) == -np.sort(-(x @ y.T), axis=1)[:, :5]).all()
    assert (a.reshape(40, 5) == np.arange(40)[:, None]).all()
