import math

import numpy as np
import pytest

from quarry.llm import topk


def brute(rows, queries, k=5):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def ints(v):
        return [math.floor(256 * x) for x in v]

    out = []
    for qi, q in queries:
        if qi is None or not ok(q):
            continue
        scored = sorted((-sum(a * b for a, b in zip(ints(q), ints(v), strict=True)), i) for i, v in rows if i is not None and i != qi and ok(v) and len(v) == len(q))
        out += [(qi, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,shard", [(4096, 8192), (3, 64)])
def test_random_and_ties(spark, block, shard):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = df.filter("vec_id % 50 = 0")
    got = sorted(map(tuple, topk.search(df, queries, block=block, shard=shard).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, [1.5, -2.25]), (6, [1.5, -2.25]), (None, [9.0, 9.0]), (7, []), (50, []), (100, [3.0]), (150, [1e12, -1e12]), (8, [1e300, 1.0]), (9, [2.0, 2.0]), (9, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, topk.search(df, df.filter("vec_id % 50 = 0")).collect()))
    assert got == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0])
    assert topk.search(df.limit(0), df.limit(0)).collect() == []


def test_one_large_component_among_many_rows(spark):
    """Rows and queries too large for exact floats stand beside others, which keep to the trees."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows[7], rows[100] = (7, [3e7] * 6), (100, [-5e9] * 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.search(df, df.filter("vec_id % 50 = 0"), shard=64).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0])
