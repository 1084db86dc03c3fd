import math
import random

import numpy as np
import pytest

from graphflow.llm import knn, queries


def slow(rows, asked, k):
    ok = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    out = []
    for q, v in asked:
        if q is None or not ok(v):
            continue
        near = sorted((-float((np.array(v, float) * np.array(u, float)).sum()), j) for j, u in rows if j is not None and j != q and ok(u) and len(u) == len(v))[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group"), [(7, 2000), (512, 16_000_000)])
def test_against_brute_force(make, block, group):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (10 if i % 11 == 0 else 1) for _ in range(9)]) for i in range(300)]
    same = rows[5][1]
    rows += [(i, list(same)) for i in range(300, 420)]  # ties
    rows += [(500, None), (501, []), (502, [0.0] * 9), (503, [1.0, None] + [0.0] * 7), (504, [float("nan")] * 9), (505, [float("inf")] + [1.0] * 8), (None, same), (506, [1.0, 2.0]), (520, [3.0, 1.0]), (300, list(same)), (540, [1e-300] * 9)]
    df = make([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted(tuple(r) for r in knn.nearest(df, df.where("vec_id % 20 = 0"), 20, block, group).collect())
    want = slow(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


@pytest.mark.parametrize(("block", "group"), [(7, 2000), (512, 16_000_000)])
def test_repeated_ids_over_partitions(make, block, group):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(100)]
    others = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(100)]
    for twin in (rows, others):  # the same rows again, and other vectors under the same ids
        df = make(rows, "vec_id long, embedding array<double>").union(make(twin, "vec_id long, embedding array<double>"))
        assert df.rdd.getNumPartitions() >= 2
        got = sorted(tuple(r) for r in knn.nearest(df, df.where("vec_id % 20 = 0"), 20, block, group).collect())
        want = slow(rows + twin, [r for r in rows + twin if r[0] % 20 == 0], 20)
        assert [g[:3] for g in got] == [w[:3] for w in want]


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    for dim in (3, 64, 2000):
        a, b = rng.normal(size=(40, dim)) * rng.exponential(size=(40, 1)), rng.normal(size=(50, dim))
        near, error = knn.bounded_products(knn.quantise(a), knn.quantise(b))
        assert (np.abs(near - a @ b.T) <= error).all()


def test_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in queries.op10_knn(spark, sf).collect())
    want = slow(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_empty(make):
    df = make([], "vec_id long, embedding array<float>")
    assert knn.nearest(df, df).count() == 0
