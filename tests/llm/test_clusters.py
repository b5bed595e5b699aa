import hashlib

import numpy as np
import pytest

from sondeflow.llm.lloyd import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, n int"
DIM = 6


def by_hand(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if some := [v for (_, v), m in zip(kept, mine) if m == j]:
                centroids[j] = [sum(x) // len(some) for x in zip(*some)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in found)
    each = [sum(d for _, j, d in found if j == c) for c in range(len(centroids))]
    return [(i, j, d, each[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


def sample(n, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, DIM)).astype(np.float32)
    x[r.integers(0, n, n // 3)] = x[0]  # a third are one vector
    rows = [(i, v.tolist(), 7, 8) for i, v in enumerate(x)]
    odd = [(n, None, 0, 0), (n + 1, [], 0, 0), (n + 2, [None, *[0.5] * (DIM - 1)], 0, 0), (n + 3, [float("nan")] * DIM, 0, 0), (n + 4, [1.0, float("inf")] * (DIM // 2), 0, 0), (n + 5, [1.0], 0, 0)]
    return rows + odd + [(None, [0.25] * DIM, 0, 0), rows[2], rows[2], (2, [2.5] * DIM, 0, 0)]  # repeats, and an id with two vectors


@pytest.mark.parametrize("n, k, rounds", [(300, 5, 3), (300, 5, 0), (3, 16, 2)])
def test_as_by_hand(spark, n, k, rounds):
    rows = sample(n, n)
    got = clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, dim=DIM, rounds=rounds).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_hand(rows, k, rounds)))


def test_empty_table(spark):
    got = clusters(spark.createDataFrame([(1, None, 0, 0)], SCHEMA), dim=DIM)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not got.collect()


def test_components_too_large_are_named(spark):
    with pytest.raises(Exception, match="beyond 2\\*\\*27"):
        clusters(spark.createDataFrame([(1, [1e9] * DIM, 0, 0)], SCHEMA), dim=DIM).collect()
