import numpy as np
import pytest

from sondeflow.llm.descent import nearest
from sondeflow.llm.pivots import top_products

SCHEMA = "vec_id long, embedding array<float>, rank int"


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[r.integers(0, n, n // 3)] = x[0]  # a third are one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [None] * dim, 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [float("inf")] * dim, 0), (None, x[1].tolist(), 0), (n + 5, [1.0], 0), rows[7]]
    return x, rows + odd


def test_products_exact(spark):
    x, rows = vectors(700, 12, 1)
    got = top_products(spark.createDataFrame(rows, SCHEMA).repartition(3), every=50, k=5).collect()
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        s = v @ v[q]
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert sorted(map(tuple, got)) == want


def test_products_of_large_numbers(spark):
    """Exact beyond 2^53; an error, not a clipped score, beyond 64 bits."""
    rows = [(0, [9e6, 1.0], 0), (1, [9e6, 3.0], 0), (2, [-9e6, 0.0], 0), (3, [9e6, 2.0], 0)]
    got = sorted(map(tuple, top_products(spark.createDataFrame(rows, SCHEMA), every=50, k=5).collect()))
    big = (256 * 9 * 10**6) ** 2
    assert [r[2:] for r in got] == [(1, big + 256 * 768), (3, big + 256 * 512), (2, -big)]
    for far in (1e10, 1e30):
        with pytest.raises(Exception, match="64-bit"):
            top_products(spark.createDataFrame([(0, [far], 0), (1, [far], 0)], SCHEMA)).collect()


def test_nearest_recall(spark):
    x, rows = vectors(3000, 16, 2)
    x = x.astype(float)
    got = nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), every=100, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = 0
    assert set(by) == set(range(0, 3000, 100))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [r.rank for r in found] == list(range(1, 11)) and q not in {r.vec_id for r in found}
        assert [r.score for r in found] == pytest.approx([d[r.vec_id] for r in found])
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (d[i], i))[:10]
        hit += len({r.vec_id for r in found} & set(order))
    assert hit >= 0.9 * 300


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (5, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in nearest(df).collect()] == [(0, 1, 1, pytest.approx(2**0.5))]
    assert sorted(tuple(r) for r in top_products(df).collect()) == [(0, 1, 1, 0), (0, 2, 5, 0)]
    for f in (nearest, top_products):
        assert f(df.filter("vec_id = 0")).count() == 0
        assert f(df.limit(0)).count() == 0


def test_each_length_is_searched_by_itself(spark):
    rows = [(0, [1.0, 0.0], 0), (100, [0.0, 1.0, 2.0], 0), (7, [3.0, 0.0], 0), (8, [0.0, 1.0, 1.0], 0), (200, [5.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.query_id, r.vec_id, r.score) for r in nearest(df).collect()) == [(0, 7, 2.0), (100, 8, 1.0)]
    assert sorted((r.query_id, r.vec_id) for r in top_products(df).collect()) == [(0, 7), (100, 8)]


def test_recall_in_many_dimensions(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), float)
    got = {}
    for r in nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        want = [i for _, i in sorted(zip(d, ids)) if i != q][:10]
        hit, total = hit + len(got[q] & set(want)), total + 10
    assert hit >= 0.9 * total
