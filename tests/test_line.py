"""Neighbours on a line against all pairs."""

import numpy as np
import pytest

from sondeflow.operators import joins, line


def entities(n, seed):
    r = np.random.default_rng(seed)
    v = [None if r.random() < 0.05 else float("nan") if r.random() < 0.02 else float(x) for x in r.integers(0, n // 3, n) / 4]
    return [(i, x, None if r.random() < 0.05 else int(r.integers(5)) if i % 3 else 1) for i, x in enumerate(v)]


def slow(rows, k, kind_of):
    out = {}
    for i, v, _ in rows:
        best = {}
        for j, u, c in rows:
            if i != j:
                d = None if v is None or u is None or v != v or u != u else abs(v - u)
                at = (d is None, d or 0.0, j)
                best[kind_of(j, c)] = min(best.get(kind_of(j, c), (at, d)), (at, d))
        for rank, (at, d) in enumerate(sorted(best.values())[:k]):
            out[i, rank + 1] = (at[2], d)
    return out


@pytest.mark.parametrize("n, part", [(90, 20), (400, 50_000), (3, 1)])
def test_sweeps_as_all_pairs(spark, monkeypatch, n, part):
    monkeypatch.setattr(line, "PART", part)
    rows = entities(n, n)
    a = spark.createDataFrame(rows, "a long, va double, c int").repartition(3)
    b = a.toDF("b", "vb", "kind")
    got = {(r.a, r.rank): (r.b, r.distance) for r in joins.nearest_of_kinds(a, b, ("va", "vb"), "a", "b", "kind", 3).collect()}
    assert got == slow(rows, 3, lambda j, c: c)
    first = {(r.a, r.rank): (r.b, r.score) for r in joins.own_first(a, b, ("va", "vb"), "a", "b", 4).collect()}
    assert first == {(i, 1): (i, None) for i, _, _ in rows} | {(i, k + 1): x for (i, k), x in slow(rows, 3, lambda j, c: j).items()}


def test_no_pairs_of_many_equals_are_made(spark):
    """20,000 entities at one place: all pairs would be 4 * 10^8 rows."""
    a = spark.range(20_000).selectExpr("id AS a", "CAST(id % 2 AS DOUBLE) AS va")
    got = joins.own_first(a, a.toDF("b", "vb"), ("va", "vb"), "a", "b", 3)
    assert got.count() == 60_000 and got.filter("rank > 1 AND score > 0").count() == 0
    assert {r.b for r in got.filter("a = 9 AND rank > 1").collect()} == {1, 3}
