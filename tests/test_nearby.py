import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import nearby

Q, P = "note string, qid long, qwho long, qx double, qy double", "pid long, pwho long, px double, py double, big long"


def clustered(seed, n, entities):
    """Most points in a few narrow clusters, each mostly of one entity, a third of all at one place."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = int(r.integers(0, 5))
        x, y = (1.0, 2.0) if i % 3 == 0 else r.normal(0, 10.0 ** -c, 2) + 50 * c
        who = c % entities if r.random() < 0.9 else int(r.integers(0, entities))
        out.append((i, who, round(float(x), 3), round(float(y), 3), (1 << 60) + i if i % 7 else None))
    return out


def brute(queries, points, k, exclude_self=True):
    out = {}
    for _, i, w, x, y in queries:
        near = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j, big) for j, v, a, b, big in points if v != w or not exclude_self)
        out[i] = near[:k]
    return {i: near for i, near in out.items() if near}


def found(spark, q, p, k, **how):
    by = {}
    for row in nearby.nearest(spark.createDataFrame(q, Q).repartition(3), spark.createDataFrame(p, P).repartition(3), k, **how).collect():
        by.setdefault(row.qid, []).append((row.rank, row.distance, row.pid, row.big))
    for rows in by.values():
        assert [r[0] for r in sorted(rows)] == list(range(1, len(rows) + 1))
    return {i: [r[1:] for r in sorted(rows)] for i, rows in by.items()}


@pytest.mark.parametrize("leaf,entities,exclude_self", [(16, 5, True), (16, 1, False), (10_000, 3, True)])
def test_as_brute_force(spark, monkeypatch, leaf, entities, exclude_self):
    monkeypatch.setattr(nearby, "LEAF", leaf)
    monkeypatch.setattr(nearby, "PART", 50)
    p = clustered(leaf, 500, entities)
    q = [("q", i, w, x, y) for i, w, x, y, _ in p] + [("far", 9000, 99, 1e6, -1e6), ("odd", 9001, 0, float("inf"), 0.0)]
    want = brute(q[:-1], p, 4, exclude_self)
    assert {i: v for i, v in found(spark, q, p, 4, exclude_self=exclude_self).items() if i != 9001} == want


def test_few_and_odd_rows(spark):
    p = [(1, 1, 0.0, 0.0, 5), (2, 2, 3.0, 4.0, None), (3, None, 0.0, 0.0, 1), (4, 2, None, 0.0, 1), (5, 2, float("nan"), 0.0, 1)]
    q = [("a", 1, 1, 0.0, 0.0), ("b", 2, None, 0.0, 0.0), ("c", 3, 7, None, 0.0), ("d", 4, 9, 0.0, 0.0)]
    assert found(spark, q, p, 3) == {1: [(5.0, 2, None)], 4: [(0.0, 1, 5), (5.0, 2, None)]}
    assert found(spark, q, [], 3) == {} == found(spark, [], p, 3)


def test_leaves_hold_alike(spark):
    """However narrow the clusters, the fullest leaf holds less than twice the median."""
    r = np.random.default_rng(4)
    xy = np.concatenate([r.normal(100 * c, 10.0 ** (2 - 2 * c), (6000, 2)) for c in range(4)])
    tree = nearby.grown(xy[r.permutation(len(xy))[: 16 * nearby.SAMPLED]], 4)
    held = np.bincount(tree.leaf(xy), minlength=16)
    assert held.max() < 2 * np.median(held) and held.min() > np.median(held) / 2
    for at, half in ((xy[:50], 0.5), (xy[-50:], 30.0)):
        who, leaf = tree.reached(at, np.full(len(at), half))
        seen = set(zip(who.tolist(), leaf.tolist()))
        near = np.nonzero((np.abs(at[:, None] - xy).max(axis=2) <= half))
        assert {(a, b) for a, b in zip(near[0].tolist(), tree.leaf(xy)[near[1]].tolist())} <= seen


def test_pairs_of_points_are_no_rows(spark, monkeypatch):
    """What is shuffled are queries and points with the leaves that they meet in."""
    monkeypatch.setattr(nearby, "LEAF", 64)
    df = spark.range(4000).select(F.col("id").alias("pid"), F.col("id").alias("pwho"), (F.col("id") % 61).cast("double").alias("px"), (F.col("id") % 67).cast("double").alias("py"))
    points = nearby._placed(df, "px", "py", tree := nearby.tree_of(df))
    assert tree.depth == 6 and points.groupBy("__leaf").count().agg(F.max("count")).first()[0] < 4 * 64
    far = df.select(F.col("pid").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.lit(1.0).alias("__far"), F.lit(0).alias("__up"))
    asks = nearby._farther(nearby._placed(far, "qx", "qy", tree).withColumnRenamed("__leaf", "__own"), tree)
    assert asks.count() < 4 * 4000
