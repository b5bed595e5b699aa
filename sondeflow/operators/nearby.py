"""Exact nearest neighbours in the plane, or in a space of a few features, over a k-d partition tree.

The tree is cut at medians of a sample, so leaves hold about equally many points however they crowd. A query is answered by its own leaf; where that holds
fewer than k points that count (those of the query's entity may not), by the subtree STEP levels up, and so on; then the leaves that its k-th distance
reaches are searched too. What Spark deals are pairs of a query and a leaf, never pairs of points, and leaves that many queries ask for are dealt in parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from sondeflow.operators.sequence import dealt
from sondeflow.sources.staging import staged

#: Names of the coordinates, without the q or p of their side.
Axes = tuple[str, ...]
PLANE: Axes = ("x", "y")
#: Points of a leaf, sampled points for each, and the greatest depth: at most 2^DEEPEST leaves, and SAMPLED times as many rows, reach the driver.
LEAF, SAMPLED, DEEPEST = 2048, 128, 13
#: Queries of a task, queries that a kernel compares at once, and levels that a query without k points goes up.
PART, SLICE, STEP = 8192, 128, 2


@dataclass(frozen=True)
class Tree:
    """A full binary tree in heap order: node i has children 2i + 1 (at most `cut` along `axis`) and 2i + 2. A node without a cut sends all to the left."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    crowded: bool

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1

    def leaf(self, xy: np.ndarray) -> np.ndarray:
        """The leaf, from 0, of each row of coordinates."""
        node = np.zeros(len(xy), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (xy[np.arange(len(xy)), self.axis[node]] > self.cut[node])
        return node - self.inner

    def reached(self, xy: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of coordinates and the leaves that the square (or cube) of half side r around them touches."""
        who, node = np.arange(len(xy)), np.zeros(len(xy), np.int64)
        for _ in range(self.depth):
            off, far = xy[who, self.axis[node]] - self.cut[node], r[who]
            low, high = off <= far, off >= -far
            who, node = np.concatenate((who[low], who[high])), np.concatenate((2 * node[low] + 1, 2 * node[high] + 2))
        return who, node - self.inner


def grown(sample: np.ndarray, depth: int) -> Tree:
    """Cut at medians along the wider axis. crowded: some node's sampled points lie at one place and can't be parted."""
    axis, cut, crowded = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), False
    held = {0: sample}
    for node in range(len(cut)):
        xy = held.pop(node)
        left, right = xy, xy[:0]
        if len(xy) > 1:
            axis[node] = int(np.ptp(xy, axis=0).argmax())
            v = xy[:, axis[node]]
            middle = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if middle == v.max():  # over half of the points share the largest value: cut below it
                middle = v[v < middle].max(initial=-np.inf)
            if middle == -np.inf:
                crowded = True
            else:
                cut[node] = middle
                left, right = xy[v <= middle], xy[v > middle]
        held[2 * node + 1], held[2 * node + 2] = left, right
    return Tree(depth, axis, cut, crowded)


def tree_of(points: DataFrame, axes: Axes = PLANE, leaf: int | None = None) -> Tree:
    """The tree of the points' coordinates, from a sample that a hash of the point picks: of bounded size, the same whenever it is taken."""
    n = points.count()
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(max(1, n / (leaf or LEAF)))))))
    share = min(1.0, (SAMPLED << depth) / max(n, 1))
    picked = points.filter(F.pmod(F.xxhash64("pid", *_named("p", axes)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    xy = picked.select(*(F.col(c).cast("double").alias(c) for c in _named("p", axes))).toPandas().to_numpy(float)
    return grown(xy, depth)


def _named(side: str, axes: Axes) -> list[str]:
    return [f"{side}{a}" for a in axes]


def _together(coordinates: list[str]) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(c) for c in coordinates))


def _there(df: DataFrame, coordinates: list[str]) -> DataFrame:
    for c in coordinates:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def _thinned(points: DataFrame, k: int, axes: Axes = PLANE) -> DataFrame:
    """Points but those that are no one's neighbour: of one place, the first k of each entity by pid, and the first 2k of these, hold the first k for any query."""
    place = _named("p", axes)
    own, all_ = Window.partitionBy(*place, "pwho").orderBy("pid"), Window.partitionBy(*place).orderBy("pid")
    first = points.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= k)
    return first.withColumn("__n", F.row_number().over(all_)).filter(F.col("__n") <= 2 * k).drop("__n")


def _placed(df: DataFrame, *by) -> DataFrame:
    """The rows with their leaf. by: the names of the coordinates, and the tree."""
    *coordinates, tree = by

    @F.pandas_udf("long")
    def leaf(at: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.leaf(at.to_numpy(float)))

    return df.withColumn("__leaf", leaf(_together(coordinates)))


def _searched(asked: DataFrame, points: DataFrame, k: int, exclude_self: bool, axes: Axes = PLANE) -> DataFrame:
    """The k nearest points of each query in each leaf that it asks: a query's rows with a column __leaf, points with theirs (a table)."""
    parts = asked.groupBy("__leaf").agg(F.ceil(F.count("*") / PART).alias("__parts"))  # a row a leaf
    parts = F.broadcast(parts)
    cell = F.shiftleft("__leaf", 32).bitwiseOR(F.col("__part")).alias("__cell")
    q_names, p_names = [c for c in asked.columns if c != "__leaf"], [c for c in points.columns if c != "__leaf"]
    q = asked.join(parts, "__leaf").withColumn("__part", F.pmod(F.xxhash64("qid"), F.col("__parts"))).select(cell, *q_names)
    p = points.join(parts, "__leaf").withColumn("__part", F.explode(F.expr("sequence(0L, __parts - 1)"))).select(cell.alias("__of"), *p_names)
    fields = [StructField(f.name, f.dataType) for f in (*asked.select(q_names).schema, *points.select(p_names).schema)]
    return dealt(q, "__cell").groupBy("__cell").cogroup(dealt(p, "__of").groupBy("__of")).applyInArrow(_kernel(q_names, p_names, k, exclude_self, axes), StructType([*fields, StructField("distance", DoubleType())]))


def _kernel(q_names: list[str], p_names: list[str], k: int, exclude_self: bool, axes: Axes):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, there = ([t[c].cast(pa.float64()).to_numpy() for c in _named(side, axes)] for t, side in ((left, "q"), (right, "p")))
        order = pd.factorize(right["pid"].to_pandas(), sort=True)[0]
        if exclude_self:
            codes = pd.factorize(pd.concat((left["qwho"].to_pandas(), right["pwho"].to_pandas())))[0]
            mine, theirs = codes[: len(left)], codes[len(left) :]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for first in range(0, len(left) if len(right) else 0, SLICE):
            at = slice(first, first + SLICE)
            d = np.sqrt(sum(off * off for off in (a[at, None] - b for a, b in zip(asks, there))))
            if exclude_self:
                d[mine[at, None] == theirs] = np.inf
            last = np.partition(d, k - 1, axis=1)[:, k - 1, None] if len(right) > k else np.inf
            i, j = np.nonzero((d <= last) & (d < np.inf))
            by = np.lexsort((order[j], d[i, j], i))
            i, j = i[by], j[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[keep] + first, j[keep], d[i[keep], j[keep]]))
        i, j, d = (np.concatenate(c) for c in zip(*found))
        return pa.table([*left.select(q_names).take(i).columns, *right.select(p_names).take(j).columns, pa.array(d)], names=[*q_names, *p_names, "distance"])

    return run


def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = True, axes: Axes = PLANE, leaf: int | None = None) -> DataFrame:
    """The k nearest points of each query by (distance, pid): the columns of both, distance and rank (from 1).

    queries: qid (one row each), qx, qy, qwho and others; points: pid, px, py, pwho and others, no name in both. With exclude_self, points of the query's own entity
    (qwho) are left out, and so are those of which this can't be told, as one is null. Rows with a null or NaN coordinate take no part. Where there are no more
    than k points, every query gets them all. Empty tables give no rows. axes: the coordinates, q and p and these names, if they are not qx, qy, px and py.
    leaf: points of a leaf, about.
    """
    points, queries = _there(points, _named("p", axes)), _there(queries, _named("q", axes))
    if exclude_self:
        points, queries = points.filter("pwho IS NOT NULL"), queries.filter("qwho IS NOT NULL")
    points = staged(points)
    tree = tree_of(points, axes, leaf)
    held = staged(_placed(_thinned(points, k, axes) if tree.crowded else points, *_named("p", axes), tree))
    left = staged(_placed(queries, *_named("q", axes), tree).withColumnRenamed("__leaf", "__own"))
    sure, up = None, 0
    best = Window.partitionBy("qid").orderBy("distance", "pid")
    while True:
        up = min(up, tree.depth)
        first = F.shiftleft(F.expr(f"shiftright(__own, {up})"), up)
        asks = left.withColumn("__leaf", F.explode(F.sequence(first, first + ((1 << up) - 1))))
        got = _searched(asks, held, k, exclude_self, axes).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        got = staged(got.withColumn("__up", F.lit(up)))
        full = staged(got.filter(F.col("rank") == k).select("qid", F.col("distance").alias("__far")))
        if up == tree.depth:  # these have seen every point
            done = got.drop("__own", "__up", "rank")
            break
        some = got.join(full, "qid", "left_semi")
        sure = some if sure is None else sure.unionByName(some)
        farther = left.join(full, "qid").withColumn("__up", F.lit(up))
        more = farther if up == 0 else more.unionByName(farther)
        left = staged(left.join(full, "qid", "left_anti"))
        if left.isEmpty():
            done = None
            break
        up += STEP
    if sure is not None:
        seen = sure.drop("__own", "__up", "rank")
        done = seen if done is None else done.unionByName(seen)
        beyond = _searched(staged(_farther(more, tree, axes)), held, k, exclude_self, axes)
        done = done.unionByName(beyond)
    return done.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _farther(queries: DataFrame, tree: Tree, axes: Axes = PLANE) -> DataFrame:
    """The queries with each leaf that their k-th distance so far (__far) reaches outside the subtree that they have seen (__up levels above their leaf)."""

    @F.pandas_udf("array<long>")
    def leaves(place: pd.DataFrame, far: pd.Series, own: pd.Series, up: pd.Series) -> pd.Series:
        xy = place.to_numpy(float)
        who, leaf = tree.reached(xy, far.to_numpy(float) * (1 + 1e-9))  # room for rounding
        new = leaf >> up.to_numpy()[who] != own.to_numpy()[who] >> up.to_numpy()[who]
        who, leaf = who[new], leaf[new]
        by = np.argsort(who, kind="stable")
        return pd.Series(np.split(leaf[by], np.searchsorted(who[by], np.arange(1, len(xy)))))

    at = leaves(_together(_named("q", axes)), "__far", "__own", "__up")
    return queries.withColumn("__leaf", F.explode(at)).drop("__far", "__up", "__own")
