"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, so a vector that a third of the rows share is one node too. The graph starts from cells of a few
random-hyperplane orderings. Each round joins every node's neighbours, forward and (up to K, by hash) backward, with their
vectors; members of one node's list are measured against each other, and pairs closer than what either has so far go to a
merge that keeps the K nearest. Only pairs with a member that is new since the last round are measured.

The graph is built on vectors in single precision. Queries walk it on the original ones: the EF nearest nodes seen so far are the front, and the
neighbours of its nodes not yet opened are measured, until the front stays, however many steps that takes. A query that is a row starts from its own node's list. All rounds are Spark joins on nodes; what is broadcast is one wave of query
vectors. The index covers every row. Recall over check data is in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.llm.common import forget, written
from sondeflow.llm.vectors import lengths, matrix, packed, single, waves

K = 24
TREES, CELL, BITS = 4, 128, 6
ROUNDS, EACH = 5, 6
EF = 256
SETTLED = 0.02  #: rounds end when so small a share of the graph's edges is new


def _groups(keys: list[np.ndarray]) -> Iterator[slice]:
    """Runs of equal keys."""
    edge = np.zeros(len(keys[0]), bool)
    for k in keys:
        edge[1:] |= k[1:] != k[:-1]
    cut = np.concatenate(([0], np.flatnonzero(edge), [len(edge)]))
    for a, b in zip(cut[:-1], cut[1:]):
        yield slice(a, b)


def _square_distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    return np.maximum(s[:, None] + s[None, :] - 2 * (x @ x.T), 0)


def _start(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """a, b, d: the K nearest of each node within its cell, for each of TREES orderings."""
    r = np.random.default_rng(7)
    planes = r.standard_normal((TREES, BITS + 1, dim)).astype(np.float32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist(), dim, np.float32)
            for t in range(TREES):
                p = (x @ planes[t].T).astype(np.float64)
                bit = (p[:, :BITS] > 0) @ (1 << np.arange(BITS))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bit.astype(np.int64)), pa.array(p[:, BITS]), *batch.columns], names=["tree", "code", "along", "node", "v"])

    coded = nodes.select("node", "v").mapInArrow(code, "tree int, code long, along double, node long, v binary")
    ordered = coded.repartitionByRange(max(1, min(4096, TREES * n // 8192)), "tree", "code", "along").sortWithinPartitions("tree", "code", "along")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, rows = -1, [], []
        for batch in batches:
            for t, i, v in zip(batch.column("tree").to_pylist(), batch.column("node").to_pylist(), batch.column("v").to_pylist()):
                if t != tree or len(ids) == CELL:
                    yield from _nearest(ids, rows, dim)
                    tree, ids, rows = t, [], []
                ids.append(i)
                rows.append(v)
        yield from _nearest(ids, rows, dim)

    return ordered.select("tree", "node", "v").mapInArrow(cells, "a long, b long, d float")


def _nearest(ids: list[int], rows: list[bytes], dim: int) -> Iterator[pa.RecordBatch]:
    if len(ids) < 2:
        return
    d = _square_distances(matrix(rows, dim, np.float32))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, : min(K, len(ids) - 1)]
    a, b = np.repeat(np.array(ids), near.shape[1]), np.array(ids)[near].ravel()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.take_along_axis(d, near, 1).ravel().astype(np.float32))], names=["a", "b", "d"])


def _kept(edges: DataFrame) -> DataFrame:
    """The K nearest of each a, each b once; an edge that was there before is not new."""
    once = edges.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("at") <= K).drop("at")


def _round(graph: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """a, b, d: pairs found through a common neighbour that are nearer than a's farthest."""
    back = graph.select(F.col("b").alias("centre"), F.col("a").alias("member"), "new")
    back = back.withColumn("at", F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("new"), F.xxhash64("member"), "member"))).filter(F.col("at") <= K).drop("at")
    both = graph.select(F.col("a").alias("centre"), F.col("b").alias("member"), "new").union(back).groupBy("centre", "member").agg(F.max("new").alias("new"))
    reach = graph.groupBy("a").agg(F.when(F.count("*") >= K, F.max("d")).alias("reach"))
    known = nodes.select("node", "v").join(reach.withColumnRenamed("a", "node"), "node", "left")
    rows = both.join(known, both["member"] == known["node"]).select("centre", "member", "new", "reach", "v").repartition("centre").sortWithinPartitions("centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            c = t.column("centre").to_numpy()
            last = int(np.searchsorted(c, c[-1])) if len(c) else 0
            rest = t.slice(last)
            if last:
                yield _joined(t.slice(0, last), dim)
        if rest is not None and rest.num_rows:
            yield _joined(rest, dim)

    return rows.mapInArrow(run, "a long, b long, d float")


def _joined(t: pa.Table, dim: int) -> pa.RecordBatch:
    centre, member = t.column("centre").to_numpy(), t.column("member").to_numpy()
    new = t.column("new").to_numpy(zero_copy_only=False).astype(bool)
    reach = np.nan_to_num(t.column("reach").to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf)
    x = matrix(t.column("v").to_pylist(), dim, np.float32)
    out = []
    for s in _groups([centre]):
        ids, fresh = member[s], new[s]
        if len(ids) < 2 or not fresh.any():
            continue
        d = _square_distances(x[s])
        d[~(fresh[:, None] | fresh[None, :])] = np.inf
        np.fill_diagonal(d, np.inf)
        d[d >= reach[s][:, None]] = np.inf
        k = min(EACH, len(ids) - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        dist = np.take_along_axis(d, near, 1)
        i, j = np.nonzero(dist < np.inf)
        out.append((ids[i], ids[near[i, j]], dist[i, j]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.float32))], names=["a", "b", "d"])


def build_graph(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """a, b, d (squared distance): up to K near nodes of each node. nodes: node, v (single precision)."""
    graph = written(_kept(_start(nodes, n, dim).withColumn("new", F.lit(True))), "graph")
    for _ in range(ROUNDS):
        found = _round(graph, nodes, dim).withColumn("new", F.lit(True))
        before, graph = graph, written(_kept(graph.withColumn("new", F.lit(False)).union(found)), "graph")
        forget(before)
        if graph.filter("new").count() <= SETTLED * K * n:
            break
    return graph.drop("new")


def nearest(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision) of the k nearest rows found for each query.

    Queries: rows whose id is divisible by `every`; candidates: all rows of another id; ties to the smaller vec_id. Rows with a null id, or a vector that is null, empty, zero or
    holds null or non-finite components, take no part. Vectors of different lengths have no distance: each length is searched by itself. Repeated rows
    count once. Fewer than k candidates give as many rows; an empty table gives none.
    """
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = written(packed(table, id_, vector, zero=False), "vectors")
    found = None
    for dim in lengths(rows):
        part = _nearest_of(rows.filter(F.col("dim") == dim).select("vec_id", "v"), dim, every, k)
        found = part if found is None else found if part is None else found.union(part)
    return spark.createDataFrame([], out) if found is None else found


def _nearest_of(rows: DataFrame, dim: int, every: int, k: int) -> DataFrame | None:
    """The same for vectors of one length; None without queries."""
    nodes = written(single(rows.groupBy("v").agg(F.min("vec_id").alias("node")), dim), "nodes")
    # Ids of each node: the k + 1 smallest answer any query; the queries themselves are apart.
    named = written(rows.distinct().join(nodes.select("node", "v"), "v").select("node", "vec_id"), "names")
    few = named.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("at") <= k + 1).drop("at")
    queries = named.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "node")
    asked = written(queries.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "v"), "asked")
    n_asked = asked.count()
    if not n_asked:
        return None
    graph = build_graph(nodes.select("node", F.col("w").alias("v")), nodes.count(), dim)
    links = written(_adjacency(graph), "links")
    found = None
    for wave in waves(asked, "q", n_asked):
        part = _walk(wave, nodes.select("node", "v"), links, dim, k + 1)
        found = part if found is None else found.union(part)
    answers = found.join(few.withColumnRenamed("node", "b"), "b").join(queries.withColumnRenamed("node", "q"), "q").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def _adjacency(graph: DataFrame) -> DataFrame:
    """node, near: its neighbours forward, and backward up to K, nearest first."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    back = back.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("at") <= K).drop("at")
    return graph.select("a", "b").union(back.select("a", "b")).groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("near"))


def _walk(wave: DataFrame, nodes: DataFrame, links: DataFrame, dim: int, k: int) -> DataFrame:
    """q, b, d: the k nearest nodes that the walk of each query of the wave has seen, itself included."""
    spark = wave.sparkSession
    rows = wave.collect()
    ids = np.array([r["q"] for r in rows], np.int64)
    order = np.argsort(ids)
    asked = spark.sparkContext.broadcast((ids[order], matrix([r["v"] for r in rows], dim)[order]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = asked.value
        for batch in batches:
            qs = batch.column("qs")
            lengths = qs.value_lengths().to_numpy(zero_copy_only=False)
            q = qs.flatten().to_numpy(zero_copy_only=False)
            b = np.repeat(batch.column("b").to_numpy(zero_copy_only=False), lengths)
            v = matrix(batch.column("v").to_pylist(), dim)
            own = np.repeat(np.arange(len(v)), lengths)
            at = np.searchsorted(ids, q)
            d = np.empty(len(q))
            for i in range(0, len(q), 8192):
                s = slice(i, i + 8192)
                d[s] = np.sqrt(((x[at[s]] - v[own[s]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(d)], names=["q", "b", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        by_node = pairs.groupBy("b").agg(F.collect_list("q").alias("qs"))
        return by_node.join(nodes.select(F.col("node").alias("b"), "v"), "b").mapInArrow(measure, "q long, b long, d double")

    start = wave.select("q", F.col("q").alias("b")).union(wave.join(links, wave["q"] == links["node"]).select("q", F.explode("near").alias("b")))
    seen = written(measured(start.distinct()), "seen")
    front_of = Window.partitionBy("q").orderBy("d", "b")
    opened = wave.select("q", F.col("q").alias("b"))
    while True:
        front = seen.withColumn("at", F.row_number().over(front_of)).filter(F.col("at") <= EF).select("q", "b").join(opened, ["q", "b"], "left_anti")
        front = written(front, "front")
        reached = front.join(links, front["b"] == links["node"]).select("q", F.explode("near").alias("b")).distinct().join(seen, ["q", "b"], "left_anti")
        more = written(measured(reached), "seen")
        opened = opened.union(front)
        if more.isEmpty():  # no node of the front has a neighbour that was not seen
            break
        seen = seen.union(more)
    return seen.withColumn("at", F.row_number().over(front_of)).filter(F.col("at") <= k).drop("at")
