"""Exact top-k by inner product with a pivot table.

Each vector's distances to PIVOTS pivots are computed once and written beside it. For a query q and a candidate x the triangle inequality gives
|q - x| >= max over pivots |d(q, p) - d(x, p)|, and so an upper bound of the product, (|q|^2 + |x|^2 - |q - x|^2) / 2.
Candidates of a block are taken in the order of that bound, best first, until the bound falls below the query's k-th
product so far. A first threshold comes from a sample of real candidates, so most blocks send few rows on.

Queries come in waves of bounded size (broadcast); every wave passes over all rows in blocks. Products are exact: in doubles while all
sums stay below 2^53, else in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.llm.common import written
from sondeflow.llm.vectors import lengths, matrix, packed, waves

PIVOTS = 32
SAMPLE = 1024  #: rows, in the order of a hash of the id, that pivots and first thresholds come from
BLOCK = 8192
SCALE = 256
_LIMIT = float(1 << 62)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 x); beyond 2^62 in size it raises."""
    out = np.floor(SCALE * x)
    if len(bad := x[np.abs(out) > _LIMIT]):
        raise ValueError(f"component {bad[0]!r} is beyond 2^62 when scaled: its products are no 64-bit numbers")
    return out


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each the sample's row farthest from those before."""
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row for each pivot."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots])


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products; one beyond 64 bits raises."""
    if len(x) and float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) >= 1 << 53:
        whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
        if bad := [v for v in whole if not -(1 << 63) <= v < 1 << 63]:
            raise OverflowError(f"an inner product of {bad[0]} is no 64-bit number")
        return np.array(whole, np.int64)
    return (x @ q).astype(np.int64)


class _Best:
    """The k best (score, smaller id first) of one query so far."""

    def __init__(self, k: int, at_least: int | None) -> None:
        self.k, self.score, self.id, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), at_least

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        _, first = np.unique(np.stack((s, i)), axis=1, return_index=True)
        s, i = s[first], i[first]
        order = np.lexsort((i, -s))[: self.k]
        self.score, self.id = s[order], i[order]
        if len(order) == self.k:
            self.least = int(self.score[-1]) if self.least is None else max(self.least, int(self.score[-1]))


def top_products(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest integer inner products of each query, ties to the smaller vec_id.

    Queries: rows whose id is divisible by `every`; candidates: all rows of another id. Vectors become floor(256 x). Rows with a null id, or a vector
    that is null, empty or holds null or non-finite components, take no part. Vectors of different lengths have no product: each length is searched by
    itself. Repeated rows count once. Fewer than k candidates give as many rows; an empty table gives none. A score is a 64-bit number: components beyond
    2^62 in size when scaled and products beyond 64 bits raise an error.
    """
    spark = table.sparkSession
    whole = written(packed(table, id_, vector, scaled), "integers")
    found = None
    for dim in lengths(whole):
        part = _top_of(whole.filter(F.col("dim") == dim), dim, every, k)
        found = part if found is None else found if part is None else found.union(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if found is None else found


def _top_of(whole: DataFrame, dim: int, every: int, k: int) -> DataFrame | None:
    """The same for vectors of one length; None without queries."""
    spark = whole.sparkSession
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    some, some_ids = matrix([r["v"] for r in sample], dim), np.array([r["vec_id"] for r in sample], np.int64)
    pivots = _far_apart(some, PIVOTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(matrix(batch.column(1).to_pylist(), dim), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in d.T], pa.binary())], names=["vec_id", "v", "d"])

    pivoted = written(whole.select("vec_id", "v").mapInArrow(measure, "vec_id long, v binary, d binary"), "pivots")
    queries = pivoted.filter(F.col("vec_id") % every == 0)
    parts = []
    for wave in waves(queries, "vec_id", queries.count()):
        rows = wave.collect()
        asked = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), matrix([r["v"] for r in rows], dim), np.array([np.frombuffer(r["d"]) for r in rows]).reshape(len(rows), len(pivots))))
        parts.append(written(pivoted.mapInArrow(_searcher(asked, dim, k, some, some_ids), "query_id long, vec_id long, score long"), "found"))
    if not parts:
        return None
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(asked, dim: int, k: int, some: np.ndarray, some_ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, dq = asked.value
        best = []
        for i, x in zip(ids, q):  # a first threshold: the k-th of the sample; its rows come again in their own blocks
            s = np.sort(_products(some, x)[_first_of_each(some_ids, i)])
            best.append(_Best(k, int(s[-k]) if len(s) >= k else None))
        own, vs, ds, n = [], [], [], 0
        for batch in batches:
            own.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            vs += batch.column("v").to_pylist()
            ds += batch.column("d").to_pylist()
            n += batch.num_rows
            if n >= BLOCK:
                _block(np.concatenate(own), matrix(vs, dim), np.frombuffer(b"".join(ds)).reshape(n, -1).T, ids, q, dq, best)
                own, vs, ds, n = [], [], [], 0
        if n:
            _block(np.concatenate(own), matrix(vs, dim), np.frombuffer(b"".join(ds)).reshape(n, -1).T, ids, q, dq, best)
        cols = [np.repeat(ids, [len(b.id) for b in best]), np.concatenate([b.id for b in best] or [ids[:0]]), np.concatenate([b.score for b in best] or [ids[:0]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _first_of_each(ids: np.ndarray, but: int) -> np.ndarray:
    _, at = np.unique(ids, return_index=True)
    return at[ids[at] != but]


def _block(own: np.ndarray, x: np.ndarray, dx: np.ndarray, ids: np.ndarray, q: np.ndarray, dq: np.ndarray, best: list[_Best]) -> None:
    square = (x * x).sum(axis=1)
    dx = np.ascontiguousarray(dx)
    for i, a, b, mine in zip(ids, q, dq, best):
        far = np.abs(dx - b[:, None]).max(axis=0)
        bound = (square + float((a * a).sum()) - far * far) / 2
        bound += 1e-9 * (square + float((a * a).sum())) + 1
        left = np.flatnonzero((bound >= mine.least if mine.least is not None else np.ones(len(bound), bool)) & (own != i))
        left = left[np.argsort(-bound[left], kind="stable")]
        at, step = 0, 256
        while at < len(left) and (mine.least is None or bound[left[at]] >= mine.least):
            part = left[at : at + step]
            s = _products(x[part], a)
            good = s >= mine.least if mine.least is not None else np.ones(len(s), bool)
            if good.any():
                mine.add(s[good], own[part][good])
            at, step = at + step, 2 * step
