"""Centroid clustering by plain Lloyd rounds on integer vectors.

Centroids are broadcast; mapInPandas takes the integer squared differences to each centroid in NumPy and the first smallest one, and gives
one row of exact integer sums for each centroid and task, which a groupBy merges. No row of the table is shuffled: every round is a scan,
and all that reaches the driver is k rows of sums, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest size of an integer component: squared differences of 64 of them, and sums over 2**36 rows, fit 64 bits.
MOST = 1 << 27


def integers(table: DataFrame, id_: str, vector: str, dim: int, scale: float) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the rows whose vector has `dim` components, none null or non-finite."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector).cast("array<double>")
    whole = table.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == dim) & F.forall("v", real))
    return whole.select("vec_id", F.transform("v", lambda x: F.floor(_held(x * scale))).alias("v"))


def _held(x: Column) -> Column:
    return F.when(F.abs(x) <= MOST, x).otherwise(F.raise_error(F.concat(F.lit("a component is beyond 2**27: "), x.cast("string"))).cast("double"))


def starts(table: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with smallest hexadecimal sha256 of `<salt>:<vec_id>`; equal hashes by components, null ids last."""
    first = table.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return np.array([r["v"] for r in first.orderBy(F.asc_nulls_last("h"), "v").collect()], np.int64)


def _nearest(rows: pd.Series, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors as a matrix, the nearest centroid of each, the lowest of equally near ones, and the squared distance."""
    x = np.stack(rows.to_numpy()).astype(np.int64)
    d = np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return x, best, d[np.arange(len(x)), best]


def sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """For each centroid with vectors: their number, the sum of their distances, and the sums of their components."""
    k, dim = centroids.shape
    held = table.sparkSession.sparkContext.broadcast(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, 2 + dim), np.int64)
        for part in parts:
            if len(part):
                x, best, distance = _nearest(part["v"], held.value)
                np.add.at(total, best, np.column_stack((np.ones_like(distance), distance, x)))
        some = np.flatnonzero(total[:, 0])
        yield pd.DataFrame({"cluster": some, **{name: total[some, i] for i, name in enumerate(names)}})

    names = ["n", "inertia", *(f"s{i}" for i in range(dim))]
    parts = table.select("v").mapInPandas(run, "cluster int, " + ", ".join(f"{name} long" for name in names))
    merged = parts.groupBy("cluster").agg(*(F.sum(name).alias(name) for name in names)).collect()
    held.unpersist()
    return {r["cluster"]: (r["n"], r["inertia"], [r[name] for name in names[2:]]) for r in merged}


def clusters(table: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = 16, dim: int = 64, scale: float = 64.0, rounds: int = 3, salt: str = "1") -> DataFrame:
    """vec_id, cluster int, distance long, cluster_inertia, inertia long, centroid_sha256: a row for each kept vector.

    Vectors that are null, of another length, or hold null or non-finite components take no part; those with a null id do, but start no cluster
    while others are left. Centroids start as the k vectors with the smallest sha256 of `<salt>:<id>` (fewer if there are fewer). Each
    round assigns every vector to the nearest centroid (squared distance, ties to the smaller number) and replaces each
    centroid that has vectors by floor(sum / count); then vectors are assigned once more. Rows that repeat an id are vectors of their own;
    other columns are ignored. A component beyond 2**27 after scaling raises, as distances would not fit a long. An empty table gives no rows.
    """
    spark = table.sparkSession
    kept = integers(table, id_, vector, dim, scale)
    centroids = starts(kept, k, salt)
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return kept.select("vec_id").join(spark.createDataFrame([], schema), F.lit(False)).select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), *("cluster_inertia", "inertia", "centroid_sha256"))
    for _ in range(rounds):
        for i, (n, _, s) in sums(kept, centroids).items():
            centroids[i] = [x // n for x in s]
    last = {i: inertia for i, (_, inertia, _) in sums(kept, centroids).items()}
    held = spark.sparkContext.broadcast(centroids)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                _, best, distance = _nearest(part["v"], held.value)
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "cluster": best.astype(np.int32), "distance": distance})

    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(i, last[i], sum(last.values()), digest[i]) for i in last], schema)  # k rows at most
    return kept.mapInPandas(run, "vec_id long, cluster int, distance long").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
