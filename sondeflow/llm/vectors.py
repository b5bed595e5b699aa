"""What the two vector searches share: packing vectors, their common length, waves of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries a wave broadcasts at most, about; a wave of 64-dimensional vectors takes 2 MB.
WAVE = 4096


def packed(table: DataFrame, id_: str, vector: str, change: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = True) -> DataFrame:
    """vec_id long, dim int, v binary (doubles), without rows whose id or vector is null, whose vector is empty or holds null, NaN or
    infinite components, or (unless `zero`) is all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and (zero or x.any()):
                    ids.append(i)
                    vs.append(change(x) if change else x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(v) for v in vs], pa.int32()), pa.array([v.tobytes() for v in vs], pa.binary())], names=["vec_id", "dim", "v"])

    return table.select(F.col(id_).alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, "vec_id long, dim int, v binary")


def lengths(table: DataFrame) -> list[int]:
    """The lengths that vectors have, one as a rule."""
    return sorted(r["dim"] for r in table.select("dim").distinct().collect())


def single(table: DataFrame, dim: int) -> DataFrame:
    """node, v and w, the vector in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = matrix(batch.column(1).to_pylist(), dim).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in w], pa.binary())], names=["node", "v", "w"])

    return table.select("node", "v").mapInArrow(run, "node long, v binary, w binary")


def matrix(rows: list, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim) if rows else np.zeros((0, dim), kind)


def waves(queries: DataFrame, key: str, n: int) -> Iterator[DataFrame]:
    """The queries in parts of about WAVE rows by a hash of the key; n: their number."""
    parts = -(-n // WAVE)
    for k in range(parts):
        yield queries if parts == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
