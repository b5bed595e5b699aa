"""Assigning entities to folds."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window


def balanced(entities: DataFrame, key: str, load: str, folds: int) -> DataFrame:
    """Heaviest first, each to the fold with the least load so far (the lowest of equals); equal loads in the order of key.

    The rule is sequential: one row for each entity passes, sorted, through one task that holds a heap of folds and nothing else. For a number
    of entities that one task should not go through, use `hashed`.
    """
    ordered = entities.select(F.col(key), F.col(load).cast("double").alias(load)).repartition(1).sortWithinPartitions(F.desc(load), key)

    def run(frames):
        heap = [(0.0, f) for f in range(folds)]
        for pdf in frames:
            out = []
            for x in pdf[load].tolist():
                total, f = heap[0]
                heapq.heapreplace(heap, (total + x, f))
                out.append(f)
            yield pdf.assign(fold=pd.Series(out, dtype="int32", index=pdf.index))

    return ordered.mapInPandas(run, StructType([*ordered.schema, StructField("fold", IntegerType())]))


def hashed(entities: DataFrame, key: str, folds: int, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """Seeded shuffle by 60 bits of an md5, dealt round robin within each stratum (over all entities, by the hash alone, without strata)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    if not strata:
        return entities.withColumn("fold", F.pmod(h, F.lit(folds)).cast("int"))
    w = Window.partitionBy(*strata).orderBy(h, key)
    return entities.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(folds)).cast("int"))


def merged_by_signature(folds: DataFrame, key: str, signature: str) -> DataFrame:
    """All entities with one signature go to the fold of the smallest key among them."""
    return folds.withColumn("fold", F.min_by("fold", key).over(Window.partitionBy(signature)))


def balance(assigned: DataFrame, load: str) -> DataFrame:
    return assigned.groupBy("fold").agg(F.count("*").alias("entities"), F.sum(load).alias("load"))


def strata(df: DataFrame, cluster: str, quartile: str, flag: str) -> DataFrame:
    return df.withColumn("stratum", F.col(cluster) * 12 + F.col(quartile) * 3 + F.col(flag))
