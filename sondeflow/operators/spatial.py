"""What is computed from nearest neighbours (`nearby.nearest`) and features: weighted means, leave-one-entity-out surfaces, local planes, and neighbours in
feature space.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.operators.aggregates import plane_fit
from sondeflow.operators.nearby import nearest
from sondeflow.sources.staging import staged

#: Entities of a leaf.
BLOCK = 2048


def inverse_distance(neighbours: DataFrame, value: str, eps: float = 1e-6) -> DataFrame:
    """qid, mean weighted by 1 / (distance + eps), spread under the same weights, and the nearest distance."""
    w = 1 / (F.col("distance") + eps)
    v = F.col(value)
    g = neighbours.groupBy("qid").agg((F.sum(w * v) / F.sum(w)).alias("idw"), (F.sum(w * v * v) / F.sum(w)).alias("__m2"), F.min("distance").alias("near"))
    return g.select("qid", "idw", F.sqrt(F.greatest(F.col("__m2") - F.col("idw") * F.col("idw"), F.lit(0.0))).alias("idw_std"), "near")


def local_planes(neighbours: DataFrame, value: str, eps: float = 1e-3, ridge: float = 1e-9, least: int = 3) -> DataFrame:
    """qid, value at the query of the plane fitted to its neighbours with weights 1 / (distance + eps); the weighted mean where they lie on a line."""
    rows = neighbours.withColumn("dx", F.col("px") - F.col("qx")).withColumn("dy", F.col("py") - F.col("qy"))
    w = 1 / (F.col("distance") + eps)
    fit = plane_fit(rows, value, "dx", "dy", ["qid"], least, w, ridge)
    mean = rows.groupBy("qid").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))
    return fit.join(mean, "qid").select("qid", F.coalesce("c0", "mean").alias("plane"))


def standardised(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """Columns less their mean over their population deviation (over `by` if given); a constant column becomes 0."""
    stats = (by if by is not None else df).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    out = df.join(F.broadcast(stats))
    z: dict[str, Column] = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in columns}
    return out.withColumns(z).drop(*(f"__{p}_{c}" for c in columns for p in "ms"))


def clusters(df: DataFrame, columns: list[str], k: int, name: str = "cluster", seed: int = 42) -> DataFrame:
    """k-means labels; their numbering depends on the seed only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=name).fit(made).transform(made).drop("__v")


def feature_neighbours(focus: DataFrame, others: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """The k nearest other entities of each focus entity in features standardised over `others`, by (distance, key): see all_feature_neighbours, of which
    these are the focus entities' rows."""
    return all_feature_neighbours(others, key, features, k).join(focus.select(F.col(key).alias("focus")).distinct(), "focus", "left_semi")


def all_feature_neighbours(entities: DataFrame, key: str, features: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """feature_neighbours with every entity as focus, for one row a key. Entities are searched by leaves of about `block` of them, of a k-d tree over the standardised features
    (see nearby.nearest): exact, and meant for a few features, as in many a leaf's neighbourhood is all leaves. A distance with a null feature is null and ranks last."""
    scaled = staged(standardised(entities.select(key, *features), features).filter(F.col(key).isNotNull()))
    whole = reduce(and_, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features))
    known, odd = scaled.filter(whole), scaled.filter(~whole)
    axes = tuple(map(str, range(len(features))))
    side = lambda s: known.select(F.col(key).alias(f"{s}id"), F.col(key).alias(f"{s}who"), *(F.col(c).cast("double").alias(s + a) for a, c in zip(axes, features)))
    near = nearest(side("q"), side("p"), k, axes=axes, leaf=block).select(F.col("qid").alias("focus"), F.col("pid").alias(key), "distance", "rank")
    if odd.isEmpty():
        return near
    # Distances that are null are ordered by key alone: k + 1 entities hold the first k others of any.
    unknown = lambda focus, others, n: focus.select(F.col(key).alias("focus")).join(F.broadcast(others.select(key).orderBy(key).limit(n)), F.col("focus") != F.col(key)).withColumn("distance", F.lit(None).cast("double"))
    near = near.drop("rank").union(unknown(odd, scaled, k + 1))
    if known.limit(k + 1).count() <= k:
        near = near.union(unknown(known, odd, k))
    by = Window.partitionBy("focus").orderBy(F.asc_nulls_last("distance"), key)
    return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def surface_offset(rows: DataFrame, surface: str, z: str, given: str, key: str) -> DataFrame:
    """The surface less z, moved by the median of what the known rows of the key lack to it (0 without any)."""
    raw = F.col(surface) - F.col(z)
    off = rows.groupBy(key).agg(F.coalesce(F.percentile(F.col(given) - raw, F.lit(0.5)), F.lit(0.0)).alias("__off"))
    return rows.join(off, key).withColumn("moved", raw + F.col("__off")).drop("__off")


def transferred(neighbours: DataFrame, value: str) -> DataFrame:
    """qid and the plain mean of its neighbours' values."""
    return neighbours.groupBy("qid").agg(F.avg(value).alias("transferred"), F.count("*").alias("n"))
