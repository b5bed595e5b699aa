"""Connected components by alternating large and small stars, each round written to the shared folder in place of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import forget, written

#: Far more than the logarithm of any number of vertices; reaching it raises.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex that has a link to another.

    links: a long, b long, in any direction; loops and repeats do no harm, links with a null are left out. Returns vertex,
    component, but for the smallest vertex of each component, which is its own. An empty table gives no rows. The number of rounds grows with the
    logarithm of the number of vertices; only a count and a sum of each round reach the driver. A vertex with very many links is one key of
    joins whose sides are both read from tables, so adaptive execution can split it.
    """
    edges = written(_down(links), "links")
    before = None
    for _ in range(ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = _down(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(parent.select("a", F.col("m").alias("b")))
        after = written(_down(small), "links")
        forget(edges, least)
        edges = after
    raise RuntimeError(f"no stable components after {ROUNDS} rounds")


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller vertex."""
    return links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), (F.col("a") != F.col("b")).alias("apart")).filter("apart").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
