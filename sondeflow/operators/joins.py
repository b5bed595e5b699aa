"""Joins with stated cardinality, order and fallback rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.operators.line import nearest_on_line

#: Rows a lookup side may have to be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


class CardinalityError(ValueError):
    """A lookup side repeats a key, or lacks one that must be there."""


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, marked for broadcast if it has at most `rows` rows and, written as JSON, `most` bytes (both counted up to that many rows)."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    n, total = df.limit(rows + 1).select(size.alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def every_pair(asked: DataFrame, candidates: DataFrame, condition: Column) -> DataFrame:
    """Pairs of two sets of entities under a condition. Candidates that are small are broadcast; others are dealt into blocks, and the asked ones go to each."""
    few = small(candidates)
    if few is not candidates:
        return asked.join(few, condition)
    blocks = max(1, -(-candidates.count() // BROADCAST_ROWS))
    dealt = candidates.withColumn("__block", F.pmod(F.xxhash64(*candidates.columns), F.lit(blocks)))
    every = asked.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return every.join(dealt, "__block").filter(condition).drop("__block")


def attach(left: DataFrame, right: DataFrame, on: list[str], complete: bool = True) -> DataFrame:
    """Left join many-to-one. The right side must have each key once, and with `complete` every key of the left; both are checked first."""
    twice = right.groupBy(*on).count().filter("count > 1").limit(5).collect()
    if twice:
        raise CardinalityError(f"keys that repeat: {[tuple(r)[:-1] for r in twice]}")
    if complete:
        lost = left.select(*on).distinct().join(right, on, "left_anti").limit(5).collect()
        if lost:
            raise CardinalityError(f"keys that are missing: {[tuple(r) for r in lost]}")
    return left.join(small(right), on, "left")


def with_fallback(left: DataFrame, right: DataFrame, on: list[str], value: str, fallback: Column) -> DataFrame:
    return left.join(right.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), fallback))


def either_side(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer join in which a's value wins over b's; tells which side it came from."""
    x = a.select(*on, F.col(value).alias("__a"))
    y = b.select(*on, F.col(value).alias("__b"))
    origin = F.when(F.col("__a").isNull(), "b").when(F.col("__b").isNull(), "a").otherwise("both")
    return x.join(y, on, "full_outer").select(*on, F.coalesce("__a", "__b").alias(value), origin.alias("origin"))


def all_inner(frames: dict[str, DataFrame], on: list[str], value: str) -> DataFrame:
    """Rows that every frame has, with each frame's value under its name: one aggregation in place of a chain of joins.

    Keys must be unique in each frame and values not null.
    """
    rows = None
    for name, df in frames.items():
        part = df.select(*on, F.lit(name).alias("__name"), F.col(value).cast("double").alias("__value"))
        rows = part if rows is None else rows.union(part)
    cols = [F.max(F.when(F.col("__name") == n, F.col("__value"))).alias(n) for n in frames]
    return rows.groupBy(*on).agg(F.count("*").alias("__n"), *cols).filter(F.col("__n") == len(frames)).drop("__n")


def by_position(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], key: str) -> DataFrame:
    """Join rows by their place within each key under explicit total orders."""
    place = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return place(a, order_a).join(place(b, order_b), [key, "place"])


def by_rounded(left: DataFrame, right: DataFrame, columns: list[str], digits: int, keep: list[str]) -> DataFrame:
    """Equi-join on coordinates rounded half to even, the right side first reduced to one row (the smallest `keep`) for each place."""
    at = [F.bround(c, digits).alias(f"__{c}") for c in columns]
    names = [f"__{c}" for c in columns]
    one = right.select(*at, F.struct(*keep).alias("__row")).groupBy(*names).agg(F.min("__row").alias("__row"))
    out = left.select("*", *at).join(one, names, "left")
    return out.select(*left.columns, *(F.col(f"__row.{k}").alias(k) for k in keep))


def present_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def absent_from(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def window_candidates(rows: DataFrame, grid: DataFrame, at: str, reach: int, value: str) -> DataFrame:
    """For each row the grid place within `reach` of its own with the nearest value (the smaller place of equals).

    rows: columns and an integer place `at`; grid: g_at, g_value. Each row asks for its 2 reach + 1 places by an equi-join, so no range or cross join.
    """
    asked = rows.withColumn("g_at", F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)))
    both = asked.join(grid, "g_at")
    best = F.min(F.struct(F.abs(F.col("g_value") - F.col(value)).alias("cost"), F.col("g_at").alias("g_at")))
    keys = rows.columns
    return both.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.g_at").alias("match"), F.col("b.cost").alias("cost"))


def nearest_of_kinds(asked: DataFrame, candidates: DataFrame, distance: Column | tuple[str, str], key: str, other: str, kind: str, k: int) -> DataFrame:
    """The k nearest candidates of each key with different kinds: the nearest of each kind, then by distance. Both are sets of entities (one row each).

    A distance that is the difference of a number of each side is given as the names of the two: these are swept in order (see nearest_on_line), which gives key,
    other, kind, distance and rank. Any other distance is taken of all pairs: see every_pair."""
    if isinstance(distance, tuple):
        return nearest_on_line(asked, candidates, distance, key, other, kind, k)
    pairs = every_pair(asked, candidates, F.col(key) != F.col(other)).withColumn("distance", distance)
    one = pairs.withColumn("__k", F.row_number().over(Window.partitionBy(key, kind).orderBy("distance", other))).filter("__k = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", other))).filter(F.col("rank") <= k).drop("__k")


def own_first(asked: DataFrame, candidates: DataFrame, score: Column | tuple[str, str], key: str, other: str, k: int) -> DataFrame:
    """k candidates of each key: its own, ranked 1 with a null score, then the k - 1 others with the smallest score, ties to the smaller. A score that is
    the difference of two numbers is given as their names: see nearest_of_kinds."""
    if isinstance(score, tuple):
        best = nearest_on_line(asked, candidates, score, key, other, other, k - 1).withColumnRenamed("distance", "score").withColumn("rank", F.col("rank") + 1)
    else:
        pairs = every_pair(asked, candidates, F.col(key) != F.col(other)).withColumn("score", score)
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("score", other)) + 1).filter(F.col("rank") <= k)
    own = asked.select(key, F.col(key).alias(other), F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank"))
    return own.unionByName(best.select(key, other, "score", "rank"))


def with_suffixes(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "left") -> DataFrame:
    """Join on several columns; columns that both sides have besides get a suffix each."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    return a.join(right.withColumnsRenamed({c: c + suffixes[1] for c in shared}), on, how)


def overwritten(left: DataFrame, right: DataFrame, columns: list[str], digits: int, value: str, weight: float) -> DataFrame:
    """`value` moved by `weight` towards the right side's where a row lies at the same rounded place (see by_rounded); others keep theirs."""
    out = by_rounded(left, right.select(*columns, F.col(value).alias("__other")), columns, digits, ["__other"])
    moved = (1 - weight) * F.col(value) + weight * F.col("__other")
    return out.withColumn(value, F.coalesce(moved, F.col(value))).drop("__other")


def all_keys(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that any of the frames has, each once."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()
