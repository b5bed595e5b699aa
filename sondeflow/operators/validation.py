"""Checks of the data contract. Each returns rows that tell what is wrong or one row of counts, all computed in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_mismatches(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], key: str, group: str) -> DataFrame:
    """Places in each group at which two tables differ in key, or that one lacks."""
    place = lambda df, o, n: df.select(group, F.col(key).alias(n), F.row_number().over(Window.partitionBy(group).orderBy(*o)).alias("place"))
    both = place(a, order_a, "a").join(place(b, order_b, "b"), [group, "place"], "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def broken_tails(df: DataFrame, given: str, key: str, index: str) -> DataFrame:
    """Keys in which a value comes after the first null, with how many."""
    first = F.min(F.when(F.col(given).isNull(), F.col(index))).over(Window.partitionBy(key))
    return df.withColumn("__f", first).groupBy(key).agg(F.count_if((F.col(index) >= F.col("__f")) & F.col(given).isNotNull()).alias("late")).filter("late > 0")


def largest_gap(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.abs(F.col(a) - F.col(b))).alias("gap"), F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias("unmatched"))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def fold_faults(folds: DataFrame, entities: DataFrame, key: str, n_folds: int) -> DataFrame:
    """One row: repeated keys, keys missing on either side, fold numbers out of range."""
    a = folds.groupBy(key).agg(F.count("*").alias("n"), F.min("fold").alias("lo"), F.max("fold").alias("hi"), F.lit(1).alias("in_folds"))
    b = entities.select(key).distinct().withColumn("in_entities", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("in_folds").isNull()).alias("without_fold"), F.count_if(F.col("in_entities").isNull()).alias("unknown"), F.count_if((F.col("lo") < 0) | (F.col("hi") >= n_folds)).alias("out_of_range"))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values of each column are null, NaN or infinite."""
    return df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def same_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both."""
    x = a.select(key).distinct().withColumn("__a", F.lit(1))
    y = b.select(key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"))


def fold_loads(folds: DataFrame, rows: DataFrame, key: str, load: str) -> DataFrame:
    """Keys whose stated load is not the number of their rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("rows"))
    both = folds.select(key, load).join(n, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return both.filter(~F.col(load).cast("long").eqNullSafe(F.col("rows")))


def gates(df: DataFrame, truth: str, guess: str, rows: int | None = None, error: tuple[float, float] | None = None) -> dict:
    """Number of rows and error; raises where rows are not as many as expected or the error lies outside its range."""
    e = F.col(guess) - F.col(truth)
    got = df.agg(F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse")).first().asDict()
    if rows is not None and got["rows"] != rows:
        raise ValueError(f"{got['rows']} rows, expected {rows}")
    if error is not None and not (got["rmse"] is not None and error[0] <= got["rmse"] <= error[1]):
        raise ValueError(f"an error of {got['rmse']}, expected {error[0]} to {error[1]}")
    return got


def present_files(spark, paths: list[str]) -> dict[str, bool]:
    """Whether each path is there, in any store that Spark reads."""
    out = {}
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out[path] = bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
    return out
