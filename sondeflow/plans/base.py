"""Sequences made of the events table, as a DataFrame and as the SQL that the checks start from.

A user's events in the order of (ts, event_id) are one well: md is seconds since the first, gr the value but for errors, x and tvt are
running sums (of whole numbers, so both engines agree), and the last 73 % of tvt is hidden in tvt_input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sondeflow.operators import sequence


def in_well() -> WindowSpec:
    return Window.partitionBy("well").orderBy("row_idx")


def back_in_well() -> WindowSpec:
    return sequence.in_reverse()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well, row_idx, event_id, event_type, value, md, gr, x, y, z, tvt, tvt_input."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "event_id", "event_type", "ts", "value")
    out = sequence.row_index(e, ["ts", "event_id"])
    every = Window.partitionBy("well")
    out = out.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("md", (micros(F.col("ts")) - F.min(micros(F.col("ts"))).over(every)) / 1e6)
    past = in_well().rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("gr", F.when(F.col("event_type") != "error", F.col("value")))
    out = out.withColumn("x", F.sum(F.round(F.col("value") * 10).cast("long")).over(past) / 10.0)
    out = out.withColumn("tvt", F.sum(F.round(F.col("value") * 100).cast("long")).over(past) / 100.0)
    out = out.withColumn("y", F.col("row_idx") * F.col("value") / 10).withColumn("z", F.col("value") - F.col("x") / 20)
    out = out.withColumn("tvt_input", F.when(F.col("row_idx") < F.floor(F.col("n") * 0.27), F.col("tvt")))
    return out.select("well", "row_idx", "event_id", "event_type", "value", "md", "gr", "x", "y", "z", "tvt", "tvt_input")


WELLS_SQL = """
raw AS (
  SELECT user_id AS well, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx,
         count(*) OVER (PARTITION BY user_id) AS n,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS md
  FROM events),
sums AS (
  SELECT *, CASE WHEN event_type <> 'error' THEN value END AS gr,
         CAST(sum(CAST(round(value * 10) AS BIGINT)) OVER past AS DOUBLE) / 10.0 AS x,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER past AS DOUBLE) / 100.0 AS tvt
  FROM raw WINDOW past AS (PARTITION BY well ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
wells AS (
  SELECT well, row_idx, event_id, event_type, value, md, gr, x, row_idx * value / 10 AS y, value - x / 20 AS z, tvt,
         CASE WHEN row_idx < floor(n * 0.27::DOUBLE) THEN tvt END AS tvt_input
  FROM sums)"""

BASE_SQL = (
    WELLS_SQL
    + """,
parts AS (
  SELECT *, count(*) OVER (PARTITION BY well) AS n_rows,
         coalesce(min(CASE WHEN tvt_input IS NULL THEN row_idx END) OVER (PARTITION BY well), count(*) OVER (PARTITION BY well)) AS ps_idx
  FROM wells),
last_known AS (
  SELECT well, md AS md0, x AS x0, y AS y0, z AS z0, tvt_input AS tvt0 FROM parts WHERE row_idx = greatest(ps_idx - 1, 0)),
base AS (
  SELECT p.*, p.ps_idx AS known_length, p.n_rows - p.ps_idx AS hidden_length, p.row_idx >= p.ps_idx AS is_target,
         p.tvt_input IS NOT NULL AS is_known, p.gr IS NULL AS is_gr_missing, md0, x0, y0, z0, tvt0,
         md - md0 AS delta_md, x - x0 AS delta_x, y - y0 AS delta_y, z - z0 AS delta_z,
         greatest(p.row_idx - p.ps_idx, 0) AS post_ps_step, p.row_idx / greatest(p.n_rows - 1, 1) AS row_frac
  FROM parts p JOIN last_known USING (well))"""
)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wells with segments, anchor (md0, x0, y0, z0, tvt0) and differences from it."""
    out = sequence.segments(wells(spark, sf_dir))
    out = sequence.anchors(out, {"md": "md0", "x": "x0", "y": "y0", "z": "z0", "tvt_input": "tvt0"})
    return sequence.from_anchor(out, {"md": "md0", "x": "x0", "y": "y0", "z": "z0"})
