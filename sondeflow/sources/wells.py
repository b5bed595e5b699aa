"""Folders of well files: one CSV a well and kind, named {well}__{kind}.csv, under a folder for each split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from sondeflow.functions.scalars import known, row_id
from sondeflow.operators import sequence

KINDS = ("horizontal_well", "typewell")
# The columns of the raw files.
HORIZONTAL = ("MD", "X", "Y", "Z", "GR", "TVT_input", "TVT")
TYPEWELL = ("TVT", "GR", "Geology")
#: The files' name: what stands before the kind is the well.
NAME = r"([^/]+?)__(horizontal_well|typewell)\.csv$"


def raw(spark: SparkSession, folder: str, split: str, kind: str) -> DataFrame:
    """All files of one kind in one scan: split, well_id, source_path and the kind's columns; a column a file lacks is null, NaN is null.

    Columns are matched by header name within the widest header of the folder; every value is read as text and cast, so a word in a number's
    place is null. Files with other names are not read.
    """
    wanted = HORIZONTAL if kind == "horizontal_well" else TYPEWELL
    path = f"{folder}/{split}/*__{kind}.csv"
    lines = spark.read.text(path).select("value", F.input_file_name().alias("source_path"), F.monotonically_increasing_id().alias("line"))
    lines = lines.filter(F.regexp_like("source_path", F.lit(NAME)))
    # A file's header is its first line: the least line number of the file, since a file's blocks keep their order in the scan.
    head = lines.groupBy("source_path").agg(F.min("line").alias("first"), F.min_by("value", "line").alias("header"))
    rows = lines.join(F.broadcast(head), "source_path").filter(F.col("line") > F.col("first"))
    cells, names = _cells("value"), _cells("header")

    def column(name: str):
        at = F.array_position(F.transform(names, lambda x: F.trim(x)), name)
        text = F.nullif(F.trim(F.when(at > 0, F.try_element_at(cells, at.cast("int")))), F.lit(""))
        return text.alias(name) if name == "Geology" else known(text.try_cast("double")).alias(name)

    return rows.select(F.lit(split).alias("split"), F.regexp_extract("source_path", NAME, 1).alias("well_id"), "source_path", "line", *(column(c) for c in wanted))


def _cells(line) -> Column:
    """The fields of a line; a comma between quotes does not part them, and the quotes go."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), '""', '"'))


def indexed(rows: DataFrame) -> DataFrame:
    """row_idx: the place of the line in its file, from 0."""
    w = Window.partitionBy("split", "well_id").orderBy("line")
    return rows.withColumn("row_idx", (F.row_number().over(w) - 1).cast("long")).drop("line")


def base_table(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The base table of one split: raw columns, id of target rows (test only), flags, lengths, anchor, differences from it."""
    rows = indexed(raw(spark, folder, split, "horizontal_well"))
    out = sequence.segments(rows, "TVT_input", "GR", "well_id")
    out = sequence.anchors(out, {"TVT_input": "last_known_TVT", "MD": "last_known_MD", "X": "last_known_X", "Y": "last_known_Y", "Z": "last_known_Z"}, "well_id")
    out = sequence.from_anchor(out, {c: f"last_known_{c}" for c in ("MD", "X", "Y", "Z")})
    id_ = F.when(F.col("is_target") & (F.col("split") == "test"), row_id(F.col("well_id"), F.col("row_idx")))
    return out.select(
        "split", "well_id", "row_idx", "source_path", *HORIZONTAL, id_.alias("id"), "is_target", F.col("is_known").alias("is_known_tvt"), "is_gr_missing",
        *(F.col(c).cast("int").alias(n) for c, n in {"ps_idx": "ps_idx", "n_rows": "n_rows_in_well", "known_length": "known_length", "hidden_length": "hidden_length"}.items()),
        *(f"last_known_{c}" for c in ("TVT", "MD", "X", "Y", "Z")), *(F.col(f"delta_{c}").alias(f"delta_{c}_from_PS") for c in ("MD", "X", "Y", "Z")), "post_ps_step", "row_frac",
    )


def typewell_table(spark: SparkSession, folder: str, split: str) -> DataFrame:
    rows = indexed(raw(spark, folder, split, "typewell"))
    n = F.count(F.lit(1)).over(Window.partitionBy("split", "well_id"))
    return rows.withColumn("n_rows_in_well", n.cast("int")).withColumn("row_frac", F.col("row_idx") / F.greatest(n - 1, F.lit(1)))


def inventory(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """One row for each file: split, well_id, table_type, source_path, n_rows (lines after the header), n_cols, columns."""
    out = None
    for split in splits:
        lines = spark.read.text(f"{folder}/{split}/*.csv").select("value", F.input_file_name().alias("source_path"), F.monotonically_increasing_id().alias("line"))
        lines = lines.filter(F.regexp_like("source_path", F.lit(NAME)))
        cols = F.transform(_cells(F.min_by("value", "line")), lambda x: F.trim(x))
        part = lines.groupBy("source_path").agg((F.count("*") - 1).alias("n_rows"), cols.alias("columns"))
        part = part.select(F.lit(split).alias("split"), F.regexp_extract("source_path", NAME, 1).alias("well_id"), F.regexp_extract("source_path", NAME, 2).alias("table_type"), "source_path", "n_rows", F.size("columns").alias("n_cols"), "columns")
        out = part if out is None else out.union(part)
    return out


def structure(kind: str) -> StructType:
    """The strict schema of one kind, for spark.read.csv where all files of a folder share one header."""
    names = HORIZONTAL if kind == "horizontal_well" else TYPEWELL
    return StructType([StructField(n, StringType() if n == "Geology" else DoubleType()) for n in names])
