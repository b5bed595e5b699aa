"""Ordered sequences keyed by an entity: row index, known and hidden parts, the anchor between them.

Every function adds columns over one window specification, so a chain of them plans to one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEY, INDEX = "well", "row_idx"


def by_key(key: str = KEY) -> WindowSpec:
    return Window.partitionBy(key)


def in_order(key: str = KEY, index: str = INDEX) -> WindowSpec:
    return Window.partitionBy(key).orderBy(index)


def in_reverse(key: str = KEY, index: str = INDEX) -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.desc(index))


def row_index(df: DataFrame, order: list[str], key: str = KEY, name: str = INDEX) -> DataFrame:
    """Zero-based place of each row in its sequence; `order` must be total."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def segments(df: DataFrame, given: str = "tvt_input", gr: str = "gr", key: str = KEY, index: str = INDEX) -> DataFrame:
    """Where the hidden part begins, lengths of both parts, and flags.

    ps_idx is the first row without `given` (the number of rows if none); rows from it on are targets, of which a sequence without
    a null has none.
    """
    w = by_key(key)
    n = F.count(F.lit(1)).over(w)
    first = F.min(F.when(F.col(given).isNull(), F.col(index))).over(w)
    return (
        df.withColumn("n_rows", n)
        .withColumn("ps_idx", F.coalesce(first, F.col("n_rows")))
        .withColumn("known_length", F.col("ps_idx"))
        .withColumn("hidden_length", F.col("n_rows") - F.col("ps_idx"))
        .withColumn("is_target", F.col(index) >= F.col("ps_idx"))
        .withColumn("is_known", F.col(given).isNotNull())
        .withColumn("is_gr_missing", F.col(gr).isNull())
    )


def anchors(df: DataFrame, columns: dict[str, str], key: str = KEY, index: str = INDEX) -> DataFrame:
    """Values of the last row before the hidden part (the first row if there is none), on every row. columns: source to new name."""
    at = F.when(F.col(index) == F.greatest(F.col("ps_idx") - 1, F.lit(0)), F.col(index))
    row = F.max_by(F.struct(*columns), at).over(by_key(key))
    out = df.withColumn("__anchor", row)
    return out.select("*", *(F.col(f"__anchor.{c}").alias(n) for c, n in columns.items())).drop("__anchor")


def from_anchor(df: DataFrame, columns: dict[str, str], index: str = INDEX) -> DataFrame:
    """Differences from the anchor, steps since the hidden part began, and the relative place. columns: source to anchor column."""
    deltas = {f"delta_{c}": F.col(c) - F.col(a) for c, a in columns.items()}
    return df.withColumns(deltas | {"post_ps_step": F.greatest(F.col(index) - F.col("ps_idx"), F.lit(0)), "row_frac": F.col(index) / F.greatest(F.col("n_rows") - 1, F.lit(1))})


def broadcast_stats(df: DataFrame, column: str, key: str = KEY) -> DataFrame:
    """Mean, sample deviation, size and range of a column over the whole sequence, on every row."""
    w = by_key(key)
    x = F.col(column)
    return df.select("*", F.avg(x).over(w).alias(f"{column}_mean"), F.stddev_samp(x).over(w).alias(f"{column}_std"), F.count(x).over(w).alias(f"{column}_n"), (F.max(x).over(w) - F.min(x).over(w)).alias(f"{column}_range"))


def last_rows(df: DataFrame, n: int, key: str = KEY, index: str = INDEX) -> DataFrame:
    """The last n rows of each sequence."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(index)))
    return df.withColumn("__at", at).filter(F.col("__at") <= n).drop("__at")


def evenly_spaced(df: DataFrame, m: int, key: str = KEY, index: str = INDEX) -> DataFrame:
    """At most m rows of each sequence at places floor(j (n - 1) / (m - 1)), j = 0 .. m - 1."""
    n = F.count(F.lit(1)).over(by_key(key))
    i = F.col("__i")
    out = df.withColumn("__i", F.row_number().over(in_order(key, index)) - 1).withColumn("__n", n)
    # i is some floor(j (n - 1) / (m - 1)) if the smallest j that reaches i does not pass i + 1.
    j = F.when(F.col("__n") > 1, F.ceil(i * (m - 1) / (F.col("__n") - 1))).otherwise(F.lit(0))
    hit = (j <= m - 1) & (F.floor(j * (F.col("__n") - 1) / (m - 1)) == i)
    return out.filter((F.col("__n") <= m) | hit).drop("__i", "__n")


def remasked(df: DataFrame, cuts: list[float], given: str = "tvt_input", key: str = KEY, index: str = INDEX) -> DataFrame:
    """Copies of the sequences with the known part cut shorter: one for each fraction, tagged aug_k; the original has -1.

    A copy ends where the original's known part ends, so what it hides is known.
    """
    known = F.count(F.when(F.col(given).isNotNull(), 1)).over(by_key(key))
    base = df.withColumn("__known", known)
    ks = F.array(F.lit(-1.0), *(F.lit(float(c)) for c in cuts))
    out = base.withColumn("aug_k", F.explode(ks)).filter((F.col("aug_k") < 0) | (F.col(index) < F.col("__known")))
    hide = (F.col("aug_k") >= 0) & (F.col(index) >= F.floor(F.col("__known") * F.col("aug_k")))
    return out.withColumn("truth", F.col(given)).withColumn(given, F.when(~hide, F.col(given))).drop("__known")


def self_labelled(df: DataFrame, cuts: list[float], given: str = "tvt_input", key: str = KEY, index: str = INDEX) -> DataFrame:
    """Training rows from sequences without truth: their own known part stands for it, and is cut at each fraction (see remasked); only the cut copies."""
    known = df.filter(F.col(given).isNotNull())
    return remasked(known, cuts, given, key, index).filter("aug_k >= 0")


def restored(df: DataFrame, change, name: str = "__place") -> DataFrame:
    """change(df) in the order in which df's rows came: a place is carried along; it must survive the change."""
    out = change(df.withColumn(name, F.monotonically_increasing_id()))
    return out.orderBy(name).drop(name)


def held_out(index: Column, n: Column, fraction: float) -> Column:
    """True for the first floor(n * fraction) rows."""
    return index < F.floor(n * fraction)


def dealt(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """The rows by key over a set number of tasks (spark.sql.shuffle.partitions unless given). For kernels whose time goes with the rows and not with their bytes:
    adaptive execution puts small partitions together by size, but leaves an explicit number alone, and grouping by the keys needs no further exchange."""
    return df.repartition(tasks or _tasks(df), *keys)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows of whole keys that a task of by_keys holds at once, if they are of several keys.
ROWS = 1 << 16


def by_keys(df: DataFrame, keys: list[str], order: list[Column], kernel: Callable, schema: str) -> DataFrame:
    """kernel(table of whole keys, places at which each begins) over all rows, dealt by key and sorted by keys and order. Where keys are small, many share a call."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            code = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def run(batches):
        held, n, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= enough:
                table = pa.Table.from_batches(held)
                first = starts(table)
                cut, enough = int(first[-1]), ROWS  # the last key may go on
                if cut:
                    yield from kernel(table.slice(0, cut), first[:-1]).to_batches()
                held, n = table.slice(cut).to_batches(), len(table) - cut
                enough = max(ROWS, 2 * n)
        if n:
            table = pa.Table.from_batches(held)
            yield from kernel(table, starts(table)).to_batches()

    # Dealt by a hash of the keys, not by the keys: a union of tables that are dealt by them already would be taken as it is, with partitions that adaptive
    # execution has put together differently on either side.
    return df.repartition(_tasks(df), F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
