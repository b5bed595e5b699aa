"""Window expressions over one sequence. All take the ordered window of `sequence.in_order`; null is missing and never counts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from sondeflow.operators import sequence

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _frame(w: WindowSpec, width: int, centred: bool) -> WindowSpec:
    """Trailing, or centred; a centred frame of even width reaches one row further back."""
    return w.rowsBetween(-(width // 2), (width - 1) // 2) if centred else w.rowsBetween(1 - width, 0)


def rolling_mean(x: Column, w: WindowSpec, width: int, least: int = 1, centred: bool = False) -> Column:
    f = _frame(w, width, centred)
    return F.when(F.count(x).over(f) >= least, F.avg(x).over(f))


def rolling_std(x: Column, w: WindowSpec, width: int, least: int = 2, centred: bool = False, fill: float | None = None) -> Column:
    f = _frame(w, width, centred)
    out = F.when(F.count(x).over(f) >= max(least, 2), F.stddev_samp(x).over(f))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def rolling_median(x: Column, w: WindowSpec, width: int, centred: bool = True) -> Column:
    return F.percentile(x, F.lit(0.5)).over(_frame(w, width, centred))


class Middle:
    """The median of a changing bag of numbers: two heaps, the lower half's largest and the upper half's smallest on top. What is taken out stays in its heap until it comes to the
    top, so putting in and taking out cost the logarithm of the bag's size."""

    def __init__(self) -> None:
        self.low, self.high = [], []  # of (-value, number) and (value, number)
        self.place: dict[int, bool] = {}  # whether each number that is in the bag lies in the lower half
        self.n_low = 0

    def _top(self, heap: list) -> float:
        while heap[0][1] not in self.place or self.place[heap[0][1]] != (heap is self.low):
            heapq.heappop(heap)
        return heap[0][0]

    def put(self, number: int, value: float) -> None:
        lower = self.n_low > 0 and value <= -self._top(self.low)
        self.place[number] = lower
        heapq.heappush(self.low if lower else self.high, (-value if lower else value, number))
        self.n_low += lower
        self._even()

    def take(self, number: int) -> None:
        self.n_low -= self.place.pop(number)
        self._even()

    def _even(self) -> None:
        """The lower half has as many as the upper one, or one more."""
        want = (len(self.place) + 1) // 2
        while self.n_low < want:
            value = self._top(self.high)
            number = heapq.heappop(self.high)[1]
            self.place[number] = True
            heapq.heappush(self.low, (-value, number))
            self.n_low += 1
        while self.n_low > want:
            value = -self._top(self.low)
            number = heapq.heappop(self.low)[1]
            self.place[number] = False
            heapq.heappush(self.high, (value, number))
            self.n_low -= 1

    def median(self) -> float | None:
        n = len(self.place)
        if not n:
            return None
        low = -self._top(self.low)
        return low if n % 2 else 0.5 * low + 0.5 * self._top(self.high)


def rolling_medians(df: DataFrame, key: str, index: str, column: str, name: str, width: int, centred: bool = True, block: int = 1 << 14) -> DataFrame:
    """df with `name`, the median of `column` over `width` rows of a key, trailing or centred (nulls do not count), at a cost for each row that grows with the logarithm of the width.

    index: a key's rows numbered from 0 without gaps (see sequence.row_index). Each key is cut into blocks of at least `block` rows, which also get the rows next to them
    that their frames reach: a long key is many tasks' work, and a task holds one block.
    """
    before, after = (width // 2, (width - 1) // 2) if centred else (width - 1, 0)
    size = max(block, 2 * width)
    at = lambda x: F.call_function("div", F.greatest(x, F.lit(0)), F.lit(size))
    i = F.col(index).cast("long")
    rows = df.withColumn("__block", F.explode(F.array_distinct(F.array(at(i), at(i - after), at(i + before)))))
    rows = sequence.dealt(rows, key, "__block").sortWithinPartitions(key, "__block", index)
    names = df.columns
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in consecutive(batches, [key, "__block"]):
            place, number = group.column(index).to_numpy(), group.column("__block")[0].as_py()
            value = group.column(column).cast(pa.float64()).to_pylist()
            own = np.flatnonzero(place // size == number)
            bag, out, put, taken = Middle(), [], 0, 0
            for k in own.tolist():
                while put < len(value) and put <= k + after:
                    if value[put] is not None:
                        bag.put(put, value[put])
                    put += 1
                while taken < k - before:
                    if value[taken] is not None:
                        bag.take(taken)
                    taken += 1
                out.append(bag.median())
            if len(own):
                mine = group.select(names).slice(int(own[0]), len(own)).append_column(name, pa.array(out, pa.float64()))
                yield from mine.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def consecutive(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that follow one another with the same values of `by`."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
        a = 0
        for b in range(1, len(keys) + 1):
            if b < len(keys) and keys[b] == keys[a]:
                continue
            if held and keys[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
            a = b
    if held:
        yield pa.Table.from_batches(held)


def envelope(x: Column, w: WindowSpec, width: int) -> Column:
    return F.max(x).over(_frame(w, width, True))


def energy(x: Column, w: WindowSpec, width: int) -> Column:
    """Root mean square over a centred frame."""
    return F.sqrt(F.avg(x * x).over(_frame(w, width, True)))


def padded_mean(x: Column, w: WindowSpec, width: int) -> Column:
    """Moving average in which rows beyond the ends count as zeros."""
    return F.sum(x).over(_frame(w, width, True)) / width


def lagged(x: Column, w: WindowSpec, k: int) -> Column:
    """The value k rows back (ahead for negative k); beyond the end, the nearest present one there."""
    if k >= 0:
        return F.coalesce(F.lag(x, k).over(w), F.first(x, ignorenulls=True).over(w.rowsBetween(*ALL)))
    return F.coalesce(F.lead(x, -k).over(w), F.last(x, ignorenulls=True).over(w.rowsBetween(*ALL)))


def difference(x: Column, w: WindowSpec) -> Column:
    """Step from the row before, 0 at the start and where either is null."""
    return F.coalesce(x - F.lag(x).over(w), F.lit(0.0))


def gradient(x: Column, w: WindowSpec, reach: int = 1) -> Column:
    """Central difference over `reach` rows each way; null where a side is missing (edge_filled on it then copies the nearest inner value)."""
    return (F.lead(x, reach).over(w) - F.lag(x, reach).over(w)) / (2 * reach)


def _next_present(x: Column, w: WindowSpec, back: WindowSpec | None) -> Column:
    if back is not None:
        return F.last(x, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def edge_filled(x: Column, w: WindowSpec, back: WindowSpec | None = None) -> Column:
    """Forward then backward fill. back: the same sequences in the opposite order; with it the cost is linear in a sequence's length, without it
    every row looks ahead for itself."""
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(before, _next_present(x, w, back))


def interpolated(x: Column, w: WindowSpec, index: Column, back: WindowSpec | None = None) -> Column:
    """Gaps filled linearly by row place; before the first and after the last value, that value. back: as in edge_filled."""
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(x.isNotNull(), index)
    x0, x1 = F.last(x, ignorenulls=True).over(past), _next_present(x, w, back)
    i0, i1 = F.last(at, ignorenulls=True).over(past), _next_present(at, w, back)
    between = x0 + (x1 - x0) * (index - i0) / (i1 - i0)
    return F.when(x.isNotNull(), x).when(x0.isNotNull() & x1.isNotNull(), between).otherwise(F.coalesce(x0, x1))


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


@cache
def savgol_weights(width: int, degree: int) -> np.ndarray:
    """Row k has the weights that give the fitted polynomial at place k of a window."""
    at = np.arange(width) - width // 2
    v = np.vander(at, degree + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol(df: DataFrame, column: str, name: str, width: int, degree: int, key: str, index: str) -> DataFrame:
    """Savitzky-Golay smoothing: inner rows by fixed weights over their window, the half-windows at both ends from the polynomial of the
    first or last whole window, which needs the 2 width - 1 rows around each. Sequences shorter than the window keep their values. The column must have no nulls."""
    weights, half, reach = savgol_weights(width, degree), width // 2, width - 1
    w, x = Window.partitionBy(key).orderBy(index), F.col(column)
    near = {f"__x{o + reach}": x if o == 0 else F.lag(x, -o).over(w) if o < 0 else F.lead(x, o).over(w) for o in range(-reach, reach + 1)}
    out = df.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy(key)), "__i": F.row_number().over(w) - 1, **near})
    inner = sum((float(c) * F.col(f"__x{k - half + reach}") for k, c in enumerate(weights[half][1:], 1)), float(weights[half][0]) * F.col(f"__x{reach - half}"))
    # The window that serves a row starts `place` rows before it; at the ends that differs from half.
    place = (F.col("__i") - F.least(F.greatest(F.col("__i") - half, F.lit(0)), F.col("__n") - width)).cast("int")
    table = F.array(*(F.array(*(F.lit(float(c)) for c in row)) for row in weights))
    window = F.slice(F.array(*near), F.lit(width) - place, F.lit(width))
    edge = F.aggregate(F.zip_with(window, F.element_at(table, place + 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    value = F.when(F.col("__n") < width, x).when(place == half, inner).otherwise(edge)
    return out.withColumn(name, value).drop("__n", "__i", *near)
