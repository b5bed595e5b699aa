"""Gradient-boosted regression trees over binned features, grown from histograms.

Features are cut into bins once and a row travels as its bins' bytes, its target and what is left of it. For a pass, every task routes its rows through the tree so far and sums residuals and
rows by (node, feature, bin); a groupBy merges the sums of all tasks, so a pass is one shuffle of node x feature x bin rows, whatever the
number of rows. Only the smaller child of a node is summed; the larger is the difference. Growing leaf by leaf, a pass takes the children of all leaves that may be split
later, as many as leaves are left: which ones are, is decided afterwards by gain alone, so the tree is the one that one pass a leaf would give, for about one pass a level.

Residuals are whole numbers of a power of two that their sum cannot overflow: sums do not depend on the order of tasks, so lost and repeated ones change nothing.
What is left of the targets is written anew after every `refresh` trees; the newer ones are applied on the way.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeflow.sources.staging import staged

MOST_BINS = 255


@dataclass
class Tree:
    """Nodes as arrays; rows whose bin of `feature` is at most `cut` go left. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children
        for _ in children:
            for name, value in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0)):
                getattr(self, name).append(value)
        return children

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at, open_ = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(open_ := open_[feature[at[open_]] >= 0]):
            node = at[open_]
            at[open_] = np.where(bins[open_, feature[node]] <= cut[node], left[node], right[node])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.route(bins)]


@dataclass
class Model:
    """base and the trees' values, added up; edges: for each feature the values at which its bins end."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    errors: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(x)))

    def prediction(self) -> Column:
        """A column of the features' columns."""
        k, model = len(self.features), self

        @F.arrow_udf("double")
        def guess(x: pa.Array) -> pa.Array:
            return pa.array(model.predict(_matrix(x, k)))

        return guess(F.array(*(F.col(c).cast("double") for c in self.features)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())

    def importances(self) -> dict[str, tuple[float, int]]:
        """For each feature the gain of its splits and their number."""
        out = {name: (0.0, 0) for name in self.features}
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total, n = out[self.features[f]]
                    out[self.features[f]] = total + gain, n + 1
        return out


def _matrix(lists: pa.ListArray, k: int) -> np.ndarray:
    """Rows of k numbers; null is NaN."""
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins as bytes: 0 for missing, else 1 and the number of edges below the value."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left"))
    return out


def bin_edges(df: DataFrame, features: list[str], bins: int = 64, error: float = 0.001) -> list[np.ndarray]:
    """Ends of about `bins` equally full bins of each feature, from Spark's quantile summaries; features are few."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must be 2 to {MOST_BINS}")
    shares = [k / bins for k in range(1, bins)]
    finite = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features))
    found = finite.agg(*(F.percentile_approx(c, shares, int(1 / error)).alias(c) for c in features)).first()
    return [np.unique(np.array(found[c], float)) if found[c] else np.zeros(0) for c in features]


@dataclass(frozen=True)
class Growth:
    """How trees grow. leaves: most leaves, by gain (0: no bound). depth: most splits above a leaf (0: no bound). alike: all nodes of a level are split at one place.
    least: fewest rows of a leaf; pull: L2 weight. Of the features a share of `columns` takes part in a tree, of the rows a share of `rows`."""

    trees: int = 100
    rate: float = 0.05
    leaves: int = 63
    depth: int = 0
    alike: bool = False
    least: int = 50
    pull: float = 1.0
    columns: float = 1.0
    rows: float = 1.0
    patience: int = 0
    seed: int = 42


def leafwise(**change) -> Growth:
    """Leaf by leaf, the one of largest gain first."""
    return Growth(**{"leaves": 63, "least": 50, "columns": 0.9, "rows": 0.9, **change})


def levelwise(**change) -> Growth:
    """All leaves down to a depth."""
    return Growth(**{"leaves": 0, "depth": 7, "least": 20, "columns": 0.9, "rows": 0.9, **change})


def alike(**change) -> Growth:
    """One split for all nodes of a level."""
    return Growth(**{"leaves": 0, "depth": 8, "alike": True, "least": 1, "pull": 3.0, **change})


def _gains(sums: np.ndarray, counts: np.ndarray, g: Growth, usable: np.ndarray) -> np.ndarray:
    """Gain of each (feature, cut) of a node from residual sums and rows by (feature, bin); -inf where a side has too few rows."""
    s, n = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(counts, axis=1)[:, :-1]
    total_s, total_n = sums[0].sum(), counts[0].sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        out = s * s / (n + g.pull) + (total_s - s) ** 2 / (total_n - n + g.pull) - total_s * total_s / (total_n + g.pull)
    out = np.nan_to_num(out, nan=0.0)
    out[(n < g.least) | (total_n - n < g.least) | ~usable[:, None]] = -np.inf
    return out


class Histograms:
    """Sums of nodes, as a pass gives them: (features, bins) arrays of residuals (in units) and rows."""

    def __init__(self, unit: float, width: int) -> None:
        self.unit, self.width = unit, width
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def best(self, node: int, g: Growth, usable: np.ndarray) -> tuple[float, int, int]:
        gains = _gains(self.of[node][0] * self.unit, self.of[node][1], g, usable)
        f, c = np.unravel_index(int(gains.argmax()), gains.shape)  # of equal gains the first feature and cut
        return float(gains[f, c]), int(f), int(c)

    def value(self, node: int, g: Growth) -> float:
        sums, counts = self.of[node]
        return float(g.rate * sums[0].sum() * self.unit / (counts[0].sum() + g.pull)) if counts[0].sum() + g.pull > 0 else 0.0

    def smaller(self, node: int, feature: int, cut: int) -> bool:
        """Whether the left child has fewer rows than the right one."""
        counts = self.of[node][1][feature]
        return 2 * counts[: cut + 1].sum() <= counts.sum()


def grown(look, unit: float, width: int, g: Growth, usable: np.ndarray) -> Tree:
    """One tree. look(tree, nodes) gives the sums of nodes of the tree as it is, in one pass."""
    tree, seen = Tree(), Histograms(unit, width)
    seen.of |= look(tree, [0])
    depth = {0: 0}
    if g.alike:
        level = [0]
        for _ in range(g.depth):
            gains = sum(np.where(np.isneginf(x := _gains(seen.of[n][0] * unit, seen.of[n][1], g, usable)), 0.0, x) for n in level)
            f, c = np.unravel_index(int(gains.argmax()), gains.shape)
            if gains[f, c] <= 0:
                break
            level = _children(tree, seen, look, [(n, int(f), int(c), float(_gains(seen.of[n][0] * unit, seen.of[n][1], replace(g, least=0), usable)[f, c])) for n in level])
    else:
        splits: dict[int, tuple[float, int, int]] = {}  # the best split of each node whose sums are known
        planned: dict[int, tuple[int, int]] = {}  # children of nodes whose children's sums are known
        final: dict[int, tuple[int, int]] = {}  # children of nodes that are split for good

        def may(node: int) -> bool:
            if node not in splits:
                splits[node] = seen.best(node, g, usable) if not g.depth or depth[node] < g.depth else (0.0, -1, -1)
            return splits[node][0] > 0

        def open_(node: int) -> Iterator[int]:
            """Nodes at and below this one that could be split, but whose children's sums are not known."""
            if may(node):
                if node not in planned:
                    yield node
                else:
                    for child in planned[node]:
                        yield from open_(child)

        front = [(-splits[0][0], 0)] if may(0) else []
        while front and (not g.leaves or len(final) + 1 < g.leaves):
            node = front[0][1]
            if node not in planned:
                ask = sorted((n for _, top in front for n in open_(top)), key=lambda n: (-splits[n][0], n))
                ask = [node, *(n for n in ask if n != node)][: g.leaves - len(final) - 1 if g.leaves else None]
                children = _children(tree, seen, look, [(n, *splits[n][1:], splits[n][0]) for n in ask])
                for n, pair in zip(ask, zip(children[::2], children[1::2])):
                    planned[n] = pair
                    depth[pair[0]] = depth[pair[1]] = depth[n] + 1
            heapq.heappop(front)
            final[node] = planned[node]
            for child in planned[node]:
                if may(child):
                    heapq.heappush(front, (-splits[child][0], child))
        tree = _pruned(tree, final)
        seen.of = {new: seen.of[old] for old, new in tree.names.items()}
    for node, f in enumerate(tree.feature):
        if f < 0:
            tree.value[node] = seen.value(node, g)
    return tree


def _children(tree: Tree, seen: Histograms, look, splits: list[tuple[int, int, int, float]]) -> list[int]:
    """Splits nodes and takes the sums of their children: the smaller ones from a pass, the larger by subtraction. The children, pairwise."""
    pairs = [(n, tree.split(n, f, c, gain), seen.smaller(n, f, c)) for n, f, c, gain in splits]
    found = look(tree, [pair[0 if left else 1] for _, pair, left in pairs])
    for n, pair, left in pairs:
        small, large = pair if left else pair[::-1]
        seen.of[small] = found[small]
        seen.of[large] = tuple(whole - part for whole, part in zip(seen.of[n], found[small]))
    return [x for _, pair, _ in pairs for x in pair]


def _pruned(tree: Tree, final: dict[int, tuple[int, int]]) -> Tree:
    """The tree with the splits that were decided on; `names` maps its nodes from those of the tree given."""
    out, names, stack = Tree(), {0: 0}, [0]
    while stack:
        node = stack.pop()
        if node in final:
            for old, new in zip(final[node], out.split(names[node], tree.feature[node], tree.cut[node], tree.gain[node])):
                names[old] = new
                stack.append(old)
    out.names = names
    return out


def _look(rows: DataFrame, trees: list[Tree], unit: float, width: int, k: int, g: Growth, number: int):
    """A function that sums the rows of nodes of a tree in one pass. rows: bins, rest, mark, held."""

    def look(tree: Tree, nodes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        wanted = np.full(len(tree.feature), -1)
        wanted[nodes] = np.arange(len(nodes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(nodes) * k * width
            sums, counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for batch in batches:
                bins, rest, mark = _taken(batch, k, trees)
                stay = np.ones(len(rest), bool) if g.rows >= 1 else _share(mark, g.seed + number) < g.rows
                at = wanted[tree.route(bins[stay])]
                here = at >= 0
                units = np.rint(rest[stay][here] / unit).astype(np.int64)
                for j in range(k):
                    cell = (at[here] * k + j) * width + bins[stay][here, j]
                    np.add.at(sums, cell, units)
                    counts += np.bincount(cell, minlength=size)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some]), pa.array(counts[some])], names=["cell", "s", "n"])

        parts = rows.filter("NOT held").select("bins", "rest", "mark").mapInArrow(run, "cell long, s long, n long")
        merged = parts.groupBy("cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()  # nodes x features x bins at most
        sums, counts = np.zeros(len(nodes) * k * width, np.int64), np.zeros(len(nodes) * k * width, np.int64)
        sums[merged["cell"].to_numpy()], counts[merged["cell"].to_numpy()] = merged["s"].to_numpy(), merged["n"].to_numpy()
        shape = (len(nodes), k, width)
        return {n: (a, b) for n, a, b in zip(nodes, sums.reshape(shape), counts.reshape(shape))}

    return look


def _bins_of(column: pa.Array, k: int) -> np.ndarray:
    """Rows of k bytes, which lie one after another in Arrow's buffer as well."""
    fixed = column.cast(pa.binary(k))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * k :][: len(fixed) * k].reshape(-1, k)


def _taken(batch: pa.RecordBatch, k: int, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, what the trees leave, and marks."""
    bins = _bins_of(batch.column("bins"), k)
    rest = batch.column("rest").to_numpy()
    for t in trees:
        rest = rest - t.predict(bins)
    return bins, rest, batch.column("mark").to_numpy()


def _share(mark: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row, by its mark."""
    x = mark.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).astype(float) / 2.0**64


def _left(rows: DataFrame, trees: list[Tree], k: int) -> DataFrame:
    """rows with the trees' values taken off `rest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rest, _ = _taken(batch, k, trees)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), pa.array(rest), batch.column("mark"), batch.column("held")], names=["bins", "rest", "mark", "held"])

    return rows.select("bins", "rest", "mark", "held").mapInArrow(run, "bins binary, rest double, mark long, held boolean")


def _error(rows: DataFrame, trees: list[Tree], k: int) -> float:
    """Root mean square of what the trees leave on held-out rows."""
    e = _left(rows.filter("held"), trees, k).agg(F.avg(F.col("rest") * F.col("rest"))).first()[0]
    return math.sqrt(e) if e is not None else float("nan")


def fitted(df: DataFrame, features: list[str], target: str, growth: Growth = Growth(), held: str | None = None, bins: int = 64, edges: list[np.ndarray] | None = None, refresh: int = 10) -> Model:
    """Trees that add up to the target's mean in the rows that are not held out.

    df: features (null or NaN is missing and goes left), target (rows without it are left out), held: a boolean column of rows that only tell when to stop. With
    growth.patience, growing ends once the error on held-out rows has not fallen for so many trees, and the trees after the best are dropped; without, or without held-out rows, all trees grow. Gains and
    leaf values are those of squared error: sum^2 / (rows + pull). A table without rows to learn from gives a model of base 0 without trees.
    """
    k = len(features)
    y = F.col(target).cast("double")
    df = df.filter(y.isNotNull() & ~F.isnan(y)).withColumn("__held", F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False))
    told = df.filter("NOT __held").agg(F.avg(y), F.count(F.lit(1)), F.min(y), F.max(y)).first()
    edges = edges if edges is not None else bin_edges(df.filter("NOT __held"), features, bins) if told[1] else []
    if not told[1]:
        return Model(features, [np.zeros(0)] * k, 0.0, [], [])
    base, width = float(told[0]), max(len(e) for e in edges) + 2
    reach = 4 * max(told[3] - base, base - told[2], 1e-300)  # what is left grows no larger than this while trees fit
    unit = 2.0 ** math.ceil(math.log2(reach) + math.log2(told[1]) - 61)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = binned(_matrix(batch.column("x"), k), edges)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(b), [None, pa.py_buffer(b.tobytes())]).cast(pa.binary()), *(batch.column(c) for c in ("rest", "mark", "held"))], names=["bins", "rest", "mark", "held"])

    x = F.array(*(F.col(c).cast("double") for c in features))
    ready = df.select(x.alias("x"), (y - base).alias("rest"), F.xxhash64(*features, target).alias("mark"), F.col("__held").alias("held"))
    rows = staged(ready.mapInArrow(cut, "bins binary, rest double, mark long, held boolean"))
    rng, trees, fresh, errors = np.random.default_rng(growth.seed), [], [], []
    stops = growth.patience > 0 and not rows.filter("held").isEmpty()
    for number in range(growth.trees):
        usable = np.zeros(k, bool)
        usable[rng.permutation(k)[: max(1, round(k * growth.columns))]] = True
        trees.append(grown(_look(rows, fresh, unit, width, k, growth, number), unit, width, growth, usable))
        fresh.append(trees[-1])
        if stops:
            errors.append(_error(rows, fresh, k))
            best = int(np.argmin(errors))
            if number - best >= growth.patience:
                return Model(features, edges, base, trees[: best + 1], errors)
        if len(fresh) >= refresh and number + 1 < growth.trees:
            rows, fresh = staged(_left(rows, fresh, k)), []
    return Model(features, edges, base, trees[: int(np.argmin(errors)) + 1] if stops else trees, errors)


class Estimator:
    """The learner as one that models.fold_models takes: fit(df) with `features` as an MLlib vector, `label`, and `held` rows to stop by."""

    def __init__(self, growth: Growth, bins: int = 64) -> None:
        self.growth, self.bins = growth, bins

    def fit(self, df: DataFrame) -> "Fitted":
        from pyspark.ml.functions import vector_to_array

        k = df.schema["features"].metadata["ml_attr"]["num_attrs"]
        x = vector_to_array("features")
        names = [f"__f{j}" for j in range(k)]
        flat = df.select(*(x[j].alias(n) for j, n in enumerate(names)), "label", *(["held"] if "held" in df.columns else []))
        return Fitted(fitted(flat, names, "label", self.growth, "held" if "held" in df.columns and self.growth.patience else None, self.bins))


class Fitted:
    def __init__(self, model: Model) -> None:
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        model, k = self.model, len(self.model.features)

        @F.arrow_udf("double")
        def guess(x: pa.Array) -> pa.Array:
            return pa.array(model.predict(_matrix(x, k)))

        return df.withColumn("prediction", guess(vector_to_array("features")))

    @property
    def featureImportances(self) -> list[float]:
        gains = [g for g, _ in self.model.importances().values()]
        total = sum(gains)
        return [g / total if total else 0.0 for g in gains]
