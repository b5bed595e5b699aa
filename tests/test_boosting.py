"""Boosted trees against a grower that looks at the rows one leaf at a time; weights on the simplex against a fine grid."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import blending, boosting, models


def sample(n, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 3))
    y = 3 * (x[:, 0] > 0.2) - 2 * (x[:, 1] > 0) * (x[:, 0] < 0) + x[:, 2] + 0.2 * r.standard_normal(n)
    x[r.random((n, 3)) < 0.05] = np.nan
    return x, y


def frame(spark, x, y, **more):
    rows = [(*(None if np.isnan(v) else float(v) for v in a), float(b), *(m[i] for m in more.values())) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["a", "b", "c", "y", *more]).repartition(3)


def split_of(bins, rest, rows, g):
    """Best (gain, -feature, -cut) of a set of rows by trying each."""
    best = (0.0, 0, 0)
    s, n = rest[rows].sum(), len(rows)
    for f in range(bins.shape[1]):
        for c in range(int(bins[:, f].max())):
            left = rows[bins[rows, f] <= c]
            ls, ln = rest[left].sum(), len(left)
            if min(ln, n - ln) >= g.least:
                best = max(best, (ls**2 / (ln + g.pull) + (s - ls) ** 2 / (n - ln + g.pull) - s**2 / (n + g.pull), -f, -c))
    return best


def plain(bins, y, g):
    """Predictions of trees that are grown one leaf after another."""
    guess = np.full(len(y), y.mean())
    for _ in range(g.trees):
        rest = y - guess
        leaves = [(np.arange(len(y)), 0)]
        while not g.leaves or len(leaves) < g.leaves:
            found = [split_of(bins, rest, rows, g) if not g.depth or d < g.depth else (0.0, 0, 0) for rows, d in leaves]
            k = max(range(len(leaves)), key=lambda i: found[i][0])
            gain, f, c = found[k]
            if gain <= 0:
                break
            rows, d = leaves.pop(k)
            low = bins[rows, -f] <= -c
            leaves += [(rows[low], d + 1), (rows[~low], d + 1)]
        for rows, _ in leaves:
            guess[rows] += g.rate * rest[rows].sum() / (len(rows) + g.pull)
    return guess


@pytest.mark.parametrize("growth", [boosting.leafwise(trees=3, leaves=7, rate=0.3, least=20, rows=1.0, columns=1.0), boosting.levelwise(trees=2, depth=3, rate=0.3, rows=1.0, columns=1.0)])
def test_as_leaf_after_leaf(spark, growth):
    x, y = sample(600, 1)
    df = frame(spark, x, y)
    edges = boosting.bin_edges(df, ["a", "b", "c"], 16)
    m = boosting.fitted(df, ["a", "b", "c"], "y", growth, edges=edges, refresh=2)
    want = plain(boosting.binned(x, edges), y, growth)
    assert m.predict(x) == pytest.approx(want)
    got = {(r.y): r.prediction for r in m.transform(df).collect()}
    assert [got[v] for v in y.tolist()] == pytest.approx(want)
    gains = m.importances()
    assert sum(n for _, n in gains.values()) == sum(f >= 0 for t in m.trees for f in t.feature) and all(g > 0 for g, _ in gains.values())


def test_one_split_for_each_level(spark):
    x, y = sample(500, 2)
    df = frame(spark, x, y)
    g = boosting.alike(trees=1, depth=3, rate=1.0)
    m = boosting.fitted(df, ["a", "b", "c"], "y", g, bins=8)
    bins, rest, at = boosting.binned(x, m.edges), y - y.mean(), np.zeros(len(y), int)
    for _ in range(3):
        score = lambda a: sum(rest[a == v].sum() ** 2 / ((a == v).sum() + g.pull) for v in np.unique(a))
        f, c = max(((f, c) for f in range(3) for c in range(bins[:, f].max())), key=lambda s: score(2 * at + (bins[:, s[0]] > s[1])))
        at = 2 * at + (bins[:, f] > c)
    want = y.mean() + np.array([rest[at == v].sum() / ((at == v).sum() + g.pull) for v in at])
    assert m.predict(x) == pytest.approx(want)


def test_passes_for_a_tree():
    """A pass takes all leaves that may be split, so a balanced tree needs one for each level and the root."""
    r = np.random.default_rng(3)
    bins, rest = r.integers(0, 8, (4000, 4)).astype(np.uint8), r.standard_normal(4000)
    asked = []

    def look(tree, nodes):
        asked.append(len(nodes))
        at = tree.route(bins)
        return {n: tuple(np.stack([np.bincount(bins[at == n, f], w[at == n], 8) for f in range(4)]) for w in (rest * 1024, np.ones(4000))) for n in nodes}

    tree = boosting.grown(look, 1 / 1024, 8, boosting.levelwise(depth=4, least=5), np.ones(4, bool))
    assert len(asked) <= 5 and sum(f >= 0 for f in tree.feature) == 15


def test_stops_by_held_out_rows(spark):
    x, y = sample(900, 4)
    held = [bool(i % 3 == 0) for i in range(900)]
    r = np.random.default_rng(0)
    noise = np.where(held, y, y + 3 * r.standard_normal(900))
    df = frame(spark, x, noise, held=held)
    m = boosting.fitted(df, ["a", "b", "c"], "y", boosting.leafwise(trees=40, leaves=31, least=3, rate=0.8, patience=3, rows=1.0, columns=1.0), held="held")
    assert 1 <= len(m.trees) < 40 and len(m.trees) == int(np.argmin(m.errors)) + 1
    e = np.sqrt(np.mean((m.predict(x)[held] - y[held]) ** 2))
    assert e == pytest.approx(min(m.errors))


def test_bags_repeat_and_differ(spark):
    x, y = sample(400, 5)
    df = frame(spark, x, y)
    g = boosting.leafwise(trees=3, leaves=5, rows=0.5, columns=0.5, least=5)
    one, two = (boosting.fitted(d, ["a", "b", "c"], "y", g, bins=8) for d in (df, df.repartition(7)))
    assert one.predict(x) == pytest.approx(two.predict(x)) and one.trees[0].feature != one.trees[1].feature


def test_odd_tables(spark):
    empty = boosting.fitted(spark.createDataFrame([], "a double, y double"), ["a"], "y")
    assert empty.predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]
    same = boosting.fitted(spark.createDataFrame([(1.0, 5.0)] * 60 + [(None, None)], "a double, y double"), ["a"], "y", boosting.leafwise(trees=2))
    assert same.predict(np.array([[np.nan], [3.0]])).tolist() == [5.0, 5.0]


def test_learner_in_the_driver_of_folds(spark):
    x, y = sample(300, 6)
    df = frame(spark, x, y, fold=[i % 2 for i in range(300)], key=list(range(300)))
    out, w, which = models.blended(df, ["a", "b", "c"], "y", "fold", ["key"], {"one": lambda: models.leafwise(trees=4, rate=0.5, leaves=6, least=10, rows=1.0), "two": lambda: models.alike(trees=3, rate=0.5, depth=3, patience=2)})
    assert which in ("best", "equal") and sum(w.values()) == pytest.approx(1.0) and out.count() == 300
    assert out.agg(F.sqrt(F.avg((F.col("guess") - F.col("y")) ** 2))).first()[0] < np.std(y)


@pytest.mark.parametrize("seed", range(12))
def test_simplex_as_a_fine_grid(seed):
    r = np.random.default_rng(seed)
    x, y = r.standard_normal((50, 3)) + r.standard_normal((50, 1)), r.standard_normal(50)
    m = blending.Moments(x.T @ x, x.T @ y, float(y @ y), 50.0)
    w = m.simplex()
    grid = min(m.rmse(np.array([a, b, 200 - a - b]) / 200) for a in range(201) for b in range(201 - a))
    assert (w >= 0).all() and w.sum() == pytest.approx(1.0) and m.rmse(w) <= grid + 1e-12


def test_convex_falls_back_to_equal_weights():
    r = np.random.default_rng(1)
    y = r.standard_normal(200)
    good, bad = np.stack((y + 0.1 * r.standard_normal(200), y + 0.3 * r.standard_normal(200)), axis=1), np.stack((y, y + 5), axis=1)
    of = lambda x: blending.Moments(x.T @ x, x.T @ y, float(y @ y), 200.0)
    assert blending.convex({0: of(good), 1: of(good)})[1] == "best"
    w, which = blending.convex({0: of(bad), 1: of(bad[:, ::-1]), 2: of(good)})
    assert which == "equal" and w.tolist() == [0.5, 0.5]


def test_search_beats_as_many_random_trials(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.uniform(0, 4, 400)
    y = 0.7 * x + 1.3 * np.exp(-x / 0.85)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    guess = lambda d: d["a"] * d["x"] + d["b"] * F.exp(-d["x"] / d["c"])
    space = {"a": (0.0, 2.0, 0.01), "b": (0.0, 3.0, 0.01), "c": (0.05, 3.0, 0.05)}
    plain = lambda trials: [float(np.sqrt(np.mean((t["a"] * x + t["b"] * np.exp(-x / t["c"]) - y) ** 2))) for t in trials]
    best, error, trials = models.searched(df, guess, "y", space, trials=40, batch=10, start=20, seed=1)
    assert len(trials) == len({tuple(t.values()) for t, _ in trials}) == 40 and error == min(e for _, e in trials)
    assert [e for _, e in trials] == pytest.approx(plain([t for t, _ in trials])) and plain([best]) == [pytest.approx(error)]
    _, _, all_ = models.searched(df, guess, "y", {"a": (0.0, 0.2, 0.1), "b": (1.0, 1.0, 1.0), "c": (1.0, 1.0, 1.0)}, trials=50)
    assert sorted(t["a"] for t, _ in all_) == pytest.approx([0.0, 0.1, 0.2])
    monkeypatch.setattr(models, "trial_errors", lambda df, guess, truth, trials: plain(trials))

    def random_(seed):
        rng = np.random.default_rng(seed)
        return min(plain([{n: lo + step * int(rng.integers(0, int((hi - lo) / step) + 1)) for n, (lo, hi, step) in space.items()} for _ in range(120)]))

    seeds = range(100, 115)
    found = [models.searched(None, None, "y", space, trials=120, seed=k)[1] for k in seeds]
    assert np.median(found) < 0.8 * np.median([random_(k) for k in seeds])


def test_bins_are_read_from_the_buffer():
    b = np.arange(36, dtype=np.uint8).reshape(12, 3)
    whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(3), 12, [None, pa.py_buffer(b.tobytes())]).cast(pa.binary())
    assert [v.as_py() for v in whole] == [r.tobytes() for r in b]
    for column, want in ((whole, b), (whole.slice(4, 5), b[4:9]), (whole.slice(12), b[:0]), (whole.cast(pa.large_binary()).slice(2), b[2:])):
        assert (boosting._bins_of(column, 3) == want).all() and boosting._bins_of(column, 3).shape == want.shape


def test_a_blend_computes_its_input_once_and_joins_nothing(spark):
    x, y = sample(400, 3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = frame(spark, x, y, key=list(range(400)), fold=[i % 2 for i in range(400)])
    df = df.mapInArrow(counted, df.schema)
    few = {"trees": 2, "rate": 0.5, "least": 10, "rows": 1.0, "columns": 1.0}
    out, _, _ = models.blended(df, ["a", "b", "c"], "y", "fold", ["key"], {"one": lambda: models.leafwise(leaves=4, **few), "two": lambda: models.levelwise(depth=2, **few)})
    assert out.columns == ["key", "fold", "y", "one", "two", "guess"] and out.count() == 400 and seen.value == 400
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
