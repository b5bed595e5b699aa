"""Hand-checked cases, edge cases and brute-force comparisons of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.functions import scalars as S
from sondeflow.operators import aggregates as A
from sondeflow.operators import blending as B
from sondeflow.operators import curves as C
from sondeflow.operators import features, folds, joins, nearby, sequence, tracking
from sondeflow.operators import windows as W


def over():
    return Window.partitionBy("well").orderBy("row_idx")


def series(spark, values, name="x"):
    return spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate(values)], f"well long, row_idx long, {name} double")


def column(df, c):
    return [r[0] for r in df.orderBy("row_idx").select(c).collect()]


@pytest.mark.parametrize("given,ps,known,hidden,target", [([5, 6, None, None], 2, 2, 2, [False, False, True, True]), ([5, 6], 2, 2, 0, [False, False]), ([None, 6], 0, 0, 2, [True, True])])
def test_segments_and_anchor(spark, given, ps, known, hidden, target):
    df = series(spark, given, "tvt_input").withColumn("gr", F.lit(1.0))
    out = sequence.anchors(sequence.segments(df), {"tvt_input": "tvt0", "row_idx": "at"})
    rows = out.orderBy("row_idx").collect()
    assert [r.is_target for r in rows] == target
    assert {(r.ps_idx, r.known_length, r.hidden_length, r.at) for r in rows} == {(ps, known, hidden, max(ps - 1, 0))}


def test_gap_fill(spark):
    df = series(spark, [None, 1, None, None, 4, None])
    assert column(df, W.interpolated(F.col("x"), over(), F.col("row_idx"))) == [1, 1, 2, 3, 4, 4]
    assert column(df, W.edge_filled(F.col("x"), over())) == [1, 1, 1, 1, 4, 4]


def test_trailing(spark):
    df = series(spark, [1, None, 3, None, None, 6, None])
    assert column(df, W.rolling_mean(F.col("x"), over(), 3)) == [1, 1, 2, 3, 3, 6, 6]
    std = column(df, W.rolling_std(F.col("x"), over(), 3))
    assert std[2] == pytest.approx(math.sqrt(2)) and [v for k, v in enumerate(std) if k != 2] == [None] * 6


def test_even_centred_window(spark):
    got = column(series(spark, range(1, 31)), W.rolling_mean(F.col("x"), over(), 20, centred=True))
    assert got[15] == 15.5


def test_savgol_reproduces_a_polynomial(spark):
    y = [3 + 2 * i - 0.5 * i * i for i in range(25)]
    got = column(W.savgol(series(spark, y), "x", "s", 11, 2, "well", "row_idx"), "s")
    assert got == pytest.approx(y)
    assert column(W.savgol(series(spark, y[:5]), "x", "s", 11, 2, "well", "row_idx"), "s") == y[:5]


@pytest.mark.parametrize("edge,want", [("clamp", [0, 5, 20, 30, None]), ("extrapolate", [-10, 5, 20, 90, None]), ("null", [None, 5, 20, None, None])])
def test_lookup(spark, edge, want):
    k = C.curves(spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 3.0, 30.0), (1, None, 5.0)], "c long, x double, y double"), "c", "x", "y")
    v = spark.createDataFrame([(0, 1, -1.0), (1, 1, 0.5), (2, 1, 2.0), (3, 1, 9.0), (4, 1, None)], "row_idx long, c long, v double")
    assert column(v.join(k, "c"), C.lookup(F.col("knots"), F.col("v"), edge)) == want


def test_bins(spark):
    df = series(spark, [0, 1, 200, 500, 501, -1, None])
    assert column(df, S.cut(F.col("x"), [0.0, 1.0, 200.0, 500.0])) == [0, 0, 1, 2, None, None, None]
    assert column(A.quantile_bins(series(spark, range(1, 9)), "x", "b", 4), "b") == [0, 0, 1, 1, 2, 2, 3, 3]


def test_balanced_folds(spark):
    df = spark.createDataFrame([("a", 9.0), ("b", 7.0), ("c", 6.0), ("d", 5.0), ("e", 4.0)], "k string, load double")
    assert {r.k: r.fold for r in folds.balanced(df, "k", "load", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_regression_and_percentile(spark):
    df = series(spark, [2 * i + i % 3 for i in range(10)])
    r = A.line_fit(df, "x", "row_idx", ["well"]).first()
    assert (r.slope, r.intercept) == (pytest.approx(2.018181818), pytest.approx(0.818181818))
    assert df.agg(F.percentile("x", F.lit(0.95))).first()[0] == pytest.approx(18.0)


def test_guard_and_ids(spark):
    df = spark.createDataFrame([(9000, 40.0, -120.0), (10, 0.0, 0.0)], "h long, d double, z double")
    assert [r[0] for r in df.select(B.guard_rule(F.col("h"), F.col("d"), F.col("z"))).collect()] == ["full_anchor", "none"]
    ids = spark.createDataFrame([("a_b_12",), ("x",)], "id string")
    assert [tuple(r) for r in ids.select(S.id_key(F.col("id")), S.id_index(F.col("id"))).collect()] == [("a_b", 12), ("", None)]
    names = spark.createDataFrame([("w10",), ("w9",), ("w100",)], "n string")
    assert [r.n for r in names.orderBy(S.natural_key(F.col("n"))).collect()] == ["w9", "w10", "w100"]


def test_nnls():
    assert B.nnls(np.eye(2), np.array([2.0, -1.0])).tolist() == [2, 0]
    r = np.random.default_rng(0)
    for _ in range(50):
        x, y = r.normal(size=(40, 5)), r.normal(size=40)
        g, b = x.T @ x, x.T @ y
        w = B.nnls(g, b)
        slope = b - g @ w
        assert (w >= 0).all() and (slope <= 1e-8).all() and abs(slope @ w) < 1e-8


def test_robust_polynomial_ignores_outliers():
    x = np.linspace(0, 10, 60)
    y = 1 + 2 * x - 0.3 * x**2
    bad = y.copy()
    bad[::9] += 500
    assert np.abs(B.robust_polynomial(x, bad, 2, 8) - y).max() < 5


def test_spatial_as_brute_force(spark):
    r = np.random.default_rng(3)
    p = [(i, int(r.integers(0, 12)), float(x), float(y)) for i, (x, y) in enumerate(np.concatenate((r.normal(0, 1, (150, 2)), r.normal(0, 900, (30, 2)), np.zeros((20, 2)))))]
    q = [(i, w, x, y) for i, w, x, y in p] + [(9000, 99, 1e6, -1e6)]
    got = nearby.nearest(spark.createDataFrame(q, "qid long, qwho long, qx double, qy double"), spark.createDataFrame(p, "pid long, pwho long, px double, py double"), 4).collect()
    by = {}
    for row in got:
        by.setdefault(row.qid, []).append((row.distance, row.pid))
    for i, w, x, y in q:
        want = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, v, a, b in p if v != w)[:4]
        assert [j for _, j in sorted(by[i])] == [j for _, j in want]


def test_attach_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, 5)], "k long, v long")
    with pytest.raises(joins.CardinalityError, match="missing"):
        joins.attach(a, b, ["k"])
    with pytest.raises(joins.CardinalityError, match="repeat"):
        joins.attach(a, b.union(b), ["k"])
    assert joins.attach(a, b, ["k"], complete=False).count() == 2


def test_trackers_follow_a_clean_signal():
    import pandas as pd

    x = np.arange(0, 200.0)
    y = 50 + 30 * np.sin(x / 7) + x / 4
    path = 60 + np.cumsum(np.full(80, 0.1))
    rows = pd.DataFrame({"gr": np.interp(path, x, y), "start": 60.0})
    rows.loc[10:14, "gr"] = np.nan
    rng = np.random.default_rng(0)
    for kernel in (tracking.viterbi(states=201, sigma=3.0),):
        guess, loglik = kernel(rows, x, y, rng)
        assert np.abs(guess - path).mean() < 2 and math.isfinite(loglik)
    for kernel in (tracking.beam(), tracking.beam(trace_back=False), tracking.greedy_match(), tracking.correlation_match()):
        guess, _ = kernel(rows, x, y, rng)
        assert len(guess) == 80 and np.isfinite(guess).all()


def test_viterbi_as_all_paths():
    import itertools

    import pandas as pd

    r = np.random.default_rng(1)
    x, y = np.arange(10.0), r.normal(50, 10, 10)
    rows = pd.DataFrame({"gr": r.normal(50, 10, 5), "start": 5.0})
    guess, score = tracking.viterbi(reach=2.0, states=5, sigma=5.0)(rows, x, y, None)
    grid = 5.0 + np.linspace(-2, 2, 5)
    cost = lambda p: sum(((g - np.interp(a, x, y)) / 5) ** 2 / 2 for g, a in zip(rows["gr"], p)) + (p[0] - 5) ** 2 / 2 + sum((a - b) ** 2 / 2 for a, b in zip(p, p[1:]))
    best = min(itertools.product(grid, repeat=5), key=cost)
    assert list(guess) == list(best) and -score == pytest.approx(cost(best))


def test_hidden_truth_does_not_reach_features(spark):
    from sondeflow.operators import features

    base = lambda flip: sequence.from_anchor(sequence.anchors(sequence.segments(spark.createDataFrame([(1, i, float(i), float(i), 2.0 * i, 1.0, float(i) if i < 6 else None, (99.0 if flip else 1.0) * i) for i in range(20)], "well long, row_idx long, md double, x double, y double, z double, tvt_input double, tvt double").withColumn("gr", F.col("x"))), {"md": "md0"}), {"md": "md0"})
    a, b = (features.momentum(base(f)).collect() for f in (False, True))
    assert a == b


def test_remasked_and_sampled(spark):
    df = series(spark, [1, 2, 3, 4, None, None], "tvt_input")
    got = sequence.remasked(df, [0.5])
    assert [r.tvt_input for r in got.filter("aug_k = 0.5").orderBy("row_idx").collect()] == [1, 2, None, None]
    assert got.filter("aug_k = -1").count() == 6
    many = spark.range(4000)
    a, b = (sorted(r.id for r in d.filter(S.sampled(F.col("id"), 7, 10)).collect()) for d in (many, many.repartition(9)))
    assert a == b and 300 < len(a) < 500


def test_filling_is_linear_in_a_sequence(spark):
    """Four times the rows take about four times the time, also in one sequence."""
    import time

    back = Window.partitionBy("well").orderBy(F.desc("row_idx"))
    took = []
    for n in (20_000, 80_000):
        df = spark.range(n).select(F.lit(1).alias("well"), F.col("id").alias("row_idx"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("x"))
        began = time.perf_counter()
        out = df.select(W.interpolated(F.col("x"), over(), F.col("row_idx"), back).alias("a"), W.edge_filled(F.col("x"), over(), back).alias("b"))
        assert out.agg(F.count("a"), F.count("b")).first() == (n, n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 1
    many = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("load"))
    began = time.perf_counter()
    loads = folds.balance(folds.balanced(many, "k", "load", 5), "load").collect()
    assert time.perf_counter() - began < 30 and max(r.load for r in loads) - min(r.load for r in loads) < 97


def test_gap_fill_with_and_without_the_other_order(spark):
    df = series(spark, [None, 1, None, None, 4, None])
    back = Window.partitionBy("well").orderBy(F.desc("row_idx"))
    for f in (lambda b: W.interpolated(F.col("x"), over(), F.col("row_idx"), b), lambda b: W.edge_filled(F.col("x"), over(), b)):
        a, b = ([r.v for r in df.select("row_idx", f(o).alias("v")).orderBy("row_idx").collect()] for o in (back, None))
        assert a == b


def test_exact_quantiles_and_parts(spark):
    r = np.random.default_rng(0)
    v = np.concatenate((r.normal(size=501), np.zeros(200)))
    got = A.exact_quantiles(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double").repartition(7), "x", [0, 0.1, 0.5, 0.77, 1])
    assert got == pytest.approx(np.quantile(v, [0, 0.1, 0.5, 0.77, 1]))
    assert A.exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_regression_as_least_squares(spark):
    r = np.random.default_rng(1)
    x = r.normal(1e6, 3, (40, 3))
    y = 5 + x @ [1.0, -2.0, 0.5] + r.normal(0, 0.1, 40)
    rows = [(1, *map(float, (*a, b))) for a, b in zip(x, y)] + [(2, 1.0, 2.0, 3.0, 4.0)]
    got = {q.k: q for q in A.regression(spark.createDataFrame(rows, "k long, a double, b double, c double, y double"), "y", ["a", "b", "c"], ["k"]).collect()}
    coef = np.linalg.lstsq(np.column_stack((x - x.mean(axis=0), np.ones(40))), y, rcond=None)[0]
    assert [got[1].c_a, got[1].c_b, got[1].c_c] == pytest.approx(coef[:3], rel=1e-4)
    assert got[1].r2 > 0.99 and got[2].c_a is None and got[2].r2 is None
    flat = spark.createDataFrame([(1, float(i), 2.0 * i, 7.0, 3.0 * i) for i in range(10)], "k long, a double, b double, c double, y double")
    q = A.regression(flat, "y", ["a", "b", "c"], ["k"]).first()
    assert q.c_a + 2 * q.c_b == pytest.approx(3, abs=1e-6) and q.c_c == 0 and q.r2 == pytest.approx(1)


def test_gates_and_files(spark, tmp_path):
    from sondeflow.operators import validation as V

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "t double, g double")
    assert V.gates(df, "t", "g", 2, (0.5, 1.0))["rmse"] == pytest.approx(0.5**0.5)
    with pytest.raises(ValueError, match="rows"):
        V.gates(df, "t", "g", 3)
    with pytest.raises(ValueError, match="error"):
        V.gates(df, "t", "g", None, (0.0, 0.1))
    (tmp_path / "a").write_text("x")
    assert V.present_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == {str(tmp_path / "a"): True, str(tmp_path / "b"): False}
    assert V.missing_columns(df, ["t", "z"]) == ["z"]
    assert [(r.t, r.n) for r in V.duplicated(df.union(df.limit(1)), ["t"]).collect()] == [(1.0, 2)]


def test_small_pieces(spark):
    df = spark.createDataFrame([(3, [5.0, 1.0, 9.0])], "k long, v array<double>")
    v = F.col("v")
    row = df.select(A.largest_of(v, 2).alias("top"), S.argmin(v).alias("at"), S.running(v).alias("sums"), S.evenly(0, 1, 3).alias("even"), S.place_in(F.array(F.lit(1.0), F.lit(5.0)), F.lit(5.0), True).alias("place"), S.looked_up(F.col("k"), {3: "c"}).alias("name"), S.stable_seed(F.lit("a"), F.lit(1)).alias("seed"), S.iso_now().alias("now")).first()
    assert (row.top, row.at, row.sums, row.even, row.place, row.name) == ([9, 5], 1, [5, 6, 15], [0, 0.5, 1], 2, "c")
    import re
    import zlib

    assert row.seed == zlib.crc32(b"a:1") and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", row.now)
    assert B.variant_parts("pf_scale_8_beam_0.25_hold_0.5") == (8.0, 0.25, 0.5) and B.variant_parts("pf_scale_3") == (3.0, 0.0, 0.0)
    assert B.predicted_board(10.0) == pytest.approx(8.6)
    assert tracking.agreed(np.array([1.0, 5.0]), np.array([1.5, 9.0]), 1.0).tolist() == [True, False]
    m = {f: B.Moments(np.eye(2) * (f + 1), np.array([1.0, 0.5]), 2.0, 4.0) for f in range(3)}
    assert B.consistent(m, 0, [0, 1], 0) and not B.consistent(m, 0, [0, 1], 4)
    assert A.first_rows(spark.range(9), ["id"], 4).count() == 4 and A.first_rows(spark.range(9), ["id"], None).count() == 9
    shuffled = spark.createDataFrame([(k,) for k in (4, 1, 3)], "k long").coalesce(1)
    assert [r.k for r in sequence.restored(shuffled, lambda d: d.filter("k > 1")).collect()] == [4, 3]


def test_large_candidate_sets_are_dealt(spark, monkeypatch):
    a = spark.createDataFrame([(k, float(k * 7 % 50)) for k in range(40)], "a long, va double")
    b = a.select(F.col("a").alias("b"), F.col("va").alias("vb"), (F.col("a") % 4).alias("kind"))
    find = lambda: sorted(map(tuple, joins.nearest_of_kinds(a, b, F.abs(F.col("va") - F.col("vb")), "a", "b", "kind", 2).collect()))
    few = find()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 7)
    monkeypatch.setattr(joins.small, "__defaults__", (7, 100))
    assert find() == few


def test_models(spark):
    from sondeflow.operators import models

    r = np.random.default_rng(2)
    rows = [(i, i % 3, *map(float, v), float(3 * v[0] - v[1] + r.normal(0, 0.05))) for i, v in enumerate(r.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "k long, fold int, a double, b double, y double").withColumn("rough", 2.5 * F.col("a"))
    error = lambda d, c: d.select(F.sqrt(F.avg((F.col(c) - F.col("y")) ** 2))).first()[0]
    fitted = models.fold_models(df, ["a", "b"], "y", "fold", models.linear)
    out = models.out_of_fold(df, fitted, ["a", "b"], "y", "fold", ["k"])
    assert out.count() == 240 and error(out, "guess") < 0.1
    mean = models.averaged(df.drop("y"), list(fitted.values()), ["a", "b"], ["k"]).join(df, "k")
    assert error(mean, "guess") < 0.1
    better = models.on_residual(df, "rough", ["a", "b"], "y", "fold", ["k"], [models.linear])
    assert error(better, "guess") < 0.1 < error(better, "rough")
    trees = models.fold_models(df, ["a", "b"], "y", "fold", lambda: models.boosted(5, 3))
    rank = models.importances(trees, ["a", "b"], spark).collect()
    assert rank[0].feature == "a" and sum(x.importance for x in rank) == pytest.approx(1)
    mix, w, _ = models.blended(df, ["a", "b"], "y", "fold", ["k"], {"line": models.linear, "trees": lambda: models.boosted(3, 2)})
    assert w["line"] > 0.9 and sum(w.values()) == pytest.approx(1) and error(mix, "guess") < 0.2


def test_stored_models(spark, tmp_path):
    from sondeflow.operators import models

    df = spark.createDataFrame([(i, i % 2, float(i), 2.0 * i) for i in range(20)], "k long, fold int, a double, y double")
    fitted = list(models.fold_models(df, ["a"], "y", "fold", models.linear).values())
    models.save_all(fitted, str(tmp_path / "m"))
    back = models.stored(str(tmp_path / "m"))
    both = [sorted(map(tuple, models.averaged(df, m, ["a"], ["k"]).collect())) for m in (fitted, back)]
    assert len(back) == 2 and both[0] == both[1]


def test_lateral_extrapolation(spark):
    """Well 1 bends before its last known rows, well 2 knows too little, well 3 nothing, well 4 does not move, well 5 lacks an md."""
    rows = [(1, i, float(i), 2.0 * i, (5.0 * i if i < 10 else 45.0 + 0.5 * (i - 9)) if i < 50 else None) for i in range(54)]
    rows += [(2, i, float(i), float(i), 7.0 + i if i < 3 else None) for i in range(5)] + [(3, i, float(i), 1.0, None) for i in range(2)]
    rows += [(4, i, 8.0, 1.0, 4.0 if i < 40 else None) for i in range(41)] + [(5, i, float(i) if i != 41 else None, 1.0, 1.0 * i if i < 40 else None) for i in range(42)]
    df = spark.createDataFrame(rows, "well long, row_idx long, md double, z double, tvt_input double").withColumn("gr", F.lit(1.0)).withColumn("__extra", F.lit(0))
    base = sequence.segments(df)
    got = {(r.well, r.row_idx): r for r in features.lateral(base).collect()}
    assert len(got) == 4 + 2 + 2 + 1 + 2
    known = np.array([r[4] for r in rows[:50]])
    slope = np.polyfit(np.arange(20, 50.0), known[20:], 1)[0]
    for i in range(50, 54):
        r = got[1, i]
        assert (r.held, r.by_md, r.by_z) == pytest.approx((known[-1], known[-1] + slope * (i - 49), known[-1] + slope / 2 * 2 * (i - 49)))
        assert r.by_steps == pytest.approx(known[-1] + np.median(np.diff(known)) * (i - 49)) and r.lateral == pytest.approx((r.by_md + r.by_z + r.by_steps) / 3)
    for k, want in {(2, 4): 9.0, (3, 0): 0.0, (4, 40): 4.0}.items():
        assert [got[k][c] for c in ("held", "by_md", "by_z", "by_steps", "lateral")] == [want] * 5
    assert got[5, 40].by_md == pytest.approx(40.0) and got[5, 41].by_md is None and got[5, 41].by_z == 39.0
    assert features.lateral(base.limit(0)).count() == 0
