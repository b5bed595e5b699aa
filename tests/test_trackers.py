"""Filters, beams and matches against slow plain versions of the same rules."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import features, filters, tracking
from sondeflow.operators.windows import savgol_weights


def well(n=30, known=12, seed=0):
    r = np.random.default_rng(seed)
    md = np.cumsum(r.uniform(0.5, 3.0, n))
    z = -np.cumsum(r.uniform(0, 1, n))
    tvt = 60 + np.cumsum(r.normal(0.3, 0.2, n))
    x = np.arange(0, 140.0, 2.0)
    y = 60 + 30 * np.sin(x / 6) + x / 5
    gr = np.interp(tvt, x, y) + r.normal(0, 1, n)
    gr[[k for k in (4, 15, 16) if k < n - 1]] = np.nan
    return pd.DataFrame({"well": 1, "row_idx": np.arange(n), "md": md, "z": z, "gr": gr, "tvt": tvt, "tvt_input": np.where(np.arange(n) < known, tvt, np.nan)}), x, y


def slow_filter(part, seeds, rng, s):
    """One particle after another, from the same draws."""
    shape, n = (seeds, s.particles), len(part.md)
    a = rng.standard_normal(shape)
    b = rng.standard_normal(shape)
    place = [[part.anchor + part.z0 + s.start_spread * a[i, j] for j in range(shape[1])] for i in range(shape[0])]
    rate = [[part.rate + s.rate_spread * b[i, j] for j in range(shape[1])] for i in range(shape[0])]
    w = [[1 / shape[1]] * shape[1] for _ in range(seeds)]
    out, total, before = np.zeros((seeds, n)), np.zeros(seeds), part.md0
    for row in range(n):
        run = max(part.md[row] - before, 1.0)
        a, b = rng.standard_normal(shape), rng.standard_normal(shape)
        for i in range(seeds):
            mean = 0.0
            for j in range(shape[1]):
                rate[i][j] = s.momentum * rate[i][j] + s.rate_noise * a[i, j]
                p = place[i][j] + rate[i][j] * run + s.place_noise * b[i, j] - part.z[row]
                p = min(max(p, part.x[0] - s.margin), part.x[-1] + s.margin)
                place[i][j] = p + part.z[row]
                if part.seen[row] or not s.skip_null:
                    d = (part.gr[row] - np.interp(p, part.x, part.y)) / part.scale
                    w[i][j] *= max(math.exp(-0.5 * min(d * d, 600.0)), 1e-300)
            if part.seen[row] or not s.skip_null:
                mean = sum(w[i])
                total[i] += math.log(max(mean, 1e-300))
                w[i] = [v / mean if mean > 0 else 1 / shape[1] for v in w[i]]
        for i in range(seeds):
            if 1 / sum(v * v for v in w[i]) < s.resample * shape[1]:
                u, cum, chosen = rng.random(), np.cumsum(w[i]), []
                for j in range(shape[1]):
                    chosen.append(next((k for k in range(shape[1]) if cum[k] >= (u + j) / shape[1]), shape[1] - 1))
                a, b = rng.standard_normal(shape[1]), rng.standard_normal(shape[1])
                place[i] = [place[i][k] + s.rough_place * a[j] for j, k in enumerate(chosen)]
                rate[i] = [rate[i][k] + s.rough_rate * b[j] for j, k in enumerate(chosen)]
                w[i] = [1 / shape[1]] * shape[1]
            out[i, row] = sum(v * (p - part.z[row]) for v, p in zip(w[i], place[i]))
        before = part.md[row]
    return out, total


@pytest.mark.parametrize("skip", [False, True])
def test_filter_as_one_particle_after_another(skip):
    rows, x, y = well()
    s = filters.Settings(particles=15, start_spread=6.0, rate_noise=0.05, skip_null=skip)
    part = filters.prepared(rows, x, y, s)
    got, loglik, spread = filters.paths(part, 3, np.random.default_rng(5), s)
    want, total = slow_filter(part, 3, np.random.default_rng(5), s)
    assert got == pytest.approx(want) and loglik == pytest.approx(total)
    assert (spread >= 0).all() and got.shape == (3, 18)


def test_what_the_known_part_says():
    rows, x, y = well(known=20)
    part = filters.prepared(rows, x, y)
    known = rows[rows["tvt_input"].notna()]
    resid = known["gr"].fillna(0).to_numpy() - np.interp(known["tvt_input"], x, y)
    assert part.scale == pytest.approx(np.clip(resid.std(), 10, 60))
    steps = (np.diff(known["tvt_input"] + known["z"]) / np.diff(known["md"]))[-29:]
    assert part.rate == pytest.approx(np.median(steps))
    assert (part.anchor, part.md0) == (known["tvt_input"].iloc[-1], known["md"].iloc[-1])
    assert filters.prepared(known, x, y) is None
    assert filters.rate_of(np.array([1.0, 2.0]), np.array([1.0, 2.0])) == 0.0


def test_filters_follow_a_clean_signal():
    rows, x, y = well(n=80, known=30, seed=3)
    for s in (filters.Settings(particles=400, rate_noise=0.05, place_noise=0.1), filters.Settings(**{**filters.DIP.__dict__, "particles": 400, "rate_noise": 0.05, "place_noise": 0.1})):
        part = filters.prepared(rows, x, y, s)
        guess, loglik, spread = filters.paths(part, 4, np.random.default_rng(0), s)
        best = guess[loglik.argmax()]
        assert np.abs(best - rows["tvt"].to_numpy()[30:]).mean() < 5
    part = filters.prepared(rows, x, y)
    guess, loglik, _ = filters.tempered(part, np.random.default_rng(1), filters.Settings(particles=400, rate_noise=0.05, place_noise=0.1))
    assert guess.shape == (1, 50) and np.abs(guess[0] - rows["tvt"].to_numpy()[30:]).mean() < 8 and np.isfinite(loglik).all()


def test_two_filters_as_one_particle_after_another():
    rows, x, y = well()
    s = filters.Settings(particles=15, start_spread=6.0, rate_noise=0.05)
    part = filters.prepared(rows, x, y, s)
    got, loglik, spread = filters.both_ways(part, 1, np.random.default_rng(5), s, wide=20.0)
    rng = np.random.default_rng(5)
    ahead, total = slow_filter(part, 1, rng, s)
    back_part = filters.turned(part, float(ahead[0][-1]))
    assert (np.diff(back_part.md) >= 0).all() and back_part.rate == -part.rate and back_part.z0 == part.z[-1]
    back, _ = slow_filter(back_part, 1, rng, filters.replace(s, start_spread=20.0))
    again = np.random.default_rng(5)
    var = filters.paths(part, 1, again, s)[2][0] ** 2
    back_var = filters.paths(back_part, 1, again, filters.replace(s, start_spread=20.0))[2][0][::-1] ** 2
    a, b = 1 / np.maximum(var, 1e-3), 1 / np.maximum(back_var, 1e-3)
    want = (a * ahead[0] + b * back[0][::-1]) / (a + b)
    assert got[0] == pytest.approx(want) and loglik[0] == pytest.approx(total[0]) and spread[0] == pytest.approx(1 / np.sqrt(a + b))
    gated = filters.both_ways(part, 1, np.random.default_rng(5), s, wide=20.0, limit=1.0)[0][0]
    assert gated == pytest.approx(np.where(np.abs(want - ahead[0]) <= 1.0, want, ahead[0]))


def test_best_restart_keeps_its_ensemble():
    rows, x, y = well()
    s = filters.Settings(particles=15, start_spread=4.0, rate_noise=0.05)
    part = filters.prepared(rows, x, y, s)
    got, loglik, _ = filters.restarted(part, 2, np.random.default_rng(4), s, offsets=(-20.0, 0.0, 20.0))
    rng = np.random.default_rng(4)
    tries = [slow_filter(filters.replace(part, anchor=part.anchor + o), 2, rng, s) for o in (-20.0, 0.0, 20.0)]
    guess, total = max(tries, key=lambda t: max(t[1]))
    w = [math.exp((v - max(total)) / 8) for v in total]
    assert loglik[0] == pytest.approx(max(total)) and got[0] == pytest.approx((w[0] * guess[0] + w[1] * guess[1]) / sum(w))


def test_one_replica_is_the_plain_filter():
    rows, x, y = well(n=60, known=20, seed=2)
    s = filters.Settings(particles=40, start_spread=6.0, rate_noise=0.05)
    part = filters.prepared(rows, x, y, s)
    one = filters.paths(part, 1, np.random.default_rng(9), s)
    got = filters.tempered(part, np.random.default_rng(9), s, replicas=1, every=1000)
    for a, b in zip(got, one):
        assert a == pytest.approx(b)


def test_replicas_change_places_in_detailed_balance():
    """At two powers of three states' likelihoods, exchanges by the odds leave the joint distribution as it is."""
    met, (a, b) = np.array([0.0, -1.5, -4.0]), (1.0, 0.25)
    joint = np.exp(a * met[:, None] + b * met[None, :])
    go = np.minimum(1.0, np.exp([[filters.exchange_odds(a, b, x, y) for y in met] for x in met]))
    assert joint * go == pytest.approx((joint * go).T)


def test_filtered_table(spark):
    parts = [well(seed=k)[0].assign(well=k) for k in range(3)]
    _, x, y = well()
    rows = spark.createDataFrame(pd.concat(parts)).replace(float("nan"), None)
    curve = spark.createDataFrame([(k, float(a), float(b)) for k in range(2) for a, b in zip(x, y)], "well long, x double, y double")
    s = filters.Settings(particles=20)
    one = filters.filtered(rows, curve, "well", "row_idx", 2, s)
    again = filters.filtered(rows.repartition(5), curve, "well", "row_idx", 2, s)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    assert one.count() == 3 * 18 * 2
    held = one.filter("well = 2").select("guess", "loglik").distinct().collect()
    assert len(held) == 1 and held[0].loglik == 0
    scales = filters.many_scales(one, "well", "row_idx").collect()
    by = {}
    for r in one.collect():
        by.setdefault((r.well, r.row_idx), []).append((r.loglik, r.guess))
    for r in scales:
        for scale in (3.0, 12.0):
            ll, g = map(np.array, zip(*by[(r.well, r.row_idx)]))
            w = np.exp((ll - ll.max()) / scale)
            assert r[f"at_{scale:g}"] == pytest.approx((w * g).sum() / w.sum())
        assert r.guess == pytest.approx(np.mean([r[f"at_{v}"] for v in (3, 5, 8, 12)]))
    anchors = spark.createDataFrame([(k, 5.0) for k in range(3)], "well long, tvt0 double")
    moved = filters.to_anchor(one, anchors, "well", "tvt0")
    pairs = one.join(moved.withColumnRenamed("guess", "new").select("well", "row_idx", "seed", "new"), ["well", "row_idx", "seed"]).filter("well < 2")
    changed = [r for r in pairs.collect() if abs(r.guess - r.new) > 1e-12]
    assert 0 < len(changed) <= 0.26 * pairs.count() and all(r.new == pytest.approx(0.7 * r.guess + 1.5) for r in changed)


def test_curves_in_a_column_are_as_a_table(spark):
    """Whatever row of a key holds its knots; keys without any, with a null array and with knots without a number, too."""
    r = np.random.default_rng(3)
    rows = [(w, i, float(i), 0.1 * i, None if i % 7 == 3 else float(r.normal()), 100.0 + i if i < 8 and w != 3 else None) for w in range(1, 6) for i in range(30)]
    knots = {1: [(90.0, 1.0), (100.0, 3.0), (100.0, 5.0), (140.0, 2.0)], 2: [], 3: [(90.0, 1.0), (120.0, 4.0)], 4: [(None, 1.0), (120.0, 4.0)], 5: [(130.0, 1.0), (95.0, 4.0)]}
    kind = "well long, row_idx long, md double, z double, gr double, tvt_input double"
    curve = spark.createDataFrame([(w, x, y) for w, pairs in knots.items() for x, y in pairs], "well long, x double, y double")
    inside = [(*row, knots[row[0]] if row[1] == row[0] and row[0] != 2 else None) for row in rows]
    s, found = filters.Settings(particles=20), []
    for table, given in ((spark.createDataFrame(rows, kind), curve), (spark.createDataFrame(inside, kind + ", c array<struct<x: double, y: double>>").repartition(3), "c")):
        found.append(sorted(filters.filtered(table, given, "well", "row_idx", 2, s).collect(), key=lambda v: (v.well, v.row_idx, v.seed)))
    assert len(found[0]) == 2 * (22 * 4 + 30) and str(found[0]) == str(found[1])  # NaN where nothing is known


def test_filters_go_through_the_events_once(spark):
    from sondeflow.plans import registry

    for name in ("pf_tempered", "pf_annealed", "track_restarted", "track_both_ways"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("user_id#") and sum("Relation" in line and "user_id#" in line for line in plan.split("\n")) == 1, name


def test_candidates_are_weighed(spark):
    rows = [(1, c, i, s, float(10 * c + i), float(l), c == 1) for c, l in ((1, -4.0), (2, -4.0)) for i in range(2) for s in range(2)]
    df = spark.createDataFrame(rows, "well long, cand int, row_idx long, seed int, guess double, loglik double, own boolean")
    got = {r.row_idx: r.guess for r in filters.over_candidates(df, "well", "row_idx", "cand", "own", 16.0, 2.0).collect()}
    w = math.exp(2) / (math.exp(2) + 1)
    assert got[0] == pytest.approx(10 * w + 20 * (1 - w)) and got[1] == pytest.approx(11 * w + 21 * (1 - w))
    old = {r.row_idx: r.guess for r in tracking.of_candidates(df, "well", "row_idx", "cand", "own").collect()}
    assert old[0] == pytest.approx(got[0], abs=1e-9)


def slow_beam(g, x, y, start, width, scale, cost, trace_back):
    heads = {int(np.abs(x - start).argmin()): 0.0}
    links, best = [], []
    for v in g:
        new = {}
        for s in sorted(heads):
            for m in range(-2, 3):
                t = s + m
                if 0 <= t < len(x):
                    c = heads[s] + (v - y[t]) ** 2 / scale + cost * abs(m)
                    if t not in new or c < new[t][0]:
                        new[t] = (c, s)
        heads = {t: new[t][0] for t in sorted(new, key=lambda t: (new[t][0], t))[:width]}
        links.append({t: new[t][1] for t in heads})
        best.append(min(heads, key=lambda t: (heads[t], t)))
    if not trace_back:
        return [x[t] for t in best]
    path = [best[-1]]
    for link in reversed(links[1:]):
        path.append(link[path[-1]])
    return [x[t] for t in path[::-1]]


@pytest.mark.parametrize("trace_back", [False, True])
def test_beam_as_a_dictionary_of_heads(trace_back):
    rows, x, y = well(n=60, known=0, seed=2)
    rows["start"] = 60.0
    g = rows["gr"].interpolate(limit_direction="both").to_numpy()
    for width, cost, scale, _ in tracking.BEAMS:
        got, _ = tracking.beam(width=width, emission=scale, move_cost=cost, trace_back=trace_back)(rows, x, y, None)
        assert list(got) == slow_beam(g, x, y, 60.0, width, scale, cost, trace_back)
    each = [tracking.beam(width=w, emission=e, move_cost=c, trace_back=trace_back, smooth="savgol", radius=r)(rows, x, y, None)[0] for w, c, e, r in tracking.BEAMS]
    assert tracking.mean_beam(trace_back=trace_back)(rows, x, y, None)[0] == pytest.approx(np.mean(each, axis=0))


def test_smoothing_of_arrays():
    v = np.array([3 + 2 * i - 0.5 * i * i for i in range(25)])
    assert tracking.savgol_of(v, 4) == pytest.approx(v) and tracking.savgol_of(v[:5], 4).tolist() == v[:5].tolist()
    noisy = v + np.random.default_rng(0).normal(0, 5, 25)
    w = savgol_weights(9, 2)
    assert tracking.savgol_of(noisy, 4)[10] == pytest.approx(w[4] @ noisy[6:15]) and tracking.savgol_of(noisy, 4)[1] == pytest.approx(w[1] @ noisy[:9])
    assert tracking.median_filter(np.array([5.0, 1, 9, 2, 2]), 3).tolist() == [5, 5, 2, 2, 2]
    assert tracking.low_pass(np.full(20, 3.0)) == pytest.approx(np.full(20, 3.0))
    assert tracking.low_pass_extrapolated(np.full(20, 3.0), 4) == pytest.approx(np.full(4, 3.0))
    same = tracking.emission_scores(noisy, noisy)
    assert same["sse"] == same["wavelet"] == same["sorted"] == 0 and same["ncc"] == pytest.approx(1, abs=1e-6) and same["phase"] == pytest.approx(1)
    other = tracking.emission_scores(noisy, noisy[::-1])
    assert other["wavelet"] > 0 and other["ncc"] < same["ncc"]


def test_self_matches_as_all_windows():
    r = np.random.default_rng(4)
    known, target, hidden = r.normal(0, 1, 40), np.cumsum(r.uniform(0, 1, 40)), r.normal(0, 1, 9)
    at, score = tracking.self_matches(known, target, hidden, 3, 2)
    padded = np.pad(hidden, 3, mode="edge")
    z = lambda v: (v - v.mean()) / (v.std() + 1e-6)
    for k in range(9):
        tries = [(round(float((z(padded[k : k + 7]) * z(known[s : s + 7])).mean()), 9), -s) for s in range(0, 34, 2)]
        best, s = max(tries)
        assert score[k] == pytest.approx(best, abs=1e-8) and at[k] == target[-s + 3]
    assert tracking.self_matches(known[:5], target[:5], hidden, 3, 2)[0].tolist() == [target[4]] * 9


def test_self_correlation_table(spark):
    rows = well(n=60, known=40)[0]
    out = tracking.self_correlated(spark.createDataFrame(rows).replace(float("nan"), None), "well", "row_idx", halves=(2, 4)).orderBy("row_idx").collect()
    assert len(out) == 20
    for q in out:
        w = np.exp(3 * np.array([q.score_2, q.score_4]))
        assert q.guess == pytest.approx((w * np.array([q.at_2, q.at_4])).sum() / w.sum())


def test_hybrid_beam_as_all_paths():
    rows, x, y = well(n=5, known=0, seed=6)
    rows["start"] = 62.0
    got, score = tracking.hybrid_beam(width=99, states=7, reach=6.0)(rows, x, y, None)
    g = rows["gr"].interpolate(limit_direction="both").to_numpy()
    grid = np.linspace(56, 68, 7)

    def emission(i, c):
        alike = []
        for h in (1, 2, 3):
            own = np.pad(g, h, mode="edge")[i : i + 2 * h + 1]
            want = np.interp(c + np.arange(-h, h + 1), x, y)
            own, want = own - own.mean(), want - want.mean()
            alike.append(own @ want / (np.linalg.norm(own) * np.linalg.norm(want) + 1e-9))
        return math.log(0.6 * math.exp(-abs(g[i] - np.interp(c, x, y)) / 40) + 0.2 * (1 + np.mean(alike)))

    value = lambda p: sum(emission(i, c) for i, c in enumerate(p)) - 0.05 * ((p[0] - 62) ** 2 + sum((b - a) ** 2 for a, b in zip(p, p[1:])))
    best = max(itertools.product(grid, repeat=5), key=value)
    assert score == pytest.approx(value(best)) and list(got) == pytest.approx(list(best))
    assert set(tracking.hybrid_beam(constant=True)(rows, x, y, None)[0]) == {tracking.hybrid_beam()(rows, x, y, None)[0][-1]}


def test_alignment_as_a_loop(spark):
    rows, x, y = well(n=120, known=40, seed=7)
    rows["is_target"] = rows["tvt_input"].isna()
    rows["centre"] = rows["tvt"] + 4.0
    curve = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "well long, x double, y double")
    df = spark.createDataFrame(rows).replace(float("nan"), None)
    got = features.alignment(df, curve, "centre").orderBy("row_idx").collect()
    known = rows[rows["tvt_input"].notna() & rows["gr"].notna()]
    a, b = np.polyfit(np.interp(known["tvt_input"], x, y), known["gr"], 1)
    seen = rows[rows["is_target"] & rows["gr"].notna()]
    cost = {c: np.mean([abs((g - b) / a - np.interp(p + c, x, y)) for g, p in zip(seen["gr"], seen["centre"])]) for c in np.arange(-30, 30.25, 0.5)}
    best = min(cost, key=cost.get)
    assert len(got) == 80 and {r.offset for r in got} == {best} and got[0].gain == pytest.approx(cost[0.0] - cost[best])
    assert abs(best + 4.0) <= 1.0
    local = {r.row_idx: r.local for r in got}
    idx = seen["row_idx"].tolist()
    for k in (0, 30, len(idx) - 1):
        window = seen.iloc[max(k - 30, 0) : min(k + 30, len(idx))]
        tries = {c: np.mean([abs((g - b) / a - np.interp(p + c, x, y)) for g, p in zip(window["gr"], window["centre"])]) for c in np.arange(-15, 15.25, 0.5)}
        assert local[idx[k]] == min(tries, key=tries.get)


def test_seeds_may_be_dealt(spark):
    rows = well(n=20, known=0)[0].assign(start=60.0)
    _, x, y = well()
    curve = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    df = spark.createDataFrame(rows).replace(float("nan"), None).select("well", "row_idx", "gr", "start")
    kernel = lambda rows, x, y, rng: (rng.standard_normal(len(rows)), rng.random())
    one, dealt = (sorted(map(tuple, tracking.tracked(df, curve, kernel, "well", "row_idx", "gr", 3, spread).collect())) for spread in (1, 2))
    keyed = sorted(map(tuple, tracking.tracked(df, curve.select(F.lit(1).cast("long").alias("well"), "x", "y"), kernel, "well", "row_idx", "gr", 3).collect()))
    assert one == dealt == keyed and len(one) == 60


def test_self_matches_by_transform_on_long_and_flat_parts():
    r = np.random.default_rng(6)
    known, hidden = 80 + np.cumsum(r.normal(size=900)), 80 + np.cumsum(r.normal(size=333))
    known[200:300], hidden[50:120] = 77.0, 75.0  # windows that do not vary correlate with nothing
    target = np.arange(900.0)
    for half, stride in ((8, 3), (25, 1)):
        unit = lambda v: (v - v.mean(axis=1, keepdims=True)) / (v.std(axis=1, keepdims=True) + 1e-6)
        windows = np.lib.stride_tricks.sliding_window_view(known, 2 * half + 1)[::stride]
        flat = np.ptp(windows, axis=1) == 0
        want = unit(np.lib.stride_tricks.sliding_window_view(np.pad(hidden, half, mode="edge"), 2 * half + 1)) @ np.where(flat[:, None], 0.0, unit(windows)).T / (2 * half + 1)
        at, score = tracking.self_matches(known, target, hidden, half, stride)
        assert score == pytest.approx(want.max(axis=1), abs=1e-9)
        k = ((at - half) / stride).astype(int)
        assert want[np.arange(len(k)), k] == pytest.approx(want.max(axis=1), abs=1e-8)


@pytest.mark.parametrize("emission", ["gaussian", "slope", "correlation"])
def test_keys_that_step_together_are_as_alone(emission, monkeypatch):
    """Keys of several lengths, one without a curve: the same draws give the same paths, bit for bit."""
    wells = [well(n=n, known=12, seed=n) for n in (30, 14, 55, 21)]
    s = filters.Settings(particles=20, start_spread=6.0, rate_noise=0.05, emission=emission, skip_null=True, anneal=0.5)
    parts = [filters.prepared(rows, x, y, s) for rows, x, y in wells] + [filters.prepared(well()[0], np.zeros(0), np.zeros(0), s)]
    rngs = lambda: [np.random.default_rng(k) for k in range(len(parts))]
    for cells in (1 << 15, 130):
        monkeypatch.setattr(filters, "CELLS", cells)
        for many, one in (
            (lambda p, r: filters.all_paths(p, 3, r, s), lambda p, r: filters.paths(p, 3, r, s)),
            (lambda p, r: filters.all_restarted(p, 2, r, s), lambda p, r: filters.restarted(p, 2, r, s)),
            (lambda p, r: filters.all_both_ways(p, 2, r, s), lambda p, r: filters.both_ways(p, 2, r, s)),
            (lambda p, r: filters.all_tempered(p, r, s), lambda p, r: filters.tempered(p, r, s)),
        ):
            for got, part, rng in zip(many(parts, rngs()), parts, rngs()):
                assert all(np.array_equal(a, b) for a, b in zip(got, one(part, rng)))


def test_tasks_get_whole_keys(spark, monkeypatch):
    """Both sides of the union come dealt by the key and put together differently; keys run over batches, one is null."""
    import pyarrow as pa

    from sondeflow.operators import sequence

    def of_keys(table, starts):
        ends = [*starts[1:], len(table)]
        assert all(len(set(table["k"][int(a) : int(b)].to_pylist())) == 1 for a, b in zip(starts, ends))
        return pa.table({"k": table["k"].take(pa.array(starts)), "n": pa.array([int(b - a) for a, b in zip(starts, ends)])})

    monkeypatch.setattr(sequence, "ROWS", 40)
    rows = spark.range(4000).selectExpr("IF(id % 7 = 0, NULL, id % 97) AS k", "id AS i")
    few = rows.groupBy("k").agg(F.max("i").alias("i"))
    other = rows.withColumn("i", F.count("*").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("k")))
    got = sequence.by_keys(other.union(few), ["k"], [F.col("i")], of_keys, "k long, n long").collect()
    assert len(got) == 98 and {r.k: r.n for r in got} == {r.k: r["count"] + 1 for r in rows.groupBy("k").count().collect()}


def test_beams_side_by_side_cost_little_more_than_one():
    import time

    rows, x, y = well(n=400, known=0, seed=2)
    rows["start"] = 60.0

    def seconds(kernel):
        began = time.perf_counter()
        kernel(rows, x, y, None)
        return time.perf_counter() - began

    one, all_ = (min(seconds(k) for _ in range(3)) for k in (tracking.beam(width=10), tracking.mean_beam()))
    assert all_ < 7 * one  # 14 beams one after another take 14 times as long


@pytest.mark.parametrize("even", [True, False])
def test_curves_are_read_as_by_interp(even, monkeypatch):
    """Bit for bit: at knots, a rounding beside them, beyond both ends and without a number; even curves of several sizes all at once."""
    r = np.random.default_rng(8)

    class Curve:
        def __init__(self, n):
            shift = 0.45 if even else 30.0
            self.x = np.sort(7.3 + 40.1 * (np.arange(n) + shift * r.uniform(-1, 1, n)))
            self.y, self.gr, self.scale = r.normal(size=n), r.normal(size=5), 10.0

    parts = [Curve(n) for n in (50, 2, 17, 3, 50)]
    ys = [p.y for p in parts], [np.exp(p.y) for p in parts]
    for who in (np.arange(5), np.arange(3), np.array([1, 3, 4]), np.array([2])):
        at = []
        for k in who:
            x = parts[k].x
            some = np.concatenate((x, np.nextafter(x, -1e9), np.nextafter(x, 1e9), [x[0] - 100.0, x[-1] + 100.0, np.nan], r.uniform(x[0] - 50, x[-1] + 50, 500)))
            at.append(np.resize(some, (3, 300)))
        at = np.array(at)
        want = [np.stack([np.interp(v, parts[k].x, y[k]) for k, v in zip(who, at)]) for y in ys]
        got = tracking.reader(parts, *ys)(who, at.copy())
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))
    if even:  # no call a key and row
        score = tracking.SCORES["gaussian"](parts)
        monkeypatch.setattr(np, "interp", None)
        assert np.isfinite(score(2, np.arange(5), np.zeros((5, 2, 6)))).all()


def test_seeds_averaged_in_the_task_are_as_in_a_table(spark):
    wells = [well(n=n, known=12, seed=n) for n in (30, 14, 55)]
    s = filters.Settings(particles=20, start_spread=6.0, rate_noise=0.05)
    parts = [filters.prepared(rows, x, y, s) for rows, x, y in wells] + [filters.prepared(well()[0], np.zeros(0), np.zeros(0), s)]
    rngs = lambda: [np.random.default_rng(k) for k in range(len(parts))]
    rows = [(k, i, float(g), float(ll)) for k, (guess, loglik, _) in enumerate(filters.all_paths(parts, 3, rngs(), s)) for one, ll in zip(guess, loglik) for i, g in enumerate(one)]
    want = {(r.well, r.row_idx): (r.guess, r.spread) for r in tracking.ensemble(spark.createDataFrame(rows, "well long, row_idx long, guess double, loglik double"), "well", "row_idx", 8.0).collect()}
    got = {(k, i): (float(g), float(d)) for k, (guess, _, spread) in enumerate(filters.all_ensembles(parts, 3, rngs(), s)) for i, (g, d) in enumerate(zip(guess[0], spread[0]))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_single_paths_are_not_shuffled_again(spark):
    from sondeflow.plans import registry

    for name in ("pf_ensemble", "track_particles", "track_particles_slope", "track_restarted", "track_both_ways", "track_both_ways_gated"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")], name
