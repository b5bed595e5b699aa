"""Tracking a sequence against a reference curve: nearest match, beams, Viterbi, particle filters, correlation.

Kernels are NumPy functions of one sequence and one curve; `tracked` runs one over all keys as a grouped map. Particle filters run one
task for each (key, seed), so a few long sequences still spread over the cluster, and give a log-likelihood with each path; any
temperature of the ensemble is then an aggregation, without running the filters again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.operators import sequence
from sondeflow.operators.windows import savgol_weights

# Bounds of a squared residual and of a likelihood.
MOST, FLOOR = 600.0, 1e-300


#: Rows of a curve that all keys share and that goes to every task.
MOST_KNOTS = 1_000_000


def tracked(rows: DataFrame, curve: DataFrame, kernel: Callable, key: str, index: str, gr: str, seeds: int = 1, spread: int = 1) -> DataFrame:
    """key, index, seed, guess, loglik. kernel(rows as a sorted pandas frame, knots x, knots y, rng) gives the guesses and a log-likelihood.

    rows: key, index, gr and what the kernel reads; curve: key, x, y (repeated x count by their mean), or x, y alone for one curve of all keys, of at most
    MOST_KNOTS rows. Keys without a curve give nothing. A task goes through the seeds of a key, so rows are shuffled once; where keys are few, `spread` deals
    the seeds over so many tasks a key. The generator is seeded by crc32 of seed and key, so a path does not depend on partitions.
    """
    cols = [key, index, "seed", "guess", "loglik"]

    def knots_of(right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        knots = right.dropna(subset=["x", "y"]).groupby("x")["y"].mean().sort_index()
        return knots.index.to_numpy(float), knots.to_numpy(float)

    def run(left: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        if left.empty or not len(x):
            return pd.DataFrame(columns=cols)
        left = left.sort_values(index, kind="stable").reset_index(drop=True)
        who, part, out = left[key].iloc[0], int(left["__part"].iloc[0]), []
        for seed in range(part, seeds, spread):
            guess, loglik = kernel(left, x, y, np.random.default_rng(zlib.crc32(f"{seed}:{who}".encode())))
            out.append(pd.DataFrame({key: left[key], index: left[index], "seed": seed, "guess": np.asarray(guess, float), "loglik": float(loglik)}))
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    kind = dict(rows.dtypes)
    schema = f"{key} {kind[key]}, {index} {kind[index]}, seed int, guess double, loglik double"
    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))) if spread > 1 else F.lit(0)
    dealt = rows.withColumn("__part", every)
    if key not in curve.columns:
        got = curve.select(F.col("x").cast("double"), F.col("y").cast("double")).limit(MOST_KNOTS + 1).toPandas()
        if len(got) > MOST_KNOTS:
            raise ValueError(f"a curve of all keys may have {MOST_KNOTS} rows")
        x, y = knots_of(got)
        return sequence.dealt(dealt, key, "__part").groupBy(key, "__part").applyInPandas(lambda left: run(left, x, y), schema)
    each = curve.select(F.col(key).alias("__key"), "x", "y", every.alias("__own"))
    sides = sequence.dealt(dealt, key, "__part").groupBy(key, "__part"), sequence.dealt(each, "__key", "__own").groupBy("__key", "__own")
    return sides[0].cogroup(sides[1]).applyInPandas(lambda left, right: run(left, *knots_of(right)), schema)


def ensemble(paths: DataFrame, key: str, index: str, scale: float) -> DataFrame:
    """Paths averaged with weights softmax(loglik / scale) over seeds."""
    from pyspark.sql.window import Window

    top = F.max("loglik").over(Window.partitionBy(key))
    w = F.exp((F.col("loglik") - top) / scale)
    return paths.withColumn("__w", w).groupBy(key, index).agg((F.sum(F.col("__w") * F.col("guess")) / F.sum("__w")).alias("guess"), F.stddev_pop("guess").alias("spread"))


def _filled(rows: pd.DataFrame, gr: str, level: float) -> np.ndarray:
    return rows[gr].interpolate(limit_direction="both").fillna(level).to_numpy(float)


def reader(parts: list, *values: list[np.ndarray]) -> Callable:
    """(who, at) to one array for each of `values`, lists of each key's y over its x: the keys' curves at their places, at having a row for each of `who`. The results are
    those of np.interp, bit for bit; places are finite or NaN. Where the knots of all keys lie about evenly, a place's knot is reckoned for all keys at once and set right by its neighbours."""
    sizes = [len(p.x) for p in parts]
    if not all(_even(p.x) and all(np.isfinite(y[k]).all() for y in values) for k, p in enumerate(parts)):

        def read(who: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
            out = [np.empty(at.shape) for _ in values]
            for j, k in enumerate(who.tolist()):
                for v, y in zip(out, values):
                    v[j] = np.interp(at[j], parts[k].x, y[k])
            return out

        return read

    # A piece before the first knot and one after the last, both level, stand about each key's own.
    width = max(sizes) + 1
    low, high = np.full((len(parts), width), -1e300), np.full((len(parts), width), np.inf)
    slope, level = np.zeros((len(values), len(parts), width)), np.zeros((len(values), len(parts), width))
    for k, (p, n) in enumerate(zip(parts, sizes)):
        low[k, 1 : n + 1] = high[k, :n] = p.x
        for v, y in enumerate(values):
            slope[v, k, 1:n], level[v, k, 0], level[v, k, 1 : n + 1] = np.diff(y[k]) / np.diff(p.x), y[k][0], y[k]
    low, high, slope, level = low.ravel(), high.ravel(), slope.reshape(len(values), -1), level.reshape(len(values), -1)
    scale = np.array([(n - 1) / (p.x[-1] - p.x[0]) for p, n in zip(parts, sizes)])[:, None, None]
    start = np.array([p.x[0] for p in parts])[:, None, None] - 1.0 / scale
    last, first = np.array(sizes, float)[:, None, None], (np.arange(len(parts)) * width)[:, None, None]

    def read(who: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        own = slice(0, len(who)) if len(who) and who[-1] == len(who) - 1 else who
        t = at - start[own]
        t *= scale[own]
        np.maximum(t, 0.0, out=t)
        np.minimum(t, last[own], out=t)
        with np.errstate(invalid="ignore"):  # a place without a number has a value without one
            piece = t.astype(np.intp)
        piece += first[own]
        for _ in range(3):  # at most two off, counting what rounding does
            began = low.take(piece, mode="clip", out=t)
            off, over = at < began, at >= high.take(piece, mode="clip")
            if not (off.any() or over.any()):
                break
            piece += over
            piece -= off
        d = np.subtract(at, began, out=t)
        out = []
        for a, b in zip(slope, level):
            v = a.take(piece, mode="clip")
            v *= d
            v += b.take(piece, mode="clip")
            out.append(v)
        return out

    return read


def _even(x: np.ndarray) -> bool:
    """True where a place's knot, reckoned from the first and the last, is at most one off."""
    if len(x) < 2 or not np.isfinite(x).all():
        return False
    step = (x[-1] - x[0]) / (len(x) - 1)
    return step > 0 and bool((np.abs(x - x[0] - step * np.arange(len(x))) < step).all())


def _rows_of(values: list[np.ndarray]) -> np.ndarray:
    """Arrays of several lengths, the longest first, as (places, arrays, 1, 1)."""
    out = np.zeros((max(map(len, values)), len(values), 1, 1))
    for k, v in enumerate(values):
        out[: len(v), k, 0, 0] = v
    return out


# Emissions: log-likelihoods at row i of some keys (`who`) at places (keys, clouds, particles), for parts with gr, a curve x, y and a scale.


def _gaussian(parts: list) -> Callable:
    g, read, sigma = _rows_of([p.gr for p in parts]), reader(parts, [p.y for p in parts]), np.array([p.scale for p in parts])[:, None, None]

    def score(i: int, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        (v,) = read(who, at)
        np.subtract(g[i, who], v, out=v)
        v /= sigma[who]
        v *= v
        np.minimum(v, MOST, out=v)
        v *= -0.5
        return v

    return score


def _with_slope(parts: list, weights: tuple[float, float] = (1.0, 0.5)) -> Callable:
    """Standardised level, and slope against slope."""
    z = lambda v: (v - v.mean()) / (v.std() + 1e-9)
    a = _rows_of([z(p.gr) for p in parts])
    da = _rows_of([z(np.gradient(p.gr)) if len(p.gr) > 1 else np.zeros(len(p.gr)) for p in parts])
    b = [z(p.y) for p in parts]
    db = [z(np.gradient(p.y, p.x)) if len(p.y) > 1 else np.zeros(len(p.y)) for p in parts]
    read = reader(parts, b, db)

    def score(i: int, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        v, dv = read(who, at)
        return -0.5 * np.minimum(weights[0] * (a[i, who] - v) ** 2 + weights[1] * (da[i, who] - dv) ** 2, MOST)

    return score


def _correlated(parts: list, half: int = 10, sharp: float = 4.0, mix: float = 0.6) -> Callable:
    """A share of windowed correlation with the curve and the rest of the plain residual."""
    wins = []
    for p in parts:
        win = np.lib.stride_tricks.sliding_window_view(np.pad(p.gr, half, mode="edge"), 2 * half + 1)
        wins.append(win - win.mean(axis=1, keepdims=True))
    norm = _rows_of([np.sqrt((win**2).sum(axis=1)) + 1e-9 for win in wins])
    y, plain, steps = [p.y for p in parts], _gaussian(parts), np.arange(-half, half + 1)
    alike = np.full(len(steps), 1.0 / len(steps))

    def score(i: int, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        ncc = np.empty(at.shape)
        for j, k in enumerate(who.tolist()):  # a key's windows at a time, which stay in cache
            want = np.interp(at[j][..., None] + steps, parts[k].x, y[k])
            want -= (want @ alike)[..., None]
            ncc[j] = want @ wins[k][i] / (np.sqrt(np.einsum("...i,...i", want, want)) + 1e-9)
        return mix * sharp * (ncc / norm[i, who] - 1) + (1 - mix) * plain(i, who, at)

    return score


SCORES = {"gaussian": _gaussian, "slope": _with_slope, "correlation": _correlated}


def agreed(forward: np.ndarray, backward: np.ndarray, limit: float) -> np.ndarray:
    """True where two filters' paths lie within the limit of each other."""
    return np.abs(forward - backward) <= limit


def of_candidates(paths: DataFrame, key: str, index: str, candidate: str, own: str, bias: float = 2.0, scale: float = 16.0) -> DataFrame:
    """Paths on several candidate curves averaged by softmax of likelihood over `scale`, the key's own curve (a boolean column) favoured by `bias`."""
    return ensemble(paths.withColumn("loglik", F.col("loglik") + F.when(F.col(own), F.lit(bias * scale)).otherwise(F.lit(0.0))), key, index, scale)


def two_way(forward: np.ndarray, backward: np.ndarray, var_f: np.ndarray, var_b: np.ndarray) -> np.ndarray:
    """Mean of two filters' paths by inverse variance."""
    a, b = 1 / np.maximum(var_f, 1e-9), 1 / np.maximum(var_b, 1e-9)
    return (a * forward + b * backward) / (a + b)


def viterbi(gr: str = "gr", start: str = "start", reach: float = 25.0, states: int = 51, sigma: float = 20.0, step: float = 1.0, drift: str | None = None) -> Callable:
    """Best path over a grid around the start: squared gamma residual and squared moves, each over its scale; the first of equals.

    drift names a column whose steps are the moves expected between rows (none by default).
    """

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        grid = rows[start].iloc[0] + np.linspace(-reach, reach, states)
        want = np.interp(grid, x, y)
        g = _filled(rows, gr, float(y.mean()))
        expected = np.diff(rows[drift].to_numpy(float)) if drift else np.zeros(max(len(rows) - 1, 0))
        gap = grid[None, :] - grid[:, None]
        cost, back = ((g[0] - want) / sigma) ** 2 / 2 + ((grid - rows[start].iloc[0]) / step) ** 2 / 2, []
        for v, e in zip(g[1:], expected):
            all_ = cost[:, None] + ((gap - e) / step) ** 2 / 2
            back.append(all_.argmin(axis=0))
            cost = all_.min(axis=0) + ((v - want) / sigma) ** 2 / 2
        at = [int(cost.argmin())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        return grid[at[::-1]], -float(cost.min())

    return run


def _beams(g: np.ndarray, y: np.ndarray, first: int, width: np.ndarray, moves: int, emission: np.ndarray, move_cost: np.ndarray, trace_back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places among the knots for several beams side by side, (beams, rows), each with its own g, width and scales, and their costs: costs of all knots in one array, those
    outside a beam infinite. Of equal costs the lower knot is kept, and the lower one before it."""
    beams, n = len(g), len(y)
    steps = np.arange(moves, -moves - 1, -1)  # from the lowest knot before to the highest
    padded = np.full((beams, n + 2 * moves), np.inf)
    cost = padded[:, moves : moves + n]
    cost[:, first] = 0.0
    before = np.lib.stride_tricks.sliding_window_view(padded, n, axis=1)  # (beams, steps, knots), as seen from each knot
    fixed, most = move_cost[:, None, None] * np.abs(steps)[:, None], int(width.max())
    some = n > int(width.min())
    kept_of = np.arange(min(most, n)) < width[:, None]
    links, heads = np.empty((g.shape[1], beams, n), np.int8), np.empty((g.shape[1], beams), np.int64)
    for i in range(g.shape[1]):
        miss = (g[:, i, None] - y) ** 2 / emission[:, None]
        tries = (before + miss[:, None]) + fixed
        links[i] = tries.argmin(axis=1)
        best = tries.min(axis=1)
        if some:
            kept = best.argsort(axis=1, kind="stable")[:, :most]
            cost[:] = np.inf
            np.put_along_axis(cost, kept, np.where(kept_of, np.take_along_axis(best, kept, 1), np.inf), 1)
        else:
            cost[:] = best
        heads[i] = cost.argmin(axis=1)
    total = cost.min(axis=1, initial=np.inf)
    if not trace_back or not len(heads):
        return heads.T, total
    at, path, each = heads[-1], np.empty_like(heads), np.arange(beams)
    for i in range(len(heads) - 1, -1, -1):
        path[i] = at
        at = at - steps[links[i, each, at]]
    return path.T, total


def beam(gr: str = "gr", start: str = "start", width: int = 8, moves: int = 2, emission: float = 400.0, move_cost: float = 0.5, trace_back: bool = True, smooth: str | None = None, radius: int = 0) -> Callable:
    """Beam over knots with moves of a few knots, from the knot nearest to the start. With trace_back the best final path; else the best head at each row.

    smooth: gr first goes through a parabola (savgol) or a mean over 2 radius + 1 rows.
    """

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g = _smoothed(_filled(rows, gr, float(y.mean())), smooth, radius)
        at, cost = _beams(g[None], y, int(np.abs(x - rows[start].iloc[0]).argmin()), np.array([width]), moves, np.array([emission]), np.array([move_cost]), trace_back)
        return x[at[0]], -float(cost[0])

    return run


def _smoothed(g: np.ndarray, smooth: str | None, radius: int) -> np.ndarray:
    if smooth == "savgol":
        return savgol_of(g, radius)
    if smooth == "mean" and radius:
        return pd.Series(g).rolling(2 * radius + 1, center=True, min_periods=1).mean().to_numpy()
    return g


def savgol_of(v: np.ndarray, radius: int, degree: int = 2) -> np.ndarray:
    """Savitzky-Golay smoothing over 2 radius + 1 values, with the polynomials of the first and last window at the ends; short or odd requests leave the values."""
    width = 2 * radius + 1
    if radius < 1 or len(v) <= max(3, width):
        return v
    weights = savgol_weights(width, min(degree, width - 1))
    out = np.convolve(v, weights[radius][::-1], "valid")
    return np.concatenate((weights[:radius] @ v[:width], out, weights[radius + 1 :] @ v[-width:]))


# Beam width, cost of a move, scale of the squared residual, and radius of the smoothing of each beam.
BEAMS = (
    (10, 20.0, 144.0, 2), (10, 8.0, 64.0, 2), (8, 35.0, 220.0, 1), (10, 14.0, 90.0, 5), (20, 4.0, 36.0, 3), (12, 12.0, 100.0, 3), (15, 25.0, 180.0, 2),
    (20, 30.0, 200.0, 2), (15, 10.0, 80.0, 4), (25, 6.0, 50.0, 3), (10, 40.0, 300.0, 1), (12, 18.0, 120.0, 5), (30, 8.0, 70.0, 2), (10, 50.0, 400.0, 0),
)


def mean_beam(gr: str = "gr", start: str = "start", beams: tuple = BEAMS, trace_back: bool = False, smooth: str = "savgol") -> Callable:
    """The mean of several beams' paths, which are sought side by side."""
    width, move_cost, scale, radius = (np.array(v) for v in zip(*beams))

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g = _filled(rows, gr, float(y.mean()))
        of = {r: _smoothed(g, smooth, r) for r in set(radius.tolist())}
        first = int(np.abs(x - rows[start].iloc[0]).argmin())
        at, cost = _beams(np.stack([of[r] for r in radius.tolist()]), y, first, width, 2, scale, move_cost, trace_back)
        return np.mean(x[at], axis=0), float(np.mean(-cost))

    return run


def nearest_match(gr: str = "gr", start: str = "start", reach: float = 25.0, width: int = 1) -> Callable:
    """At each row by itself the knot within reach of the start whose value is nearest (the lower of equals), then a centred mean over `width` rows."""

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g, at = _filled(rows, gr, float(y.mean())), float(rows[start].iloc[0])
        miss = np.where(np.abs(x - at) <= reach, np.abs(g[:, None] - y), np.inf)
        best = miss.argmin(axis=1)
        found = np.where(np.isfinite(miss.min(axis=1)), x[best], at)
        smooth = pd.Series(found).rolling(width, center=True, min_periods=1).mean().to_numpy() if width > 1 else found
        return smooth, -float(np.where(np.isfinite(miss.min(axis=1)), miss.min(axis=1), 0.0).sum())

    return run


def self_correlated(rows: DataFrame, key: str, index: str, gr: str = "gr", given: str = "tvt_input", halves: tuple[int, ...] = (8, 15, 25), stride: int = 3, sharp: float = 3.0) -> DataFrame:
    """Hidden rows matched with the key's own known part: key, index, at_<half> and score_<half> for each half-width, and guess, their mean weighted by softmax(sharp
    score). A window of smoothed gr is compared, by correlation, with every stride-th window of the known part; the target at the middle of the best one
    counts (the first of equals). A known part shorter than a window gives the last known target and a score of 0."""
    names = [n for h in halves for n in (f"at_{h}", f"score_{h}")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, kind="stable")
        known, hidden = pdf[pdf[given].notna()], pdf[pdf[given].isna()]
        out = pd.DataFrame({key: hidden[key], index: hidden[index]})
        if hidden.empty or known.empty:
            return out.assign(**{n: np.nan for n in names}, guess=np.nan)
        g = pdf[gr].interpolate(limit_direction="both").fillna(0.0)
        mean5 = lambda rows_: g.loc[rows_.index].rolling(5, center=True, min_periods=1).mean().to_numpy(float)
        a, b, t = mean5(known), mean5(hidden), known[given].to_numpy(float)
        for half in halves:
            at, score = self_matches(a, t, b, half, stride)
            out[f"at_{half}"], out[f"score_{half}"] = at, score
        w = np.exp(sharp * out[[f"score_{h}" for h in halves]].to_numpy())
        out["guess"] = (w * out[[f"at_{h}" for h in halves]].to_numpy()).sum(axis=1) / w.sum(axis=1)
        return out

    kind = dict(rows.dtypes)
    schema = f"{key} {kind[key]}, {index} {kind[index]}, " + ", ".join(f"{n} double" for n in names) + ", guess double"
    return sequence.dealt(rows.select(key, index, gr, given), key).groupBy(key).applyInPandas(run, schema)


#: Sums of products that are held at once, in self_matches.
CELLS = 1 << 21


def _window_moments(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of every window, some windows at a time; 0 for the deviation of windows that do not vary."""
    windows = np.lib.stride_tricks.sliding_window_view(v, width)
    mean, std = np.empty(len(windows)), np.empty(len(windows))
    step = max(1, CELLS // width)
    for a in range(0, len(windows), step):
        part = windows[a : a + step]
        mean[a : a + step], std[a : a + step] = part.mean(axis=1), np.where(np.ptp(part, axis=1) > 0, part.std(axis=1), 0.0)
    return mean, std


def self_matches(known: np.ndarray, target: np.ndarray, hidden: np.ndarray, half: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For each hidden value the target at the middle of the known window that correlates best with the window around it, and the correlation.

    The products of a hidden window with all known ones are one transform of the known values, multiplied by the window's and turned back; a block of hidden windows is done at
    once, so memory grows with the sequence and time hardly with the window.
    """
    width = 2 * half + 1
    if len(known) < width + 1:
        return np.full(len(hidden), target[-1]), np.zeros(len(hidden))
    around = np.pad(hidden, half, mode="edge")
    known_std = _window_moments(known, width)[1][::stride]
    mean, std = _window_moments(around, width)
    size = 1 << (len(known) - 1).bit_length()
    spectrum = np.fft.rfft(known - known.mean(), size)
    windows = np.lib.stride_tricks.sliding_window_view(around, width)
    best, score = np.empty(len(hidden), np.int64), np.empty(len(hidden))
    step = max(1, CELLS // size)
    for a in range(0, len(hidden), step):
        own = windows[a : a + step] - mean[a : a + step, None]  # sums to 0, so the known windows' means drop out
        products = np.fft.irfft(spectrum * np.conj(np.fft.rfft(own, size, axis=1)), size, axis=1)[:, : len(known) - width + 1 : stride]
        r = np.where(known_std > 0, products / width / ((std[a : a + step, None] + 1e-6) * (known_std + 1e-6)), 0.0)
        best[a : a + step] = np.round(r, 9).argmax(axis=1)
        score[a : a + step] = r[np.arange(len(r)), best[a : a + step]]
    return target[best * stride + half], score


def greedy_match(gr: str = "gr", start: str = "start", reach: float = 25.0, stay: float = 0.15) -> Callable:
    """At each row the knot near the last one with the least gamma residual and distance."""

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g, at, out, total = _filled(rows, gr, float(y.mean())), float(rows[start].iloc[0]), [], 0.0
        for v in g:
            cost = np.where(np.abs(x - at) <= reach, np.abs(y - v) + stay * np.abs(x - at), np.inf)
            k = int(cost.argmin())
            if np.isfinite(cost[k]):
                at, total = float(x[k]), total - float(cost[k])
            out.append(at)
        return np.array(out), total

    return run


def correlation_match(gr: str = "gr", start: str = "start", halves: tuple[int, ...] = (8, 15, 25), reach: float = 25.0, step: float = 0.5, sharp: float = 3.0) -> Callable:
    """Best normalised correlation of windows of several half-widths with the curve around the start, averaged by softmax of the scores."""

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g, n = _filled(rows, gr, float(y.mean())), len(rows)
        centre = rows[start].iloc[0] + np.arange(-reach, reach + step / 2, step)
        guess, score = np.zeros((len(halves), n)), np.full((len(halves), n), -1.0)
        for h, half in enumerate(halves):
            want = np.interp(centre[:, None] + np.arange(-half, half + 1)[None, :], x, y)
            want = want - want.mean(axis=1, keepdims=True)
            norm = np.sqrt((want**2).sum(axis=1)) + 1e-9
            padded = np.pad(g, half, mode="edge")
            win = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
            win = win - win.mean(axis=1, keepdims=True)
            ncc = (win @ want.T) / (np.sqrt((win**2).sum(axis=1)) + 1e-9)[:, None] / norm[None, :]
            k = ncc.argmax(axis=1)
            guess[h], score[h] = centre[k], ncc[np.arange(n), k]
        w = np.exp(sharp * score)
        return (w * guess).sum(axis=0) / w.sum(axis=0), float(score.mean())

    return run


def refine(gr: str = "gr", centre: str = "start", half: int = 10, reach: float = 10.0, step: float = 0.5) -> Callable:
    """Around a given path, at each row the shift with the least mean squared residual over a window of rows; the smallest shift of equals."""

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g, path = _filled(rows, gr, float(y.mean())), rows[centre].to_numpy(float)
        shifts = np.array(sorted(np.arange(-reach, reach + step / 2, step), key=abs))
        cost = (g[:, None] - np.interp(path[:, None] + shifts[None, :], x, y)) ** 2
        total = np.concatenate((np.zeros((1, len(shifts))), np.cumsum(cost, axis=0)))
        lo, hi = np.maximum(np.arange(len(g)) - half, 0), np.minimum(np.arange(len(g)) + half + 1, len(g))
        mean = (total[hi] - total[lo]) / (hi - lo)[:, None]
        k = np.round(mean, 9).argmin(axis=1)
        return path + shifts[k], -float(mean[np.arange(len(g)), k].mean())

    return run


def hybrid_beam(gr: str = "gr", start: str = "start", width: int = 20, reach: float = 50.0, states: int = 61, sigma: float = 20.0, mix: float = 0.6, dip: float = 0.05, rate: float = 0.0, constant: bool = False) -> Callable:
    """A beam over places around the start whose emission mixes how near gr lies to the curve, exp(-|residual| / 2 sigma), with how its shape follows the curve, half of one plus
    the mean correlation of windows of 3, 5 and 7 rows with the curve read around the place; moves cost dip (move - rate)^2 in the log.

    constant: the best final place stands for all rows.
    """

    def run(rows: pd.DataFrame, x: np.ndarray, y: np.ndarray, rng) -> tuple[np.ndarray, float]:
        g, at = _filled(rows, gr, float(y.mean())), float(rows[start].iloc[0])
        grid = np.linspace(max(x[0], at) - reach, min(x[-1], at) + reach, states) if max(x[0], at) - reach < min(x[-1], at) + reach else at + np.linspace(-reach, reach, states)
        near, alike = np.exp(-np.abs(g[:, None] - np.interp(grid, x, y)) / (2 * sigma)), []
        for half in (1, 2, 3):
            own = np.lib.stride_tricks.sliding_window_view(np.pad(g, half, mode="edge"), 2 * half + 1)
            want = np.interp(grid[:, None] + np.arange(-half, half + 1), x, y)
            own, want = (v - v.mean(axis=1, keepdims=True) for v in (own, want))
            alike.append(own @ want.T / (np.linalg.norm(own, axis=1)[:, None] * np.linalg.norm(want, axis=1) + 1e-9))
        log = np.log(np.maximum(mix * near + (1 - mix) * 0.5 * (1 + np.mean(alike, axis=0)), FLOOR))
        move = -dip * (grid[None, :] - grid[:, None] - rate) ** 2
        score, links = log[0] - dip * (grid - at - rate) ** 2, []
        for e in log[1:]:
            if states > width:
                score = np.where(score >= np.sort(score)[-width], score, -np.inf)
            tries = score[:, None] + move
            links.append(tries.argmax(axis=0))
            score = tries.max(axis=0) + e
        path = [int(score.argmax())]
        for best in reversed(links):
            path.append(int(best[path[-1]]))
        found = grid[path[::-1]]
        return (np.full(len(g), found[-1]) if constant else found), float(score.max())

    return run


# The low-pass filter of the Daubechies wavelet of two moments.
DB2 = (0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145)


def emission_scores(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """How well a stretch of gr fits a stretch of curve: squared error, correlation, correlation of slopes, mean phase agreement (analytic signals
    by FFT), distance of wavelet approximations, and the distance between the sorted values."""
    z = lambda v: (v - v.mean()) / (v.std() + 1e-9)

    def phase(v: np.ndarray) -> np.ndarray:
        f = np.fft.fft(v - v.mean())
        h = np.zeros(len(v))
        h[0] = 1
        h[1 : (len(v) + 1) // 2] = 2
        if len(v) % 2 == 0:
            h[len(v) // 2] = 1
        return np.angle(np.fft.ifft(f * h))

    def smooth(v: np.ndarray) -> np.ndarray:
        """Approximation of one step of the Daubechies wavelet of two moments, round the ends."""
        return sum(c * np.roll(v, -k) for k, c in enumerate(DB2))[::2]

    return {
        "wavelet": float(np.sqrt(((smooth(z(a)) - smooth(z(b))) ** 2).sum())),
        "sse": float(((a - b) ** 2).sum()), "ncc": float((z(a) * z(b)).mean()), "slope": float((z(np.gradient(a)) * z(np.gradient(b))).mean()),
        "phase": float(np.cos(phase(a) - phase(b)).mean()), "sorted": float(np.abs(np.sort(a) - np.sort(b)).mean()),
    }


def offset_search(rows: DataFrame, gr: str, guess: Callable, offsets: list[float], segments: int, penalty: float, key: str, index: str, least: int = 8) -> DataFrame:
    """For each key and each of `segments` equal parts of its rows, the offset with the least mean absolute residual plus penalty * offset^2 (the first of
    equals). guess(offset column) is the curve along the prior path moved by the offset; parts with fewer than `least` rows of gr have offset 0."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key)
    part = F.floor((F.row_number().over(w.orderBy(index)) - 1) * segments / F.count(F.lit(1)).over(w))
    out = rows.withColumn("part", part).select("*", F.posexplode(F.array(*(F.lit(float(o)) for o in offsets))).alias("__k", "offset"))
    cost = F.avg(F.abs(F.col(gr) - guess(F.col("offset")))) + penalty * F.first("offset") * F.first("offset")
    per = out.groupBy(key, "part", "__k", "offset").agg(cost.alias("cost"), F.count(gr).alias("n"))
    best = per.groupBy(key, "part").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "__k", "offset")).alias("b"), F.max("n").alias("n"))
    return best.select(key, "part", "n", F.when(F.col("n") >= least, F.col("b.offset")).otherwise(F.lit(0.0)).alias("offset"))


def median_filter(values: np.ndarray, width: int) -> np.ndarray:
    """Running median with the end values repeated beyond the ends."""
    padded = np.pad(values, (width // 2, (width - 1) // 2), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)


def low_pass_extrapolated(values: np.ndarray, ahead: int, share: float = 0.2) -> np.ndarray:
    """`ahead` values that go on along the line through the low-passed ones."""
    smooth = low_pass(values, share)
    slope, base = np.polyfit(np.arange(len(values)), smooth, 1) if len(values) > 1 else (0.0, float(smooth[0]))
    return base + slope * np.arange(len(values), len(values) + ahead)


def low_pass(values: np.ndarray, share: float = 0.2) -> np.ndarray:
    """The lowest max(2, floor(share n)) frequencies."""
    f = np.fft.rfft(values)
    f[max(2, int(len(values) * share)) :] = 0
    return np.fft.irfft(f, len(values))
