"""Blending predictions by their second moments, guards, selectors and smoothing after the fact.

Every blend is chosen from one aggregation: sums of products of components and target for each fold. Weights, errors at any weights,
nested folds, gates and hill climbing then are small matrix work on the driver, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sondeflow.operators.sequence import dealt


@dataclass
class Moments:
    """Sums over rows: x x', x y, y y, rows."""

    g: np.ndarray
    b: np.ndarray
    c: float
    n: float

    def __add__(self, o: "Moments") -> "Moments":
        return Moments(self.g + o.g, self.b + o.b, self.c + o.c, self.n + o.n)

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.g - o.g, self.b - o.b, self.c - o.c, self.n - o.n)

    def rmse(self, w: np.ndarray) -> float:
        """Error of the blend with these weights."""
        return float(np.sqrt(max(w @ self.g @ w - 2 * w @ self.b + self.c, 0.0) / self.n)) if self.n else float("nan")

    def nnls(self) -> np.ndarray:
        return nnls(self.g, self.b)

    def simplex(self) -> np.ndarray:
        return simplex(self.g, self.b)


def simplex(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights of least w'gw - 2w'b that are not negative and sum to 1, by an active set: solve on the free weights, stop at the first that would turn negative and hold it at
    0, and free the held one whose price is lowest, until none is below the free ones'. g: symmetric, not negative definite."""
    k = len(b)
    scale = max(float(np.abs(g).max(initial=0.0)), 1e-300)
    g, b = g / scale + 1e-12 * np.eye(k), b / scale
    start = int(np.argmin(np.diag(g) - 2 * b))
    w, free = np.eye(k)[start], np.eye(k, dtype=bool)[start]
    for _ in range(50 * k + 50):  # each support comes once at most; far more than any blend needs
        n = int(free.sum())
        kkt = np.zeros((n + 1, n + 1))
        kkt[:n, :n], kkt[:n, n], kkt[n, :n] = g[np.ix_(free, free)], 1.0, 1.0
        goal = np.zeros(k)
        solved = np.linalg.lstsq(kkt, np.append(b[free], 1.0), rcond=None)[0]
        goal[free] = solved[:n]
        if (goal[free] < -1e-12).any():
            back = np.flatnonzero(free & (goal < -1e-12))
            steps = w[back] / (w[back] - goal[back])
            w = w + steps.min() * (goal - w)
            hit = back[int(np.argmin(steps))]
            w[hit], free[hit] = 0.0, False
            continue
        w = goal
        price = g @ w - b
        held = np.flatnonzero(~free)
        if not len(held) or price[held].min() >= price[free].min() - 1e-10:
            break
        free[held[int(np.argmin(price[held]))]] = True
    w = np.maximum(w, 0.0)
    return w / w.sum()


def convex(per: dict[int, Moments], slack: float = 1e-6) -> tuple[np.ndarray, str]:
    """Weights of a blend from each fold's moments, and which: `best` (on the simplex, of least error) if they beat equal weights over all folds and are in no fold worse than the best
    component alone by more than `slack`, else `equal`."""
    whole = sum(per.values(), start=Moments(0.0, 0.0, 0.0, 0.0))
    k = len(whole.b)
    w, equal = whole.simplex(), np.full(k, 1.0 / k)
    alone = min(np.eye(k), key=whole.rmse)
    if whole.rmse(w) <= whole.rmse(equal) and all(m.rmse(w) <= m.rmse(alone) + slack for m in per.values()):
        return w, "best"
    return equal, "equal"


def moment_columns(components: list[str], target: Column) -> list[Column]:
    """Aggregates whose row `as_moments` reads."""
    k = len(components)
    x = [F.col(c) for c in components]
    g = [F.sum(x[i] * x[j]).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)]
    return g + [F.sum(x[i] * target).alias(f"b_{i}") for i in range(k)] + [F.sum(target * target).alias("c"), F.count(F.lit(1)).alias("n")]


def as_moments(row, k: int) -> Moments:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    return Moments(g, np.array([row[f"b_{i}"] for i in range(k)], float), float(row["c"]), float(row["n"]))


def moments(df: DataFrame, components: list[str], target: Column, fold: str = "fold") -> dict[int, Moments]:
    """Moments of each fold. Rows with a null among them must have been left out."""
    rows = df.groupBy(fold).agg(*moment_columns(components, target)).collect()
    return {r[fold]: as_moments(r, len(components)) for r in rows}


def nnls(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights >= 0 that minimise w G w / 2 - w b: an active set grows by the steepest coordinate and shrinks at the bounds."""
    k = len(b)
    w, active = np.zeros(k), np.zeros(k, bool)
    tol = 1e-10 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(10 * k + 10):
        slope = b - g @ w
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tol:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.zeros(k)
            z[at] = np.linalg.lstsq(g[np.ix_(at, at)], b[at], rcond=None)[0]
            if (z[at] > 0).all():
                w = z
                break
            bad = at[z[at] <= 0]
            step = np.min(w[bad] / np.maximum(w[bad] - z[bad], 1e-300))
            w = w + step * (z - w)
            active &= w > 1e-14
            w[~active] = 0.0
    return w


def nested(folds: dict[int, Moments], normalise: bool = False) -> tuple[dict[int, np.ndarray], float]:
    """For each fold the weights fitted on the others, and the error of each fold under its own, pooled."""
    whole = sum(folds.values(), start=Moments(0.0, 0.0, 0.0, 0.0))
    weights, sse = {}, 0.0
    for f, m in folds.items():
        w = (whole - m).nnls()
        weights[f] = w / w.sum() if normalise and w.sum() > 0 else w
        sse += m.rmse(weights[f]) ** 2 * m.n
    return weights, float(np.sqrt(sse / whole.n))


def consistent(folds: dict[int, Moments], first: int, chosen: list[int], least: int) -> bool:
    """Whether the equal blend of the chosen components beats the first one in at least `least` folds."""
    k = len(next(iter(folds.values())).b)
    a, b = np.zeros(k), np.zeros(k)
    a[first], b[chosen] = 1.0, 1.0 / len(chosen)
    return sum(m.rmse(b) < m.rmse(a) for m in folds.values()) >= least


def hill_climb(m: Moments, start: np.ndarray, steps: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Move one weight at a time by the step that lowers the error most, until none does."""
    steps = np.arange(-0.5, 0.51, 0.05) if steps is None else steps
    w, best = start.astype(float), m.rmse(start)
    for _ in range(rounds):
        tries = [(m.rmse(w + s * np.eye(len(w))[i]), i, s) for i in range(len(w)) for s in steps]
        e, i, s = min(tries)
        if e >= best - 1e-12:
            break
        w, best = w + s * np.eye(len(w))[i], e
    return w, best


def stability(weights: dict[int, np.ndarray], drop: float = 0.05) -> dict[str, np.ndarray]:
    """Mean, coefficient of variation over folds, and which components a parsimonious blend keeps."""
    w = np.array(list(weights.values()))
    mean = w.mean(axis=0)
    return {"mean": mean, "cv": np.where(mean > 0, w.std(axis=0) / np.where(mean > 0, mean, 1), np.inf), "kept": mean >= drop}


def predicted_board(error: float, gap: float = 1.40) -> float:
    """What a cross-validated error is likely to be elsewhere: less a fixed gap."""
    return error - gap


def gate(folds: dict[int, Moments], names: list[str], least: int = 4) -> list[dict]:
    """For each number of components, in the given order: in how many folds their equal blend beats the first one alone, and whether in `least`."""
    out = []
    k = len(names)
    for n in range(2, k + 1):
        chosen, alone = np.where(np.arange(k) < n, 1.0 / n, 0.0), np.where(np.arange(k) == 0, 1.0, 0.0)
        better = sum(m.rmse(chosen) < m.rmse(alone) for m in folds.values())
        out.append({"components": n, "last": names[n - 1], "better": better, "passes": better >= least})
    return out


def variant_parts(name: str) -> tuple[float, float, float]:
    """Scale, weight of the beam and weight of the anchor that a variant's name states, as pf_scale_8_beam_0.2_hold_0.1."""
    words = name.split("_")
    after = lambda word: float(words[words.index(word) + 1]) if word in words else 0.0
    return after("scale"), after("beam"), after("hold")


def by_variant(df: DataFrame, code: Column, variants: dict[int, str], default: str, by_scale: dict[float, str], beam: str, anchor: str) -> DataFrame:
    """`chosen`: of each row the filter's path of its variant's scale (columns by_scale), mixed with the beam's and then with the anchor as the variant says.
    Codes without a variant take the default; an unknown scale takes the default's."""

    def mixed(name: str) -> Column:
        scale, to_beam, to_anchor = variant_parts(name)
        path = F.col(by_scale.get(scale, by_scale[variant_parts(default)[0]]))
        both = (1 - to_beam) * path + to_beam * F.col(beam)
        return (1 - to_anchor) * both + to_anchor * F.col(anchor)

    out = mixed(default)
    for value, name in variants.items():
        out = F.when(code == value, mixed(name)).otherwise(out)
    return df.withColumn("chosen", out)


def regime_code(hidden: Column, span: Column, long: float, spans: list[float]) -> Column:
    """1 for long hidden parts, plus twice the number of bounds that the span reaches."""
    return (hidden > long).cast("int") + 2 * sum(((span >= b).cast("int") for b in spans), F.lit(0))


def ramp_grid(df: DataFrame, a: str, b: str, truth: str, md_since: str, weights: list[float], taus: list[float], alphas: list[float], fold: str) -> DataFrame:
    """Error, pooled (null fold) and by fold, for every weight of b, ramp length (0: none) and factor: alpha times the blend, led over to b by the ramp. Rows
    meet the grid where they arise and are summed there."""
    col = lambda n, v: F.explode(F.array(*(F.lit(float(x)) for x in v))).alias(n)
    grid = df.sparkSession.range(1).select(col("w", weights)).select("w", col("tau", taus)).select("*", col("alpha", alphas))
    both = df.crossJoin(F.broadcast(grid))
    t = F.when(F.col("tau") > 0, 1 - F.exp(-F.col(md_since) / F.col("tau"))).otherwise(F.lit(0.0))
    mix = (1 - F.col("w")) * F.col(a) + F.col("w") * F.col(b)
    e = F.col("alpha") * (mix * (1 - t) + F.col(b) * t) - F.col(truth)
    per = both.groupBy(fold, "w", "tau", "alpha").agg(F.sum(e * e).alias("sse"), F.count("*").alias("n"))
    g = per.groupingSets([[F.col("w"), F.col("tau"), F.col("alpha"), F.col(fold)], [F.col("w"), F.col("tau"), F.col("alpha")]], "w", "tau", "alpha", fold)
    return g.agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


def two_components(df: DataFrame, a: str, b: str, weight: float) -> tuple[DataFrame, DataFrame]:
    """The rows with `blend`, (1 - weight) a + weight b, and one row on how the components differ: mean, deviation, largest and 95th percentile of |a - b|."""
    d = F.abs(F.col(a) - F.col(b))
    out = df.withColumn("blend", (1 - weight) * F.col(a) + weight * F.col(b))
    return out, df.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.max(d).alias("most"), F.percentile(d, F.lit(0.95)).alias("p95"))


# The bounds of the guards.
def guard_rule(hidden: Column, delta: Column, dz: Column) -> Column:
    """Which guard a sequence falls under; the strictest wins."""
    return (
        F.when((hidden >= 8000) & (F.abs(delta) >= 30) & (dz <= -100), "full_anchor")
        .when(F.abs(delta) >= 60, "delta_extreme")
        .when((hidden >= 6000) & (F.abs(delta) >= 30), "strong")
        .when((hidden >= 5000) | (F.abs(delta) >= 20), "mild")
        .otherwise("none")
    )


def alpha_grid(df: DataFrame, truth: str, guess: str, anchor: str, alphas: list[float], keys: list[str]) -> DataFrame:
    """Error of (1 - alpha) guess + alpha anchor for every alpha and key, from three sums of one pass: the error is quadratic in alpha."""
    e, d = F.col(guess) - F.col(truth), F.col(anchor) - F.col(guess)
    s = df.groupBy(*keys).agg(F.sum(e * e).alias("ee"), F.sum(e * d).alias("ed"), F.sum(d * d).alias("dd"), F.count("*").alias("n"))
    a = F.col("alpha")
    out = s.withColumn("alpha", F.explode(F.array(*(F.lit(float(x)) for x in alphas))))
    return out.select(*keys, "alpha", F.sqrt(F.greatest(F.col("ee") + 2 * a * F.col("ed") + a * a * F.col("dd"), F.lit(0.0)) / F.col("n")).alias("rmse"))


def select_by_regime(df: DataFrame, variants: list[str], truth: str, regime: str, fold: str) -> DataFrame:
    """For each regime and fold the variant with the least error on the other folds (the first named of equals), and its error on this one."""
    err = [F.sum((F.col(v) - F.col(truth)) * (F.col(v) - F.col(truth))).alias(v) for v in variants]
    per = df.groupBy(regime, fold).agg(*err, F.count("*").alias("n"))
    long = per.select(regime, fold, "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("variant"), F.col(v).alias("sse")) for i, v in enumerate(variants)))).alias("v")).select(regime, fold, "n", "v.*")
    whole = long.groupBy(regime, "i").agg(F.sum("sse").alias("all_sse"))
    rest = long.join(whole, [regime, "i"]).withColumn("rest", F.col("all_sse") - F.col("sse"))
    best = F.min(F.struct(F.round("rest", 6).alias("r"), "i", "variant", "sse", "n"))
    return rest.groupBy(regime, fold).agg(best.alias("b")).select(regime, fold, F.col("b.variant").alias("variant"), F.sqrt(F.col("b.sse") / F.col("b.n")).alias("rmse"))


def fall_back(df: DataFrame, resid: str, known: str, key: str, guess: str, anchor: str, limit: float, share: float = 0.9) -> DataFrame:
    """The anchor in place of the guess for keys whose known residuals are wide: twice their quantile of the absolute value above `limit`."""
    wide = df.filter(known).groupBy(key).agg((2 * F.percentile(F.abs(resid), F.lit(share))).alias("__width"))
    return df.join(wide, key, "left").withColumn("final", F.when(F.col("__width") > limit, F.col(anchor)).otherwise(F.col(guess))).drop("__width")


def robust_polynomial(x: np.ndarray, y: np.ndarray, degree: int, fits: int = 4, centred: bool = True) -> np.ndarray:
    """Fitted values of a polynomial by iteratively reweighted least squares with Cauchy weights; the scale is the residuals' median deviation."""
    span = max(float(np.ptp(x)), 1e-9) if len(x) else 1.0
    v = np.vander((x - x.min()) / span if len(x) else x, min(degree, max(len(x) - 1, 0)) + 1)
    w, fit = np.ones(len(x)), y.astype(float)
    for _ in range(fits):
        coef = np.linalg.lstsq(v * w[:, None], y * w, rcond=None)[0]
        fit = v @ coef
        r = y - fit
        scale = 1.4826 * np.median(np.abs(r - (np.median(r) if centred else 0.0))) + 1e-9
        w = np.sqrt(1 / (1 + (r / (2.385 * scale)) ** 2))
    return fit


def projected(df: DataFrame, guess: str, z: str, anchor: str, md: str, key: str, degree: int = 4, beta: float = 0.75) -> DataFrame:
    """The guess pulled towards a robust polynomial of guess + z - anchor over md: one task for each key, `projected` added."""
    names = df.columns
    schema = StructType([*df.schema, StructField("projected", DoubleType())])

    def run(pdf):
        pdf = pdf.sort_values(md, kind="stable")
        u = (pdf[guess] + pdf[z] - pdf[anchor]).to_numpy(float)
        fit = robust_polynomial(pdf[md].to_numpy(float), u, degree)
        pdf["projected"] = (1 - beta) * pdf[guess] + beta * (fit - pdf[z] + pdf[anchor])
        return pdf[[*names, "projected"]]

    return dealt(df, key).groupBy(key).applyInPandas(run, schema)


def smoothing_errors(df: DataFrame, guess: str, truth: str, key: str, index: str, fold: str, widths: list[int], method: str = "mean") -> DataFrame:
    """Error by fold of the guess smoothed over several centred widths (0: as it is), from one pass: all windows share one order.

    method: mean or median over the window, or savgol, the value there of a parabola fitted to it (see windows.savgol).
    """
    from pyspark.sql.window import Window

    from sondeflow.operators.windows import savgol

    w = Window.partitionBy(key).orderBy(index)
    out = df
    for n in widths:
        frame = w.rowsBetween(-(n // 2), (n - 1) // 2)
        if n == 0:
            out = out.withColumn("__0", F.col(guess))
        elif method == "savgol":
            out = savgol(out, guess, f"__{n}", n, 2, key, index)
        else:
            out = out.withColumn(f"__{n}", F.avg(guess).over(frame) if method == "mean" else F.percentile(F.col(guess), F.lit(0.5)).over(frame))
    g = out.groupBy(fold).agg(*(F.sqrt(F.avg((F.col(f"__{n}") - F.col(truth)) * (F.col(f"__{n}") - F.col(truth)))).alias(f"__{n}") for n in widths))
    return g.select(fold, F.explode(F.array(*(F.struct(F.lit(n).alias("width"), F.col(f"__{n}").alias("rmse")) for n in widths))).alias("e")).select(fold, "e.*")


def smoothed_by_regime(df: DataFrame, guess: str, regime: str, widths: dict, key: str, index: str) -> DataFrame:
    """The guess under a centred mean whose width depends on the row's regime (0 or unknown: as it is)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(index)
    out = F.col(guess)
    for value, n in widths.items():
        if n:
            out = F.when(F.col(regime) == value, F.avg(guess).over(w.rowsBetween(-(n // 2), (n - 1) // 2))).otherwise(out)
    return df.withColumn("smoothed", out)


def weight_candidates(df: DataFrame, a: str, b: str, truth: str, weights: list[float]) -> DataFrame:
    """For each weight of b: error of the blend, and mean and largest absolute difference from a."""
    w = F.col("weight")
    out = df.select(a, b, truth, F.explode(F.array(*(F.lit(float(x)) for x in weights))).alias("weight"))
    mix = (1 - w) * F.col(a) + w * F.col(b)
    return out.groupBy("weight").agg(F.sqrt(F.avg((mix - F.col(truth)) * (mix - F.col(truth)))).alias("rmse"), F.avg(F.abs(mix - F.col(a))).alias("mean_moved"), F.max(F.abs(mix - F.col(a))).alias("most_moved"))
