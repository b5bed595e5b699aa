"""Cross-validated models with MLlib, and grids of parameters in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.operators import boosting
from sondeflow.sources.staging import staged


def assembled(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """df with `features` as one vector (nulls as NaN) and, with a target, `label` without nulls."""
    from pyspark.ml.feature import VectorAssembler

    if target is not None:
        df = df.withColumn("label", F.col(target).cast("double")).na.drop(subset=["label"])
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def fold_models(df: DataFrame, features: list[str], target: str, fold: str, make=None) -> dict:
    """A model for each fold, fitted on the others. Rows with aug_k (if there) other than -1 train but are no one's held-out rows.

    make() gives an MLlib estimator over `features` and `label`; gradient-boosted trees by default. An estimator with a validation column (see boosted) stops early on
    every tenth training row by hash. Folds are few, so they are a loop.
    """
    with _kept(df, features, target) as ready:
        return _of_folds(ready, fold, make or boosted)


@contextmanager
def _kept(df: DataFrame, features: list[str], target: str) -> Iterator[DataFrame]:
    """The assembled rows, of which every tenth is marked `held`, computed once for all that is done with them."""
    ready = assembled(df, features, target).withColumn("held", F.pmod(F.xxhash64(*features, "label"), F.lit(10)) == 0).cache()
    try:
        yield ready
    finally:
        ready.unpersist()


def _of_folds(ready: DataFrame, fold: str, make) -> dict:
    return {f: make().fit(ready.filter(F.col(fold) != f)) for f in sorted(r[fold] for r in ready.select(fold).distinct().collect())}


def out_of_fold(df: DataFrame, models: dict, features: list[str], target: str, fold: str, keep: list[str]) -> DataFrame:
    """Each fold's rows as its model, which has not seen them, predicts them: keep, fold, target, guess."""
    return _side_by_side(assembled(df, features, target), {"guess": models}, target, fold, keep)


def _side_by_side(ready: DataFrame, learners: dict[str, dict], target: str, fold: str, keep: list[str]) -> DataFrame:
    """out_of_fold of several learners' models by fold, a column each, in one pass over the assembled rows."""
    ready = ready.filter("aug_k = -1") if "aug_k" in ready.columns else ready
    out = None
    for f in next(iter(learners.values())):
        part = ready.filter(F.col(fold) == f)
        for k, models in enumerate(learners.values()):
            part = models[f].transform(part).withColumnRenamed("prediction", f"__p{k}").drop("probability", "rawPrediction")
        part = part.select(*keep, fold, F.col("label").alias(target), *(F.col(f"__p{k}").alias(name) for k, name in enumerate(learners)))
        out = part if out is None else out.union(part)
    return out


def cross_validated(df: DataFrame, features: list[str], target: str, fold: str, keep: list[str], make=None) -> DataFrame:
    """Out-of-fold predictions: for each fold a model fitted on the others (see fold_models)."""
    return staged(out_of_fold(df, fold_models(df, features, target, fold, make), features, target, fold, keep))


def averaged(df: DataFrame, models: list, features: list[str], keep: list[str]) -> DataFrame:
    """keep and guess, the mean of the models' predictions: for rows that no model has seen, or a family of stored models (see stored)."""
    out, names = assembled(df, features), [f"__p{k}" for k in range(len(models))]
    for n, m in zip(names, models):
        out = m.transform(out).withColumnRenamed("prediction", n)
        out = out.drop(*(c for c in out.columns if c in ("probability", "rawPrediction")))
    return out.select(*keep, (sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).alias("guess"))


def stored(path: str) -> list:
    """Models that MLlib wrote under path/0, path/1, ..., in that order: what save_all wrote."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    from sondeflow.operators.validation import present_files

    spark, out = SparkSession.getActiveSession(), []
    while present_files(spark, [f"{path}/{len(out)}"])[f"{path}/{len(out)}"]:
        out.append(DefaultParamsReader.loadParamsInstance(f"{path}/{len(out)}", spark.sparkContext))
    return out


def save_all(models: list, path: str) -> None:
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{k}")


def importances(models: dict, features: list[str], spark) -> DataFrame:
    """feature, importance: the mean over the folds' models of what their trees gain by it, summing to 1."""
    rows = [(n, float(sum(m.featureImportances[i] for m in models.values()) / len(models))) for i, n in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def boosted(trees: int = 20, depth: int = 4, rate: float = 0.1):
    """Gradient-boosted trees that stop once the error on the rows marked `held` does not fall any more."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=42, validationIndicatorCol="held", validationTol=0.001)


def leafwise(**change):
    """Boosting leaf by leaf (see boosting); `change`: fields of boosting.Growth."""
    return boosting.Estimator(boosting.leafwise(**change))


def levelwise(**change):
    return boosting.Estimator(boosting.levelwise(**change))


def alike(**change):
    return boosting.Estimator(boosting.alike(**change))


def forest(trees: int = 10, depth: int = 6):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=42)


def on_residual(df: DataFrame, base: str, features: list[str], target: str, fold: str, keep: list[str], makes: list | None = None) -> DataFrame:
    """What a base prediction leaves, learnt out of fold by one or several learners and averaged: keep, fold, target, base and guess = base + residual."""
    rows = staged(df.withColumn("__left", F.col(target) - F.col(base)))
    parts = None
    for k, make in enumerate(makes or [boosted]):
        part = out_of_fold(rows, fold_models(rows, features, "__left", fold, make), features, "__left", fold, [*keep, target, base])
        part = part.select(*keep, fold, target, base, F.col("guess").alias(f"__g{k}"))
        parts = part if parts is None else parts.join(part.select(*keep, f"__g{k}"), keep)
    n = len(makes or [boosted])
    mean = sum((F.col(f"__g{k}") for k in range(1, n)), F.col("__g0")) / n
    return staged(parts.withColumn("guess", F.col(base) + mean).drop(*(f"__g{k}" for k in range(n))))


def blended(df: DataFrame, features: list[str], target: str, fold: str, keep: list[str], makes: dict) -> tuple[DataFrame, dict[str, float], str]:
    """Out-of-fold predictions of several learners, a column each, and `guess`, their blend; the weights, and which they are (see blending.convex): those of least error on the
    simplex, or equal ones where a fold speaks against them."""
    from sondeflow.operators import blending as B

    names = list(makes)
    with _kept(df, features, target) as ready:
        learners = {name: _of_folds(ready, fold, make) for name, make in makes.items()}
        out = staged(_side_by_side(ready, learners, target, fold, keep))
    w, which = B.convex(B.moments(out, names, F.col(target), fold))
    guess = sum((float(c) * F.col(n) for c, n in zip(w[1:], names[1:])), float(w[0]) * F.col(names[0]))
    return out.withColumn("guess", guess), dict(zip(names, map(float, w))), which


def many_targets(df: DataFrame, features: list[str], targets: list[str], fold: str, keep: list[str], make=None) -> DataFrame:
    """Out-of-fold predictions of several targets, a column guess_<target> each."""
    out = None
    for t in targets:
        part = cross_validated(df, features, t, fold, keep, make).select(*keep, F.col("guess").alias(f"guess_{t}"))
        out = part if out is None else out.join(part, keep)
    return out


def linear():
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol="label", regParam=1e-6)


def grid_errors(df: DataFrame, guess, truth: str, grid: dict[str, list[float]], keys: list[str]) -> DataFrame:
    """Error for every combination of parameters in one pass: guess(struct of parameters) gives a column. Rows times combinations never shuffle:
    they are summed where they arise."""
    combos = None
    for name, values in grid.items():
        col = F.explode(F.array(*(F.lit(float(v)) for v in values))).alias(name)
        combos = df.sparkSession.range(1).select(col) if combos is None else combos.select("*", col)
    both = df.crossJoin(F.broadcast(combos))
    e = guess(both) - F.col(truth)
    return both.groupBy(*keys, *grid).agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def trial_errors(df: DataFrame, guess, truth: str, trials: list[dict[str, float]]) -> list[float]:
    """The error of each set of parameters, all in one pass: rows times trials are summed where they arise."""
    names = sorted(trials[0])
    sets = df.sparkSession.createDataFrame([(k, *(float(t[n]) for n in names)) for k, t in enumerate(trials)], "__trial int, " + ", ".join(f"`{n}` double" for n in names))
    both = df.crossJoin(F.broadcast(sets))  # a batch of trials
    e = guess(both) - F.col(truth)
    got = {r["__trial"]: r["rmse"] for r in both.groupBy("__trial").agg(F.sqrt(F.avg(e * e)).alias("rmse")).collect()}
    return [got.get(k, float("nan")) for k in range(len(trials))]


def searched(df: DataFrame, guess, truth: str, space: dict[str, tuple[float, float, float]], trials: int = 60, batch: int = 10, start: int = 20, seed: int = 42, good: float = 0.1, candidates: int = 24) -> tuple[dict[str, float], float, list[tuple[dict[str, float], float]]]:
    """Parameters of least error by sequential search, their error, and all trials: after `start` random ones each batch is drawn where good trials are dense and bad ones are not.

    space: name to (lowest, highest, step). The density of the best `good` share of trials, and that of the others, is a mean of normal kernels around them, as wide as
    they spread; candidates are drawn from the good density, and those of the largest ratio of the two are tried. A batch is one pass over the rows, no set is
    tried twice, and the search ends early once all have been.
    """
    import numpy as np

    rng, names = np.random.default_rng(seed), sorted(space)
    low, high, step = (np.array([space[n][k] for n in names], float) for k in range(3))
    most = np.floor((high - low) / step + 1e-9).astype(int)  # parameters as whole numbers of steps
    seen: dict[tuple[int, ...], float] = {}

    def width(at: np.ndarray) -> np.ndarray:
        """Of the kernels in each direction, by the spread of the points; few points are kept apart, so that the search doesn't close in too soon."""
        least = np.maximum(0.7, (most + 1) / (2 * (len(at) + 1)))
        return np.clip(at.std(axis=0) * len(at) ** (-1.0 / (at.shape[1] + 4)), least, np.maximum(least, (most + 1) / 2))

    def log_density(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of a mean of normal kernels, with an even share over the whole space as one more."""
        w = width(at)
        kernels = np.exp(-0.5 * (((x[:, None, :] - at) / w) ** 2).sum(axis=2)) / np.prod(w * np.sqrt(2 * np.pi))
        return np.log((kernels.sum(axis=1) + 1.0 / np.prod(most + 1.0)) / (len(at) + 1))

    while len(seen) < min(trials, int(np.prod((most + 1).astype(float)))):
        want = min(batch if len(seen) >= start else start - len(seen), trials - len(seen))
        fresh: list[tuple[int, ...]] = []
        for attempt in range(200):
            if len(seen) < start or attempt >= 100:
                draw = np.stack([rng.integers(0, m + 1, candidates) for m in most], axis=1)
            else:
                order = sorted(seen, key=seen.get)
                cut = max(5, int(np.ceil(good * len(order))))
                best, rest = (np.array(x, float) for x in (order[:cut], order[cut:]))
                own = best[rng.integers(0, len(best), candidates)]
                draw = np.clip(np.rint(own + width(best) * rng.standard_normal(own.shape)), 0, most).astype(int)
                draw = draw[np.argsort(log_density(draw, rest) - log_density(draw, best), kind="stable")][:1]
            for row in map(tuple, draw.tolist()):
                if row not in seen and row not in fresh and len(fresh) < want:
                    fresh.append(row)
            if len(fresh) >= want:
                break
        if not fresh:
            break
        sets = [{n: float(low[j] + step[j] * row[j]) for j, n in enumerate(names)} for row in fresh]
        for row, e in zip(fresh, trial_errors(df, guess, truth, sets)):
            seen[row] = e if np.isfinite(e) else float("inf")
    told = [({n: float(low[j] + step[j] * row[j]) for j, n in enumerate(names)}, e) for row, e in seen.items()]
    return (*min(told, key=lambda t: t[1]), told)
