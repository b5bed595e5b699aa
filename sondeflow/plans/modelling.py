"""Blends, guards, trackers and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sondeflow.operators import blending as B
from sondeflow.operators import features, folds, models, tracking
from sondeflow.plans.base import BASE_SQL, base, rounded, table
from sondeflow.plans.registry import query

_PREDS = f"""WITH {BASE_SQL}, preds AS (SELECT well, row_idx, CAST(well % 5 AS INT) AS fold, tvt, tvt0, tvt - tvt0 AS y, (x - x0) AS a, delta_md / 100000 AS b, (post_ps_step * 250)::DOUBLE AS c, hidden_length FROM base WHERE is_target)"""
NAMES = ["a", "b", "c"]


def preds(spark, sf_dir):
    """Target rows with three guesses of the target's distance from the anchor (y): a, b, c."""
    b = base(spark, sf_dir).filter("is_target")
    return b.select("well", "row_idx", (F.col("well") % 5).cast("int").alias("fold"), "tvt", "tvt0", (F.col("tvt") - F.col("tvt0")).alias("y"), (F.col("x") - F.col("x0")).alias("a"), (F.col("delta_md") / 100000).alias("b"), (F.col("post_ps_step") * 250).cast("double").alias("c"), "hidden_length")


_SUMS = ", ".join([f"round(sum({p} * {q}) / count(*), 2) AS g_{i}_{j}" for i, p in enumerate(NAMES) for j, q in enumerate(NAMES) if j >= i] + [f"round(sum({p} * y) / count(*), 2) AS b_{i}" for i, p in enumerate(NAMES)])


@query("blend_moments", f"{_PREDS} SELECT fold, {_SUMS}, count(*) AS n FROM preds GROUP BY fold")
def blend_moments(spark, sf_dir):
    out = preds(spark, sf_dir).groupBy("fold").agg(*B.moment_columns(NAMES, F.col("y"))).drop("c")
    return out.select("fold", *(F.round(F.col(k) / F.col("n"), 2).alias(k) for k in out.columns if k not in ("fold", "n")), "n")


@query("nested_blend")
def nested_blend(spark, sf_dir):
    """Weights of each fold from the other folds' moments, and the pooled error."""
    per = B.moments(preds(spark, sf_dir), NAMES, F.col("y"))
    weights, error = B.nested(per)
    return spark.createDataFrame([(f, *map(float, w), error) for f, w in sorted(weights.items())], "fold int, a double, b double, c double, rmse double")


@query("hill_climb")
def hill_climb(spark, sf_dir):
    per = B.moments(preds(spark, sf_dir), NAMES, F.col("y"))
    whole = sum(per.values(), start=B.Moments(0.0, 0.0, 0.0, 0.0))
    w, error = B.hill_climb(whole, np.array([1.0, 0.0, 0.0]))
    return spark.createDataFrame([(*map(float, w), error)], "a double, b double, c double, rmse double")


@query("fixed_blend", f"{_PREDS} SELECT well, row_idx, round(tvt0 + 0.6::DOUBLE * a + 0.3::DOUBLE * b + 0.1::DOUBLE * c, 6) AS guess FROM preds")
def fixed_blend(spark, sf_dir):
    p = preds(spark, sf_dir)
    return rounded(p.select("well", "row_idx", (F.col("tvt0") + 0.6 * F.col("a") + 0.3 * F.col("b") + 0.1 * F.col("c")).alias("guess")))


@query(
    "guard_rules",
    f"""{_PREDS}, g AS (SELECT well, max(hidden_length) * 150 AS h, avg(a) / 10 AS d, -max(c) / 100 AS dz FROM preds GROUP BY well) SELECT well,
    CASE WHEN h >= 8000 AND abs(d) >= 30 AND dz <= -100 THEN 'full_anchor' WHEN abs(d) >= 60 THEN 'delta_extreme' WHEN h >= 6000 AND abs(d) >= 30 THEN 'strong' WHEN h >= 5000 OR abs(d) >= 20 THEN 'mild' ELSE 'none' END AS rule FROM g""",
)
def guard_rules(spark, sf_dir):
    g = preds(spark, sf_dir).groupBy("well").agg((F.max("hidden_length") * 150).alias("h"), (F.avg("a") / 10).alias("d"), (-F.max("c") / 100).alias("dz"))
    return g.select("well", B.guard_rule(F.col("h"), F.col("d"), F.col("dz")).alias("rule"))


@query(
    "alpha_grid",
    f"{_PREDS} SELECT fold, alpha, round(sqrt(avg(pow((1 - alpha) * a + alpha * b - y, 2))), 4) AS rmse FROM preds, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(alpha) GROUP BY fold, alpha",
)
def alpha_grid(spark, sf_dir):
    return rounded(B.alpha_grid(preds(spark, sf_dir), "y", "a", "b", [0.0, 0.25, 0.5, 0.75, 1.0], ["fold"]), 4)


_E = ", ".join(f"sum(({v} - y) * ({v} - y)) AS {v}" for v in NAMES)


@query(
    "select_by_regime",
    f"""{_PREDS}, r AS (SELECT *, CASE WHEN hidden_length > 50 THEN 1 ELSE 0 END AS regime FROM preds), s AS (SELECT regime, fold, count(*) AS n, {_E} FROM r GROUP BY ALL),
    l AS (SELECT regime, fold, n, i, variant, sse FROM (SELECT regime, fold, n, unnest([{{'i': 0, 'variant': 'a', 'sse': a}}, {{'i': 1, 'variant': 'b', 'sse': b}}, {{'i': 2, 'variant': 'c', 'sse': c}}], recursive := true) FROM s)),
    t AS (SELECT *, sum(sse) OVER (PARTITION BY regime, i) - sse AS rest FROM l)
    SELECT regime, fold, variant, round(sqrt(sse / n), 6) AS rmse FROM t QUALIFY row_number() OVER (PARTITION BY regime, fold ORDER BY rest, i) = 1""",
)
def select_by_regime(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("regime", F.when(F.col("hidden_length") > 50, 1).otherwise(0))
    return rounded(B.select_by_regime(p, NAMES, "y", "regime", "fold"))


@query(
    "fall_back",
    f"""{_PREDS}, w AS (SELECT well, 2 * quantile_cont(abs(a - y), 0.9) AS width FROM preds WHERE row_idx % 3 = 0 GROUP BY well)
    SELECT p.well, row_idx, round(CASE WHEN width > 20000 THEN tvt0 ELSE tvt0 + a END, 6) AS final FROM preds p LEFT JOIN w USING (well)""",
)
def fall_back(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("r", F.col("a") - F.col("y")).withColumn("guess", F.col("tvt0") + F.col("a"))
    return rounded(B.fall_back(p, "r", "row_idx % 3 = 0", "well", "guess", "tvt0", 20000.0).select("well", "row_idx", "final"))


@query(
    "grid_search",
    f"{_PREDS} SELECT scale, tau, round(sqrt(avg(pow(scale * a * (1 - exp(-(row_idx / tau))) - y, 2))), 4) AS rmse FROM preds, (VALUES (0.5::DOUBLE), (1.0)) s(scale), (VALUES (5.0::DOUBLE), (20.0), (80.0)) t(tau) GROUP BY ALL",
)
def grid_search(spark, sf_dir):
    guess = lambda d: d["scale"] * d["a"] * features.ramp(d["row_idx"].cast("double"), d["tau"])
    return rounded(models.grid_errors(preds(spark, sf_dir), guess, "y", {"scale": [0.5, 1.0], "tau": [5.0, 20.0, 80.0]}, []), 4)


@query("parameter_search")
def parameter_search(spark, sf_dir):
    """Scale and warm-up of a guess by sequential search: all trials with their errors, the best first."""
    guess = lambda d: d["scale"] * d["a"] * features.ramp(d["row_idx"].cast("double"), d["tau"])
    _, _, trials = models.searched(preds(spark, sf_dir), guess, "y", {"scale": (0.0, 1.5, 0.05), "tau": (5.0, 500.0, 5.0)}, trials=40, batch=10, start=20)
    out = spark.createDataFrame([(t["scale"], t["tau"], e) for t, e in trials], "scale double, tau double, rmse double")
    return rounded(out, 4).orderBy("rmse", "scale", "tau")


@query("robust_projection")
def robust_projection(spark, sf_dir):
    b = base(spark, sf_dir).filter("is_target").withColumn("guess", F.col("tvt0") + (F.col("x") - F.col("x0")))
    return B.projected(b.select("well", "row_idx", "md", "z", "tvt0", "guess"), "guess", "z", "tvt0", "md", "well").select("well", "row_idx", "projected")


def _tracking(spark, sf_dir):
    """Rows with gr and a start on a curve of part prices by size, which all wells share."""
    e = base(spark, sf_dir).select("well", "row_idx", "gr", (F.lit(1.0) + F.col("well") % 50).alias("start"), (-F.col("md") / 86400).alias("drift"))
    c = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg((F.avg("p_retailprice") / 15).alias("y"))
    return e, c


def _track(name: str, kernel, seeds: int = 1, sql: str | None = None):
    @query(f"track_{name}", sql)
    def run(spark, sf_dir):
        rows, curve = _tracking(spark, sf_dir)
        out = tracking.tracked(rows, curve, kernel, "well", "row_idx", "gr", seeds)
        if sql is not None:
            return out.select("well", "row_idx", "guess")
        return tracking.ensemble(out, "well", "row_idx", 8.0) if seeds > 1 else out


# What the trackers' checks start from: gr filled as in the kernels, and the curve as one list of knots.
_TRACK = f"""{BASE_SQL},
f AS (SELECT well, row_idx, gr, last_value(gr IGNORE NULLS) OVER b AS x0, first_value(gr IGNORE NULLS) OVER a AS x1,
  last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER a AS i1
  FROM base WINDOW b AS (PARTITION BY well ORDER BY row_idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY well ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
knots AS MATERIALIZED (SELECT p_size::DOUBLE AS x, avg(p_retailprice) / 15 AS y FROM part GROUP BY 1),
g AS MATERIALIZED (SELECT well, row_idx, coalesce(CASE WHEN gr IS NOT NULL THEN gr WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN x0 + (x1 - x0) / (i1 - i0) * (row_idx - i0) ELSE coalesce(x0, x1) END, (SELECT avg(y) FROM knots)) AS g FROM f),
c AS MATERIALIZED (SELECT list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys, count(*)::INT AS n FROM knots)"""

_BEST = """list_transform(range(1, n + 1), lambda t: list_min(list_transform([2, 1, 0, -1, -2], lambda m: {'c': CASE WHEN t - m BETWEEN 1 AND n THEN cost[t - m] + (g - ys[t]) * (g - ys[t]) / 400 + 0.5::DOUBLE * abs(m) ELSE 'inf'::DOUBLE END, 's': t - m})))"""
_BEAM = f"""WITH RECURSIVE {_TRACK},
r(well, row_idx, cost, back) AS (
  SELECT w.well, -1::BIGINT, list_transform(range(1, c.n + 1), lambda t: CASE WHEN t = list_position(list_transform(c.xs, lambda v: abs(v - (1 + w.well % 50))), list_min(list_transform(c.xs, lambda v: abs(v - (1 + w.well % 50))))) THEN 0::DOUBLE ELSE 'inf'::DOUBLE END), []::BIGINT[]
  FROM (SELECT DISTINCT well FROM base) w, c
  UNION ALL
  SELECT well, row_idx, list_transform(range(1, n + 1), lambda t: CASE WHEN {{'c': best[t].c, 't': t}} <= coalesce(list_sort(list_transform(range(1, n + 1), lambda u: {{'c': best[u].c, 't': u}}))[8], {{'c': 'inf'::DOUBLE, 't': n + 1}}) THEN best[t].c ELSE 'inf'::DOUBLE END), list_transform(best, lambda b: b.s)
  FROM (SELECT r.well, g.row_idx, c.n, {_BEST} AS best FROM r JOIN g ON g.well = r.well AND g.row_idx = r.row_idx + 1, c)),
m AS MATERIALIZED (SELECT * FROM r)"""
_HEADS = f"{_BEAM} SELECT well, row_idx, xs[list_position(cost, list_min(cost))] AS guess FROM m, c WHERE row_idx >= 0"
_TRACED = f"""{_BEAM},
p(well, row_idx, knot) AS (SELECT well, row_idx, list_position(cost, list_min(cost))::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY row_idx DESC) AS last FROM m WHERE row_idx >= 0) WHERE last = 1
  UNION ALL SELECT p.well, p.row_idx - 1, m.back[p.knot] FROM p JOIN m ON m.well = p.well AND m.row_idx = p.row_idx WHERE p.row_idx > 0)
SELECT well, row_idx, xs[knot] AS guess FROM p, c"""


def _viterbi_sql(reach: int, drift: str) -> str:
    """The tracker's costs and links row by row; a grid of whole steps around the start. drift: the move expected at a row."""
    states = 2 * reach + 1
    knot = "len(list_filter(xs, lambda x: x <= place))"
    return f"""WITH RECURSIVE {_TRACK},
e AS (SELECT well, row_idx, {drift} AS e FROM base WINDOW w AS (PARTITION BY well ORDER BY row_idx)),
s AS MATERIALIZED (SELECT well, p, CASE WHEN {knot} = 0 THEN ys[1] WHEN {knot} = n THEN ys[n] ELSE (ys[{knot} + 1] - ys[{knot}]) / (xs[{knot} + 1] - xs[{knot}]) * (place - xs[{knot}]) + ys[{knot}] END AS y
  FROM (SELECT well, p, CAST(1 + well % 50 + p AS DOUBLE) AS place FROM (SELECT DISTINCT well FROM base), (SELECT unnest(range(-{reach}, {reach} + 1)) AS p)), c),
want AS MATERIALIZED (SELECT well, list(y ORDER BY p) AS want FROM s GROUP BY well),
h AS MATERIALIZED (SELECT well, row_idx, g, e FROM g JOIN e USING (well, row_idx)),
r(well, row_idx, cost, back) AS (
  SELECT h.well, h.row_idx, list_transform(range(1, {states} + 1), lambda t: ((g - want[t]) / 20.0::DOUBLE) * ((g - want[t]) / 20.0::DOUBLE) / 2 + CAST(t - {reach + 1} AS DOUBLE) * CAST(t - {reach + 1} AS DOUBLE) / 2), []::BIGINT[] FROM h JOIN want USING (well) WHERE row_idx = 0
  UNION ALL
  SELECT well, row_idx, list_transform(range(1, {states} + 1), lambda t: best[t].c + ((g - want[t]) / 20.0::DOUBLE) * ((g - want[t]) / 20.0::DOUBLE) / 2), list_transform(best, lambda b: b.s)
  FROM (SELECT r.well, h.row_idx, h.g, want.want, list_transform(range(1, {states} + 1), lambda t: list_min(list_transform(range(1, {states} + 1), lambda s: {{'c': cost[s] + (CAST(t - s AS DOUBLE) - e) * (CAST(t - s AS DOUBLE) - e) / 2, 's': s}}))) AS best
    FROM r JOIN h ON h.well = r.well AND h.row_idx = r.row_idx + 1 JOIN want ON want.well = r.well)),
m AS MATERIALIZED (SELECT * FROM r),
p(well, row_idx, state) AS (SELECT well, row_idx, list_position(cost, list_min(cost))::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY well ORDER BY row_idx DESC) AS last FROM m) WHERE last = 1
  UNION ALL SELECT p.well, p.row_idx - 1, m.back[p.state] FROM p JOIN m ON m.well = p.well AND m.row_idx = p.row_idx WHERE p.row_idx > 0)
SELECT well, row_idx, CAST(1 + well % 50 AS DOUBLE) + state - {reach + 1} AS guess FROM p"""


_NEAREST = f"""WITH {_TRACK} SELECT well, row_idx, coalesce(list_min(list_transform(list_filter(range(1, n + 1), lambda k: abs(xs[k] - (1 + well % 50)) <= 25), lambda k: {{'d': abs(g - ys[k]), 'x': xs[k]}})).x, 1 + well % 50) AS guess FROM g, c"""

_track("viterbi", tracking.viterbi(), sql=_viterbi_sql(25, "0.0::DOUBLE"))
_track("viterbi_drift", tracking.viterbi(drift="drift", states=31, reach=15.0), sql=_viterbi_sql(15, "(-md / 86400) - lag(-md / 86400) OVER w"))
_track("beam", tracking.beam(), sql=_TRACED)
_track("beam_heads", tracking.beam(trace_back=False), sql=_HEADS)
_track("nearest", tracking.nearest_match(), sql=_NEAREST)
_track("nearest_smoothed", tracking.nearest_match(width=11))
_track("beam_mean", tracking.mean_beam())
_track("beam_mean_traced", tracking.mean_beam(trace_back=True, smooth="mean"))
_track("correlation", tracking.correlation_match())
_track("refine", tracking.refine())
_track("refine_wide", tracking.refine(half=30, reach=20.0))
_track("hybrid_beam", tracking.hybrid_beam())

_GREEDY = f"""WITH RECURSIVE {BASE_SQL},
f AS (SELECT well, row_idx, gr, last_value(gr IGNORE NULLS) OVER b AS x0, first_value(gr IGNORE NULLS) OVER a AS x1,
  last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER a AS i1
  FROM base WINDOW b AS (PARTITION BY well ORDER BY row_idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY well ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS MATERIALIZED (SELECT well, row_idx, CASE WHEN gr IS NOT NULL THEN gr WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN x0 + (x1 - x0) / (i1 - i0) * (row_idx - i0) ELSE coalesce(x0, x1) END AS g FROM f),
c AS MATERIALIZED (SELECT list({{'x': x, 'y': y}} ORDER BY x) AS k FROM (SELECT p_size::DOUBLE AS x, avg(p_retailprice) / 15 AS y FROM part GROUP BY 1)),
t(well, row_idx, place) AS (SELECT well, -1::BIGINT, 1.0::DOUBLE + well % 50 FROM (SELECT DISTINCT well FROM base) UNION ALL
  SELECT t.well, g.row_idx, list_min(list_transform(list_filter(c.k, lambda s: abs(s.x - t.place) <= 25), lambda s: {{'cost': abs(s.y - g.g) + 0.15::DOUBLE * abs(s.x - t.place), 'x': s.x}})).x
  FROM t JOIN g ON g.well = t.well AND g.row_idx = t.row_idx + 1, c)
SELECT well, row_idx, place AS guess FROM t WHERE row_idx >= 0"""


@query("track_greedy", _GREEDY)
def track_greedy(spark, sf_dir):
    rows, curve = _tracking(spark, sf_dir)
    return tracking.tracked(rows, curve, tracking.greedy_match(), "well", "row_idx", "gr").select("well", "row_idx", "guess")


@query(
    "offset_search",
    f"""WITH {BASE_SQL}, r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY well ORDER BY row_idx) - 1) * 3 / count(*) OVER (PARTITION BY well)) AS BIGINT) AS part FROM base),
    c AS (SELECT well, part, k, o, avg(abs(gr - (100 + x / 500 + o))) + 0.01::DOUBLE * o * o AS cost, count(gr) AS n FROM r, (VALUES (0, -20.0::DOUBLE), (1, -5.0), (2, 0.0), (3, 5.0), (4, 20.0)) t(k, o) GROUP BY well, part, k, o)
    SELECT well, part, n, CASE WHEN n >= 8 THEN o ELSE 0 END AS "offset" FROM c QUALIFY row_number() OVER (PARTITION BY well, part ORDER BY cost, k) = 1""",
)
def offset_search(spark, sf_dir):
    b = base(spark, sf_dir)
    return tracking.offset_search(b, "gr", lambda o: F.lit(100) + F.col("x") / 500 + o, [-20.0, -5.0, 0.0, 5.0, 20.0], 3, 0.01, "well", "row_idx")


@query(
    "physical_extrapolation",
    f"""WITH {BASE_SQL}, s AS (SELECT well, regr_slope(tvt_input, z) AS s FROM base WHERE is_known GROUP BY well)
    SELECT well, row_idx, round(tvt0, 4) AS held, round(tvt0 + coalesce(s, 0) * delta_z, 4) AS sloped, round(tvt0 - delta_z, 4) AS structural FROM base JOIN s USING (well) WHERE is_target""",
)
def physical_extrapolation(spark, sf_dir):
    return rounded(features.physical(base(spark, sf_dir)).select("well", "row_idx", "held", "sloped", "structural"), 4)


@query(
    "lateral_extrapolation",
    f"""WITH {BASE_SQL}, k AS (
      SELECT well, md, z, tvt_input AS y, row_number() OVER back AS last, tvt_input - lead(tvt_input) OVER back AS dy, md - lead(md) OVER back AS dm
      FROM base WHERE is_known WINDOW back AS (PARTITION BY well ORDER BY row_idx DESC)),
    f AS (SELECT well, count(*) AS n, CASE WHEN stddev_pop(md) FILTER (last <= 8) > 1e-6 THEN regr_slope(y, md) FILTER (last <= 8) ELSE 0 END AS sm,
      CASE WHEN stddev_pop(z) FILTER (last <= 8) > 1e-6 THEN regr_slope(y, z) FILTER (last <= 8) ELSE 0 END AS sz,
      median(dy / CASE WHEN dm = 0 THEN 1e-6::DOUBLE ELSE dm END) FILTER (last <= 12) AS sr FROM k GROUP BY well),
    e AS (SELECT well, row_idx, tvt0 AS held, CASE WHEN n >= 8 THEN tvt0 + sm * delta_md ELSE tvt0 END AS by_md, CASE WHEN n >= 8 THEN tvt0 + sz * delta_z ELSE tvt0 END AS by_z,
      CASE WHEN n >= 8 THEN tvt0 + sr * delta_md ELSE tvt0 END AS by_steps FROM base JOIN f USING (well) WHERE is_target)
    SELECT well, row_idx, round(held, 4) AS held, round(by_md, 4) AS by_md, round(by_z, 4) AS by_z, round(by_steps, 4) AS by_steps, round((by_md + by_z + by_steps) / 3, 4) AS lateral FROM e""",
)
def lateral_extrapolation(spark, sf_dir):
    out = features.lateral(base(spark, sf_dir), near=8, far=12, least=8)
    return rounded(out.select("well", "row_idx", "held", "by_md", "by_z", "by_steps", "lateral"), 4)


@query("cross_validated_model")
def cross_validated_model(spark, sf_dir):
    b = base(spark, sf_dir)
    p = preds(spark, sf_dir).drop("fold")
    wells = b.groupBy("well").agg(F.max("hidden_length").cast("double").alias("load"))
    f = folds.balanced(wells, "well", "load", 3).select("well", "fold")
    return models.cross_validated(p.join(f, "well"), NAMES, "y", "fold", ["well", "row_idx"], models.linear)
