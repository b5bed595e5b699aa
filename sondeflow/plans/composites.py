"""Composite features, smoothing sweeps and neighbour transfers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeflow.operators import aggregates as A
from sondeflow.operators import blending as B
from sondeflow.operators import curves as C
from sondeflow.operators import features, nearby, spatial
from sondeflow.plans.base import BASE_SQL, WELLS_SQL, base, rounded, table, wells
from sondeflow.plans.registry import query

_GRID = "grid AS (SELECT p_size AS g_at, avg(p_retailprice) / 10 AS g_value FROM part GROUP BY p_size)"


def _curve(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg((F.avg("p_retailprice") / 10).alias("y"))
    return C.curves(g.withColumn("k", F.lit(0)), "k", "x", "y")


@query(
    "shape_labels",
    f"""WITH {WELLS_SQL}, s AS (SELECT well, max(z) - min(z) AS depth, stddev_samp(y) AS sway FROM wells GROUP BY well), c AS (SELECT quantile_cont(depth, 0.33) AS d1, quantile_cont(depth, 0.67) AS d2, quantile_cont(sway, 0.33) AS s1, quantile_cont(sway, 0.67) AS s2 FROM s),
    l AS (SELECT well, CASE WHEN depth <= d1 THEN 'low' WHEN depth <= d2 THEN 'mid' ELSE 'high' END AS vertical, CASE WHEN sway <= s1 THEN 'low' WHEN sway <= s2 THEN 'mid' ELSE 'high' END AS side FROM s, c)
    SELECT well, vertical, side, vertical || '-' || side AS shape FROM l""",
)
def shape_labels(spark, sf_dir):
    s = wells(spark, sf_dir).groupBy("well").agg((F.max("z") - F.min("z")).alias("depth"), F.stddev_samp("y").alias("sway"))
    return features.shape_labels(s, {"depth": "vertical", "sway": "side"}).select("well", "vertical", "side", "shape")


_REF = f"""WITH {BASE_SQL}, {_GRID}, ref AS (SELECT b.*, 1 + row_idx % 49 + 0.5::DOUBLE AS at, (lo.g_value + hi.g_value) / 2 AS reference, hi.g_value - lo.g_value AS slope FROM base b JOIN grid lo ON lo.g_at = 1 + row_idx % 49 JOIN grid hi ON hi.g_at = 2 + row_idx % 49)"""


def _referenced(spark, sf_dir):
    """Rows with the reference curve's value and slope at a place of their own."""
    b = base(spark, sf_dir).join(F.broadcast(_curve(spark, sf_dir).drop("k"))).withColumn("at", F.lit(1.5) + F.col("row_idx") % 49)
    look = lambda v: C.lookup(F.col("knots"), v)
    return b.withColumn("reference", look(F.col("at"))).withColumn("slope", look(F.col("at") + 0.5) - look(F.col("at") - 0.5)).drop("knots")


@query(
    "curve_calibration",
    f"{_REF} SELECT well, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN corr(gr, reference) END, 6) AS corr, round(CASE WHEN count(*) >= 10 THEN avg(gr - reference) END, 6) AS \"offset\", round(CASE WHEN count(*) >= 10 THEN stddev_pop(gr) / stddev_pop(reference) END, 6) AS scale FROM ref WHERE is_known AND gr IS NOT NULL GROUP BY well",
)
def curve_calibration(spark, sf_dir):
    return rounded(features.calibration(_referenced(spark, sf_dir).filter("is_known"), "gr", "reference"))


@query("curve_inversion", f"{_REF} SELECT well, row_idx, round(CASE WHEN abs(slope) >= 0.2::DOUBLE THEN greatest(least(-(value - reference) / slope, 150), -150) ELSE 0 END, 5) AS shift FROM ref WHERE is_target")
def curve_inversion(spark, sf_dir):
    r = _referenced(spark, sf_dir).filter("is_target")
    return r.select("well", "row_idx", F.round(features.inverted(F.col("value") - F.col("reference"), F.col("slope")), 5).alias("shift"))


@query(
    "holdout_probe",
    f"""WITH {BASE_SQL}, k AS (SELECT *, row_idx < floor(known_length * 0.7::DOUBLE) AS first FROM base WHERE is_known), f AS (SELECT well, regr_slope(tvt_input, md) FILTER (first) AS s, regr_intercept(tvt_input, md) FILTER (first) AS i FROM k GROUP BY well)
    SELECT well, count(*) AS n, round(avg(s * md + i - tvt_input), 4) AS bias FROM k JOIN f USING (well) WHERE NOT first GROUP BY well""",
)
def holdout_probe(spark, sf_dir):
    return rounded(features.holdout_slopes(base(spark, sf_dir), 0.7), 4)


@query(
    "window_costs",
    f"""WITH {WELLS_SQL}, o AS (SELECT well, row_idx, k, o, avg(pow(gr - (x / (row_idx + 1) * 1.1::DOUBLE + o), 2)) OVER (PARTITION BY well, k ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS cost FROM wells, (VALUES (0, -20.0::DOUBLE), (1, 0.0), (2, 20.0)) t(k, o))
    SELECT well, row_idx, o AS "offset", round(cost, 4) AS cost FROM o WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY well, row_idx ORDER BY cost, k) = 1""",
)
def window_costs(spark, sf_dir):
    w = wells(spark, sf_dir)
    out = features.window_costs(w, "gr", F.col("x") / (F.col("row_idx") + 1) * 1.1 + F.col("offset"), [-20.0, 0.0, 20.0], 5)
    return rounded(out, 4)


_GUESS = f"WITH {BASE_SQL}, g AS (SELECT *, well % 5 AS fold, tvt0 + x - x0 AS guess FROM base WHERE is_target)"


def _guessed(spark, sf_dir):
    return base(spark, sf_dir).filter("is_target").withColumn("fold", F.col("well") % 5).withColumn("guess", F.col("tvt0") + F.col("x") - F.col("x0"))


@query(
    "smoothing_sweep",
    f"""{_GUESS}, s AS (SELECT fold, tvt, unnest([{{'width': 0, 'v': guess}}, {{'width': 5, 'v': avg(guess) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)}}, {{'width': 21, 'v': avg(guess) OVER (w ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)}}], recursive := true) FROM g WINDOW w AS (PARTITION BY well ORDER BY row_idx))
    SELECT fold, width, round(sqrt(avg(pow(v - tvt, 2))), 4) AS rmse FROM s GROUP BY fold, width""",
)
def smoothing_sweep(spark, sf_dir):
    return rounded(B.smoothing_errors(_guessed(spark, sf_dir), "guess", "tvt", "well", "row_idx", "fold", [0, 5, 21]), 4)


@query(
    "regime_smoothing",
    f"""{_GUESS} SELECT well, row_idx, round(CASE WHEN fold = 1 THEN avg(guess) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) WHEN fold = 2 THEN avg(guess) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) ELSE guess END, 5) AS smoothed FROM g WINDOW w AS (PARTITION BY well ORDER BY row_idx)""",
)
def regime_smoothing(spark, sf_dir):
    out = B.smoothed_by_regime(_guessed(spark, sf_dir), "guess", "fold", {1: 7, 2: 11}, "well", "row_idx")
    return out.select("well", "row_idx", F.round("smoothed", 5).alias("smoothed"))


@query("weight_candidates", f"{_GUESS} SELECT weight, round(sqrt(avg(pow((1 - weight) * guess + weight * tvt0 - tvt, 2))), 4) AS rmse, round(avg(abs((1 - weight) * guess + weight * tvt0 - guess)), 4) AS mean_moved, round(max(abs((1 - weight) * guess + weight * tvt0 - guess)), 4) AS most_moved FROM g, (VALUES (0.0::DOUBLE), (0.3), (0.7)) t(weight) GROUP BY weight")
def weight_candidates(spark, sf_dir):
    return rounded(B.weight_candidates(_guessed(spark, sf_dir), "guess", "tvt0", "tvt", [0.0, 0.3, 0.7]), 4)


@query(
    "feature_neighbours_all",
    f"""WITH {WELLS_SQL}, f AS (SELECT well, avg(value) AS a, max(value) AS b, count(*)::DOUBLE AS c FROM wells GROUP BY well), s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc FROM f), z AS (SELECT well, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM f, s),
    p AS (SELECT x.well AS focus, y.well, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2)) AS distance FROM z x JOIN z y ON x.well <> y.well)
    SELECT focus, well, round(distance, 6) AS distance, row_number() OVER (PARTITION BY focus ORDER BY distance, well) AS rank FROM p QUALIFY rank <= 3""",
)
def feature_neighbours_all(spark, sf_dir):
    f = wells(spark, sf_dir).groupBy("well").agg(F.avg("value").alias("a"), F.max("value").alias("b"), F.count("*").cast("double").alias("c"))
    return rounded(spatial.all_feature_neighbours(f, "well", ["a", "b", "c"], 3))


@query(
    "histogram_peaks",
    """WITH h AS (SELECT event_type, least(floor(value * 20 / 500), 19)::BIGINT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY ALL), g AS (SELECT event_type, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM h) CROSS JOIN range(20) t(bin) LEFT JOIN h USING (event_type, bin)),
    s AS (SELECT event_type, n >= 3 AND n > coalesce(lag(n) OVER w, 0) AND n > coalesce(lead(n) OVER w, 0) AS top FROM g WINDOW w AS (PARTITION BY event_type ORDER BY bin)) SELECT event_type, count(*) FILTER (top) AS peaks FROM s GROUP BY event_type""",
)
def histogram_peaks(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "events"), "value", ["event_type"], 0.0, 500.0, 20)
    return A.histogram_peaks(h, ["event_type"], 20, 3)


@query(
    "offset_transfer",
    """WITH p AS (SELECT s_suppkey AS id, s_acctbal AS px, (s_nationkey * 100)::DOUBLE AS py, (s_suppkey % 13)::DOUBLE AS err FROM supplier),
    n AS (SELECT q.id, p.err FROM p q JOIN p ON q.id <> p.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.px - p.px) * (q.px - p.px) + (q.py - p.py) * (q.py - p.py)), p.id) <= 5) SELECT id AS qid, round(avg(err), 6) AS transferred, count(*) AS n FROM n GROUP BY id""",
)
def offset_transfer(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_suppkey").alias("pwho"), F.col("s_acctbal").alias("px"), (F.col("s_nationkey") * 100.0).alias("py"), (F.col("s_suppkey") % 13).cast("double").alias("err"))
    q = s.select(F.col("pid").alias("qid"), F.col("pwho").alias("qwho"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    return rounded(spatial.transferred(nearby.nearest(q, s, 5), "err"))


@query("wide_features")
def wide_features(spark, sf_dir):
    """All families at once; their parts have SQL of their own."""
    b = base(spark, sf_dir)
    knots = b.select("well").distinct().join(F.broadcast(_curve(spark, sf_dir).drop("k")))
    return features.wide(b, knots).drop("event_type")
