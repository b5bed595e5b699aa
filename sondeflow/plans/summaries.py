"""Metrics, slices, distributions and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeflow.functions.scalars import cut
from sondeflow.operators import aggregates as A
from sondeflow.plans.base import BASE_SQL, WELLS_SQL, base, rounded, table, wells
from sondeflow.plans.registry import FLAGSHIP, query

EDGES = [0.0, 40.0, 50.0, 55.0, 500.0]
_BIN = "CASE WHEN hidden_length < 0 THEN NULL WHEN hidden_length <= 40 THEN 0 WHEN hidden_length <= 50 THEN 1 WHEN hidden_length <= 55 THEN 2 WHEN hidden_length <= 500 THEN 3 END"
_PRED = f"""WITH {BASE_SQL}, pred AS (SELECT *, tvt0 + (x - x0) AS guess, {_BIN} AS length_bin, guess - tvt AS err FROM base WHERE is_target)"""


def predictions(spark, sf_dir):
    """Target rows with a guess (the anchor and the change of x), and the bin of the hidden length."""
    out = base(spark, sf_dir).filter("is_target").withColumn("guess", F.col("tvt0") + (F.col("x") - F.col("x0")))
    return out.withColumn("length_bin", cut(F.col("hidden_length"), EDGES)).withColumn("err", F.col("guess") - F.col("tvt"))


def _metrics(guess: str, name: str) -> str:
    e = f"({guess} - tvt)"
    return f"round(sqrt(avg({e} * {e})), 6) AS {name}_rmse, round(avg(abs({e})), 6) AS {name}_mae, round(avg({e}), 6) AS {name}_bias, round(quantile_cont(abs({e}), 0.95), 6) AS {name}_p95"


@query(
    FLAGSHIP,
    f"""{_PRED} SELECT length_bin, n_rows, n_wells, model_rmse, model_mae, model_bias, model_p95, anchor_rmse, anchor_mae, anchor_bias, anchor_p95,
    round(a_rmse - m_rmse, 6) AS rmse_improvement, round(a_mae - m_mae, 6) AS mae_improvement FROM (
    SELECT length_bin, count(*) AS n_rows, count(DISTINCT well) AS n_wells, {_metrics("guess", "model")}, {_metrics("tvt0", "anchor")},
    sqrt(avg((tvt0 - tvt) * (tvt0 - tvt))) AS a_rmse, sqrt(avg(err * err)) AS m_rmse, avg(abs(tvt0 - tvt)) AS a_mae, avg(abs(err)) AS m_mae FROM pred GROUP BY length_bin)""",
)
def anchor_error_by_length(spark, sf_dir):
    return rounded(A.slice_report(predictions(spark, sf_dir), ["length_bin"], "tvt", "guess", "tvt0", "well"))


@query(
    "slices_all_ways",
    f"""{_PRED} SELECT length_bin, event_type, grouping(length_bin) * 2 + grouping(event_type) AS slice, count(*) AS n_rows, round(sqrt(avg(err * err)), 6) AS rmse
    FROM pred GROUP BY GROUPING SETS ((length_bin), (event_type), ())""",
)
def slices_all_ways(spark, sf_dir):
    return rounded(A.sliced_all_ways(predictions(spark, sf_dir), ["length_bin", "event_type"], "tvt", "guess"))


@query("value_shares", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY event_type")
def value_shares(spark, sf_dir):
    return rounded(A.shares(table(spark, sf_dir, "events"), "event_type"), 9)


@query(
    "described",
    "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS lo, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag",
)
def described(spark, sf_dir):
    out = A.described(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "lo", *(F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")), "hi")


@query(
    "quantile_bins",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT CASE WHEN o_totalprice > c THEN 3 WHEN o_totalprice > b THEN 2 WHEN o_totalprice > a THEN 1 ELSE 0 END AS bin, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders, q GROUP BY 1""",
)
def quantile_bins(spark, sf_dir):
    out = A.quantile_bins(table(spark, sf_dir, "orders"), "o_totalprice", "bin", 4)
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query(
    "median_deviation",
    f"WITH {WELLS_SQL}, m AS (SELECT well, quantile_cont(value, 0.5) AS median FROM wells GROUP BY well) SELECT well, round(any_value(median), 6) AS median, round(quantile_cont(abs(value - median), 0.5), 6) AS mad FROM wells JOIN m USING (well) GROUP BY well",
)
def median_deviation(spark, sf_dir):
    return rounded(A.median_deviation(wells(spark, sf_dir), "value", "well"))


_HIST = "least(floor((value - 0) * 20 / (500 - 0)), 19)::BIGINT"


@query("histogram", f"SELECT event_type, {_HIST} AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY ALL")
def histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "events"), "value", ["event_type"], 0.0, 500.0, 20)


@query(
    "divergence",
    f"""WITH h AS (SELECT event_type, {_HIST} AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY ALL), q AS (SELECT bin, sum(n) AS n FROM h GROUP BY bin),
    g AS (SELECT event_type, bin FROM (SELECT DISTINCT event_type FROM h), range(20) t(bin)),
    j AS (SELECT g.event_type, greatest(coalesce(h.n / sum(h.n) OVER (PARTITION BY g.event_type), 0), 1e-9::DOUBLE) AS p, greatest(coalesce(q.n / (SELECT sum(n) FROM q), 0), 1e-9::DOUBLE) AS q
    FROM g LEFT JOIN h USING (event_type, bin) LEFT JOIN q USING (bin)) SELECT event_type, round(sum(p * ln(p / q)), 9) AS kl FROM j GROUP BY event_type""",
)
def divergence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h = A.histogram(e, "value", ["event_type"], 0.0, 500.0, 20)
    return rounded(A.divergence(h, A.histogram(e, "value", [], 0.0, 500.0, 20), ["event_type"], 20), 9)


@query(
    "error_bands",
    f"{_PRED} SELECT length_bin, round(sum(CASE WHEN abs(err) < 8 THEN err * err ELSE 0 END) / sum(err * err), 9) AS small, round(sum(CASE WHEN abs(err) >= 8 AND abs(err) < 20 THEN err * err ELSE 0 END) / sum(err * err), 9) AS middling, round(sum(CASE WHEN abs(err) >= 20 THEN err * err ELSE 0 END) / sum(err * err), 9) AS large FROM pred GROUP BY length_bin",
)
def error_bands(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(A.error_bands(p, F.col("err"), ["length_bin"]), 9)


@query(
    "worst_first",
    f"{_PRED}, s AS (SELECT well, sum(err * err) AS sse FROM pred GROUP BY well) SELECT well, round(sse, 2) AS sse, row_number() OVER (ORDER BY sse DESC, well) AS rank, round(sum(sse) OVER (ORDER BY sse DESC, well ROWS UNBOUNDED PRECEDING) / (SELECT sum(sse) FROM s), 9) AS share FROM s",
)
def worst_first(spark, sf_dir):
    out = A.worst_first(predictions(spark, sf_dir), "well", F.col("err"))
    return out.select("well", F.round("sse", 2).alias("sse"), "rank", F.round("share", 9).alias("share"))


@query(
    "line_fit",
    f"WITH {WELLS_SQL} SELECT well, count(*) AS n, round(regr_slope(gr, row_idx), 6) AS slope, round(regr_intercept(gr, row_idx), 6) AS intercept, round(regr_r2(gr, row_idx), 6) AS r2 FROM wells WHERE gr IS NOT NULL GROUP BY well",
)
def line_fit(spark, sf_dir):
    return rounded(A.line_fit(wells(spark, sf_dir), "gr", "row_idx", ["well"]))


@query("correlation", f"WITH {WELLS_SQL} SELECT well, round(corr(gr, z), 6) AS gr_z, round(corr(gr, y), 6) AS gr_y, count(gr) AS n FROM wells GROUP BY well")
def correlation(spark, sf_dir):
    w = wells(spark, sf_dir)
    pair = lambda a, b: F.corr(F.when(F.col(a).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    return rounded(w.groupBy("well").agg(pair("gr", "z").alias("gr_z"), pair("gr", "y").alias("gr_y"), F.count("gr").alias("n")))


@query(
    "plane_fit",
    """WITH m AS (SELECT s_nationkey, count(*) AS n, avg(y) my, avg(a) ma, avg(b) mb, sum(a*a) - sum(a)*sum(a)/count(*) AS aa, sum(b*b) - sum(b)*sum(b)/count(*) AS bb, sum(a*b) - sum(a)*sum(b)/count(*) AS ab,
    sum(a*y) - sum(a)*sum(y)/count(*) AS ay, sum(b*y) - sum(b)*sum(y)/count(*) AS byy FROM (SELECT c_nationkey AS s_nationkey, c_acctbal AS y, (c_custkey % 97)::DOUBLE AS a, (c_custkey % 41)::DOUBLE AS b FROM customer) GROUP BY 1),
    s AS (SELECT *, (ay*bb - byy*ab) / (aa*bb - ab*ab) AS ca, (byy*aa - ay*ab) / (aa*bb - ab*ab) AS cb FROM m WHERE n >= 6)
    SELECT s_nationkey, n, round(my - ca*ma - cb*mb, 4) AS c0, round(ca, 4) AS ca, round(cb, 4) AS cb FROM s""",
)
def plane_fit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 97).cast("double").alias("a"), (F.col("c_custkey") % 41).cast("double").alias("b"))
    return rounded(A.plane_fit(c, "y", "a", "b", ["s_nationkey"]).filter("n >= 6"), 4)


@query(
    "gain_and_offset_whole",
    f"WITH {WELLS_SQL}, c AS (SELECT well, gr, z FROM wells WHERE gr IS NOT NULL AND z IS NOT NULL) SELECT well, count(*) AS n, round(CASE WHEN count(*) >= 24 THEN regr_slope(gr, z) ELSE 1 END, 6) AS gain, round(CASE WHEN count(*) >= 24 THEN regr_intercept(gr, z) ELSE avg(gr - z) END, 6) AS \"offset\" FROM c GROUP BY well",
)
def gain_and_offset_whole(spark, sf_dir):
    return rounded(A.gain_and_offset(wells(spark, sf_dir), "gr", "z", ["well"], 24))


@query(
    "third_medians",
    f"""WITH {WELLS_SQL}, r AS (SELECT well, gr, row_number() OVER (PARTITION BY well ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY well) AS n FROM wells WHERE gr IS NOT NULL)
    SELECT well, round(quantile_cont(gr, 0.5) FILTER (floor(i * 3 / n) = 0), 6) AS early, round(quantile_cont(gr, 0.5) FILTER (floor(i * 3 / n) = 1), 6) AS mid, round(quantile_cont(gr, 0.5) FILTER (floor(i * 3 / n) = 2), 6) AS late,
    round(quantile_cont(gr, 0.5) FILTER (i >= n - 50), 6) AS last50, round(sum(gr * exp(0.02::DOUBLE * (i - n))) / sum(exp(0.02::DOUBLE * (i - n))), 6) AS weighted FROM r GROUP BY well""",
)
def third_medians(spark, sf_dir):
    return rounded(A.third_medians(wells(spark, sf_dir), "gr", "well", "row_idx"))


@query(
    "initial_rate",
    f"""WITH {WELLS_SQL}, r AS (SELECT * FROM wells WHERE tvt_input IS NOT NULL QUALIFY row_number() OVER (PARTITION BY well ORDER BY row_idx DESC) <= 30),
    d AS (SELECT well, (tvt_input - lag(tvt_input) OVER w) / nullif(md - lag(md) OVER w, 0) AS r FROM r WINDOW w AS (PARTITION BY well ORDER BY row_idx))
    SELECT well, round(CASE WHEN count(r) >= 3 THEN quantile_cont(r, 0.5) ELSE 0 END, 9) AS rate FROM d GROUP BY well""",
)
def initial_rate(spark, sf_dir):
    return rounded(A.initial_rate(wells(spark, sf_dir), "tvt_input", "md", "well", "row_idx"), 9)


@query(
    "content_signature",
    "SELECT conv_id, md5(string_agg(concat_ws(',', coalesce(role, ''), coalesce(text, '')), ';' ORDER BY turn)) AS signature FROM conversations GROUP BY conv_id",
)
def content_signature(spark, sf_dir):
    return A.content_signature(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"])


@query(
    "first_of_each",
    "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1",
)
def first_of_each(spark, sf_dir):
    return A.first_of_each(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey", "p_retailprice")


@query(
    "nearest_label_by_fold",
    """WITH e AS (SELECT event_id, event_type, value, user_id % 5 AS fold FROM events), f AS (SELECT DISTINCT fold FROM e),
    s AS (SELECT f.fold, event_type AS label, avg(value) AS centre FROM f JOIN e ON e.fold IS DISTINCT FROM f.fold WHERE event_type IS NOT NULL GROUP BY ALL)
    SELECT event_id, fold, (SELECT label FROM s WHERE s.fold IS NOT DISTINCT FROM e.fold ORDER BY abs(centre - value), label LIMIT 1) AS nearest FROM e""",
)
def nearest_label_by_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("fold", F.col("user_id") % 5)
    return A.nearest_label_by_fold(e, "fold", "value", "event_type").select("event_id", "fold", "nearest")


@query(
    "binary_slices",
    "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(n_chars), 6) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def binary_slices(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(j.groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.avg("n_chars").alias("n_chars")))


@query(
    "quantiles_by_key",
    "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(max(value), 6) AS q100 FROM events GROUP BY event_type",
)
def quantiles_by_key(spark, sf_dir):
    """Exact quantiles of few hot keys: counted by value over all tasks."""
    return rounded(A.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}))
