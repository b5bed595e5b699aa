"""Sequence, window and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeflow.functions import scalars as S
from sondeflow.operators import features, sequence
from sondeflow.operators import windows as W
from sondeflow.plans.base import BASE_SQL, WELLS_SQL, back_in_well, base, in_well, rounded, wells
from sondeflow.plans.registry import query


@query(
    "base_table",
    f"""WITH {BASE_SQL} SELECT well, row_idx, event_id, concat(well, '_', row_idx) AS id, n_rows, ps_idx, known_length, hidden_length, is_target, is_known, is_gr_missing,
    round(md, 6) AS md, round(tvt_input, 6) AS tvt_input, round(tvt0, 6) AS tvt0, round(md0, 6) AS md0, round(delta_md, 6) AS delta_md, round(delta_x, 6) AS delta_x,
    round(delta_y, 6) AS delta_y, round(delta_z, 6) AS delta_z, post_ps_step, round(row_frac, 6) AS row_frac FROM base""",
)
def base_table(spark, sf_dir):
    out = base(spark, sf_dir).withColumn("id", S.row_id(F.col("well"), F.col("row_idx")))
    return rounded(out.select("well", "row_idx", "event_id", "id", "n_rows", "ps_idx", "known_length", "hidden_length", "is_target", "is_known", "is_gr_missing", "md", "tvt_input", "tvt0", "md0", "delta_md", "delta_x", "delta_y", "delta_z", "post_ps_step", "row_frac"))


@query(
    "rolling_stats",
    f"""WITH {WELLS_SQL} SELECT well, row_idx,
    round(avg(gr) OVER (w ROWS 19 PRECEDING), 7) AS mean20, round(avg(gr) OVER (w ROWS 49 PRECEDING), 7) AS mean50,
    round(coalesce(CASE WHEN count(gr) OVER (w ROWS 19 PRECEDING) >= 2 THEN stddev_samp(gr) OVER (w ROWS 19 PRECEDING) END, 0), 7) AS std20,
    round(CASE WHEN count(gr) OVER (w ROWS 29 PRECEDING) >= 5 THEN avg(gr) OVER (w ROWS 29 PRECEDING) END, 7) AS mean30,
    round(CASE WHEN count(gr) OVER (w ROWS 29 PRECEDING) >= 5 THEN stddev_samp(gr) OVER (w ROWS 29 PRECEDING) END, 7) AS std30,
    round(avg(gr) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 7) AS mid11,
    round(avg(gr) OVER (w ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 7) AS mid20,
    round(max(gr) OVER (w ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 7) AS top21,
    round(sqrt(avg(gr * gr) OVER (w ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)), 7) AS rms21,
    round(coalesce(sum(gr) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5, 7) AS padded5
    FROM wells WINDOW w AS (PARTITION BY well ORDER BY row_idx)""",
)
def rolling_stats(spark, sf_dir):
    g = F.col("gr")
    out = wells(spark, sf_dir).select(
        "well", "row_idx",
        W.rolling_mean(g, in_well(), 20).alias("mean20"), W.rolling_mean(g, in_well(), 50).alias("mean50"), W.rolling_std(g, in_well(), 20, fill=0.0).alias("std20"),
        W.rolling_mean(g, in_well(), 30, 5).alias("mean30"), W.rolling_std(g, in_well(), 30, 5).alias("std30"), W.rolling_mean(g, in_well(), 11, centred=True).alias("mid11"),
        W.rolling_mean(g, in_well(), 20, centred=True).alias("mid20"), W.envelope(g, in_well(), 21).alias("top21"), W.energy(g, in_well(), 21).alias("rms21"),
        W.padded_mean(F.coalesce(g, F.lit(0.0)), in_well(), 5).alias("padded5"),
    )
    return rounded(out, 7)


@query(
    "rolling_median",
    f"""WITH {WELLS_SQL} SELECT well, row_idx, round(quantile_cont(gr, 0.5) OVER (PARTITION BY well ORDER BY row_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) AS med25 FROM wells""",
)
def rolling_median(spark, sf_dir):
    return rounded(wells(spark, sf_dir).select("well", "row_idx", W.rolling_median(F.col("gr"), in_well(), 25).alias("med25")))


@query(
    "rolling_median_wide",
    f"""WITH {WELLS_SQL} SELECT well, row_idx, round(quantile_cont(gr, 0.5) OVER (PARTITION BY well ORDER BY row_idx ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING), 6) AS med151, round(quantile_cont(gr, 0.5) OVER (PARTITION BY well ORDER BY row_idx ROWS BETWEEN 40 PRECEDING AND CURRENT ROW), 6) AS past41 FROM wells""",
)
def rolling_median_wide(spark, sf_dir):
    """Wide frames, centred and trailing, by heaps over blocks of rows."""
    w = wells(spark, sf_dir).select("well", "row_idx", "gr")
    w = W.rolling_medians(w, "well", "row_idx", "gr", "med151", 151)
    return rounded(W.rolling_medians(w, "well", "row_idx", "gr", "past41", 41, centred=False).drop("gr"))


@query(
    "lags_and_rates",
    f"""WITH {WELLS_SQL}, l AS (SELECT *, md - lag(md) OVER w AS dmd, z - lag(z) OVER w AS dz, lag(value) OVER w AS before,
    coalesce(lag(value, 5) OVER w, first_value(value) OVER w) AS lag5, coalesce(lead(value, 15) OVER w, last_value(value) OVER (PARTITION BY well ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lead15,
    (lead(value) OVER w - lag(value) OVER w) / 2 AS gradient FROM wells WINDOW w AS (PARTITION BY well ORDER BY row_idx))
    SELECT well, row_idx, round(lag5, 6) AS lag5, round(lead15, 6) AS lead15, round(coalesce(value - before, 0), 6) AS step,
    round(coalesce(coalesce(value - before, 0) - lag(coalesce(value - before, 0)) OVER (PARTITION BY well ORDER BY row_idx), 0), 6) AS step2,
    round(CASE WHEN dmd <> 0 THEN dz / dmd END, 6) AS rate, round(gradient, 6) AS gradient FROM l""",
)
def lags_and_rates(spark, sf_dir):
    v = F.col("value")
    out = wells(spark, sf_dir).withColumn("step", W.difference(v, in_well()))
    dmd, dz = F.col("md") - F.lag("md").over(in_well()), F.col("z") - F.lag("z").over(in_well())
    return rounded(out.select("well", "row_idx", W.lagged(v, in_well(), 5).alias("lag5"), W.lagged(v, in_well(), -15).alias("lead15"), "step", W.difference(F.col("step"), in_well()).alias("step2"), S.ratio(dz, dmd).alias("rate"), W.gradient(v, in_well()).alias("gradient")))


@query(
    "gap_filling",
    f"""WITH {WELLS_SQL}, f AS (SELECT well, row_idx, gr,
    last_value(gr IGNORE NULLS) OVER b AS x0, first_value(gr IGNORE NULLS) OVER a AS x1,
    last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER a AS i1
    FROM wells WINDOW b AS (PARTITION BY well ORDER BY row_idx ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY well ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT well, row_idx, round(CASE WHEN gr IS NOT NULL THEN gr WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN x0 + (x1 - x0) * (row_idx - i0) / (i1 - i0) ELSE coalesce(x0, x1) END, 6) AS linear,
    round(coalesce(x0, x1), 6) AS filled FROM f""",
)
def gap_filling(spark, sf_dir):
    g = F.col("gr")
    return rounded(wells(spark, sf_dir).select("well", "row_idx", W.interpolated(g, in_well(), F.col("row_idx"), back_in_well()).alias("linear"), W.edge_filled(g, in_well(), back_in_well()).alias("filled")))


@query(
    "heading_unwrapped",
    f"""WITH {WELLS_SQL}, h AS (SELECT well, row_idx, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS heading FROM wells WINDOW w AS (PARTITION BY well ORDER BY row_idx)),
    d AS (SELECT *, heading - lag(heading) OVER (PARTITION BY well ORDER BY row_idx) AS step FROM h)
    SELECT well, row_idx, round(heading, 6) AS heading, round(step - 2 * pi() * floor((step + pi()) / (2 * pi())), 6) AS turn FROM d""",
)
def heading_unwrapped(spark, sf_dir):
    out = wells(spark, sf_dir).withColumn("heading", F.atan2(F.col("y") - F.lag("y").over(in_well()), F.col("x") - F.lag("x").over(in_well())))
    return rounded(out.select("well", "row_idx", "heading", S.unwrapped_step(F.col("heading") - F.lag("heading").over(in_well())).alias("turn")))


@query(
    "group_broadcast",
    f"""WITH {WELLS_SQL} SELECT well, row_idx, round(avg(gr) OVER w, 6) AS gr_mean, round(stddev_samp(gr) OVER w, 6) AS gr_std, count(gr) OVER w AS gr_n, round(max(gr) OVER w - min(gr) OVER w, 6) AS gr_range
    FROM wells WINDOW w AS (PARTITION BY well)""",
)
def group_broadcast(spark, sf_dir):
    return rounded(sequence.broadcast_stats(wells(spark, sf_dir), "gr").select("well", "row_idx", "gr_mean", "gr_std", "gr_n", "gr_range"))


@query("last_rows", f"WITH {WELLS_SQL} SELECT well, row_idx, event_id, round(value, 6) AS value FROM wells QUALIFY row_number() OVER (PARTITION BY well ORDER BY row_idx DESC) <= 30")
def last_rows(spark, sf_dir):
    return rounded(sequence.last_rows(wells(spark, sf_dir), 30).select("well", "row_idx", "event_id", "value"))


@query(
    "evenly_spaced",
    f"""WITH {WELLS_SQL}, n AS (SELECT well, count(*) AS n FROM wells GROUP BY well),
    picks AS (SELECT DISTINCT well, CAST(floor(j * (n - 1) / 11.0::DOUBLE) AS BIGINT) AS row_idx FROM n, range(12) t(j) WHERE n > 12 UNION SELECT well, row_idx FROM wells JOIN n USING (well) WHERE n <= 12)
    SELECT well, row_idx, round(value, 6) AS value FROM wells JOIN picks USING (well, row_idx)""",
)
def evenly_spaced(spark, sf_dir):
    return rounded(sequence.evenly_spaced(wells(spark, sf_dir), 12).select("well", "row_idx", "value"))


@query(
    "cut_point_augmentation",
    f"""WITH {WELLS_SQL}, k AS (SELECT *, count(tvt_input) OVER (PARTITION BY well) AS known FROM wells)
    SELECT well, row_idx, aug_k, round(CASE WHEN NOT (aug_k >= 0 AND row_idx >= floor(known * aug_k)) THEN tvt_input END, 6) AS tvt_input, round(tvt_input, 6) AS truth
    FROM k, (VALUES (-1.0::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) c(aug_k) WHERE aug_k < 0 OR row_idx < known""",
)
def cut_point_augmentation(spark, sf_dir):
    return rounded(sequence.remasked(wells(spark, sf_dir), [0.5, 0.8]).select("well", "row_idx", "aug_k", "tvt_input", "truth"))


_SG = W.savgol_weights(11, 2)


def _savgol_sql() -> str:
    inner = " + ".join(f"({float(_SG[5][k])!r}) * lag(value, {5 - k}) OVER w" if k <= 5 else f"({float(_SG[5][k])!r}) * lead(value, {k - 5}) OVER w" for k in range(11))
    cases = []
    for p in range(5):
        first = " + ".join(f"({float(_SG[p][k])!r}) * nth_value(value, {k + 1}) OVER whole" for k in range(11))
        last = " + ".join(f"({float(_SG[10 - p][k])!r}) * nth_value(value, {k + 1}) OVER tail" for k in range(11))
        cases.append(f"WHEN row_idx = {p} THEN {first} WHEN row_idx = n - 1 - {p} THEN {last}")
    return f"""WITH {WELLS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY well) AS n FROM wells),
    t AS (SELECT *, row_idx >= n - 11 AS in_tail FROM c)
    SELECT well, row_idx, round(CASE {' '.join(cases)} ELSE {inner} END, 6) AS smooth FROM t
    WINDOW w AS (PARTITION BY well ORDER BY row_idx), whole AS (PARTITION BY well ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
    tail AS (PARTITION BY well, in_tail ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query("savitzky_golay", _savgol_sql())
def savitzky_golay(spark, sf_dir):
    return rounded(W.savgol(wells(spark, sf_dir), "value", "smooth", 11, 2, "well", "row_idx").select("well", "row_idx", "smooth"))


_MOMENTUM = f"""WITH {BASE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY row_idx DESC) AS back, count(*) OVER (PARTITION BY well) AS k FROM base WHERE is_known),
    m AS (SELECT well, max(k) AS k, max(CASE WHEN back = 1 THEN md END) AS md1, max(CASE WHEN back = least(20, k) THEN md END) AS md20, max(CASE WHEN back = least(5, k) THEN md END) AS md5,
    max(CASE WHEN back = 1 THEN tvt_input END) AS t1, max(CASE WHEN back = least(20, k) THEN tvt_input END) AS t20, max(CASE WHEN back = least(5, k) THEN tvt_input END) AS t5,
    max(CASE WHEN back = 1 THEN x END) AS x1, max(CASE WHEN back = least(20, k) THEN x END) AS x20, max(CASE WHEN back = 1 THEN y END) AS y1, max(CASE WHEN back = least(20, k) THEN y END) AS y20,
    max(CASE WHEN back = 1 THEN z END) AS z1, max(CASE WHEN back = least(20, k) THEN z END) AS z20 FROM r GROUP BY well),
    momentum AS (SELECT well, CASE WHEN abs(md1 - md20) > 1e-6 THEN (t1 - t20) / (md1 - md20) ELSE 0 END AS slope20, CASE WHEN abs(md1 - md5) > 1e-6 THEN (t1 - t5) / (md1 - md5) ELSE 0 END AS slope5,
    t1 - t20 AS rise20, CASE WHEN abs(md1 - md20) > 1e-6 THEN (x1 - x20) / (md1 - md20) ELSE 0 END AS dx, CASE WHEN abs(md1 - md20) > 1e-6 THEN (y1 - y20) / (md1 - md20) ELSE 0 END AS dy,
    CASE WHEN abs(md1 - md20) > 1e-6 THEN (z1 - z20) / (md1 - md20) ELSE 0 END AS dz FROM m)"""


@query(
    "trajectory_momentum",
    _MOMENTUM
    + """ SELECT well, round(slope20, 8) AS slope20, round(slope5, 8) AS slope5, round(slope20 - slope5, 8) AS curvature, round(rise20, 6) AS rise20,
    round(sqrt(dx * dx + dy * dy), 8) AS horizontal, round(atan2(dy, dx), 6) AS azimuth FROM momentum""",
)
def trajectory_momentum(spark, sf_dir):
    out = features.momentum(base(spark, sf_dir))
    return out.select("well", F.round("slope20", 8).alias("slope20"), F.round("slope5", 8).alias("slope5"), F.round("curvature", 8).alias("curvature"), F.round("rise20", 6).alias("rise20"), F.round("horizontal", 8).alias("horizontal"), F.round("azimuth", 6).alias("azimuth"))


@query(
    "geometric_extrapolation",
    _MOMENTUM
    + """ SELECT well, row_idx, round(slope20 * delta_md, 6) AS by20, round(slope5 * delta_md, 6) AS by5, round(slope20 * delta_md + 0.5 * (slope20 - slope5) * delta_md * delta_md, 1) AS curved,
    round(abs(slope20 * delta_md - slope5 * delta_md), 6) AS disagreement FROM base JOIN momentum USING (well) WHERE is_target""",
)
def geometric_extrapolation(spark, sf_dir):
    b = base(spark, sf_dir)
    out = features.extrapolated(b.filter("is_target"), features.momentum(b))
    return out.select("well", "row_idx", F.round("by20", 6).alias("by20"), F.round("by5", 6).alias("by5"), F.round("curved", 1).alias("curved"), F.round("disagreement", 6).alias("disagreement"))


@query(
    "rates_since_anchor",
    f"""WITH {BASE_SQL} SELECT well, row_idx, round(delta_x / d, 6) AS dx_rate, round(delta_z / d, 6) AS dz_rate, round(sqrt(delta_x * delta_x + delta_y * delta_y), 6) AS horizontal,
    round(atan2(delta_y, delta_x), 6) AS azimuth, round(hidden_length / n_rows, 6) AS hidden_frac, round(known_length / greatest(hidden_length, 1), 6) AS kh_ratio
    FROM (SELECT *, CASE WHEN delta_md < 1 THEN 1 ELSE delta_md END AS d FROM base) WHERE is_target""",
)
def rates_since_anchor(spark, sf_dir):
    out = features.since_anchor(base(spark, sf_dir).filter("is_target"))
    return rounded(out.select("well", "row_idx", "dx_rate", "dz_rate", "horizontal", "azimuth", "hidden_frac", "kh_ratio"))


@query(
    "gamma_stats",
    f"""WITH {BASE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY well ORDER BY row_idx DESC) AS back FROM base WHERE is_known AND gr IS NOT NULL),
    s AS (SELECT well, avg(gr) AS mean, stddev_pop(gr) AS sd, avg(gr) FILTER (back <= 20) AS last20, (arg_max(gr, row_idx) - arg_min(gr, row_idx)) / greatest(max(row_idx) - min(row_idx), 1) AS trend, count(*) AS n FROM k GROUP BY well),
    a AS (SELECT avg(gr) AS mean FROM base WHERE is_known)
    SELECT w.well, round(coalesce(s.mean, a.mean), 6) AS mean, round(coalesce(sd, 0), 6) AS sd, round(coalesce(last20, a.mean), 6) AS last20, round(coalesce(trend, 0), 6) AS trend, round(coalesce(n, 0) / w.known, 6) AS availability
    FROM (SELECT well, max(known_length) AS known FROM base GROUP BY well) w LEFT JOIN s USING (well), a""",
)
def gamma_stats(spark, sf_dir):
    return rounded(features.gamma_stats(base(spark, sf_dir)))


@query(
    "gamma_rows",
    f"""WITH {BASE_SQL}, s AS (SELECT well, avg(gr) AS mean, stddev_pop(gr) AS sd FROM base WHERE is_known GROUP BY well),
    f AS (SELECT b.well, row_idx, coalesce(gr, mean) AS g, mean, sd FROM base b JOIN s USING (well))
    SELECT well, row_idx, round(g, 7) AS filled, round(g - mean, 7) AS deviation, round(CASE WHEN sd > 0 THEN (g - mean) / sd ELSE 0 END, 7) AS z_score FROM f""",
)
def gamma_rows(spark, sf_dir):
    return rounded(features.gamma_rows(base(spark, sf_dir)).drop("mean20"), 7)


@query(
    "tortuosity",
    f"""WITH {WELLS_SQL}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM wells WINDOW w AS (PARTITION BY well ORDER BY row_idx)),
    v AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len, lag(dx) OVER w AS ex, lag(dy) OVER w AS ey, lag(dz) OVER w AS ez FROM d WINDOW w AS (PARTITION BY well ORDER BY row_idx)),
    a AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS len0 FROM v)
    SELECT well, round(sum(len) / sqrt(pow(arg_max(x, row_idx) - arg_min(x, row_idx), 2) + pow(arg_max(y, row_idx) - arg_min(y, row_idx), 2) + pow(arg_max(z, row_idx) - arg_min(z, row_idx), 2)), 6) AS tortuosity,
    round(avg(CASE WHEN len * len0 > 0 THEN acos(greatest(least((dx * ex + dy * ey + dz * ez) / (len * len0), 1), -1)) END), 6) AS mean_bend,
    round(avg(CASE WHEN len > 0 THEN acos(greatest(least(abs(dz) / len, 1), -1)) END), 6) AS inclination FROM a GROUP BY well""",
)
def tortuosity(spark, sf_dir):
    return rounded(features.tortuosity(wells(spark, sf_dir)))


@query(
    "warm_up_ramp",
    f"""WITH {BASE_SQL} SELECT well, row_idx, round(tvt0 + (1 - exp(-greatest(delta_md, 0) / 85)) * (x - x0) / 10, 6) AS ramped FROM base WHERE is_target""",
)
def warm_up_ramp(spark, sf_dir):
    b = base(spark, sf_dir).filter("is_target")
    return rounded(b.select("well", "row_idx", (F.col("tvt0") + features.ramp(F.col("delta_md"), 85.0) * (F.col("x") - F.col("x0")) / 10).alias("ramped")))
