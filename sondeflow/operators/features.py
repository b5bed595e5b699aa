"""Feature families over sequences with segments and anchors (see `sequence`). Only known rows and rows' own positions enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.functions.scalars import clip, ratio
from sondeflow.operators import sequence
from sondeflow.operators.aggregates import exact_quantiles
from sondeflow.operators.sequence import INDEX, KEY, in_order, in_reverse


def momentum(base: DataFrame, far: int = 20, near: int = 5, key: str = KEY, index: str = INDEX) -> DataFrame:
    """Slopes of the target over the last `far` and `near` known rows, their difference, and the direction of travel; one row for each key.

    A stretch without progress in md has slope 0.
    """
    w = Window.partitionBy(key)
    known = base.filter("is_known").withColumn("__back", F.row_number().over(w.orderBy(F.desc(index)))).withColumn("__k", F.count(F.lit(1)).over(w))
    known = known.filter(F.col("__back") <= far)
    place = {"1": F.lit(1), "f": F.least(F.lit(far), F.col("__k")), "n": F.least(F.lit(near), F.col("__k"))}
    cols = {"md": "md", "t": "tvt_input", "x": "x", "y": "y", "z": "z"}
    picked = [F.max(F.when(F.col("__back") == at, F.col(c))).alias(f"__{n}{p}") for n, c in cols.items() for p, at in place.items()]
    g = known.groupBy(key).agg(*picked)

    def slope(n: str, p: str) -> Column:
        run = F.col("__md1") - F.col(f"__md{p}")
        return F.when(F.abs(run) > 1e-6, (F.col(f"__{n}1") - F.col(f"__{n}{p}")) / run).otherwise(F.lit(0.0))

    dx, dy = slope("x", "f"), slope("y", "f")
    return g.select(
        key, slope("t", "f").alias("slope20"), slope("t", "n").alias("slope5"), (slope("t", "f") - slope("t", "n")).alias("curvature"), (F.col("__t1") - F.col("__tf")).alias("rise20"),
        dx.alias("dx_md"), dy.alias("dy_md"), slope("z", "f").alias("dz_md"), F.sqrt(dx * dx + dy * dy).alias("horizontal"), F.atan2(dy, dx).alias("azimuth"),
    )


def extrapolated(rows: DataFrame, slopes: DataFrame, key: str = KEY) -> DataFrame:
    """Deltas from the anchor by the known slopes: straight by either, and curved."""
    d = F.col("delta_md")
    out = rows.join(slopes.select(key, "slope20", "slope5", "curvature"), key)
    return out.withColumns({"by20": F.col("slope20") * d, "by5": F.col("slope5") * d, "curved": F.col("slope20") * d + 0.5 * F.col("curvature") * d * d}).withColumn("disagreement", F.abs(F.col("by20") - F.col("by5")))


def since_anchor(rows: DataFrame) -> DataFrame:
    """Rates per md since the anchor (md below 1 counts as 1), horizontal displacement and direction, and the lengths' ratios."""
    d = F.when(F.col("delta_md") < 1, F.lit(1.0)).otherwise(F.col("delta_md"))
    dx, dy = F.col("delta_x"), F.col("delta_y")
    return rows.withColumns({
        "dx_rate": dx / d, "dy_rate": dy / d, "dz_rate": F.col("delta_z") / d, "horizontal": F.sqrt(dx * dx + dy * dy), "azimuth": F.atan2(dy, dx),
        "hidden_frac": F.col("hidden_length") / F.col("n_rows"), "kh_ratio": F.col("known_length") / F.greatest(F.col("hidden_length"), F.lit(1)),
    })


def gamma_stats(base: DataFrame, key: str = KEY, index: str = INDEX) -> DataFrame:
    """Level, spread, last-20 level, end-to-end trend and availability of gr over known rows; keys without any take the mean of all."""
    seen = base.filter("is_known AND gr IS NOT NULL").withColumn("__back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(index))))
    g = seen.groupBy(key).agg(
        F.avg("gr").alias("mean"), F.stddev_pop("gr").alias("sd"), F.avg(F.when(F.col("__back") <= 20, F.col("gr"))).alias("last20"), F.count("*").alias("n"),
        ((F.max_by("gr", index) - F.min_by("gr", index)) / F.greatest(F.max(index) - F.min(index), F.lit(1))).alias("trend"),
    )
    all_ = F.broadcast(base.filter("is_known").agg(F.avg("gr").alias("all_mean")))
    keys = base.groupBy(key).agg(F.max("known_length").alias("known"))
    out = keys.join(g, key, "left").join(all_)
    return out.select(key, F.coalesce("mean", "all_mean").alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"), F.coalesce("last20", "all_mean").alias("last20"), F.coalesce("trend", F.lit(0.0)).alias("trend"), ratio(F.coalesce("n", F.lit(0)), F.col("known")).alias("availability"))


def gamma_rows(base: DataFrame, key: str = KEY, index: str = INDEX) -> DataFrame:
    """Rows with gr filled by the known level, its deviation, z-score and trailing mean. One window exchange: no join."""
    w = Window.partitionBy(key)
    known = F.when(F.col("is_known"), F.col("gr"))
    out = base.withColumn("mean", F.avg(known).over(w)).withColumn("sd", F.stddev_pop(known).over(w)).withColumn("filled", F.coalesce("gr", "mean"))
    dev = F.col("filled") - F.col("mean")
    z = F.when(F.col("sd") > 0, dev / F.col("sd")).otherwise(F.lit(0.0))
    return out.select(key, index, "filled", dev.alias("deviation"), z.alias("z_score"), F.avg("filled").over(in_order(key, index).rowsBetween(-19, 0)).alias("mean20"))


def tortuosity(rows: DataFrame, key: str = KEY, index: str = INDEX) -> DataFrame:
    """Path length over the straight distance, mean bend between successive steps, and mean angle of steps to the vertical."""
    w = in_order(key, index)
    out = rows.withColumns({f"d{c}": F.col(c) - F.lag(c).over(w) for c in "xyz"})
    out = out.withColumns({f"e{c}": F.lag(f"d{c}").over(w) for c in "xyz"})
    length = lambda p: F.sqrt(sum((F.col(p + c) * F.col(p + c) for c in "yz"), F.col(p + "x") * F.col(p + "x")))
    out = out.withColumns({"len": length("d"), "len0": length("e")})
    dot = F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey") + F.col("dz") * F.col("ez")
    both = F.col("len") * F.col("len0")
    bend = F.when(both > 0, F.acos(clip(dot / F.nullif(both, F.lit(0.0)), -1.0, 1.0)))
    tilt = F.when(F.col("len") > 0, F.acos(clip(F.abs("dz") / F.nullif("len", F.lit(0.0)), -1.0, 1.0)))
    span = F.sqrt(sum((F.pow(F.max_by(c, index) - F.min_by(c, index), F.lit(2)) for c in "yz"), F.pow(F.max_by("x", index) - F.min_by("x", index), F.lit(2))))
    return out.groupBy(key).agg(ratio(F.sum("len"), span).alias("tortuosity"), F.avg(bend).alias("mean_bend"), F.avg(tilt).alias("inclination"))


def ramp(md_since: Column, tau: float) -> Column:
    """1 - exp(-md / tau), 0 before the anchor."""
    return 1 - F.exp(-F.greatest(md_since, F.lit(0.0)) / tau)


def shape_labels(stats: DataFrame, columns: dict[str, str], low: float = 0.33, high: float = 0.67) -> DataFrame:
    """A label low, mid or high for each column by the quantiles of all keys, and the labels joined. columns: source to label name."""
    out = stats
    for c, name in columns.items():
        a, b = (F.lit(v).cast("double") for v in exact_quantiles(stats, c, [low, high]))
        out = out.withColumn(name, F.when(F.col(c) <= a, "low").when(F.col(c) <= b, "mid").when(F.col(c).isNotNull(), "high"))
    return out.withColumn("shape", F.concat_ws("-", *columns.values()))


def calibration(rows: DataFrame, y: str, reference: str, key: str = KEY, least: int = 10) -> DataFrame:
    """How a sequence's gr relates to its reference curve over known rows: correlation, mean offset, ratio of spreads; null with fewer than `least` pairs."""
    ok = F.col(y).isNotNull() & F.col(reference).isNotNull()
    g = rows.filter(ok).groupBy(key).agg(F.count("*").alias("n"), F.corr(y, reference).alias("corr"), F.avg(F.col(y) - F.col(reference)).alias("offset"), F.stddev_pop(y).alias("__a"), F.stddev_pop(reference).alias("__b"))
    enough = F.col("n") >= least
    return g.select(key, "n", F.when(enough, F.col("corr")).alias("corr"), F.when(enough, F.col("offset")).alias("offset"), F.when(enough, ratio(F.col("__a"), F.col("__b"))).alias("scale"))


def inverted(deviation: Column, slope: Column, limit: float = 150.0, reliable: float = 0.2) -> Column:
    """First-order inversion -deviation / slope, held to the limit; 0 where the slope is too flat to trust."""
    return F.when(F.abs(slope) >= reliable, clip(-deviation / F.nullif(slope, F.lit(0.0)), -limit, limit)).otherwise(F.lit(0.0))


def holdout_slopes(base: DataFrame, fraction: float, key: str = KEY, index: str = INDEX) -> DataFrame:
    """A line over the first part of the known rows and its mean error over the rest of them: how far a key's own past foretells."""
    known = base.filter("is_known").withColumn("__first", F.col(index) < F.floor(F.col("known_length") * fraction))
    x, y = F.when(F.col("__first"), F.col("md")), F.when(F.col("__first"), F.col("tvt_input"))
    fit = known.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    rest = known.filter(~F.col("__first")).join(fit, key)
    return rest.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("slope") * F.col("md") + F.col("intercept") - F.col("tvt_input")).alias("bias"))


def window_costs(rows: DataFrame, value: str, guess: Column, offsets: list[float], reach: int, key: str = KEY, index: str = INDEX) -> DataFrame:
    """For each row the offset with the least mean squared residual over rows -reach .. reach - 1, the first of equals. guess(offset column) is the
    reference at that offset; rows spread over offsets, so the windows of all offsets share one exchange."""
    out = rows.select("*", F.posexplode(F.array(*(F.lit(float(o)) for o in offsets))).alias("__k", "offset"))
    d = F.col(value) - guess
    w = Window.partitionBy(key, "__k").orderBy(index).rowsBetween(-reach, reach - 1)
    cost = out.withColumn("cost", F.avg(d * d).over(w))
    best = F.min(F.struct(F.round("cost", 9).alias("cost"), "__k", "offset"))
    return cost.filter(F.col("cost").isNotNull()).groupBy(key, index).agg(best.alias("b")).select(key, index, F.col("b.offset").alias("offset"), F.col("b.cost").alias("cost"))


def physical(base: DataFrame, key: str = KEY) -> DataFrame:
    """Target rows with four extrapolations of the target from the known part: held; by the slope to z; by the slopes to z and md of the last rows
    (plane); and held along the structure (target + z constant)."""
    from sondeflow.operators.aggregates import line_fit, plane_fit

    known = base.filter("is_known")
    by_z = line_fit(known, "tvt_input", "z", [key]).select(key, F.col("slope").alias("__sz"))
    plane = plane_fit(known, "tvt_input", "z", "md", [key]).select(key, F.col("ca").alias("__pz"), F.col("cb").alias("__pm"))
    out = base.filter("is_target").join(by_z, key, "left").join(plane, key, "left")
    flat = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumns({
        "held": F.col("tvt0"), "sloped": F.col("tvt0") + flat(F.col("__sz")) * F.col("delta_z"), "planar": F.col("tvt0") + flat(F.col("__pz")) * F.col("delta_z") + flat(F.col("__pm")) * F.col("delta_md"), "structural": F.col("tvt0") - F.col("delta_z"),
    }).drop("__sz", "__pz", "__pm")


def lateral(base: DataFrame, near: int = 30, far: int = 50, least: int = 30, md: str = "md", z: str = "z", given: str = "tvt_input", key: str = KEY, index: str = INDEX) -> DataFrame:
    """Target rows with the extrapolations of the last known rows alone, from the last of them: `by_md` and `by_z` by the lines over the last `near` rows,
    `by_steps` by the median step of the target over md of the last `far` steps, `held`, and `lateral`, the mean of the first three.

    A flat spread (deviation to 1e-6) has slope 0, a step without md counts as one of 1e-6, and keys with fewer than `least` known rows are held; with
    none they are held at 0. A null md or z on a target row gives null there. One exchange by key serves the ranks, the steps and the join back."""
    last = F.row_number().over(in_reverse(key, index))
    step = lambda c: F.col(c) - F.lead(c).over(in_reverse(key, index))
    known = base.filter(F.col("is_known") & F.col(given).isNotNull()).withColumns({"__last": last, "__dy": step(given), "__dm": step(md)})
    rate = F.col("__dy") / F.when(F.col("__dm") == 0, F.lit(1e-6)).otherwise(F.col("__dm"))
    line = lambda x: F.when(F.stddev_pop(F.when(F.col("__last") <= near, F.col(x))) > 1e-6, F.regr_slope(F.when(F.col("__last") <= near, F.col(given)), F.col(x)))
    end = lambda c: F.max(F.when(F.col("__last") == 1, F.col(c)))
    fits = known.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), line(md).alias("__by_md"), line(z).alias("__by_z"), F.percentile(F.when(F.col("__last") <= far, rate), 0.5).alias("__rate"),
        end(given).alias("__y"), end(md).alias("__md"), end(z).alias("__z"),
    )
    out = base.filter("is_target").join(fits, key, "left").withColumn("held", F.coalesce("__y", F.lit(0.0)))
    enough = F.coalesce(F.col("__n") >= least, F.lit(False))
    moved = lambda slope, x: F.when(enough, F.col("held") + F.coalesce(F.col(slope), F.lit(0.0)) * (F.col(x) - F.col(f"__{x}_end"))).otherwise(F.col("held"))
    out = out.withColumnsRenamed({"__md": f"__{md}_end", "__z": f"__{z}_end"})
    out = out.withColumns({"by_md": moved("__by_md", md), "by_z": moved("__by_z", z), "by_steps": moved("__rate", md)})
    mean = (F.col("by_md") + F.col("by_z") + F.col("by_steps")) / 3
    return out.withColumn("lateral", mean).drop("__n", "__by_md", "__by_z", "__rate", "__y", f"__{md}_end", f"__{z}_end")


def from_contacts(rows: DataFrame, formation: str, z: str, reference: str, known: str, target: str, key: str = KEY) -> DataFrame:
    """reference - (z - formation) plus the mean offset to the target over KNOWN rows only; hidden targets never enter."""
    raw = rows.withColumn("__raw", F.col(reference) - (F.col(z) - F.col(formation)))
    off = F.avg(F.when(F.col(known), F.col(target) - F.col("__raw"))).over(Window.partitionBy(key))
    return raw.withColumn("contact", F.col("__raw") + F.coalesce(off, F.lit(0.0))).drop("__raw")


def wide(base: DataFrame, knots: DataFrame | None = None, offsets: tuple[float, ...] = (-30.0, -10.0, 0.0, 10.0, 30.0), key: str = KEY, index: str = INDEX) -> DataFrame:
    """Target rows with all families at once: rates since the anchor, extrapolations, levels and spreads of gr, rolls, lags and steps, and (with knots, one
    row a key) residuals against the curve at offsets around three references. Windows run over whole sequences before hidden rows are taken; all
    share one exchange."""
    from sondeflow.operators import curves as C
    from sondeflow.operators import windows as W

    w, every = in_order(key, index), Window.partitionBy(key)
    known_gr = F.when(F.col("is_known"), F.col("gr"))
    out = base.withColumn("g", W.interpolated(F.col("gr"), w, F.col(index), in_reverse(key, index)))
    out = out.withColumns({"gr_mean": F.avg(known_gr).over(every), "gr_sd": F.stddev_pop(known_gr).over(every)})
    g = F.col("g")
    rolls = {f"mean{n}": W.rolling_mean(g, w, n, centred=True) for n in (5, 21, 51)} | {f"std{n}": W.rolling_std(g, w, n, centred=True, fill=0.0) for n in (5, 21, 51)}
    lags = {f"lag{k}": W.lagged(g, w, k) for k in (1, 5, 15)} | {f"lead{k}": W.lagged(g, w, -k) for k in (1, 5, 15)}
    more = {"top21": W.envelope(g, w, 21), "rms21": W.energy(g, w, 21), "step": W.difference(g, w), "slope": W.gradient(g, w), "dz": F.col("z") - F.lag("z").over(w), "dmd": F.col("md") - F.lag("md").over(w)}
    out = out.withColumns(rolls | lags | more)
    out = out.withColumn("dip", ratio(F.col("dz"), F.col("dmd"))).withColumn("gr_dev", g - F.col("gr_mean")).withColumn("gr_z", ratio(g - F.col("gr_mean"), F.col("gr_sd")))
    out = since_anchor(extrapolated(out.filter("is_target"), momentum(base, key=key, index=index), key))
    if knots is None:
        return out
    out = out.join(knots.select(key, "knots"), key, "left")
    places = {"anchor": F.col("tvt0"), "by20": F.col("tvt0") + F.col("by20"), "by5": F.col("tvt0") + F.col("by5")}
    probes = {f"probe_{n}_{k}": g - C.lookup(F.col("knots"), at + F.lit(float(o))) for n, at in places.items() for k, o in enumerate(offsets)}
    return out.withColumns(probes).drop("knots")


def row_bends(rows: DataFrame, key: str = KEY, index: str = INDEX) -> DataFrame:
    """The angle in degrees between the steps into and out of each row; 0 at both ends and where a step has no length."""
    w = in_order(key, index)
    a = {c: F.col(c) - F.lag(c).over(w) for c in "xyz"}
    b = {c: F.lead(c).over(w) - F.col(c) for c in "xyz"}
    out = rows.withColumns({f"__a{c}": v for c, v in a.items()} | {f"__b{c}": v for c, v in b.items()})
    dot = lambda p, q: F.col(f"__{p}x") * F.col(f"__{q}x") + F.col(f"__{p}y") * F.col(f"__{q}y") + F.col(f"__{p}z") * F.col(f"__{q}z")
    both = F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))
    bend = F.degrees(F.acos(clip(dot("a", "b") / F.nullif(both, F.lit(0.0)), -1.0, 1.0)))
    return out.withColumn("bend", F.coalesce(F.when(both > 0, bend), F.lit(0.0))).drop(*(f"__{p}{c}" for p in "ab" for c in "xyz"))


def disagreement(rows: DataFrame, a: str, b: str, key: str = KEY, index: str = INDEX) -> DataFrame:
    """How two predictions differ: at the row, its mean and deviation over the key, and what else tells sequences apart (spread of z and gr, rows, place)."""
    every = Window.partitionBy(key)
    d = F.abs(F.col(a) - F.col(b))
    out = rows.withColumn("disagree", d)
    return out.withColumns({
        "dis_mean": F.avg("disagree").over(every), "dis_std": F.coalesce(F.stddev_samp("disagree").over(every), F.lit(0.0)), "z_span": F.max("z").over(every) - F.min("z").over(every),
        "gr_std": F.coalesce(F.stddev_samp("gr").over(every), F.lit(0.0)), "n_hidden": F.count(F.lit(1)).over(every), "md_since": F.log1p(F.greatest(F.col("md") - F.col("md0"), F.lit(0.0))),
        "place": (F.row_number().over(in_order(key, index)) - 1) / F.count(F.lit(1)).over(every),
    })


def structural_planes(base: DataFrame, near: int = 300, limit: float = 200.0, least: int = 6, key: str = KEY, index: str = INDEX) -> DataFrame:
    """Target rows with what planes of the target over x, y, z say, less the anchor and held to the limit: fitted to all known rows, and to the last `near`
    of them; where neither fits, -z for the first and the first for the second. And how far they lie apart."""
    from sondeflow.operators.aggregates import regression

    known = base.filter("is_known").withColumn("__back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(index))))
    xs = ["x", "y", "z"]
    full = regression(known, "tvt_input", xs, [key], least).select(key, F.col("r2").alias("plane_r2"), F.col("c0").alias("__f0"), *(F.col(f"c_{c}").alias(f"__f{c}") for c in xs))
    local = regression(known.filter(F.col("__back") <= near), "tvt_input", xs, [key], least).select(key, F.col("c0").alias("__l0"), *(F.col(f"c_{c}").alias(f"__l{c}") for c in xs))
    out = base.filter("is_target").join(full, key, "left").join(local, key, "left")
    at = lambda p: F.col(f"__{p}0") + F.col(f"__{p}x") * F.col("x") + F.col(f"__{p}y") * F.col("y") + F.col(f"__{p}z") * F.col("z")
    whole = F.coalesce(at("f"), -F.col("z"))
    out = out.withColumn("plane_full", clip(whole - F.col("tvt0"), -limit, limit)).withColumn("plane_local", clip(F.coalesce(at("l"), whole) - F.col("tvt0"), -limit, limit))
    return out.withColumn("plane_apart", F.abs(F.col("plane_full") - F.col("plane_local"))).drop(*(f"__{p}{c}" for p in "fl" for c in ("0", *xs)))


def anchor_calibration(rows: DataFrame, knots: str, anchor: str, y: str = "gr", given: str = "tvt_input", key: str = KEY, index: str = INDEX, least: int = 10) -> DataFrame:
    """calibration against the key's curve (column `knots`) at the known target, with the mean difference over the last 20 such rows, the curve's value at the
    anchor, and its slope there over half a unit either way; 0 in place of what fewer than `least` rows would give."""
    from sondeflow.operators import curves as C

    seen = rows.filter(F.col(given).isNotNull() & F.col(y).isNotNull()).withColumn("__ref", C.lookup(F.col(knots), F.col(given), "extrapolate"))
    seen = seen.withColumn("__back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(index))))
    late = seen.groupBy(key).agg(F.avg(F.when(F.col("__back") <= 20, F.col(y) - F.col("__ref"))).alias("last20"))
    fit = calibration(seen, y, "__ref", key, least)
    at = lambda o: C.lookup(F.col(knots), F.col(anchor) + o, "extrapolate")
    here = rows.groupBy(key).agg(F.first(anchor).alias(anchor), F.first(knots).alias(knots)).select(key, at(0.0).alias("at_anchor"), (at(0.5) - at(-0.5)).alias("slope"))
    out = here.join(fit, key, "left").join(late, key, "left")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= least
    zero = lambda c: F.when(enough, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), zero("corr"), zero("offset"), zero("scale"), zero("last20"), "at_anchor", "slope", F.abs("slope").alias("steepness"))


def alignment(rows: DataFrame, curve: DataFrame, centre: str, key: str = KEY, index: str = INDEX, band: float = 30.0, reach: float = 15.0, step: float = 0.5, width: int = 60) -> DataFrame:
    """How hidden gr fits the curve along a path: key, index, residual, local, offset, gain; a task for each key.

    gr is first equalised by a line fitted to the known rows (10 at least). offset: the shift of the whole path, within `band`, with the least mean absolute
    residual, and gain, what it saves over no shift (8 rows at least). local: for each row the shift within `reach` that is best over the `width` rows around it
    (where there are as many). Everything is 0 where too few rows have gr. rows: known and hidden rows with gr, tvt_input, is_target and `centre`; curve: key, x, y.
    """
    import numpy as np
    import pandas as pd

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [key, index, "residual", "local", "offset", "gain"]
        left = left.sort_values(index, kind="stable")
        hidden = left[left["is_target"]]
        out = pd.DataFrame({key: hidden[key], index: hidden[index], "residual": 0.0, "local": 0.0, "offset": 0.0, "gain": 0.0})[names]
        knots = right.dropna().groupby("x")["y"].mean().sort_index()
        if hidden.empty or len(knots) < 2:
            return out
        x, y = knots.index.to_numpy(float), knots.to_numpy(float)
        known = left[left["tvt_input"].notna() & left["gr"].notna()]
        a, b = 1.0, 0.0
        if len(known) >= 10:
            ref = np.interp(known["tvt_input"].to_numpy(float), x, y)
            if ref.std() > 0:
                a, b = np.polyfit(ref, known["gr"].to_numpy(float), 1)
            if abs(a) < 1e-3 or ref.std() == 0:
                a, b = 1.0, 0.0
        seen = hidden["gr"].notna().to_numpy()
        if seen.sum() < 8:
            return out
        equal, at = (hidden["gr"].to_numpy(float)[seen] - b) / a, hidden[centre].to_numpy(float)[seen]
        shifts = np.arange(-band, band + step / 2, step)
        cost = np.abs(equal[:, None] - np.interp(at[:, None] + shifts, x, y)).mean(axis=0)
        best = int(np.round(cost, 9).argmin())
        out["offset"], out["gain"] = shifts[best], cost[len(shifts) // 2] - cost[best]
        residual, local = np.zeros(len(hidden)), np.zeros(len(hidden))
        residual[seen] = equal - np.interp(at, x, y)
        if seen.sum() >= width:
            near = np.arange(-reach, reach + step / 2, step)
            sums = np.concatenate((np.zeros((1, len(near))), np.cumsum(np.abs(equal[:, None] - np.interp(at[:, None] + near, x, y)), axis=0)))
            i = np.arange(len(equal))
            lo, hi = np.maximum(i - width // 2, 0), np.minimum(i + width // 2, len(equal))
            local[seen] = near[np.round((sums[hi] - sums[lo]) / (hi - lo)[:, None], 9).argmin(axis=1)]
        out["residual"], out["local"] = residual, local
        return out

    kind = dict(rows.dtypes)
    given = curve.select(F.col(key).alias("__key"), "x", "y")
    picked = rows.select(key, index, "gr", "tvt_input", "is_target", centre)
    schema = f"{key} {kind[key]}, {index} {kind[index]}, residual double, local double, offset double, gain double"
    return sequence.dealt(picked, key).groupBy(key).cogroup(sequence.dealt(given, "__key").groupBy("__key")).applyInPandas(run, schema)


def wide_with_paths(base: DataFrame, knots: DataFrame, paths: dict[str, DataFrame], surfaces: DataFrame | None = None, key: str = KEY, index: str = INDEX) -> DataFrame:
    """`wide` with trackers' paths (key, index, guess) as differences from the anchor, their spread, and (with surfaces: key, index, columns) surfaces less z."""
    out = wide(base, knots, key=key, index=index)
    for name, path in paths.items():
        out = out.join(path.select(key, index, F.col("guess").alias(f"__{name}")), [key, index], "left")
    if surfaces is not None:
        rest = [c for c in surfaces.columns if c not in (key, index)]
        out = out.join(surfaces, [key, index], "left").withColumns({f"{c}_over_z": F.col(c) - F.col("z") for c in rest}).drop(*rest)
    names = [F.col(f"__{n}") for n in paths]
    mean = sum(names[1:], names[0]) / len(names)
    spread = F.sqrt(sum(((c - mean) * (c - mean) for c in names[1:]), (names[0] - mean) * (names[0] - mean)) / len(names))
    return out.withColumn("path_spread", spread).withColumns({f"{n}_delta": F.col(f"__{n}") - F.col("tvt0") for n in paths}).drop(*(f"__{n}" for n in paths))
