"""Aggregates: error metrics, slices, bins, distributions, regressions. All combine on the map side unless a percentile is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeflow.functions.scalars import half_even, ratio
from sondeflow.sources.staging import staged


def rmse(truth: Column, guess: Column) -> Column:
    return F.sqrt(F.avg((guess - truth) * (guess - truth)))


def error_metrics(truth: Column, guess: Column, prefix: str = "") -> list[Column]:
    """rmse, mae, bias and 95th percentile of the absolute error."""
    e = guess - truth
    return [F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"), F.avg(F.abs(e)).alias(f"{prefix}mae"), F.avg(e).alias(f"{prefix}bias"), F.percentile(F.abs(e), F.lit(0.95)).alias(f"{prefix}p95")]


def slice_report(df: DataFrame, keys: list[str], truth: str, guess: str, anchor: str, entity: str) -> DataFrame:
    """Rows, entities, metrics of a prediction and of the anchor, and how much the prediction gains, for each value of keys."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    out = g.agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_wells"), *error_metrics(F.col(truth), F.col(guess), "model_"), *error_metrics(F.col(truth), F.col(anchor), "anchor_"))
    return out.withColumn("rmse_improvement", F.col("anchor_rmse") - F.col("model_rmse")).withColumn("mae_improvement", F.col("anchor_mae") - F.col("model_mae"))


def sliced_all_ways(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """One report over each key alone and over all rows, from one pass (grouping sets); absent keys are null."""
    cols = [F.col(k) for k in keys]
    out = df.groupingSets([[c] for c in cols] + [[]], *cols).agg(F.grouping_id().alias("slice"), F.count("*").alias("n_rows"), rmse(F.col(truth), F.col(guess)).alias("rmse"))
    return out.select(*keys, "slice", "n_rows", "rmse")


def in_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with __part and __at: sorted parts that follow each other in a total order, and each row's place in its part from 1. Written, so that the
    parts stay as they are."""
    parted = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    return parted.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))


def _before(parted: DataFrame, *sums: Column) -> DataFrame:
    """For each part the rows (__rows) and the sums (__s0, ...) of the parts before it; the table has a row for each part."""
    per = parted.groupBy("__part").agg(F.count("*").alias("__n"), *(c.alias(f"__t{k}") for k, c in enumerate(sums)))
    past = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("__part", *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(n) for c, n in (("__n", "__rows"), *((f"__t{k}", f"__s{k}") for k in range(len(sums))))))


#: Distinct values among which a quantile is picked in one task, and the sketch's accuracy.
BRACKET, ACCURACY = 100_000, 10_000


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each named share: quantiles of `column` for each key, linear between neighbours; exact, and no task holds a key's values.

    Each wanted rank of each key gets a bracket of values. A pass counts the distinct values in the brackets, which a hot key spreads over all tasks; a bracket
    with more than BRACKET of them is narrowed by the quantile sketch of what lies in it, whose error is known, and counted again. Nulls and NaN do not count; a key
    without values has nulls. With no keys there is one row.
    """
    names = list(shares)
    x = F.col(column).cast("double")
    values = staged(df.select(*keys, F.when(~F.isnan(x), x).alias("__x")))
    per = values.groupBy(*keys).agg(F.count("__x").alias("__n"))
    ranks = [(F.floor(F.lit(float(shares[n])) * (F.col("__n") - 1)), k, side) for k, n in enumerate(names) for side in (0, 1)]
    wanted = F.explode(F.array(*(F.struct(F.lit(2 * k + side).alias("j"), F.least(r + side, F.col("__n") - 1).alias("rank")) for r, k, side in ranks)))
    # One bracket for each rank: its values from lo to hi, `below` rows before them.
    state = per.filter("__n > 0").select(*keys, wanted.alias("w")).select(*keys, "w.*", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("below"))
    on = [*keys, "j"]
    for _ in range(20):
        state = staged(state)
        met = values.filter("__x IS NOT NULL").join(state, keys) if keys else values.filter("__x IS NOT NULL").join(F.broadcast(state))
        inside = (F.col("lo").isNull() | (F.col("__x") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("__x") <= F.col("hi")))
        sizes = met.filter(inside).groupBy(*on, "rank", "below").agg(F.count("*").alias("m"), F.approx_count_distinct("__x").alias("kinds"))
        wide = sizes.filter(F.col("kinds") > BRACKET)
        if wide.isEmpty():
            break
        share = (F.col("rank") - F.col("below")) / F.greatest(F.col("m") - 1, F.lit(1))
        many = staged(wide.select(*on, share.alias("share")))
        # A sketch for every bracket that is too wide, cut at the shares of all ranks: the pieces next to the rank's own share, two errors to each side.
        cuts = [k / 64 for k in range(65)]
        sketch = met.filter(inside).join(many, on, "left_semi").groupBy(*on).agg(F.percentile_approx("__x", cuts, ACCURACY).alias("cuts"))
        reach = 2.0 / ACCURACY
        place = lambda s: F.greatest(F.lit(1), F.least(F.lit(65), s)).cast("int")
        near = sketch.join(many, on).select(*on, F.element_at("cuts", place(F.floor((F.col("share") - reach) * 64) + 1)).alias("a"), F.element_at("cuts", place(F.ceil((F.col("share") + reach) * 64) + 1)).alias("b"))
        cut = state.join(near, on, "left").withColumns({"lo": F.coalesce(F.when(F.col("a") > F.coalesce("lo", F.lit(float("-inf"))), F.col("a")), "lo"), "hi": F.coalesce("b", "hi")}).drop("a", "b")
        cut = staged(cut)
        before = values.filter("__x IS NOT NULL").join(cut, keys) if keys else values.filter("__x IS NOT NULL").join(F.broadcast(cut))
        below = before.groupBy(*on).agg(F.count_if(F.col("__x") < F.col("lo")).alias("below"))
        state = cut.drop("below").join(below, on)
    counts = met.filter(inside).groupBy(*on, "rank", "below", "__x").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*on).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("__upto", upto).filter((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("c")))
    at = {j: F.max(F.when(F.col("j") == j, F.col("__x"))) for j in range(2 * len(names))}
    wide = found.groupBy(*keys).agg(*(c.alias(f"__{j}") for j, c in at.items()))
    every = per.join(wide, keys, "left") if keys else per.join(F.broadcast(wide), F.lit(True), "left")
    out = []
    for k, n in enumerate(names):
        a, b = F.col(f"__{2 * k}"), F.col(f"__{2 * k + 1}")
        part = F.lit(float(shares[n])) * (F.col("__n") - 1)
        part = part - F.floor(part)
        out.append(F.when(part == 0, a).otherwise((1 - part) * a + part * b).alias(n))
    return every.select(*keys, *out)


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles of a whole column (see quantiles); None without values."""
    return list(quantiles(df, [], column, {f"q{k}": q for k, q in enumerate(shares)}).first())


def quantile_edges(df: DataFrame, column: str, parts: int) -> DataFrame:
    """One row: the array of inner and outer quantiles at k / parts."""
    edges = exact_quantiles(df, column, [k / parts for k in range(parts + 1)])
    return df.sparkSession.createDataFrame([(edges,)], "edges array<double>")


def quantile_bins(df: DataFrame, column: str, name: str, parts: int) -> DataFrame:
    """Bin number by quantiles, bins closed on the right, the first on both sides."""
    edges = F.broadcast(quantile_edges(df, column, parts))
    out = df.join(edges)
    below = F.aggregate(F.slice("edges", 2, parts - 1), F.lit(0), lambda n, e: n + F.when(F.col(column) > e, 1).otherwise(0))
    return out.withColumn(name, F.when(F.col(column).isNotNull(), below)).drop("edges")


def shares(df: DataFrame, key: str) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    return counts.join(total).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def described(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each key that has rows."""
    x = F.col(column)
    told = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    q = quantiles(df, keys, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return told.join(q, keys).select(*keys, "n", "mean", "std", "lo", "q25", "q50", "q75", "hi")


def median_deviation(df: DataFrame, column: str, key: str) -> DataFrame:
    """Median, and median absolute deviation from it, for each key."""
    mid = staged(quantiles(df, [key], column, {"median": 0.5}))
    off = df.join(mid, key).select(key, F.abs(F.col(column) - F.col("median")).alias("__off"))
    return mid.join(quantiles(off, [key], "__off", {"mad": 0.5}), key)


def histogram(df: DataFrame, column: str, keys: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal-width bins, the last closed on the right; values outside are left out."""
    x = F.col(column)
    at = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1))
    return df.filter((x >= low) & (x <= high)).withColumn("bin", at).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def divergence(p: DataFrame, q: DataFrame, keys: list[str], bins: int, floor: float = 1e-9) -> DataFrame:
    """Kullback-Leibler divergence of histograms p (keyed) from q (one), with a floor under each share."""
    pn = p.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    total = q.agg(F.sum("n").alias("q_all"))
    qn = q.join(F.broadcast(total)).select("bin", (F.col("n") / F.col("q_all")).alias("q"))
    grid = p.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    both = grid.join(pn.select(*keys, "bin", "p"), [*keys, "bin"], "left").join(F.broadcast(qn), "bin", "left")
    p_, q_ = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(floor))
    return both.groupBy(*keys).agg(F.sum(p_ * F.ln(p_ / q_)).alias("kl"))


def error_bands(df: DataFrame, error: Column, keys: list[str], edges: tuple[float, float] = (8.0, 20.0)) -> DataFrame:
    """Share of the squared error from rows of small, middling and large absolute error."""
    a, sq = F.abs(error), error * error
    part = lambda c: ratio(F.sum(F.when(c, sq).otherwise(F.lit(0.0))), F.sum(sq))
    return df.groupBy(*keys).agg(part(a < edges[0]).alias("small"), part((a >= edges[0]) & (a < edges[1])).alias("middling"), part(a >= edges[1]).alias("large"))


def worst_first(df: DataFrame, key: str, error: Column) -> DataFrame:
    """Squared error of each key, its rank, and the running share of the total, largest first. Ranks and running sums are taken within sorted parts and
    moved by what the parts before hold."""
    per = df.groupBy(key).agg(F.sum(error * error).alias("sse"))
    parted = in_parts(per, [F.desc("sse"), F.col(key)])
    total = F.broadcast(parted.agg(F.sum("sse").alias("__total")))
    own = F.sum("sse").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    out = parted.withColumn("__own", own).join(F.broadcast(_before(parted, F.sum("sse"))), "__part").join(total)
    return out.select(key, "sse", (F.col("__rows") + F.col("__at")).cast("int").alias("rank"), ((F.col("__s0") + F.col("__own")) / F.col("__total")).alias("share"))


def line_fit(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Slope, intercept and R2 over pairs without nulls."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    return df.filter(ok).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def plane_fit(df: DataFrame, y: str, a: str, b: str, keys: list[str], least: int = 6, weight: Column | None = None, ridge: float = 0.0) -> DataFrame:
    """y ~ c0 + ca a + cb b by weighted second moments, solved in closed form; null with fewer than `least` rows or a flat spread. The sums are raw: take
    columns near the origin (distances, as local_planes does), or `regression`."""
    w = weight if weight is not None else F.lit(1.0)
    cols = {"y": F.col(y), "a": F.col(a), "b": F.col(b)}
    ok = F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = [F.sum(w).alias("__w"), F.count("*").alias("n")]
    sums += [F.sum(w * c).alias(f"__{n}") for n, c in cols.items()]
    pairs = ("aa", "ab", "bb", "ay", "by")
    sums += [F.sum(w * cols[p[0]] * cols[p[1]]).alias(f"__{p}") for p in pairs]
    g = df.filter(ok).groupBy(*keys).agg(*sums)
    centred = {p: F.col(f"__{p}") - F.col(f"__{p[0]}") * F.col(f"__{p[1]}") / F.col("__w") for p in pairs}
    aa, bb, ab = centred["aa"] + ridge, centred["bb"] + ridge, centred["ab"]
    det = aa * bb - ab * ab
    fits = (F.col("n") >= least) & (det > 1e-12 * aa * bb)
    safe = F.nullif(det, F.lit(0.0))
    ca = F.when(fits, (centred["ay"] * bb - centred["by"] * ab) / safe)
    cb = F.when(fits, (centred["by"] * aa - centred["ay"] * ab) / safe)
    out = g.select(*keys, "n", ca.alias("ca"), cb.alias("cb"), (F.col("__y") / F.col("__w")).alias("my"), (F.col("__a") / F.col("__w")).alias("ma"), (F.col("__b") / F.col("__w")).alias("mb"))
    return out.select(*keys, "n", (F.col("my") - F.col("ca") * F.col("ma") - F.col("cb") * F.col("mb")).alias("c0"), "ca", "cb")


def gain_and_offset(df: DataFrame, y: str, x: str, keys: list[str], least: int = 10) -> DataFrame:
    """Affine calibration y ~ gain x + offset; with too few pairs or a flat x, gain 1 and the mean difference."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    g = df.filter(ok).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.avg(F.col(y) - F.col(x)).alias("d"))
    fits = (F.col("n") >= least) & F.col("s").isNotNull()
    return g.select(*keys, "n", F.when(fits, F.col("s")).otherwise(F.lit(1.0)).alias("gain"), F.when(fits, F.col("i")).otherwise(F.col("d")).alias("offset"))


def third_medians(df: DataFrame, column: str, key: str, index: str) -> DataFrame:
    """Medians of the first, middle and last third, of the last 50 rows, and the mean with weights exp(0.02 i) growing along the sequence."""
    w = Window.partitionBy(key)
    r = df.filter(F.col(column).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(index)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    third = F.floor(F.col("__i") * 3 / F.col("__n"))
    x, late = F.col(column), F.exp(0.02 * (F.col("__i") - F.col("__n")))
    med = lambda c: F.percentile(F.when(c, x), F.lit(0.5))
    return r.groupBy(key).agg(med(third == 0).alias("early"), med(third == 1).alias("mid"), med(third == 2).alias("late"), med(F.col("__i") >= F.col("__n") - 50).alias("last50"), (F.sum(x * late) / F.sum(late)).alias("weighted"))


def initial_rate(df: DataFrame, y: str, x: str, key: str, index: str, rows: int = 30, least: int = 3) -> DataFrame:
    """Median of dy / dx over the last `rows` rows with y; 0 with fewer than `least` ratios."""
    w = Window.partitionBy(key)
    r = df.filter(F.col(y).isNotNull()).withColumn("__b", F.row_number().over(w.orderBy(F.desc(index)))).filter(F.col("__b") <= rows)
    o = w.orderBy(index)
    step = ratio(F.col(y) - F.lag(y).over(o), F.col(x) - F.lag(x).over(o))
    return r.withColumn("__r", step).groupBy(key).agg(F.when(F.count("__r") >= least, F.percentile("__r", F.lit(0.5))).otherwise(F.lit(0.0)).alias("rate"))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each value of keys: the first in a total order."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__at = 1").drop("__at")


def content_signature(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """md5 of a key's rounded values in order: equal for keys that hold the same curve. Values come as text, null as an empty one."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(key).agg(F.md5(F.array_join(F.transform(ordered, lambda s: s["t"]), ";").cast("binary")).alias("signature"))


def nearest_label(df: DataFrame, stats: DataFrame, value: str, label: str, centre: str) -> DataFrame:
    """The label whose centre is nearest to each row's value (the smaller label of equals). stats: one row a label, broadcast; it must be small."""
    labels = F.broadcast(stats.agg(F.collect_list(F.struct(centre, label)).alias("__labels")))
    best = F.array_min(F.transform("__labels", lambda s: F.struct(F.abs(s[centre] - F.col(value)).alias("d"), s[label].alias("l"))))
    return df.join(labels).withColumn("nearest", F.when(F.col(value).isNotNull(), best["l"])).drop("__labels")


def nearest_label_by_fold(df: DataFrame, fold: str, value: str, label: str) -> DataFrame:
    """Every row with the label whose mean value over the other folds is nearest (the smaller label of equals); null for a null value, or where the
    other folds have no label. A null fold is a fold of its own. Folds and labels are few: a row for each pair of them is broadcast."""
    sums = df.groupBy(F.col(fold).alias("__f"), F.col(label).alias("__l")).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    sums = staged(sums)
    asked = sums.select(F.col("__f").alias("__fold")).distinct()
    others = asked.join(F.broadcast(sums.filter("__l IS NOT NULL")), ~F.col("__fold").eqNullSafe(F.col("__f")))
    centres = others.groupBy("__fold", "__l").agg((F.sum("__s") / F.nullif(F.sum("__n"), F.lit(0))).alias("__c")).filter("__c IS NOT NULL")
    labels = F.broadcast(centres.groupBy("__fold").agg(F.collect_list(F.struct("__c", "__l")).alias("__labels")))
    best = F.array_min(F.transform("__labels", lambda s: F.struct(F.abs(s["__c"] - F.col(value)).alias("d"), s["__l"].alias("l"))))
    joined = df.join(labels, F.col(fold).eqNullSafe(F.col("__fold")), "left")
    return joined.withColumn("nearest", F.when(F.col(value).isNotNull(), best["l"])).drop("__labels", "__fold")


def histogram_peaks(counts: DataFrame, keys: list[str], bins: int, least: int) -> DataFrame:
    """Number of bins of a histogram (see `histogram`) that hold at least `least` and more than the bins on both sides, absent ones as empty; of
    equal neighbours none counts."""
    grid = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("bin")
    side = lambda c: F.coalesce(c, F.lit(0))
    top = (F.col("n") >= least) & (F.col("n") > side(F.lag("n").over(w))) & (F.col("n") > side(F.lead("n").over(w)))
    return full.withColumn("__top", top).groupBy(*keys).agg(F.count_if("__top").alias("peaks"))


def regression(df: DataFrame, y: str, xs: list[str], keys: list[str], least: int = 6, ridge: float = 1e-9) -> DataFrame:
    """y ~ c0 + c1 x1 + c2 x2 + c3 x3 for each key, by least squares on standardised columns: n, c0, c_<x>, r2.

    Moments are covariances, so large coordinates don't cancel; the small ridge takes, of several best fits, the one of nearly least norm. Rows with a null are
    left out; fewer than `least` rows give nulls. One to three columns.
    """
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    k = len(xs)
    moments = [F.count("*").alias("n"), F.avg(y).alias("__my"), F.var_pop(y).alias("__vy")]
    moments += [m for i, x in enumerate(xs) for m in (F.avg(x).alias(f"__m{i}"), F.when(F.var_pop(x) > 0, F.sqrt(F.var_pop(x))).otherwise(F.lit(1.0)).alias(f"__d{i}"), F.covar_pop(x, y).alias(f"__y{i}"))]
    moments += [F.covar_pop(xs[i], xs[j]).alias(f"__c{i}{j}") for i in range(k) for j in range(i, k)]
    g = df.filter(ok).groupBy(*keys).agg(*moments)
    d = [F.col(f"__d{i}") for i in range(k)]
    m = [[F.col(f"__c{min(i, j)}{max(i, j)}") / d[i] / d[j] + (ridge if i == j else 0.0) for j in range(k)] for i in range(k)]
    r = [F.col(f"__y{i}") / d[i] for i in range(k)]
    whole = _determinant(m)
    swapped = [_determinant([[r[i] if j == c else m[i][j] for j in range(k)] for i in range(k)]) for c in range(k)]
    enough = F.col("n") >= least
    coef = [F.when(enough, swapped[i] / whole / d[i]) for i in range(k)]
    out = g.select(*keys, "n", "__my", "__vy", *(F.col(f"__m{i}") for i in range(k)), *(F.col(f"__y{i}") for i in range(k)), *(c.alias(f"c_{x}") for c, x in zip(coef, xs)))
    inner = sum((F.col(f"c_{x}") * F.col(f"__m{i}") for i, x in enumerate(xs)), F.lit(0.0))
    explained = sum((F.col(f"c_{x}") * F.col(f"__y{i}") for i, x in enumerate(xs)), F.lit(0.0))
    return out.select(*keys, "n", F.when(F.col("n") >= least, F.col("__my") - inner).alias("c0"), *(f"c_{x}" for x in xs), F.when(F.col("n") >= least, ratio(explained, F.col("__vy"))).alias("r2"))


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    minor = lambda i, j: m[1][i] * m[2][j] - m[1][j] * m[2][i]
    return m[0][0] * minor(1, 2) - m[0][1] * minor(0, 2) + m[0][2] * minor(0, 1)


def residual_scale(df: DataFrame, y: str, reference: str, keys: list[str], low: float = 10.0, high: float = 60.0, missing: float | None = 0.0, least: int = 1, default: float = 20.0) -> DataFrame:
    """Population deviation of y less a reference, held to [low, high], for each key. A missing y counts as `missing` (None: its row is left out); `default`
    with fewer than `least` rows."""
    value = F.col(y) if missing is None else F.coalesce(F.col(y), F.lit(missing))
    e = value - F.col(reference)
    sd = F.least(F.greatest(F.stddev_pop(e), F.lit(low)), F.lit(high))
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.when(F.count(e) >= least, sd).otherwise(F.lit(default)).alias("scale"))


def stats_signature(df: DataFrame, key: str, columns: list[str], digits: int = 1, index: str | None = None) -> DataFrame:
    """A struct of rounded smallest, largest, mean and deviation of each column and the number of rows: equal for keys whose curves are alike at that grain.

    With `index`, an order of each key's rows, means are of sums taken in that order. Otherwise the last bit of a sum depends on how the input is split, and so does
    the rounding of a mean that lies halfway."""
    means = {c: F.avg(c) for c in columns}
    if index is not None:
        past = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"__sum_{c}": F.sum(F.col(c).cast("double")).over(past) for c in columns})
        means = {c: ratio(F.max_by(f"__sum_{c}", index), F.count(c).cast("double")) for c in columns}
    parts = [half_even(x, digits).alias(f"{n}_{c}") for c in columns for n, x in (("min", F.min(c)), ("max", F.max(c)), ("mean", means[c]), ("sd", F.stddev_pop(c)))]
    g = df.groupBy(key).agg(F.count("*").alias("n"), *parts)
    return g.select(key, F.struct("n", *(c for c in g.columns if c not in (key, "n"))).alias("signature"))


def correlations(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over rows that have both, a row for each pair a < b in the given order."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    g = df.groupBy(*keys).agg(*(both(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)))
    return g.select(*keys, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select(*keys, "p.*")


def ambiguity(counts: DataFrame, keys: list[str], bins: int, least: int) -> DataFrame:
    """Peaks of a histogram and their number times the bins' coefficient of variation: high where several places fit alike."""
    peaks = histogram_peaks(counts, keys, bins, least)
    total, square = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    spread = counts.groupBy(*keys).agg((F.sqrt(F.greatest(square / bins - (total / bins) * (total / bins), F.lit(0.0))) / (total / bins)).alias("cv"))
    return peaks.join(spread, keys).withColumn("ambiguity", F.col("peaks") * F.col("cv"))


def largest_of(values: Column, k: int) -> Column:
    """The k largest numbers of an array, largest first."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def broken_and_good(df: DataFrame, key: str, error: str, bad_above: float, good_below: float, n_bad: int, n_good: int) -> DataFrame:
    """Up to n_bad keys with the largest errors above one bound, and n_good with the smallest below another, told apart by `kind`."""
    bad = df.filter(F.col(error) > bad_above).orderBy(F.desc(error), key).limit(n_bad).withColumn("kind", F.lit("bad"))
    good = df.filter(F.col(error) < good_below).orderBy(error, key).limit(n_good).withColumn("kind", F.lit("good"))
    return bad.unionByName(good)


def first_rows(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first n rows in a total order, or all: a limit for trying things out."""
    return df if n is None else df.orderBy(*order).limit(n)


def median_filled(df: DataFrame, columns: list[str], by: DataFrame) -> DataFrame:
    """Nulls of each column become its median in `by`, the training rows."""
    middle = {c: exact_quantiles(by, c, [0.5])[0] for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in middle.items()})
