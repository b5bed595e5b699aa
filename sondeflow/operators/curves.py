"""Lookups on curves: arrays of knots, one curve for each key, values between knots by straight lines.

A curve is one row: key, knots array<struct<x, y>> sorted by x, each x once. Curves join many-to-one and lookups stay in the JVM as a search
over the array, so cost for each row grows with the number of knots; for curves of many thousand knots use `as_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def curves(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row for each key: knots, sorted, with the mean y of equal x; knots with a null are left out."""
    one = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("knots"))


def lookup(knots: Column, v: Column, edge: str = "clamp") -> Column:
    """y at v. edge: clamp to the end values, extrapolate from the end segments, or null outside."""
    n = F.size(knots)
    below = F.size(F.filter(knots, lambda k: k["x"] <= v))
    first = F.least(F.greatest(below, F.lit(1)), F.greatest(n - 1, F.lit(1)))

    def between(pair: Column) -> Column:
        a, b = F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2))
        return a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / (b["x"] - a["x"])

    # Bound by a transform of one element: the knots are searched once, however often the two are named.
    line = F.try_element_at(F.transform(F.array(F.slice(knots, first, 2)), between), F.lit(1))
    low, high = F.try_element_at(knots, F.lit(1)), F.try_element_at(knots, F.greatest(n, F.lit(1)))
    out = F.when(v.isNull() | (n == 0), F.lit(None).cast("double")).when(n == 1, low["y"] if edge != "null" else F.when(v == low["x"], low["y"]))
    if edge == "clamp":
        out = out.when(v <= low["x"], low["y"]).when(v >= high["x"], high["y"])
    elif edge == "null":
        out = out.when((v < low["x"]) | (v > high["x"]), F.lit(None).cast("double"))
    return out.otherwise(line)


def nearest_knot(knots: Column, v: Column) -> Column:
    """The knot (x, y) nearest to v, the lower of two equally near."""
    return F.when(v.isNotNull(), F.array_min(F.transform(knots, lambda k: F.struct(F.abs(k["x"] - v).alias("d"), k["x"].alias("x"), k["y"].alias("y")))))


def on_grid(values: Column, start: Column, step: float, v: Column) -> Column:
    """Value at v on a uniform grid of values from `start` on, by index arithmetic, clamped at the ends."""
    n = F.size(values)
    place = F.least(F.greatest((v - start) / step, F.lit(0.0)), (n - 1).cast("double"))
    i = F.least(F.floor(place), F.greatest(n - 2, F.lit(0))).cast("int")
    a, b = F.element_at(values, i + 1), F.try_element_at(values, i + 2)
    return F.when(n == 1, a).otherwise(a + (b - a) * (place - i))


def resampled(curve: DataFrame, key: str, step: float) -> DataFrame:
    """Each curve at start, start + step, ... up to its end."""
    ends = curve.withColumn("x0", F.element_at("knots", 1)["x"]).withColumn("m", F.floor((F.element_at("knots", -1)["x"] - F.element_at("knots", 1)["x"]) / step))
    rows = ends.select(key, "knots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("i"), "x0")
    rows = rows.withColumn("x", F.col("x0") + F.col("i") * step)
    return rows.select(key, "i", "x", lookup(F.col("knots"), F.col("x")).alias("y"))


def as_of(rows: DataFrame, knots: DataFrame, key: str, at: str, x: str, y: str) -> DataFrame:
    """rows with the last knot at or before `at`: x0, y0, null if there is none. Both sides are sorted together once for each key: no join."""
    a = rows.withColumn("__x", F.col(at).cast("double")).withColumn("__side", F.lit(1)).withColumn("__k", F.lit(None).cast("struct<x:double,y:double>"))
    b = knots.select(F.col(key), F.col(x).cast("double").alias("__x"), F.lit(0).alias("__side"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("__k"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__x", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__k", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*rows.columns, F.col("__last.x").alias("x0"), F.col("__last.y").alias("y0"))


def along(rows: DataFrame, knots: DataFrame, key: str, at: str, x: str, y: str, name: str, edge: str = "clamp") -> DataFrame:
    """rows with `name`, the curve of their key at the column `at`: lookup's values for curves of any number of knots, at a cost for each row that does not depend on it.

    Rows and knots are sorted together once for each key, and each row takes the last knot before it, which carries the next one with it; a knot at minus infinity carries the first two.
    Knots of equal x count by their mean y, those with a null not at all. A null `at`, or a key without knots, gives null.
    """
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    one = knots.select(F.col(key).alias("__key"), fx.alias("x"), fy.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").groupBy("__key", "x").agg(F.avg("y").alias("y"))
    w = Window.partitionBy("__key").orderBy("x")
    beside = {f"{c}{d}": f(c).over(w) for d, f in (("0", F.lag), ("1", F.lead)) for c in ("x", "y")}
    told = one.withColumns(beside)
    knot = lambda a, b, first: F.struct(*(F.col(c).alias(n) for c, n in zip((*a, *b), ("ax", "ay", "bx", "by"))), (F.col("x0").isNull() & F.col("x1").isNull()).alias("alone"), F.lit(first).alias("below"), F.col("x1").isNull().alias("end"))
    here, after, before = ("x", "y"), ("x1", "y1"), ("x0", "y0")
    inner = told.select("__key", F.col("x").alias("__x"), F.when(F.col("x1").isNull() & F.col("x0").isNotNull(), knot(before, here, False)).otherwise(knot(here, after, False)).alias("__k"))
    first = told.filter("x0 IS NULL").select("__key", F.lit(float("-inf")).alias("__x"), knot(here, after, True).alias("__k"))
    given = inner.union(first).withColumnRenamed("__key", key).withColumn("__side", F.lit(0))
    left = rows.withColumns({"__x": F.col(at).cast("double"), "__side": F.lit(1)})
    both = left.unionByName(given, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.asc_nulls_first("__x"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__k", F.last("__k", ignorenulls=True).over(last)).filter("__side = 1")
    k, v = (lambda n: F.col(f"__k.{n}")), F.col("__x")
    line = k("ay") + (k("by") - k("ay")) * (v - k("ax")) / (k("bx") - k("ax"))
    low = k("below") & (v < k("ax"))
    high = k("end") & ~k("alone") & ~k("below") & (v >= k("bx"))
    value = F.when(v.isNull() | F.col("__k").isNull(), F.lit(None).cast("double"))
    value = value.when(k("alone"), k("ay") if edge != "null" else F.when(v == k("ax"), k("ay")))
    if edge == "clamp":
        value = value.when(low, k("ay")).when(high, k("by"))
    elif edge == "null":
        value = value.when(low | (high & (v > k("bx"))), F.lit(None).cast("double"))
    return out.select(*rows.columns, value.otherwise(line).alias(name))


def probes(knots: Column, centre: Column, gr: Column, offsets: list[float]) -> Column:
    """gr less the curve at centre + each offset, as an array."""
    return F.transform(F.array(*(F.lit(float(o)) for o in offsets)), lambda o: gr - lookup(knots, centre + o))
