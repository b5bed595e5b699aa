"""Operators for long sequences, hot keys and large curves, against plain answers."""

import random
import statistics
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import aggregates as A
from sondeflow.operators import curves as C
from sondeflow.operators import sequence
from sondeflow.operators import windows as W


def test_middle_of_a_changing_bag():
    r = random.Random(1)
    bag, kept = W.Middle(), {}
    for i in range(3000):
        if kept and r.random() < 0.45:
            number = r.choice(list(kept))
            del kept[number]
            bag.take(number)
        else:
            kept[i] = float(r.randint(0, 30))
            bag.put(i, kept[i])
        assert bag.median() == (statistics.median(kept.values()) if kept else None)


@pytest.mark.parametrize("width, centred, block", [(5, True, 16), (6, True, 1), (9, False, 20), (1, True, 50), (301, True, 1 << 14)])
def test_rolling_medians(spark, width, centred, block):
    r = np.random.default_rng(width)
    rows = [(k, i, None if r.random() < 0.3 else float(r.integers(0, 40)), f"{k}-{i}") for k, n in (("a", 400), ("b", 1), ("c", 37)) for i in range(n)]
    rows += [("d", i, None, "null") for i in range(12)]
    got = W.rolling_medians(spark.createDataFrame(rows, "k string, i long, v double, more string").repartition(5), "k", "i", "v", "m", width, centred, block).collect()
    want = {}
    before, after = (width // 2, (width - 1) // 2) if centred else (width - 1, 0)
    for k in "abcd":
        v = [x[2] for x in rows if x[0] == k]
        for i in range(len(v)):
            some = [x for x in v[max(0, i - before) : i + after + 1] if x is not None]
            want[k, i] = statistics.median(some) if some else None
    assert len(got) == len(rows) and all(x.m == want[x.k, x.i] and x.more in (f"{x.k}-{x.i}", "null") for x in got)


def test_median_does_not_cost_more_for_wider_frames():
    v = np.random.default_rng(2).normal(size=20_000).tolist()

    def run(width):
        bag, began = W.Middle(), time.perf_counter()
        for i, x in enumerate(v):
            bag.put(i, x)
            if i >= width:
                bag.take(i - width)
            bag.median()
        return time.perf_counter() - began

    run(20)
    assert run(5000) < 4 * run(20)


@pytest.mark.parametrize("bracket", [A.BRACKET, 40])
def test_quantiles_of_hot_and_rare_keys(spark, monkeypatch, bracket):
    monkeypatch.setattr(A, "BRACKET", bracket)  # 40: brackets are narrowed first
    r = np.random.default_rng(3)
    of = {"hot": r.lognormal(0, 3, 3000), "same": np.append(np.full(500, 7.0), np.arange(100.0)), "two": np.array([1.0, 2.0]), "one": np.array([5.0])}
    rows = [(k, float(x)) for k, v in of.items() for x in v] + [("hot", None), ("none", None), ("two", float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    shares = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {x.k: x[1:] for x in A.quantiles(df, ["k"], "x", shares).collect()}
    assert set(got) == {*of, "none", None} and got["none"] == (None,) * 5
    for k, v in of.items():
        assert got[k] == pytest.approx(np.quantile(v, list(shares.values())))
    whole = A.quantiles(df, [], "x", {"m": 0.5}).collect()
    assert [x.m for x in whole] == [pytest.approx(np.median([*np.concatenate(list(of.values())), 3.0]))]
    assert A.quantiles(df.limit(0), ["k"], "x", shares).count() == 0


@pytest.mark.parametrize("edge", ["clamp", "extrapolate", "null"])
def test_merged_lookup_as_by_array(spark, edge):
    r = np.random.default_rng(4)
    knots = [(k, float(x), float(y)) for k, n in ((1, 30), (2, 1), (3, 2)) for x, y in zip(r.integers(0, 40, n), r.normal(size=n))] + [(1, None, 2.0), (1, 3.0, None)]
    rows = [(i, int(k), None if i % 17 == 0 else float(v)) for i, (k, v) in enumerate(zip(r.integers(1, 5, 400), r.integers(-10, 55, 400)))]
    kf, rf = spark.createDataFrame(knots, "k int, x double, y double"), spark.createDataFrame(rows, "i int, k int, v double").repartition(3)
    want = {x.i: x.w for x in rf.join(C.curves(kf, "k", "x", "y"), "k", "left").select("i", C.lookup(F.col("knots"), F.col("v"), edge).alias("w")).collect()}
    got = {x.i: x.w for x in C.along(rf, kf, "k", "v", "x", "y", "w", edge).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) if want[i] is not None else got[i] is None for i in want)


def test_kernels_get_as_many_tasks_as_are_set(spark):
    """1,500 small keys: adaptive execution would put them into one task by their bytes."""
    df = spark.createDataFrame([(k, float(k)) for k in range(1500)], "k long, x double")
    count = lambda part: pd.DataFrame({"k": part["k"], "pid": __import__("pyspark").TaskContext.get().partitionId()})
    got = sequence.dealt(df, "k").groupBy("k").applyInPandas(count, "k long, pid int")
    assert got.select("pid").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_lookup_searches_its_knots_once(spark):
    """Within a lambda Spark evaluates an expression as often as it is named: the plan has one search of the knots, and probes one for each offset."""
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 5.0)], "k int, x double, y double")
    plan = C.curves(df, "k", "x", "y").select(C.lookup(F.col("knots"), F.lit(1.0) * F.col("k"), "extrapolate").alias("y"))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.split("\n")[0].count("filter(") == 1 and plan.collect()[0].y == 3.0
