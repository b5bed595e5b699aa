"""Operators that leave no entity, event or row out, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeflow.operators import aggregates as A
from sondeflow.operators import nearby, spatial
from sondeflow.plans import registry
from sondeflow.plans.base import wells
from sondeflow.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [7, 4096])
def test_every_entity_has_neighbours(spark, block):
    r = np.random.default_rng(3)
    x = r.integers(0, 6, (60, 3)).astype(float)  # many equal distances
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(99, None, 1.0, 1.0)], "well long, a double, b double, c double")
    got = {(q.focus, q.rank): (q.well, q.distance) for q in spatial.all_feature_neighbours(df, "well", ["a", "b", "c"], 4, block).collect()}
    full = np.vstack([x, [np.nan, 1, 1]])
    z = (full - np.nanmean(full, axis=0)) / np.nanstd(full, axis=0)
    ids = [*range(60), 99]
    assert len(got) == 61 * 4
    for i, w in enumerate(ids[:60]):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        want = sorted((round(d[j], 9), ids[j]) for j in range(60) if j != i)[:4]
        assert [round(got[(w, k)][1], 9) for k in range(1, 5)] == [v for v, _ in want]
        mine = [(round(got[(w, k)][1], 9), got[(w, k)][0]) for k in range(1, 5)]
        assert len({m for _, m in mine}) == 4 and all(m != w and round(d[ids.index(m)], 9) == v for v, m in mine)
    assert {got[(99, k)][1] for k in range(1, 5)} == {None}


def test_every_well_is_focus(spark):
    wells = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id")).distinct().count()
    got = registry.queries()["feature_neighbours_all"](spark, SF)
    assert got.select("focus").distinct().count() == wells and got.count() == 3 * wells


def test_every_row_gets_a_label_of_the_other_folds(spark):
    r = np.random.default_rng(4)
    rows = [(i, None if i % 40 == 39 else i % 4, "abc"[int(r.integers(3))], float(r.integers(0, 50))) for i in range(200)] + [(200, 1, "only here", 7.0), (201, 2, "a", None), (202, 2, None, 3.0)]
    got = {q.id: q.nearest for q in A.nearest_label_by_fold(spark.createDataFrame(rows, "id long, fold long, label string, value double"), "fold", "value", "label").collect()}
    assert len(got) == len(rows)
    for i, fold, _, value in rows:
        seen = {}
        for _, f, label, v in rows:
            if f != fold and label is not None and v is not None:
                seen.setdefault(label, []).append(v)
        want = None if value is None else min((abs(sum(v) / len(v) - value), label) for label, v in seen.items())[1]
        assert got[i] == want
    assert got[200] != "only here" and got[201] is None
    alone = spark.createDataFrame(rows[:1], "id long, fold long, label string, value double")
    assert [q.nearest for q in A.nearest_label_by_fold(alone, "fold", "value", "label").collect()] == [None]


def test_every_event_is_classified(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    got = registry.queries()["nearest_label_by_fold"](spark, SF)
    assert got.filter("nearest IS NOT NULL").select("event_id").distinct().count() == events == got.count()


def test_gain_is_fitted_on_the_whole_well(spark):
    w = wells(spark, SF).collect()
    got = {r.well: r for r in registry.queries()["gain_and_offset_whole"](spark, SF).collect()}
    longer = 0
    for well in {r.well for r in w}:
        pairs = [(r.z, r.gr) for r in w if r.well == well and r.gr is not None and r.z is not None]
        longer += len(pairs) > 30
        assert got[well].n == len(pairs)
        if len(pairs) >= 24:
            gain, offset = np.polyfit(*zip(*pairs), 1)
            assert got[well].gain == pytest.approx(gain, abs=1e-5) and got[well].offset == pytest.approx(offset, abs=1e-3)
    assert longer


def test_counts_of_all_groups_are_written(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    facts = files.write_with_facts(spark.range(12_000).select((F.col("id") % 11_000).alias("k"), F.col("id").alias("v")), path, ["k"])
    counts = spark.read.parquet(facts["counts"])
    assert counts.count() == facts["groups"] == 11_000 and facts["by"] is None and facts["rows"] == 12_000
    assert counts.agg(F.sum("count")).first()[0] == 12_000 and counts.filter("count = 2").count() == 1_000
    facts = files.write_with_facts(spark.range(30).select((F.col("id") % 3).alias("k")), path, ["k"])
    assert {r["k"]: r["count"] for r in facts["by"]} == {0: 10, 1: 10, 2: 10} and facts["groups"] == 3


def test_signatures_do_not_depend_on_how_rows_are_split(spark):
    """Means of 0.05 and 0.15 multiples lie halfway: their sums are taken in the order of the rows, wherever these come from."""
    r = np.random.default_rng(8)
    rows = [(k, i, round(float(v), 2)) for k in range(300) for i, v in enumerate((41.75 + x for x in (lambda d: (*d, *-d))(r.integers(0, 4000, 8) / 100)))]
    want = {k: float(np.rint(10 * (np.cumsum([v for q, _, v in rows if q == k])[-1] / 16)) / 10) for k in range(300)}
    for order in (rows, rows[::-1], sorted(rows, key=lambda q: q[2])):
        df = spark.createDataFrame(order, "k int, i int, v double").repartition(7)
        assert {q.k: q.signature.mean_v for q in A.stats_signature(df, "k", ["v"], 1, "i").collect()} == want


@pytest.mark.parametrize("entities, copies", [(3000, 1), (50, 60)])
def test_neighbours_are_sought_in_leaves_and_not_among_all(spark, monkeypatch, entities, copies):
    """Each entity meets the leaves that its neighbours may lie in, few of all, whether places repeat or not; results are brute force's."""
    met = []
    search = nearby._searched
    monkeypatch.setattr(nearby, "_searched", lambda asked, *rest: (met.append(asked.count()), search(asked, *rest))[1])
    r = np.random.default_rng(5)
    x = np.tile(r.normal(size=(entities, 3)).round(6), (copies, 1))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "well long, a double, b double, c double")
    got = {(q.focus, q.rank): (q.well, q.distance) for q in spatial.all_feature_neighbours(df, "well", ["a", "b", "c"], 3, 64).collect()}
    assert len(got) == 3 * len(x) and 0 < sum(met) < 12 * len(x)  # there are 64 leaves
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for i in range(0, len(x), 29):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.lexsort((np.arange(len(x)), d.round(9)))[:3]
        assert [got[i, k][0] for k in (1, 2, 3)] == want.tolist() and [got[i, k][1] for k in (1, 2, 3)] == pytest.approx(d[want].tolist())


def test_fewer_known_entities_than_asked_for(spark):
    rows = [(1, 0.0, 0.0), (2, 3.0, 1.0), (5, None, 1.0), (4, float("nan"), 2.0), (None, 2.0, 2.0)]
    got = sorted(spatial.all_feature_neighbours(spark.createDataFrame(rows, "w int, a double, b double"), "w", ["a", "b"], 2, 64).select("focus", "rank", "w").collect())
    assert [(q.focus, q.w) for q in got] == [(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2), (5, 1), (5, 2)]
