import numpy as np
import pytest

from sondeflow.llm.mixing import mix_plan, mixed, sainte_lague, targets


def by_hand(weights, seats, caps):
    won = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if won[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_highest_quotients():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = r.integers(1, 9)
        w, caps = r.integers(0, 60, n).astype(float), r.integers(0, 40, n)
        seats = int(r.integers(0, 80))
        assert sainte_lague(w, seats, caps).tolist() == by_hand(w, seats, caps)
    assert sainte_lague(np.array([53.0, 24, 23]), 7, np.full(3, 99)).tolist() == [3, 2, 2]


def test_targets_share_again_above_the_cap():
    assert targets([10, 100, 1], [1, 2, 3]).tolist() == pytest.approx([30, 78, 3])
    assert targets([0, 0], [1, 2]).tolist() == [0, 0]
    assert targets([5], [1]).tolist() == [5]


def rows():
    r = np.random.default_rng(2)
    out = [(k, " ".join(["w"] * int(r.integers(0, 90))), f"s{k % 7}" if k % 3 else "big", 0) for k in range(900)]
    return out + [(9000, None, "s1", 0), (9001, "a b", None, 0), (9001, "a b", None, 0), (9002, "", "", 0), (None, "x y z", "big", 0)]


def test_plan(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int").repartition(4)
    got = mix_plan(df).collect()
    assert len(got) == len(rows())
    assert sorted(got, key=str) == sorted(mix_plan(df.repartition(7)).collect(), key=str)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    names = sorted({r.source for r in got}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.source == s) for s in names]
    goal = targets(sizes, [i % 3 + 1 for i in range(len(names))])
    for s, n, t in zip(names, sizes, goal):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {n} and mine[0].target == pytest.approx(t)
        assert abs(sum(r.taken for r in mine) - t) <= 0.01 * t + 2


def test_mix_takes_what_the_plan_says(spark):
    df = spark.createDataFrame([(k, " ".join(f"{k}.{i}" for i in range(3 + 11 * k % 70)), f"s{k % 4}", 5) for k in range(300)], "doc_id long, text string, source string, n_chars long")
    plan = {r.doc_id: r.taken for r in mix_plan(df).collect()}
    out = mixed(df).collect()
    took = dict.fromkeys(plan, 0)
    for r in out:
        took[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert all(w.startswith(f"{r.doc_id}.") for w in r.text.split())
    assert took == plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(df).count() == 0 and mixed(df).count() == 0


def test_texts_of_one_id_are_dealt_apart(spark):
    """A third of all rows repeat one doc_id: their texts lie in all shards, and targets are met as before."""
    from pyspark.sql import functions as F

    from sondeflow.llm import mixing

    rows = [(7 if i % 3 == 0 else i, f"words of text {i} in this table", "a") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = docs.withColumn("of_text", F.xxhash64("text")).filter("doc_id = 7").groupBy(F.pmod(mixing._dealt(0), F.lit(50)).alias("shard")).count()
    assert dealt.count() == 50 and dealt.agg(F.max("count")).first()[0] < 2 * 2000 / 50
    size, taken = mixing.mix_plan(docs).agg(F.sum("size"), F.sum("taken")).first()
    assert abs(taken - size) < 0.02 * size
