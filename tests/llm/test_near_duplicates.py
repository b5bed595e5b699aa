import itertools
import random
import re

import numpy as np
import pytest

from sondeflow.llm import neardup
from sondeflow.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, node int, band string"


def brute(rows, width, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def documents(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "One two\nthree"), (7, "é É"), (8, "É É")]
    for _ in range(12):
        base = r.choices(words, k=r.randint(4, 120))
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    chain = r.choices(words, k=60)
    for _ in range(40):  # each like the last, not like the first
        chain[r.randrange(60)] = r.choice(words)
        rows.append((len(rows), " ".join(chain)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 5)])
def test_as_all_pairs(spark, seed, width):
    rows = documents(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = near_duplicates(df, width, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, width, 80)


@pytest.mark.parametrize("block,weight", [(4, 1 << 19), (100, 150), (1, 1)])
def test_groups_of_any_size(spark, monkeypatch, block, weight):
    """The same answer whatever the bounds of blocks and parts."""
    for name, n in (("BLOCK", block), ("WEIGHT", weight), ("PART", 3)):
        monkeypatch.setattr(neardup, name, n)
    rows = documents(5)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4, 80)


def look_alikes(n, common, own, pairs, seed=3):
    """Texts round one long passage, too unlike to be linked, and every `pairs`-th with a near copy."""
    r = random.Random(seed)
    passage = [f"c{i}" for i in range(common)]
    rows = []
    for i in range(n):
        text = passage + [f"o{i}x{r.randrange(10**6)}" for _ in range(own)]
        rows.append((len(rows), " ".join(text)))
        if i % pairs == 0:
            rows.append((len(rows), " ".join([*text[:-1], "z"])))
    return rows


def test_look_alikes(spark, monkeypatch):
    """Prefixes part what shares bands without being linked: no block is left but those of the near copies, and links are those of all pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    seen = []
    parted = neardup._parted
    monkeypatch.setattr(neardup, "_parted", lambda *a: seen.append(parted(*a)) or seen[-1])
    rows = look_alikes(220, 90, 30, 20)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4, 80)
    assert sum(r.component_id != r.doc_id for r in got) == 11
    assert len(seen) == 1 and seen[0][0].count() <= 2 * 22


@pytest.mark.parametrize("common,own", [(100, 6), (100, 8), (40, 2), (12, 0)])
def test_prefixes_at_the_threshold(spark, common, own):
    """Two sets that are just linked share a shingle that is in the shorter prefix of one: all pairs of a family are found again."""
    r = random.Random(common + own)
    sets = []
    for k in range(60):
        size = own + r.randrange(3)
        items = [*r.sample(range(common + 4), common), *(1000 + 100 * k + i for i in range(size))]
        sets.append({(x * 0x9E3779B97F4A7C15) % (1 << 64) for x in items})
    rows = [(k, bytearray(np.sort(np.array(list(s), np.uint64)).tobytes())) for k, s in enumerate(sets)]
    got = {p.node: (list(p.prefix), p.larger) for p in neardup._prefixes(spark.createDataFrame(rows, "node long, items binary"), 80).collect()}
    linked = 0
    for a, b in itertools.combinations(range(60), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            linked += 1
            x, y = sorted((a, b), key=lambda k: len(sets[k]))
            assert set(got[x][0][: got[x][1]]) & set(got[y][0])
    assert linked


def test_long_text(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(5000)}" for _ in range(40_000)]
    near = list(long)
    for k in range(0, 40_000, 400):
        near[k] = "x"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:20_000])), (4, "w1 w2")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4, 80)


def test_odd_rows(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (9, 5, False)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
