import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeflow.llm import crf, gam
from sondeflow.llm.tokens import OWN, PREFIXES, tokens


def all_paths(e, first, trans):
    """P(toxic) of each token by adding up all tag sequences of each document."""
    out = np.zeros(len(e))
    cut = [*np.flatnonzero(first), len(e)]
    for a, b in zip(cut[:-1], cut[1:]):
        weight, toxic = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + k] * t for k, t in enumerate(tags)) + sum(trans[x, y] for x, y in zip(tags, tags[1:])))
            weight += w
            toxic += w * np.array(tags)
        out[a:b] = toxic / weight
    return out


def test_marginals(monkeypatch):
    monkeypatch.setattr(crf, "BLOCK", 4)
    r = np.random.default_rng(0)
    n = np.array([3, 1, 9, 6, 2])
    e, trans = r.normal(0, 2, n.sum()), r.normal(0, 1, (2, 2))
    first = crf._firsts(n)
    p, pair = crf.marginals(e, first, trans)
    assert p == pytest.approx(all_paths(e, first, trans))
    assert pair[:, ~first].sum(axis=0) == pytest.approx(1)
    assert pair[1, ~first] + pair[3, ~first] == pytest.approx(p[~first])


def test_marginals_of_large_scores_are_finite():
    p, pair = crf.marginals(np.array([800.0, -800.0] * 500), np.arange(1000) == 0, np.array([[3.0, -3], [-3, 3]]))
    assert np.isfinite(p).all() and np.isfinite(pair).all()


def test_gradient_is_that_of_the_likelihood():
    """The fit's gradient against differences of the log-likelihood, summed over all tag sequences."""
    r = np.random.default_rng(2)
    texts = [b"one two three two", b"two", b"three one three"]
    slice_ = crf._Slice(texts)
    keys = np.unique(slice_.h[slice_.h != 0])
    marks = np.unique(slice_.h[[1], 0])
    part = crf._Part(slice_, np.array([True, True, False]), keys, marks)
    part.only(np.ones(len(keys), bool))
    w, bias, trans = r.normal(0, 0.5, len(keys)), -0.3, r.normal(0, 0.5, (2, 2))
    y = (slice_.h[:, 0] == marks[0]) & np.array([True, True, False])[slice_.doc]

    def loglik(w, bias, trans):
        e, cut, out = part.emission(w, bias), [*np.flatnonzero(part.first), len(y)], 0.0
        for a, b in zip(cut[:-1], cut[1:]):
            score = lambda tags: sum(e[a + k] * t for k, t in enumerate(tags)) + sum(trans[x, z] for x, z in zip(tags, tags[1:]))
            out += score(y[a:b].astype(int).tolist()) - np.log(sum(np.exp(score(t)) for t in itertools.product((0, 1), repeat=b - a)))
        return out

    expected, g_bias, g_trans = part.gradient(w, bias, trans)
    eps = 1e-6
    for k in range(0, len(keys), 3):
        up = w + eps * (np.arange(len(keys)) == k)
        assert part.seen[k] - expected[k] == pytest.approx((loglik(up, bias, trans) - loglik(w, bias, trans)) / eps, abs=1e-4)
    assert g_bias == pytest.approx((loglik(w, bias + eps, trans) - loglik(w, bias, trans)) / eps, abs=1e-4)
    for i in range(2):
        for j in range(2):
            up = trans + eps * ((np.arange(2)[:, None] == i) & (np.arange(2)[None, :] == j))
            assert g_trans[i, j] == pytest.approx((loglik(w, bias, up) - loglik(w, bias, trans)) / eps, abs=1e-4)
    assert part.slope(w, bias, trans) == pytest.approx(part.seen - expected)


def test_document_score_and_offsets_by_hand(spark):
    """score, predicted and spans of a known field, from all tag sequences."""
    word = lambda t: crf.tokens([t])[0][0, 0]
    weight = {word(b"bad"): 5.0, word(b"vile"): 3.0}
    keys = np.array(sorted(weight), np.uint64)
    model = crf.Field(keys, np.array([weight[k] for k in keys]), -2.0, np.array([[0.5, -0.5], [-0.5, 1.0]]), np.array([-3.0, 4.0, 1.0]))
    texts = ["a bad vile thing", "nothing here", "", None, "vile é bad"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in crf.score_toxicity(df, model).collect()}
    for k, t in enumerate(texts):
        h, _, start, end, _ = crf.tokens([(t or "").encode()])
        e = model.emission(h)
        p = all_paths(e, np.arange(len(e)) == 0, model.trans) if len(e) else np.zeros(0)
        score = 1 / (1 + np.exp(-(-3.0 + 4.0 * p.max(initial=0) + np.log1p(p[p > 0.05].sum()))))
        assert got[k].score == pytest.approx(score) and got[k].predicted == (score >= 0.3)
        hit = [b for b in range(len(p)) if p[b] >= 0.5]
        runs = [b for b in hit if b - 1 not in hit]
        ends = [b for b in hit if b + 1 not in hit]
        assert got[k].spans == ",".join(f"{start[a]}:{end[b]}" for a, b in zip(runs, ends))
    assert got[0].spans == "2:10"


def toxic_rows(n, seed):
    r = np.random.default_rng(seed)
    plain = [f"{a}{b}" for a in ("tha", "ing", "ero", "ndé") for b in range(60)]
    rows = []
    for k in range(n):
        w = list(r.choice(plain, int(r.integers(5, 80))))
        bad = int(k % 7 == 0)
        for _ in range(bad * int(r.integers(2, 6))):
            w.insert(int(r.integers(0, len(w))), r.choice(["Scum", "grobelix" + "aeiou"[r.integers(0, 5)] + "xy"[r.integers(0, 2)]]))
        rows.append((k, " ".join(w), bad))
    return rows


def test_toxicity_table(spark):
    rows = toxic_rows(900, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.1), (9001, "", 0.1), (9002, "SCUM! " * 50, 0.0), (5, rows[5][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = crf.toxicity(docs, labels).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000}
    assert np.mean([held[i].predicted == y for i, _, y in rows if i in held]) > 0.98
    for i, text, y in rows:
        if i in held and y:
            raw = text.encode()
            for s in held[i].spans.split(","):
                a, b = map(int, s.split(":"))
                assert all(w.startswith((b"Scum", b"grob")) for w in raw[a:b].split())
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "SCUM scum SCUM scum " + "word " * 300_000)], "doc_id long, text string")
    assert [r.predicted for r in crf.score_toxicity(long, crf.fitted(docs, labels)).orderBy("doc_id").collect()] == [0, 1]
    again = {str(r.doc_id): r.score for r in crf.toxicity(docs.repartition(5), labels.repartition(2)).collect()}
    assert again == pytest.approx({str(r.doc_id): r.score for r in got})


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in crf.toxicity(docs, labels).collect()] == pytest.approx([0.02] * 2)
    assert {round(r.score, 6) for r in gam.quality(docs, labels).collect()} == {0.5}
    assert crf.toxicity(docs.limit(0), labels).count() == 0 == gam.quality(docs.limit(0), labels).count()


def test_tokens():
    h, doc, a, b, n = tokens([b"", "Ab, ábc-X".encode(), b"ab \xff"])
    assert n.tolist() == [0, 3, 2] and doc.tolist() == [1, 1, 1, 2, 2]
    assert h[0, 0] == h[3, 0] and (a[1], b[1]) == (4, 8)
    h, *_ = tokens([b"abcdef abcdxyzt"])
    assert h[0, 1] == h[1, 1] and h[0, 2] != h[1, 2] and h.shape[1] == 1 + len(PREFIXES) + 4 and h[0, 3] == 0
    h, *_ = tokens([b"x abcd1 Abcd y", b"x zzzabcd"])
    prev, after, shape = OWN + 1, OWN + 2, OWN + 3
    assert h[0, prev] == 0 == h[3, after] == h[4, prev] and h[1, prev] == h[5, prev] != 0 and h[0, shape] == h[3, shape] != h[2, shape]


def test_tree_finds_the_step():
    g = np.concatenate((np.full(10, -3.0), np.full(6, 5.0)))
    t = gam._tree(g, np.full(16, 2.0), 2)
    assert len(set(t[:10])) == 1 and len(set(t[10:])) == 1 and t[0] < 0 < t[-1]


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(4)
    x = r.uniform(-1, 1, (3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = gam.fit(x[:2000], y[:2000])
    assert np.mean((m.score(x[2000:]) >= 0.5) == y[2000:]) > 0.85


def test_score_is_the_sum_of_looked_up_values():
    """Every table and pair looked up one by one."""
    r = np.random.default_rng(6)
    x = np.round(r.normal(0, 1, (400, 5)), 1)
    m = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    assert m.pairs
    for row, score in zip(x[:60], m.score(x[:60])):
        at = [sum(v >= c for c in cuts) for v, cuts in zip(row, m.cuts)]
        total = m.base + sum(t[b] for t, b in zip(m.tables, at))
        for i, j, t in m.pairs:
            total += t[m.coarse[i][at[i]], m.coarse[j][at[j]]]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_tree_as_all_trees():
    """Three leaves, the best split first, against all splits tried by hand."""
    r = np.random.default_rng(7)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(20):
        g, h = r.normal(0, 3, 9), r.uniform(1.1, 2, 9)
        first = max(range(1, 9), key=lambda m: gain(g[:m], h[:m]) + gain(g[m:], h[m:]))
        tries = [(a, m, b) for a, b in ((0, first), (first, 9)) for m in range(a + 1, b)]
        more = lambda t: gain(g[t[0] : t[1]], h[t[0] : t[1]]) + gain(g[t[1] : t[2]], h[t[1] : t[2]]) - gain(g[t[0] : t[2]], h[t[0] : t[2]])
        cut = sorted({0, first, max(tries, key=more)[1], 9})
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(cut, cut[1:])])
        assert gam._tree(g, h, 3) == pytest.approx(want)


def test_quality_table(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(600):
        w = [f"w{i}" for i in r.integers(0, 500, int(r.integers(20, 200)))]
        good = int(k % 5 != 0)
        rows.append((k, " ".join(w) if good else "!! ".join(w[:5] * 20).upper(), good))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (7000, ""), (7001, "\n" * 5000), (7002, "x" * 50_000), (5, rows[5][1])], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = gam.quality(docs, labels).collect()
    assert len(got) == 605 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    by = {g.doc_id: g for g in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([by[i].predicted == y for i, _, y in rows if by[i].held_out]) > 0.98


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"One two two\nOne two two\n", b"|a|", "éé é. é".encode(), b" ", b"x" * 5000, b"\n"]
    whole = gam.features(texts)
    assert np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert whole[k] == pytest.approx(gam.features([t])[0])
