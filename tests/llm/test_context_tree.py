import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sondeflow.llm import ctw

SCHEMA = "doc_id long, text string, score double, n long"


def held(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7 == 2


class Tree:
    """One binary decision's context tree, by its definition: weighted probabilities of all counts, and of all counts and one more."""

    def __init__(self, depth):
        self.depth, self.n = depth, Counter()

    def add(self, context, bit):
        for d in range(self.depth + 1):
            self.n[context[self.depth - d :], bit] += 1

    def known(self, context, extra=None):
        n = [self.n[context, b] for b in (0, 1)]
        mine = extra and extra[0][self.depth - len(context) :] == context
        if mine:
            n[extra[1]] += 1
        own = math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)
        if len(context) == self.depth or not sum(n):
            return own
        below = {c[0][:1] for c in self.n if len(c[0]) == len(context) + 1 and c[0][1:] == context} | ({extra[0][self.depth - len(context) - 1 :][:1]} if mine else set())
        children = sum(self.known(c + context, extra) for c in below)
        return max(own, children) + math.log((1 + math.exp(-abs(own - children))) / 2)

    def predict(self, context, bit):
        return self.known(b"", (context, bit)) - self.known(b"")


def by_hand(docs, depth):
    trees = {}

    def decisions(text):
        data = b"\xff" * depth + (text or "").encode() + b"\xff"
        for at in range(depth, len(data)):
            for k in range(8):
                yield data[at - depth : at], 1 << k | data[at] >> (8 - k), data[at] >> (7 - k) & 1

    said = Counter()
    for doc_id, text, *_ in docs:
        if held(doc_id) is False:
            said.update(tokens(text))
            for context, node, bit in decisions(text):
                trees.setdefault(node, Tree(depth)).add(context, bit)
    n, v = sum(said.values()), len(said)
    for doc_id, text, *_ in docs:
        score = sum(trees.setdefault(node, Tree(depth)).predict(context, bit) for context, node, bit in decisions(text)) / math.log(10)
        own = tokens(text)
        yield doc_id, held(doc_id), len(own), sum(t in said for t in own), n, sum(math.log10((said[t] + 1) / (n + v + 1)) for t in own), score


def tokens(text):
    return [*(text or "").encode().lower().split(), b"the end"]


def sample(seed, n=14):
    r = random.Random(seed)
    docs = [(i, "".join(r.choice("ab  éA\n") for _ in range(r.randint(1, 14))), 1.0, 2) for i in range(n)]
    return docs + [(n, None, 1.0, 2), (n + 1, "", 1.0, 2), (None, "ab a", 1.0, 2), docs[0], docs[0], (0, "bb \x00\x7f", 1.0, 2)]


@pytest.mark.parametrize("depth", [2, 3])
def test_as_by_definition(spark, depth):
    docs = sample(depth)
    got = ctw.scores(spark.createDataFrame(docs, SCHEMA).repartition(3), depth=depth).collect()
    key = lambda r: (repr(r[0]), round(r[6], 6), r[2])
    want = sorted(by_hand(docs, depth), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want] and any(r[1] for r in got)
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], abs=1e-9)


def test_probabilities_of_all_symbols_add_up_to_one(spark):
    learn = [(i, "abcab", 1.0, 2) for i in range(20) if held(i) is False]
    # All one-byte texts and the empty one are held out, as they have no id, and their first symbols are the only ones that differ.
    ask = [(None, chr(c), 1.0, 2) for c in range(128)] + [(None, "", 1.0, 2)]
    rows = ctw.scores(spark.createDataFrame(learn + ask, SCHEMA), depth=2).filter("doc_id IS NULL").collect()
    end = {r.score for r in rows if r.n_bytes == 0}
    assert len(end) == 1 and 0 < sum(10**r.score for r in rows) < 1


def test_slices_pieces_and_long_texts_do_not_matter(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["on", "the", "Shore", "of", "sand\t"]) for _ in range(r.randint(0, 60))), 1.0, 2) for i in range(300)]
    docs.append((300, " ".join(r.choice(["longer", "text", "words"]) for _ in range(400_000)), 1.0, 2))
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    whole = {x.doc_id: x for x in ctw.scores(frame).collect()}
    for name, value in {"PIECE": 1000, "CUT": 500, "PART": 64, "SLICE_LEAST": 3000, "SLICES": 1 << 20, "BUCKETS_LEAST": 7, "BUCKETS_MOST": 7, "MOST_WORDS": 2}.items():
        monkeypatch.setattr(ctw, name, value)
    for x in ctw.scores(frame).collect():
        assert tuple(x)[:5] == tuple(whole[x.doc_id])[:5]
        assert (x.score, x.base_score) == pytest.approx((whole[x.doc_id].score, whole[x.doc_id].base_score), rel=1e-9)


def test_empty_table_and_nothing_to_learn(spark):
    assert not ctw.scores(spark.createDataFrame([], SCHEMA)).collect()
    (row,) = ctw.scores(spark.createDataFrame([(None, "ab", 1.0, 2)], SCHEMA)).collect()
    assert row.held_out is None and row.n_known == 0 and row.train_tokens == 0
    assert row.score == pytest.approx(24 * math.log10(0.5)) and row.base_score == pytest.approx(0.0)


def test_hash_table_of_grams():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 48, 5000))
    values = r.standard_normal(len(keys))
    assert (ctw._Table(keys, values).get(keys[::-1].copy()) == values[::-1]).all()
