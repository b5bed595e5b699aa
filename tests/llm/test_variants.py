import random
import re
import zlib
from collections import Counter

import pytest

from sondeflow.llm import spelling
from sondeflow.llm.spelling import variants

SCHEMA = "doc_id long, text string, word string, n long"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(docs):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if x != w and one_apart(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def corpus(seed, letters, docs=60, words=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(90)]
    texts = [(i, " ".join(r.choice(vocabulary[: r.randint(1, 90)]) for _ in range(words)), "x", i) for i in range(docs)]
    long = " ".join(r.choice(vocabulary) for _ in range(200_000))
    odd = [(None, "Éclair ÉCLAIR éclair éclair éclair× " * 4 + "chainab " * 3 + "Chainaa " * 7 + "chainea " * 20, "", 0), (docs, None, "", 0), (docs + 1, "", "", 0), (docs + 2, "12 3,4 \n", "", 0), (docs + 3, long, "", 0), texts[0], texts[0], (docs + 4, "a" * 30_000 + "b" + " " + "a" * 30_000, "", 0)]
    return texts + odd + [(docs + 4, odd[-1][1], "", 1)] * 3


@pytest.mark.parametrize("heavy", [1 << 15, 60])
def test_as_by_hand(spark, monkeypatch, heavy):
    monkeypatch.setattr(spelling, "HEAVY", heavy)  # 60: partitions are dealt again, as those of a hot prefix are
    docs = corpus(heavy, "abÀé")
    got = variants(spark.createDataFrame(docs, SCHEMA).repartition(5)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(docs), key=str)
    assert any(r.form for r in got) and any(r.form and r.root != r.form for r in got)


def test_one_prefix_holds_a_third_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HEAVY", 500)
    r = random.Random(5)
    words = list({"prefixes" + "".join(r.choice("abc") for _ in range(8)) for _ in range(400)} | {"".join(r.choice("abcdef") for _ in range(6)) for _ in range(800)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    parts = spelling.partitions(frame)
    assert max(x["points"] for x in parts.selectExpr("m", "left", "right", "backwards", "key", "length(path) AS k").groupBy("m", "left", "right", "backwards", "key").agg({"k": "sum"}).withColumnRenamed("sum(k)", "points").collect()) <= 500
    got = [tuple(x) for x in spelling.near_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a != b and one_apart(a, b)}


def test_empty_table(spark):
    got = variants(spark.createDataFrame([], SCHEMA))
    assert set(got.columns) == {"word", "form", "root", "n", "n_near", "form_n"} and not got.collect()
