"""The pipeline's stages, each against a brute-force version of it on what it was given."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sondeflow.llm import crf, pii
from sondeflow.llm.common import table

from .test_near_duplicates import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(300):
        w = r.choices(words, k=r.randint(1, 70))
        toxic = int(k % 6 == 0)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), "grobelix")
        if k % 7 == 0:
            w.insert(r.randrange(len(w)), "me (at) there (dot) com")
        rows.append((k, " ".join(w), "en", f"s{k % 3}", 0))
        labels.append((k, 1, toxic))
    for k in range(300, 360):  # near copies
        w = rows[r.randrange(1, 300, 2)][1].split()
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w), "en", None if k % 5 == 0 else "s0", 0))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, "a b c", "en", "s1", 5), (5, rows[5][1], "en", "s2", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What went into each stage and came out, and the last rows."""
    docs, seen = table(spark, folder, "documents"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, folder)
        out.write.parquet(f"{folder}/out-{k}")
        after = spark.read.parquet(f"{folder}/out-{k}")
        seen.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {n: (a, b, c) for n, a, b, c in seen}


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, folder, stages):
    before, after, _ = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    learn = [(r.text.encode(), labels[r.doc_id] > 0) for r in sorted((r for r in before if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 != 2), key=lambda r: r.doc_id)]
    assert sum(y for _, y in learn) > 20
    bad = {r.doc_id for r in before if "grobelix" in (r.text or "")}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
    assert len(after) == sum(r.doc_id not in bad for r in before)
    assert crf.SAMPLE >= len(learn)


def test_near_duplicates(stages):
    before, after, _ = stages["near_duplicates"]
    once = {}
    for r in before:
        once.setdefault(r.doc_id, r.text)
    want = {d for d, (_, _, kept) in brute([(d, t) for d, t in once.items() if d is not None], 5, 80).items() if kept}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in after) == 1


def test_pii(stages):
    before, after, _ = stages["pii"]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in after), key=str)

    def clean(t):
        return t if t is None else pii.redacted(t, pii.in_order(sum(pii.spans(t), [])))

    assert got == sorted(((r.doc_id, clean(r.text), len(clean(r.text) or "")) for r in before), key=str)
    assert any("<EMAIL>" in (r.text or "") for r in after) and not any("(at)" in (r.text or "") for r in after)


def test_mixing(stages):
    before, after, _ = stages["mixing"]
    size = {r.doc_id: len((r.text or "").split()) for r in before}
    took = {}
    for r in after:
        took[r.doc_id] = took.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(took[d] <= 3 * size[d] for d in took)
    by = lambda rows, of: {s: sum(of(r) for r in rows if r.source == s) for s in {r.source for r in rows}}
    sizes = by(before, lambda r: size[r.doc_id])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    from sondeflow.llm.mixing import targets

    goal = targets([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    got = by(after, lambda r: len(r.text.split()))
    for s, t in zip(names, goal):
        assert abs(got.get(s, 0) - t) <= 0.02 * t + 10


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after, _ = stages["packing"]
    t = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = sorted(((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before), key=str)
    assert any(d is None for d, _ in want)
    docs = {}
    for r in after:
        docs.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in after) == sum(n for _, n in want)
    assert {(r.doc_id, r.doc_tokens) for r in after} == set(want)
    assert len({r.sequence_id for r in after}) == len(after) and all(r.length & (r.length - 1) == 0 for r in after)


def test_run_is_the_stages(spark, folder, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(key, stages["packing"][1]), key=str)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert np.all([f is not None for _, f in corpus_pipeline.STAGES])
