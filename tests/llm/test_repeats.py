"""Rows that repeat a doc_id with other texts, or have none."""

import corpus_pipeline
from sondeflow.llm.mixing import mix_plan, mixed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_other_texts_of_an_id_stay(spark):
    say = lambda name, n=12: " ".join(f"{name}{i}" for i in range(n))
    texts = [(3, say("a")), (7, say("a")), (7, say("b")), (7, say("c")), (7, say("c")), (2, say("c")), (8, say("d")), (8, say("e")), (9, ""), (9, ""), (9, None), (9, None), (9, say("f")), (None, say("a")), (None, say("a"))]
    rows = [(d, t, "en", f"s{k % 2}", len(t or "")) for k, (d, t) in enumerate(texts)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    want = [(3, say("a")), (7, say("b")), (2, say("c")), (8, say("d")), (8, say("e")), (9, ""), (9, None), (9, say("f")), (None, say("a")), (None, say("a"))]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_each_row_is_mixed_by_its_own_plan(spark):
    rows = [(None if k % 10 == 0 else k // 2, " ".join(f"{k}.{i}" for i in range(3 + 11 * k % 70)), "en", f"s{k % 4}", 5) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    size = {t: len(t.split()) for _, t, *_ in rows}
    plan = mix_plan(df).collect()
    want, took, of = {}, {}, {}
    for r in plan:
        of.setdefault((r.doc_id, r.source, r.size), []).append(r.taken)
    out = mixed(df).collect()
    for r in out:
        own = {w.split(".")[0] for w in r.text.split()}
        assert len(own) == 1 and r.n_chars == len(r.text)
        k = int(own.pop())
        assert r.doc_id == rows[k][0] and r.source == rows[k][3]
        took[k] = took.get(k, 0) + len(r.text.split())
    for k, (d, t, _, s, _) in enumerate(rows):
        want.setdefault((d, s, size[t]), []).append(took.get(k, 0))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in of.items()}
    assert sum(v for k, v in took.items() if k % 10 == 0) > 0
