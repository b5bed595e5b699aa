import zlib

import numpy as np
import pytest

from sondeflow.llm.packing import cuts, pack, vocabulary
from sondeflow.llm.wordpiece import LongestMatch, count_pieces

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = [None, "", "Hello world", "naïve üöß ñandú " * 90, " \n\t x", "<|endoftext|> and more", "word " * 4000, "日本語😀", "a" * 3000]


def greedy(word, vocab, longest):
    n = 0
    while word:
        k = next((k for k in range(min(len(word), longest), 0, -1) if word[:k] in vocab), 0)
        if not k:
            return -1
        word, n = word[k:], n + 1
    return n


def test_automaton_as_greedy_longest_match():
    r = np.random.default_rng(0)
    for _ in range(300):
        vocab = {bytes(r.choice(list(b"abc"), int(r.integers(1, 6))).tolist()) for _ in range(int(r.integers(1, 12)))}
        count = LongestMatch(vocab).count
        for _ in range(30):
            word = bytes(r.choice(list(b"abc"), int(r.integers(0, 14))).tolist())
            assert count(word) == greedy(word, vocab, 6), (vocab, word)


def test_counts(spark):
    vocab = set(vocabulary(PATH)[0])
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(TEXTS)] + [(None, "Hello", 0), (2, TEXTS[2], 0)], "doc_id long, text string, n_words int")
    longest = max(map(len, vocab))
    got = count_pieces(df, PATH).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        words = (TEXTS[r.doc_id] or "").split() if r.doc_id is not None else ["Hello"]
        n = [greedy(w.encode(), vocab, longest) for w in words]
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(max(x, 1) for x in n), n.count(-1))
    assert count_pieces(df.limit(0), PATH).count() == 0


def test_cuts():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        c = cuts(n)
        assert sum(c) == n and all(x & (x - 1) == 0 and x <= 1024 for x in c)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(k, x, "y") for k, x in enumerate(TEXTS)], "doc_id long, text string, bucket string").repartition(3)
    got = pack(df, PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and {r.offset for r in got} == {0}
    for k, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == k)
        at = 0
        for start, length, crc, total in mine:
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert pack(df.limit(0), PATH).count() == 0


def test_sequences_of_a_bucket_follow_each_other(spark):
    df = spark.createDataFrame([(k % 7 if k % 5 else None, "word " * (37 * k % 900)) for k in range(60)], "doc_id long, text string").coalesce(1)
    got = sorted(pack(df, PATH, with_ids=True).collect(), key=lambda r: r.sequence_id)
    assert [r.bucket for r in got] == sorted(r.bucket for r in got) and all(r.length == len(r.ids) == 1 << r.bucket for r in got)
    by = {}
    for r in got:
        by.setdefault(r.bucket, []).append(r.sequence_id)
    assert all(np.diff(v).tolist() == [1] * (len(v) - 1) for v in by.values())
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert sum(r.doc_id is None for r in got) > 0 and sum(r.ids[-1] == 0 for r in got) >= 60


def test_fast_and_slow_encoders_agree_on_all_texts():
    import pyarrow.parquet as pq

    from sondeflow.llm.packing import encoder

    e = encoder(PATH)
    assert e.ranked
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    assert [e(t) for t in texts] == [x.ids for x in e.slow.encode_batch(texts, add_special_tokens=False)]


def test_other_files_go_through_the_slow_encoder(tmp_path):
    import json

    from sondeflow.llm.packing import Encoder

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file), encoding="utf-8")
    e = Encoder(str(other))
    assert not e.ranked and e("word here") == e.slow.encode("word here", add_special_tokens=False).ids


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    from sondeflow.llm import wordpiece

    monkeypatch.setattr(wordpiece, "word_hashes", lambda data, a, b, lower: np.zeros(len(a), np.uint64))
    n, doc = wordpiece._pieces([b"aa b aa ccc", b"", b"b"], len, {})
    assert n.tolist() == [2, 1, 2, 3, 1] and doc.tolist() == [0, 0, 0, 0, 2]
