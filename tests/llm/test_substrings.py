import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sondeflow.llm import substrings, suffixes
from sondeflow.llm.common import equal_spans
from sondeflow.llm.substrings import without_repeats
from sondeflow.llm.suffixes import permuted_prefixes, suffix_array


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc\xff", bytes(range(256))])
def test_suffix_array(letters):
    r = random.Random(len(letters))
    for n in [0, 1, 2, 3, 5, 8, 40, 200, 700]:
        text = bytes(r.choices(letters, k=n)) * r.choice([1, 1, 2])
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_many_names(monkeypatch):
    """The recursion, also where names become two digits."""
    r = random.Random(3)
    words = [bytes(r.choices(range(97, 123), k=r.randint(2, 9))) for _ in range(300)]
    text = b" ".join(r.choices(words, k=3000)) * 2
    want = sorted(range(len(text)), key=lambda i: text[i:])
    for widest in (4096, 20, 1):
        monkeypatch.setattr(suffixes, "WIDEST", widest)
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == want


def test_spans_with_equal_hashes_are_told_apart():
    data = np.frombuffer(b"abcabdabcxbdabcdefghijabcdefghik", np.uint8)
    start, size = np.array([0, 3, 6, 9, 12, 22, 9]), np.array([3, 3, 3, 3, 10, 10, 2])
    got = equal_spans(np.zeros(len(start), np.uint64), data, start, size)[1]
    raw = data.tobytes()
    spans = [raw[a : a + n] for a, n in zip(start, size)]
    assert [[x == y for y in spans] for x in spans] == (got[:, None] == got[None, :]).tolist()


def test_prefixes():
    text = np.frombuffer(b"mississippi-mississippi-missouri", np.uint8)
    order = np.array([i for i in suffix_array(text) if i + 10 <= len(text)])
    got = permuted_prefixes(text, order, 10)
    raw = text.tobytes()
    for a, b in zip(order, order[1:]):
        k = 0
        while k < 10 and raw[a + k] == raw[b + k]:
            k += 1
        assert got[b] == k


def brute(rows):
    smallest = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - 49 if d is not None else 0):
            k = b[i : i + 50]
            smallest[k] = min(d, smallest.get(k, d))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - 49 if d is not None else 0):
            if smallest[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if d is None else d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def documents(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(12)]
    rows = [(None, passages[0]), (1000, None), (1001, ""), (1002, "x" * 49), (1003, "y" * 300), (1004, "y" * 50), (1005, "y" * 120 + "z" + "y" * 60)]
    for k in range(120):
        parts = [r.choice(passages)[r.randint(0, 30) :] if r.random() < 0.4 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        rows.append((k, " ".join(parts)))
    rows += [(2000, rows[20][1]), (2001, rows[20][1]), (2001, rows[20][1]), (3, rows[30][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_as_all_strings(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(substrings, "SHARD", 4000)
    rows = documents(seed)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(df).collect())
    assert got == brute(rows)


def test_a_line_between_different_neighbours(spark, monkeypatch):
    """Anchors of a line that all documents hold are split, and nothing changes."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    line = " ".join(word() for _ in range(20))
    rows = []
    for k in range(150):
        near = r.choice(["a", "b", "ab", word()])
        rows.append((k, " ".join([*(word() for _ in range(10)), near, line, near, *(word() for _ in range(10))])))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    most = []
    for heavy in (10**9, 20):
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(df).collect())
        assert got == want
        hot = substrings._heavy(df, 1 << 20)
        # One slice a document, as if each came from a task of its own.
        to = np.concatenate([substrings._slice([t.encode()], np.array([i]), 64, hot, np.zeros(0, np.int64))["to"] for i, t in rows]) // 2
        most.append(np.bincount(to, minlength=64).max() / (len(to) / 64))
        assert (len(hot[0]) > 0) == (heavy == 20)
    assert most[1] < most[0] / 2


def test_long_text(spark):
    r = random.Random(4)
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60_000))
    rows = [(1, long), (2, long[1000:200_000] + "x" + long[250_000:]), (3, "short")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_without_kept_and_repeated_ids(spark, monkeypatch):
    rows = [(1, "p" * 60 + "q" * 60), (2, "q" * 70), (2, "p" * 80), (2, "q" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (100, 0):
        monkeypatch.setattr(substrings, "MOST_REPEATED", most)
        out = without_repeats(df, with_kept=False)
        assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_line_is_found_in_a_small_sample(spark, monkeypatch):
    """A line between ever different neighbours: its anchors are split at any input size, as the sample does not shrink below one in HEAVY / 8."""
    r = np.random.default_rng(8)
    line = bytes(r.integers(97, 123, 98, np.uint8))
    texts = [(bytes(r.integers(97, 123, 60, np.uint8)) + line + bytes(r.integers(97, 123, 60, np.uint8))).decode() for _ in range(8000)]
    monkeypatch.setattr(substrings, "HEAVY", 400)
    monkeypatch.setattr(substrings, "SAMPLE", 1)  # as of a table that is very much larger
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    heavy = substrings._heavy(frame, sum(map(len, texts)))
    assert 0 < len(heavy[0]) < 200

    def largest(found):
        n = np.zeros(64, np.int64)
        for k in range(0, len(texts), 500):
            to = substrings._slice([t.encode() for t in texts[k : k + 500]], np.arange(k, k + 500), 64, found, np.zeros(0, np.int64))["to"]
            n += np.bincount(to[to % 2 == 0] // 2, minlength=64)
        return n.max() / np.median(n)

    assert largest(heavy) < 3 < largest((heavy[0][:0], heavy[1][:0]))


def test_rows_of_one_id_are_dealt_apart(spark):
    ids, texts = np.full(5000, 7), [f"text {k % 2500} of the same id".encode() for k in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([t.decode() for t in texts])], names=["doc_id", "text"])
    boxes = list(substrings._boxed(8, np.array([7]))(iter([batch])))
    assert len(boxes) == 8 and sum(b.column("n")[0].as_py() for b in boxes) == 2500  # equal rows are one


def test_many_equal_rows(spark):
    text = "one and the same line of text that comes again and again in this table, row after row"
    rows = [(1, text)] * 300 + [(2, text)] * 300 + [(2, text + " with an end")] * 2 + [(None, text)] * 3 + [(3, None)] * 2
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_kept=False).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    n = len(text)
    assert sorted(map(tuple, got), key=str) == sorted([(1, n, 0, 0, 300), (2, n, n, 1, 300), (2, n + 12, n, 1, 2), (None, n, 0, 0, 3), (3, 0, 0, 0, 2)], key=str)
