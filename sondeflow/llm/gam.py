"""Text quality by a generalised additive model with pairwise interactions.

Each text becomes a row of numeric features. Features are cut into bins at quantiles of the sample. Boosting goes round the
features in turn, each time fitting a shallow regression tree of one feature to the gradient and adding it, shrunk, to
that feature's lookup table; then pairs of features, the most useful first, get two-dimensional tables in the same way. A score is
a sum of table entries: one index and one addition a table, over all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import in_slices, joined, remainder_of_id, text_slices, tidy, word_hashes, words
from sondeflow.llm.crf import labelled_sample

SAMPLE = 16_000  #: labelled rows the model is fitted on at most
SAMPLE_BYTES = 96 << 20  #: and their texts' bytes at most
BINS, COARSE = 64, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, LEAVES = 0.1, 4

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "digit", "punct", "bang", "pipe", "comma", "period", "high_byte",
    "white", "line_bytes", "distinct_words", "top_word", "repeated_lines", "repeat_gap", "long_words", "short_words", "title_words", "symbol", "distinct_pairs",
)


def _class(chars) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[list(chars)] = 1
    return t


_UPPER, _DIGIT = _class(range(0x41, 0x5B)), _class(range(0x30, 0x3A))
_PUNCT = _class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SYMBOL = _class(b"#$%&*+/<=>@[\\]^_`{|}~")
_COUNTED = {"upper": _UPPER, "digit": _DIGIT, "punct": _PUNCT, "bang": _class(b"!?"), "pipe": _class(b"|\t"), "comma": _class(b",;"), "period": _class(b"."), "high_byte": _class(range(0x80, 0x100)), "white": _class(b" \t\n\r\x0b\x0c"), "symbol": _SYMBOL}


def _distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values, and count of the most frequent, for each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    most = np.zeros(n_docs)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(h))))
    return np.bincount(doc[at], minlength=n_docs), most


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text, finite for every text."""
    n = len(texts)
    data, at = joined(texts)
    size = np.diff(at) - 1.0
    out = np.zeros((len(FEATURES), n))
    f = dict(zip(FEATURES, out))
    f["log_bytes"][:] = np.log1p(size)
    if not len(data):
        return out.T
    per = 1 / np.maximum(size, 1)
    for name, chars in _COUNTED.items():
        f[name][:] = np.add.reduceat(chars[data], at[:-1], dtype=np.float64) * per
    f["white"] -= per  # the blank that ends each text
    start, end = words(data)
    doc = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(doc, minlength=n)
    each = 1 / np.maximum(n_words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(doc, length, n) * each
    f["log_words"][:] = np.log1p(n_words)
    f["word_bytes"][:] = mean
    f["word_bytes_sd"][:] = np.sqrt(np.maximum(np.bincount(doc, length**2, n) * each - mean**2, 0))
    f["long_words"][:] = np.bincount(doc, length >= 14, n) * each
    f["short_words"][:] = np.bincount(doc, length <= 2, n) * each
    f["title_words"][:] = np.bincount(doc, _UPPER[data[start]], n) * each
    h = word_hashes(data, start, end)
    distinct, most = _distinct(h, doc, n)
    f["distinct_words"][:] = distinct * each
    f["top_word"][:] = most * each
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same]
        kinds, _ = _distinct(pairs, doc[1:][same], n)
        f["distinct_pairs"][:] = kinds / np.maximum(n_words - 1, 1)
        order = np.lexsort((np.arange(len(h)), h, doc))
        again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        gap = np.diff(order)[again]
        whose = doc[order][1:][again]
        f["repeat_gap"][:] = np.log1p(np.bincount(whose, gap, n) / np.maximum(np.bincount(whose, minlength=n), 1))
    line = np.flatnonzero(np.isin(data, (0x0A, 0x20)) & ((data == 0x0A) | np.isin(np.arange(len(data)), at[1:] - 1)))
    begin = np.concatenate(([0], line[:-1] + 1))
    whose = np.searchsorted(at, begin, "right") - 1
    n_lines = np.bincount(whose, minlength=n)
    kinds, _ = _distinct(word_hashes(data, begin, line, lower=False), whose, n)
    f["line_bytes"][:] = np.log1p(size / np.maximum(n_lines, 1))
    f["repeated_lines"][:] = 1 - kinds / np.maximum(n_lines, 1)
    return out.T


@dataclass
class Model:
    """cuts: bin edges of each feature; tables: of each feature; pairs: (i, j, table over coarse bins); coarse: fine bin to coarse bin."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = _binned(x, self.cuts)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[k]]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Regression tree over ordered bins by gradient and curvature sums: the best split first, up to `leaves` leaves; a value for each bin."""
    G, H = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda G, H: G * G / (H + 1.0)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        m = np.arange(a + 1, b)
        left, right = (G[m] - G[a], H[m] - H[a]), (G[b] - G[m], H[b] - H[m])
        s = np.where((left[1] > 1) & (right[1] > 1), gain(*left) + gain(*right), 0) - gain(G[b] - G[a], H[b] - H[a])
        k = int(np.argmax(s))
        return float(s[k]), int(m[k])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda k: parts[k][2])
        a, b, s, m = parts[k]
        if s <= 1e-9:
            break
        parts[k : k + 1] = [(a, m, *best(a, m)), (m, b, *best(m, b))]
    out = np.empty(len(g))
    for a, b, *_ in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of P(y = 1). With no rows, or rows of one label, the score is near that label's share (0.5 without any)."""
    y = np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    coarse = [(np.arange(len(c) + 1) * COARSE // (len(c) + 1)) for c in cuts]
    model = Model(cuts, coarse, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts], [])
    if not 0 < y.sum() < len(y):
        return model
    b = _binned(x, cuts)
    total = np.full(len(y), model.base)
    p = lambda: 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            q = p()
            add = RATE * _tree(np.bincount(b[k], y - q, len(t)), np.bincount(b[k], q * (1 - q), len(t)))
            t += add
            total += add[b[k]]
    q = p()
    cell = [c[v] for c, v in zip(coarse, b)]
    worth = []
    for i in range(len(b)):
        for j in range(i):
            at = cell[i] * COARSE + cell[j]
            g, h = np.bincount(at, y - q, COARSE**2), np.bincount(at, q * (1 - q), COARSE**2)
            worth.append((float((g * g / (h + 2.0)).sum()), i, j))
    for _, i, j in sorted(worth, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, np.zeros((COARSE, COARSE))))
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            q = p()
            at = cell[i] * COARSE + cell[j]
            g = np.bincount(at, y - q, COARSE**2).reshape(COARSE, COARSE)
            h = np.bincount(at, q * (1 - q), COARSE**2).reshape(COARSE, COARSE)
            add = RATE * _grid_tree(g, h)
            t += add
            total += add[cell[i], cell[j]]
    return model


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Depth two over two features: the best cut of one, then of the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for m in range(1, len(a)):
            found = np.empty_like(a)
            gain = 0.0
            for part in (slice(0, m), slice(m, None)):
                row, curve = a[part].sum(axis=0), b[part].sum(axis=0)
                value = _tree(row, curve, 2)
                found[part] = value
                gain += float((value * row).sum())
            if gain > best:
                best, out = gain, found.T if turn else found
    return out


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), predicted.

    docs: doc_id, text; other columns are ignored. A null text counts as empty, which has a score like any other. Repeated rows are
    scored each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                score = model.score(features(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels.quality, but for rows whose crc32(doc_id) mod 3 is 1, and score every row; adds held_out (true there; null for a null id)."""
    texts, y = labelled_sample(docs, labels, "quality", 3, 1, SAMPLE, SAMPLE_BYTES)
    x = np.concatenate([features(texts[i:j]) for i, j in in_slices(texts, [len(t) for t in texts])]) if texts else np.zeros((0, len(FEATURES)))
    return score_quality(docs, fit(x, y)).withColumn("held_out", remainder_of_id(F.col("doc_id"), 3) == 1)
