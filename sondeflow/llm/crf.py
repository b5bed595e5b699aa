"""Toxic spans by a linear-chain conditional random field over tokens.

Two tags, clean and toxic. A token's features, itself, its beginnings and its end, the tokens before and after it, and its shape, look up weights for the
toxic tag; tags of neighbouring tokens interact through a 2 x 2 matrix. Documents are labelled as wholes, so the token labels that the field learns from
come from the labelled sample itself: in a toxic document, tokens marked by a feature of their own that toxic documents hold far more often than
others (by document frequencies with a margin for chance, near copies counted once). Every feature that LEAST documents hold has a weight: which of them
matter the fit decides, by gradient ascent on the conditional likelihood under an L1 and an L2 penalty; the gradient is the labels less the
forward-backward marginals. Only features whose gradient exceeds the L1 penalty are worked with, and most weights stay at 0.

A document's score is a logistic function of its aggregated marginals (the largest, and the log of one more than the sum of those above 0.05), fitted on
the same sample. The chain of all documents of a slice is one product of 2 x 2 matrices that resets at each document's first
token; it is evaluated in blocks, each step over all blocks at once. The fit works through its slices on several threads of the driver.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import U64, from_text, in_slices, mix64, remainder_of_id, trim
from sondeflow.llm.tokens import OWN, tokens

SAMPLE = 3000  #: labelled rows the field is fitted on at most, in the order of a hash of their id
SAMPLE_BYTES = 8 << 20  #: and their texts' bytes at most
LEAST = 3  #: documents of the sample that hold a feature with a weight
STEPS = (6, 14, 6)  #: of the ascent, between searches for features whose gradient exceeds the L1 penalty; the others stay at 0
L1, L2 = 2.0, 0.05
SPAN = 0.5
BLOCK = 64
FIT_BYTES = 1 << 19  #: of texts whose marginals are held at a time and thread when fitting
THREADS = 2


@dataclass
class Field:
    """keys: sorted feature hashes; weight: of the toxic tag for each; bias of the toxic tag; trans[from, to]; link: logistic coefficients."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float
    trans: np.ndarray
    link: np.ndarray

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)  # low bits of the keys: most features are none of them
        self.seen[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def emission(self, h: np.ndarray) -> np.ndarray:
        weight, e = np.append(self.weight, 0.0), np.full(len(h), self.bias)
        for column in h.T:
            maybe = np.flatnonzero(self.seen[(column & U64(0xFFFF)).astype(np.int64)])
            e[maybe] += weight[_places(self.keys, column[maybe])]
        return e

    def score(self, doc: np.ndarray, p: np.ndarray, n_docs: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(_aggregates(doc, p, n_docs) @ self.link)))


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and (if asked for) P(tag before, tag here) as four rows, zero at first tokens. first: a document begins here."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((4, 0))
    t = np.exp(trans)
    top = np.maximum(emission, 0)
    low, high = np.exp(-top), np.exp(emission - top)
    open_ = lambda x: np.where(first, 1.0, x)  # noqa: E731 (from a document's end anything may follow)
    step = np.stack((open_(t[0, 0]) * low, open_(t[0, 1]) * high, open_(t[1, 0]) * low, open_(t[1, 1]) * high))
    ahead = _carried(step)  # forward: row vector after each step
    back = np.empty((4, n))  # the steps after each token, last first, transposed
    back[:, 0] = 1.0, 0.0, 0.0, 1.0
    back[:, 1:] = step[[0, 2, 1, 3], :0:-1]
    behind = _carried(back)[:, ::-1]  # backward: what follows, for each tag here
    both = ahead * behind
    p = both[1] / (both[0] + both[1])
    if not pairs:
        return p, np.zeros((4, 0))
    pair = step * behind[[0, 1, 0, 1]]
    pair[:, 1:] *= ahead[[0, 0, 1, 1], :-1]
    pair /= pair.sum(axis=0)
    pair[:, first] = 0.0
    return p, pair


def _carried(step: np.ndarray) -> np.ndarray:
    """Row vector (1, 1) times the product of the 2 x 2 steps (four rows) so far, scaled to sum 1, after each step: two rows.

    Blocks of BLOCK steps are multiplied out side by side, the blocks' products are carried in the same way, and the blocks are gone through
    again from the vectors that they start with.
    """
    n = step.shape[1]
    if n <= BLOCK:
        v0, v1, out = 1.0, 1.0, []
        for a, b, c, d in step.T.tolist():
            v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
            s = v0 + v1
            v0, v1 = v0 / s, v1 / s
            out.append((v0, v1))
        return np.array(out).reshape(n, 2).T
    blocks = -(-n // BLOCK)
    whole = np.empty((4, blocks * BLOCK))
    whole[:, :n] = step
    whole[:, n:] = np.array([[1.0], [0.0], [0.0], [1.0]])
    laid = np.ascontiguousarray(whole.reshape(4, blocks, BLOCK).transpose(0, 2, 1))
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(BLOCK):
        a, b, c, d = laid[:, k]
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        if k % 8 == 7:
            s = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / s, p01 / s, p10 / s, p11 / s
    after = _carried(np.stack((p00, p01, p10, p11)))
    v0, v1 = (np.concatenate(([0.5], x[:-1])) for x in after)
    out = np.empty((2, BLOCK, blocks))
    for k in range(BLOCK):
        a, b, c, d = laid[:, k]
        v0, v1 = v0 * a + v1 * c, v0 * b + v1 * d
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
        out[0, k], out[1, k] = v0, v1
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def _aggregates(doc: np.ndarray, p: np.ndarray, n_docs: int) -> np.ndarray:
    """1, largest marginal, and log of one more than the expected number of toxic tokens; zeros for a document without tokens."""
    most = np.zeros(n_docs)
    np.maximum.at(most, doc, p)
    return np.stack((np.ones(n_docs), most, np.log1p(np.bincount(doc, np.where(p > 0.05, p, 0.0), minlength=n_docs))), axis=1)


def _firsts(n: np.ndarray) -> np.ndarray:
    first = np.zeros(int(n.sum()), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    return first


class _Part:
    """Some documents of the sample: the place of each token's features among the keys, and the labels' sums."""

    def __init__(self, slice_: "_Slice", toxic: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> None:
        h, self.doc, self.n_docs = slice_.h, slice_.doc, slice_.n_docs
        self.first, self.n_keys = _firsts(slice_.n), len(keys)
        self.every = [_places(keys, c).astype(np.int32) for c in h.T]
        y = (_places(marks, h[:, :OWN]) < len(marks)).any(axis=1) & toxic[self.doc]
        inner = np.flatnonzero(~self.first)
        self.seen, self.total = sum(np.bincount(a, y, self.n_keys + 1) for a in self.every)[:-1], y.sum()
        self.edge = np.bincount(2 * y[inner - 1] + y[inner], minlength=4)

    def only(self, active: np.ndarray) -> None:
        """Work with some of the features: for each column the tokens that have one of them, and its place among them."""
        place = np.append(np.where(active, np.cumsum(active) - 1, -1), -1)
        at = [place[a] for a in self.every]
        self.used = [np.flatnonzero(a >= 0) for a in at]
        self.at, self.n_active = [a[u] for a, u in zip(at, self.used)], int(active.sum())

    def emission(self, weight: np.ndarray, bias: float) -> np.ndarray:
        e = np.full(len(self.first), bias)
        for a, u in zip(self.at, self.used):
            e[u] += weight[a]
        return e

    def gradient(self, weight: np.ndarray, bias: float, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """What the model expects of the active features' sums, and the gradients of bias and transitions."""
        p, pair = marginals(self.emission(weight, bias), self.first, trans)
        expected = sum(np.bincount(a, p[u], self.n_active) for a, u in zip(self.at, self.used))
        return expected, self.total - p.sum(), (self.edge - pair.sum(axis=1)).reshape(2, 2)

    def slope(self, weight: np.ndarray, bias: float, trans: np.ndarray) -> np.ndarray:
        """The gradient of every feature."""
        p = marginals(self.emission(weight, bias), self.first, trans, pairs=False)[0]
        return self.seen - sum(np.bincount(a, p, self.n_keys + 1) for a in self.every)[:-1]

    def aggregates(self, weight: np.ndarray, bias: float, trans: np.ndarray) -> np.ndarray:
        return _aggregates(self.doc, marginals(self.emission(weight, bias), self.first, trans, pairs=False)[0], self.n_docs)


class _Slice:
    """Tokens of some texts, read once."""

    def __init__(self, texts: list[bytes]) -> None:
        self.h, self.doc, _, _, self.n = tokens(texts)
        self.n_docs = len(texts)

    def prints(self) -> np.ndarray:
        """Four smallest hashes of token pairs for each text, a column each; the largest value for a text of one token or none."""
        x = self.h[:, 0]
        inner = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        pairs, doc = x[inner] * U64(0x9E3779B97F4A7C15) + x[inner + 1], self.doc[inner]
        out = np.full((self.n_docs, 4), ~U64(0), U64)
        if len(doc):
            at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            for j in range(4):
                out[doc[at], j] = np.minimum.reduceat(mix64(pairs ^ U64((j + 1) * 0x1851F42D4C957F2D)), at)
        return out

    def only(self, chosen: np.ndarray) -> None:
        """Keep some of the texts."""
        keep = chosen[self.doc]
        self.h, self.doc, self.n = self.h[keep], (np.cumsum(chosen) - 1)[self.doc[keep]], self.n[chosen]
        self.n_docs = int(chosen.sum())

    def holders(self, which: np.ndarray, columns: int) -> np.ndarray:
        """Features of the first columns, each once for each of the chosen texts that holds it; without the absent ones."""
        some = which[self.doc]
        doc, out = self.doc[some], []
        for column in range(columns):
            h = self.h[some, column]
            order = np.lexsort((h, doc))
            h, d = h[order], doc[order]
            fresh = h != 0
            fresh[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            out.append(h[fresh])
        return np.concatenate(out)


def _places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted keys, their number for none."""
    if not len(keys):
        return np.zeros(h.shape, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, len(keys))


def _originals(prints: np.ndarray) -> np.ndarray:
    """Which texts are no near copies of earlier ones: those share two of four smallest hashes of token pairs."""
    seen: set[tuple[int, int]] = set()
    kept = np.ones(len(prints), bool)
    for k, row in enumerate(prints.tolist()):
        if row[0] == (1 << 64) - 1:
            continue
        mine = list(enumerate(row))
        kept[k] = sum(m in seen for m in mine) < 2
        seen.update(mine)
    return kept


def _marks(slices: list[_Slice], toxic: list[np.ndarray]) -> np.ndarray:
    """Features of a token's own that mark toxicity: the lower end of their share among toxic documents is well above the upper end elsewhere."""
    n_toxic, n_clean = sum(t.sum() for t in toxic), sum((~t).sum() for t in toxic)
    marks, with_ = np.unique(np.concatenate([s.holders(t, OWN) for s, t in zip(slices, toxic)]), return_counts=True)
    often = with_ >= max(4, 0.01 * n_toxic)
    marks, with_ = marks[often], with_[often]
    without = np.zeros(len(marks))
    for s, t in zip(slices, toxic):
        at = _places(marks, s.holders(~t, OWN))
        without += np.bincount(at[at < len(marks)], minlength=len(marks))
    low = (with_ - 2 * np.sqrt(with_)) / n_toxic
    high = (without + 2 * np.sqrt(without) + 1) / n_clean
    return marks[low > 6 * high]


def fit(texts: list[bytes], toxic: np.ndarray) -> Field:
    """A field from labelled texts. Without labels of both kinds every score is the share of toxic ones (0 without any)."""
    toxic = np.asarray(toxic, bool)
    share = (toxic.sum() + 0.02) / (len(toxic) + 1)
    none = Field(np.zeros(0, U64), np.zeros(0), -4.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if not toxic.any() or toxic.all():
        return none
    cuts = list(in_slices(texts, [len(t) for t in texts], FIT_BYTES))
    with ThreadPoolExecutor(min(THREADS, os.cpu_count() or 1)) as pool:
        slices = list(pool.map(lambda c: _Slice(texts[c[0] : c[1]]), cuts))
        own = _originals(np.concatenate([s.prints() for s in slices]))
        for s, (i, j) in zip(slices, cuts):
            s.only(own[i:j])
        labels = [toxic[i:j][own[i:j]] for i, j in cuts]
        y = np.concatenate(labels)
        if not y.any() or y.all():
            return none
        marks = _marks(slices, labels)
        if not len(marks):
            return none
        keys, held = np.unique(np.concatenate([s.holders(np.ones(s.n_docs, bool), s.h.shape[1]) for s in slices]), return_counts=True)
        keys = keys[held >= LEAST]
        parts = list(pool.map(lambda x: _Part(x[0], x[1], keys, marks), zip(slices, labels)))
        del slices
        seen = sum(p.seen for p in parts)
        weight, bias, trans = np.zeros(len(keys)), -4.0, np.zeros((2, 2))
        speed = [np.full(len(keys), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
        active = np.zeros(len(keys), bool)
        for steps in STEPS:
            for p in parts:
                p.only(active)
            for _ in range(steps):
                w = weight[active]
                found = list(pool.map(lambda part: part.gradient(w, bias, trans), parts))
                g, g_bias, g_trans = (sum(x) for x in zip(*found))
                g = seen[active] - g - L2 * w
                speed[0][active] += g * g
                rate = 1.0 / np.sqrt(speed[0][active])
                w = w + rate * g
                weight[active] = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0.0)
                g_bias, g_trans = g_bias - L2 * bias, g_trans - 10 * L2 * trans
                speed[1], speed[2] = speed[1] + g_bias * g_bias, speed[2] + g_trans * g_trans
                bias, trans = bias + 0.5 * g_bias / np.sqrt(speed[1]), trans + 0.5 * g_trans / np.sqrt(speed[2])
            slope = sum(pool.map(lambda part: part.slope(weight[active], bias, trans), parts))
            active |= np.abs(slope) > L1
        for p in parts:
            p.only(active)
        x = np.concatenate(list(pool.map(lambda part: part.aggregates(weight[active], bias, trans), parts)))
    used = weight != 0
    del parts
    trim()
    return Field(keys[used], weight[used], float(bias), trans, _logistic(x, y.astype(float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), 0.05)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, rows: int = SAMPLE, most: int = SAMPLE_BYTES, longest: int = 1 << 20) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of the labelled documents that are not held out, in the order of a hash of the id.

    At most `rows` rows and `most` bytes; the bounds are parameters. Texts longer than `longest` bytes stay out of it. An id that repeats counts once: with its
    smallest label, and its text with the smallest digest.
    """
    learn = labels.filter(F.col(column).isNotNull() & (remainder_of_id(F.col("doc_id"), modulus) != held_out))
    once = learn.groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("label"))
    chosen = once.withColumn("at", F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary"))).orderBy("at", "doc_id").limit(rows)
    got = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id", "label", "at").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts, y, total = [], [], 0
    for row in got.sort("at", "doc_id").toLocalIterator():
        text = (row["text"] or "").encode("utf-8", "surrogatepass")
        total += len(text)
        if total > most:
            break
        texts.append(text)
        y.append(row["label"] > 0)
    return texts, np.array(y, bool)


def toxicity_of(text: Column, model: Field, threshold: float = 0.3) -> Column:
    """score, predicted and spans (byte offsets of runs of tokens with marginals of 0.5 or more) of a text, as a struct; see score_toxicity."""

    def kernel(texts: list[bytes]) -> pa.Array:
        h, doc, start, end, n = tokens(texts)
        p, _ = marginals(model.emission(h), _firsts(n), model.trans, pairs=False)
        score = model.score(doc, p, len(texts))
        cols = [pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32()), pa.array(_spans(p, doc, start, end, len(texts)), pa.string())]
        return pa.StructArray.from_arrays(cols, names=["score", "predicted", "spans"])

    return from_text(kernel, "score double, predicted int, spans string", text)


def score_toxicity(docs: DataFrame, model: Field, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, spans (byte offsets of runs of tokens with marginals of 0.5 or more), carrying the document's other columns.

    docs: doc_id, text and any others but score, predicted, spans, which are replaced. A null or empty text has no tokens: its
    score is the logistic function's constant. Repeated rows are scored each; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted", "spans", "__toxicity")]
    return docs.select(*names, toxicity_of(F.col("text"), model, threshold).alias("__toxicity")).select(*names, "__toxicity.*")


def _spans(p: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, n_docs: int) -> list[str]:
    out: list[list[str]] = [[] for _ in range(n_docs)]
    hit = np.flatnonzero(p >= SPAN)
    if len(hit):
        fresh = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(doc[hit]) != 0)))
        a, b = hit[fresh], hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)]
        for x, y in zip(a, b):
            out[doc[x]].append(f"{start[x]}:{end[y]}")
    return [",".join(x) for x in out]


def fitted(docs: DataFrame, labels: DataFrame) -> Field:
    """A field fitted on labels.toxic, but for rows whose crc32(doc_id) mod 4 is 2."""
    return fit(*labelled_sample(docs, labels, "toxic", 4, 2))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fit on labels.toxic, but for rows whose crc32(doc_id) mod 4 is 2, and score every row; adds held_out (true there; null for a null id)."""
    return score_toxicity(docs, fitted(docs, labels), threshold).withColumn("held_out", remainder_of_id(F.col("doc_id"), 4) == 2)
