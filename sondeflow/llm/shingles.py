"""Sets of word shingles as 64-bit hashes, many documents at a time, and fast similarity sketches of them."""

from __future__ import annotations

import numpy as np

from sondeflow.llm.common import U64, joined, mix64, word_hashes, words

EMPTY = ~U64(0)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and their number for each text.

    A text with fewer words than `width` has its whole sequence as one shingle; one without words has none.
    """
    data, at = joined(texts)
    start, end = words(data)
    if not len(start):
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    h = word_hashes(data, start, end)
    doc = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    run = np.zeros(len(h), U64)
    ahead = np.append(h, np.zeros(width, U64))
    own = np.append(doc, np.full(width, -1))
    for k in range(width):  # words past the end of a short text count as absent
        run = mix64(run * U64(0x9E3779B97F4A7C15) + np.where(own[k : k + len(h)] == doc, ahead[k : k + len(h)], U64(k + 1)))
    first = np.cumsum(n_words) - n_words
    here = np.arange(len(h)) - first[doc]
    whole = (here <= n_words[doc] - width) | ((here == 0) & (n_words[doc] < width))
    run, doc = run[whole], doc[whole]
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return run[fresh], np.bincount(doc[fresh], minlength=len(texts))


def fingerprints(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set, equal for equal sets."""
    total = np.zeros((2, len(sets) + 1), U64)
    np.cumsum(mix64(sets), out=total[0, 1:])
    np.cumsum(mix64(sets ^ U64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
    end = np.cumsum(n)
    return total[:, end] - total[:, end - n]


def sketches(sets: np.ndarray, n: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of each set: one row of `bins` values, EMPTY for a set without elements.

    In each of `bins` rounds every element of a set that still has an empty bin falls into one bin with a value above those of
    earlier rounds, and a bin keeps its smallest. As many further rounds put all elements in one bin each, so every bin fills.
    """
    out = np.full((len(n), bins), EMPTY, U64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(n)), n)
    for k in range(2 * bins):
        if not len(sets):
            break
        x = mix64(sets ^ mix64(np.full(1, k + 1, U64)))
        at = doc * bins + ((x % U64(bins)).astype(np.int64) if k < bins else k - bins)
        np.minimum.at(flat, at, (U64(k) << U64(54)) | (x >> U64(10)))
        open_ = (out == EMPTY).any(axis=1)[doc]
        sets, doc = sets[open_], doc[open_]
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of `rows` coordinates, different between bands."""
    n_bands = sketch.shape[1] // rows
    h = np.arange(n_bands, dtype=U64)[None, :] * np.ones((len(sketch), 1), U64)
    for k in range(rows):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + sketch[:, k : n_bands * rows : rows])
    return h
