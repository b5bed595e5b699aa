"""Token counts by a linear longest-match automaton.

The vocabulary's byte strings form a trie. Each node that the greedy longest match can leave has a failure link:
the node that stands for what remains once the longest vocabulary prefix has been popped, and the number
of tokens popped on the way. Reading a word takes each byte once, whatever the vocabulary, and the count
of pieces is the sum of the popped numbers; the pieces themselves are never built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sondeflow.llm.common import equal_spans, joined, text_slices, tidy, word_hashes, words
from sondeflow.llm.packing import vocabulary

SCHEMA = "doc_id long, n_words long, n_pieces long, n_unknown long"
CACHE = 400_000
SLICE = 1 << 20


class LongestMatch:
    """Automaton over byte strings: child per byte, failure link and popped-token count per node."""

    def __init__(self, tokens) -> None:
        child: list[dict[int, int]] = [{}]
        token = [False]
        for t in tokens:
            at = 0
            for b in t:
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                    token.append(False)
                at = child[at][b]
            token[at] = at != 0
        fail, pops = [-1] * len(child), [0] * len(child)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in child[u].items():
                queue.append(v)
                if token[v]:
                    fail[v], pops[v] = 0, 1
                elif u:
                    z, n = fail[u], pops[u]
                    while z > 0 and b not in child[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0 and b in child[z]:
                        fail[v], pops[v] = child[z][b], n
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match, or -1 if it gets stuck on bytes the vocabulary lacks."""
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for b in word:
            while (to := child[at].get(b)) is None:
                if at == 0 or fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(vocabulary(path)[0])


@lru_cache(maxsize=2)
def _known(path: str) -> dict[bytes, int]:
    """Pieces of words that this worker has read; emptied at CACHE entries."""
    return {}


def _pieces(texts: list[bytes], count, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and text number of each word. The automaton reads each distinct word once."""
    data, at = joined(texts)
    start, end = words(data)
    first, kind = equal_spans(word_hashes(data, start, end, lower=False), data, start, end - start)
    if len(known) + len(first) > CACHE:
        known.clear()
    whole, n = data.tobytes(), []
    for a, b in zip(start[first].tolist(), end[first].tolist()):
        word = whole[a:b]
        if (x := known.get(word)) is None:
            x = known[word] = count(word)
        n.append(x)
    return np.array(n, np.int64)[kind], np.searchsorted(at, start, "right") - 1


def count_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Words and greedy word pieces of each document.

    docs: doc_id, text; other columns are ignored. Words are parted by blank and tab to carriage return, and matched
    as UTF-8 bytes. A word the vocabulary cannot spell is one piece and counts as unknown. A null or empty
    text has no words. Repeated rows are counted each. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton(tokenizer).count, _known(tokenizer)
        for batch in batches:
            for part, texts in text_slices(batch, 1, SLICE):
                pieces, doc = _pieces(texts, count, known)
                stuck = pieces < 0
                cols = [np.bincount(doc, w, len(texts)).astype(np.int64) for w in (None, np.where(stuck, 1, pieces), stuck)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
