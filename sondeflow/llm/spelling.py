"""Grouping of spelling variants: a trie self-join with active-node sets over the corpus' vocabulary.

Two words at distance one share all code points before the edit and all after it. So of a pair of words of lengths m and m or m + 1, both either begin
with the same first half of m code points or end with the same second half. The vocabulary is dealt twice for each length m of the
shorter word: by first halves, with the rest of the word as a path of the partition's trie, and by second halves, with the beginning
of the word read backwards as the path. In a trie each node's active nodes, those at most one edit from it, follow from its parent's,
and terminal nodes that are active at distance one are pairs.

Skew: partitions whose paths hold more than HEAVY code points are dealt again by halves of what is left of their words, as often as
needed; a path of one or two code points ends this, so a partition's size is bounded by the alphabet and not by the vocabulary. No word and no pair is left out, and
a word is copied at most about twice its length times. Nothing but counts of heavy partitions' rows reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import forget, tidy, written

#: Runs of Latin letters.
RUN = "[A-Za-zÀ-ÿ]+"
#: Code points of paths from which a partition is dealt again.
HEAVY = 1 << 15
#: Words that a task counts before it gives the counts on.
MOST_WORDS = 1 << 17


def _runs(text: str) -> Counter:
    """The runs of a text in lower case (A-Z only), as UTF-8, with their numbers. Equal runs are counted together as they come, so a long text needs no more room than its words."""
    raw = Counter(m[0] for m in re.finditer(RUN, text))
    out: Counter = Counter()
    for run, n in raw.items():
        out[run.encode().lower()] += n
    return out


def _slipped(doc_id: int | None, run: bytes, every: int) -> str:
    """The run as a word, without one code point if `every` divides the crc32 of `<doc_id>:<run>`."""
    word = run.decode()
    if doc_id is not None and (h := zlib.crc32(b"%d:" % doc_id + run)) % every == 0:
        k = h % len(word)
        return word[:k] + word[k + 1 :]
    return word


def vocabulary(docs: DataFrame, shortest: int, fewest: int, every: int) -> DataFrame:
    """word, n: the words of at least `shortest` code points that occur at least `fewest` times in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, n in _runs(text.as_py() or "").items():
                    if len(word := _slipped(doc_id, found, every)) >= shortest:
                        total[word] += n
                if len(total) > MOST_WORDS:
                    yield counted(total)
                    total = Counter()
        yield counted(total)

    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def _halves(m: Column, left: Column, right: Column) -> Column:
    """The two ways to deal a word of a pair whose shorter word has m code points, `left` first and `right` last ones of which are the partition's already."""
    rest = m - left - right
    back = F.call_function("div", rest, F.lit(2)).cast("int")
    way = lambda a, b, backwards: F.struct(a.cast("int").alias("left"), b.cast("int").alias("right"), F.lit(backwards).alias("backwards"))
    return F.explode(F.array(way(left + rest - back, right, False), way(left, right + back, True)))


_KEY = ("m", "left", "right", "backwards", "key")


def _keyed(dealt: DataFrame) -> DataFrame:
    """With `key`, the code points that a partition's words share, at either end, and `path`, those between them in the trie's direction."""
    size = F.length("word")
    key = F.concat(F.substr("word", F.lit(1), F.col("left")), F.lit(" "), F.substr("word", size - F.col("right") + 1, F.col("right")))
    path = F.substr("word", F.col("left") + 1, size - F.col("left") - F.col("right"))
    return dealt.withColumn("key", key).withColumn("path", F.when(F.col("backwards"), F.reverse(path)).otherwise(path))


def _sizes(dealt: DataFrame) -> DataFrame:
    """The partitions that hold a pair at all, by the number of words and the code points of their paths."""
    sizes = dealt.groupBy(*_KEY).agg(F.count("*").alias("words"), F.sum(F.length("path")).alias("points"), F.min(F.length("word")).alias("least"))
    return sizes.filter((F.col("words") > 1) & (F.col("least") == F.col("m")))


def partitions(words: DataFrame) -> DataFrame:
    """m, left, right, backwards, key, path, word: a row for each word of each partition with two words or more; `tables` of the result are the tables it reads."""
    size = F.length("word")
    shorter = words.select("word", F.explode(F.array(size, size - 1)).alias("m"))
    dealt = _keyed(shorter.select("word", "m", _halves(F.col("m"), F.lit(0), F.lit(0)).alias("way")).select("word", "m", "way.*"))
    done, tables = None, []
    while True:
        sizes = written(_sizes(dealt).select(*_KEY, ((F.col("points") > HEAVY) & (F.col("m") - F.col("left") - F.col("right") > 1)).alias("heavy")), "sizes")
        kept = written(dealt.join(sizes, list(_KEY)).select(*_KEY, "path", "word", "heavy"), "kept")
        forget(sizes)
        tables.append(kept)
        light = kept.filter("NOT heavy").drop("heavy")
        done = light if done is None else done.union(light)
        again = kept.filter("heavy")
        if again.isEmpty():
            done.tables = tables
            return done
        ways = again.select("word", "m", _halves(F.col("m"), F.col("left"), F.col("right")).alias("way"))
        # A word comes from both sides to the same place; it is there once.
        dealt = _keyed(ways.select("word", "m", "way.*").distinct())


class _Trie:
    """Children, terminals and depth-first order of the paths of one partition."""

    def __init__(self, paths: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.parent, self.label, self.ends = [-1], [""], [-1]
        for k, path in enumerate(paths):
            node = 0
            for c in path:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.parent.append(node)
                    self.label.append(c)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = k

    def near(self) -> Iterator[tuple[int, int]]:
        """Pairs of different paths at distance one, each once: walks down with the active nodes of the nodes on the way."""
        root = {0: 0} | {v: 1 for v in self.children[0].values()}
        stack = [(0, root)]
        while stack:
            node, active = stack.pop()
            for c, child in self.children[node].items():
                below = self._below(active, c)
                k = self.ends[child]
                if k >= 0:
                    for other, distance in below.items():
                        if distance == 1 and self.ends[other] > k:
                            yield k, self.ends[other]
                if self.children[child]:
                    stack.append((child, below))
            if node == 0 and self.ends[0] >= 0:
                for other, distance in active.items():
                    if distance == 1 and self.ends[other] > self.ends[0]:
                        yield self.ends[0], self.ends[other]

    def _below(self, active: dict[int, int], c: str) -> dict[int, int]:
        """Active nodes of a child by label c: c is matched, replaced, or stands against nothing; a match may be followed by one more code point."""
        out: dict[int, int] = {}
        for node, distance in active.items():
            if distance == 0:
                out.setdefault(node, 1)
                for x, v in self.children[node].items():
                    if x != c:
                        out.setdefault(v, 1)
            match = self.children[node].get(c)
            if match is not None and out.get(match, 2) > distance:
                out[match] = distance
                if distance == 0:
                    for v in self.children[match].values():
                        out.setdefault(v, 1)
        return out


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: the pairs of words at distance one, both ways round, each once, as a table. words: distinct words in `word`, two code points or more."""
    parts = partitions(words)
    keys = list(_KEY)
    rows = parts.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, paths, held = None, [], []
        for batch in batches:
            for *key, path, word in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    yield from found(now, paths, held)
                    now, paths, held = key, [], []
                paths.append(path)
                held.append(word)
        yield from found(now, paths, held)

    def found(key: list | None, paths: list[str], held: list[str]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for i, j in _Trie(paths).near():
            if min(len(held[i]), len(held[j])) == key[0]:
                a += [held[i], held[j]]
                b += [held[j], held[i]]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    out = written(rows.select(*keys, "path", "word").mapInArrow(tidy(run), "a string, b string").distinct(), "pairs")
    forget(*parts.tables)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that is reached from each word that has one. forms: word, form, without circles.

    Each round follows all known ways to their ends' ends, so a chain of length c takes log2(c) rounds; a form has at least twice its word's n, so chains are short.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = after.drop("moved")
        now.written_at = after.written_at
        if after.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, shortest: int = 5, fewest: int = 3, times: int = 2, every: int = 97) -> DataFrame:
    """word, form, root string; n, n_near, form_n long: a row for each word of the vocabulary.

    docs: doc_id long, text string; other columns are ignored. Words are the maximal runs of Latin letters in lower case (A-Z only), less the code point at h % length if
    `every` divides h, the crc32 of `<doc_id>:<run>`; a null doc_id has no h, so its runs stay. Only words of at least `shortest` code points (2 or
    more) and `fewest` occurrences are returned. n_near counts the words at exactly one inserted, deleted or replaced code point. The form is the near word of
    largest n, the smallest in code point order of several, if its n is at least `times` the word's (2 or more); root is where forms lead to, or the word
    itself. A null or empty text has no words, repeated rows count each, and an empty table gives no rows.
    """
    if shortest < 2 or times < 2:
        raise ValueError("shortest and times must be 2 or more")
    words = written(vocabulary(docs, shortest, fewest, every), "words")
    pairs = near_pairs(words.select("word"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("word").alias("form")))
    near = pairs.join(words, F.col("b") == F.col("word")).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = F.coalesce(-F.col("best.minus") >= times * F.col("n"), F.lit(False))
    told = words.join(near, F.col("word") == F.col("a"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
    )
    told = written(told, "told")
    forget(words, pairs)
    ends = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
