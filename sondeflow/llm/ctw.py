"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A symbol is a byte of a text's UTF-8, or END, the byte 255, which UTF-8 never has: it ends each text and fills the context before its start. A symbol is
eight binary decisions, one at each node of the path of its leading bits. Each such node has a context tree over the bytes before: at depth d
the node of the last d bytes holds the counts of zeros and ones after them in the training texts, and their Krichevsky-Trofimov
probability. Weighting mixes, at every node above the deepest, its own estimate and the product of its children's, half each. With all counts
known, what a context predicts is a sum over the depths on its path, and a symbol's probability the product over its eight decisions.

Plans: rows are cut into slices by their place in the files, grams (a symbol and the `depth` bytes before it) into buckets by their context without the oldest byte,
words into buckets by their bytes. One scan gives each slice's distinct grams and words with their training counts, packed into a row for each slice and bucket. A
bucket's rows are added up; it holds whole contexts, so it also has the two lowest depths of the trees. Higher depths are groupBys on (context, node), and
weights come back down by joins. Then each bucket answers its slices, and the answers meet the texts slice by slice. Grams and words
that only held-out texts have are in the trees and counts with a count of 0. What is gathered grows with the corpus and is dealt by slice, bucket or context;
a kernel holds one slice's or one bucket's distinct grams and words at most, and the driver sees four totals.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import U64, forget, in_slices, mix64, numbered, remainder_of_id, tidy, written

END = b"\xff"
#: Symbols that a kernel works on at a time, and grams of a packed row, about.
PIECE, PART = 1 << 20, 1 << 16
#: Bytes of text of a slice, about: at most, at least, and slices at least between these.
SLICE_MOST, SLICE_LEAST, SLICES = 32 << 20, 1 << 20, 16
#: Bytes of text for each bucket, and the least and largest number of buckets.
BUCKET, BUCKETS_LEAST, BUCKETS_MOST = 2 << 20, 64, 1 << 14
#: Words that a task counts before it gives the counts on.
MOST_WORDS = 1 << 20
#: Bytes after which a long text is cut for its words, at white space.
CUT = 1 << 20


def log_gamma(x, log: Callable):
    """ln Gamma for x of 1/2 or more, as Columns or arrays: Stirling's series at x + 8."""
    w = x + 8.0
    shift = x * (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    v = 1.0 / (w * w)
    return (w - 0.5) * log(w) - w + 0.5 * math.log(2 * math.pi) + (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v / 1680))) / w - log(shift)


def log_kt(n0, n1, log: Callable):
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5, log) + log_gamma(n1 + 0.5, log) - log_gamma(n0 + n1 + 1.0, log) - math.log(math.pi)


def _grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For about PIECE symbols at a time: the grams, and for each stretch of a text in them the text's place and the number of grams.

    A gram is a number of depth + 1 bytes: the context without its oldest byte, that byte, and the symbol, so that those of one shorter context are neighbours.
    """
    pad = END * depth
    parts, whose, n, size = [], [], [], 0
    for k, text in enumerate(texts):
        framed = pad + text + END
        for at in range(depth, len(framed), PIECE):
            part = framed[at - depth : at + PIECE]
            parts.append(part)
            whose.append(k)
            n.append(len(part) - depth)
            size += len(part)
            if size >= PIECE:
                yield _packed(parts, depth), np.array(whose), np.array(n)
                parts, whose, n, size = [], [], [], 0
    if parts:
        yield _packed(parts, depth), np.array(whose), np.array(n)


def _packed(parts: list[bytes], depth: int) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = len(data) - depth
    out = data[1 : size + 1].astype(np.int64)
    for k in [*range(2, depth), 0, depth]:
        out <<= 8
        out |= data[k : k + size]
    end = np.cumsum([len(p) for p in parts])[:-1]
    inside = np.ones(len(out), bool)
    inside[(end[:, None] - 1 - np.arange(depth)).ravel()] = False  # grams that reach from one part into the next
    return out[inside]


def words(text: bytes) -> Counter:
    """The words of a text, A-Z in lower case; long texts are cut at white space on the way."""
    total: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + CUT
        if end < len(text):
            end = min((k for k in (text.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0), default=len(text))
        total.update(text[at:end].lower().split())
        at = end
    return total


class _Sums:
    """Grams and words with counts that are added up, a bounded number more than the distinct ones."""

    def __init__(self) -> None:
        self.grams, self.n, self.room = [], [], 0
        self.words: Counter = Counter()

    def add(self, grams: np.ndarray, n: np.ndarray) -> None:
        self.grams.append(grams)
        self.n.append(n)
        self.room += len(grams)
        if self.room > max(4 * PIECE, 2 * len(self.grams[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.grams) > 1:
            grams, n = np.concatenate(self.grams), np.concatenate(self.n)
            order = np.argsort(grams, kind="stable")
            grams, n = grams[order], n[order]
            first = np.flatnonzero(np.diff(grams, prepend=-1))
            self.grams, self.n, self.room = [grams[first]], [np.add.reduceat(n, first)], len(first)
        return (self.grams[0], self.n[0]) if self.grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bytes(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _numbers(value: pa.Scalar, kind=np.int64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)


def _word_list(value: pa.Scalar, n: np.ndarray) -> list[bytes]:
    """Words joined by blanks; n has a number for each."""
    return value.as_py().split(b" ") if len(n) else []


_ASKED = "slice long, bucket int, grams binary, n binary, words binary, m binary"


def _asked_rows(slice_: int, sums: _Sums, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of a slice."""
    grams, n = sums.merge()
    of = _bucket(grams, buckets)
    order = np.argsort(of, kind="stable")
    grams, n = grams[order], n[order]
    edge = np.searchsorted(of[order], np.arange(buckets + 1))
    said: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in sums.words:
        said[zlib.crc32(word) % buckets].append(word)
    some = [k for k in range(buckets) if edge[k] < edge[k + 1] or said[k]]
    cut = lambda x: _bytes([x[edge[k] : edge[k + 1]] for k in some])
    m = [np.array([sums.words[w] for w in said[k]], np.int64) for k in some]
    columns = [pa.array([slice_] * len(some), pa.int64()), pa.array(some, pa.int32()), cut(grams), cut(n), pa.array([b" ".join(said[k]) for k in some], pa.binary()), _bytes(m)]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "bucket", "grams", "n", "words", "m"])


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64((grams >> 16).astype(U64)) % U64(buckets)).astype(np.int64)


def _runs(*keys: pa.Array) -> Iterator[tuple[int, int]]:
    """From where to where all keys stay the same."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for key in keys:
        new[1:] |= np.diff(key.to_numpy(zero_copy_only=False).astype(np.int64)) != 0
    edges = [0, *np.flatnonzero(new).tolist(), n]
    yield from zip(edges, edges[1:]) if n else ()


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Parts of a column with about PIECE bytes, as UTF-8, empty for null."""
    data = column.cast(pa.binary())
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in data]
    for i, j in in_slices(data, sizes, PIECE):
        yield i, j, [t or b"" for t in data.slice(i, j - i).to_pylist()]


def _asked_of(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """For each slice and bucket the distinct grams with n and words with m, their occurrences in training texts. docs: slice, learned, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, _Sums()
        for batch in batches:
            for a, b in _runs(batch.column(0), batch.column(1)):
                slice_, learn = (batch.column(k)[a].as_py() for k in (0, 1))
                if slice_ != now or len(sums.words) > MOST_WORDS:
                    if now is not None:
                        yield _asked_rows(now, sums, buckets)
                    now, sums = slice_, _Sums()
                for _, _, texts in _texts(batch.column(2).slice(a, b - a)):
                    for grams, _, _ in _grams(texts, depth):
                        grams, n = np.unique(grams, return_counts=True)
                        sums.add(grams, n if learn else np.zeros(len(n), np.int64))
                    for text in texts:
                        found = words(text)
                        found[b""] = 1  # the end
                        sums.words.update(found if learn else dict.fromkeys(found, 0))
        if now is not None:
            yield _asked_rows(now, sums, buckets)

    return docs.select("slice", "learned", "text").mapInArrow(tidy(run), _ASKED)


def _counts_of(asked: DataFrame) -> DataFrame:
    """bucket, grams, n, words, m, total, kinds: the sums over all slices, whole contexts in each row; training tokens and kinds of them among the words."""
    names = ["bucket", "grams", "n", "words", "m", "total", "kinds"]

    def rows(bucket: int, sums: _Sums) -> Iterator[pa.RecordBatch]:
        grams, n = sums.merge()
        context = grams >> 16
        at = 0
        while at < len(grams):
            end = int(np.searchsorted(context, context[min(at + PART, len(grams)) - 1], "right"))
            yield row(bucket, grams[at:end], n[at:end], [], np.zeros(0, np.int64))
            at = end
        said = list(sums.words.items())
        for at in range(0, len(said), PART):
            word, m = zip(*said[at : at + PART])
            yield row(bucket, grams[:0], n[:0], word, np.array(m, np.int64))

    def row(bucket: int, grams: np.ndarray, n: np.ndarray, said: list[bytes], m: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([bucket], pa.int32()), _bytes([grams]), _bytes([n]), pa.array([b" ".join(said)], pa.binary()), _bytes([m]), pa.array([int(m.sum())], pa.int64()), pa.array([int((m > 0).sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, _Sums()
        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    if now is not None:
                        yield from rows(now, sums)
                    now, sums = bucket, _Sums()
                sums.add(_numbers(batch.column("grams")[k]), _numbers(batch.column("n")[k]))
                m = _numbers(batch.column("m")[k])
                sums.words.update(dict(zip(_word_list(batch.column("words")[k], m), m.tolist())))
        if now is not None:
            yield from rows(now, sums)

    dealt = asked.drop("slice").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(run), "bucket int, grams binary, n binary, words binary, m binary, total long, kinds long")


def _nodes(grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight decisions the nodes of the deepest contexts: each gram's node and bit, and the nodes' first gram, leading bits after a 1, zeros and ones. grams: sorted."""
    for k in range(8):
        prefix = grams >> (8 - k)
        fresh = np.diff(prefix, prepend=-1) != 0
        first = np.flatnonzero(fresh)
        bit = (grams >> (7 - k)) & 1
        ones = np.add.reduceat(counts * bit, first)
        zeros = np.add.reduceat(counts, first) - ones
        yield np.cumsum(fresh) - 1, bit, first, (1 << k) | (prefix[first] & ((1 << k) - 1)), zeros, ones


def _contexts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts without the oldest byte, and which of them each gram has."""
    return np.unique(grams >> 16, return_inverse=True)


def _lowest(counts: DataFrame) -> DataFrame:
    """context, node, n0, n1, s: nodes of the contexts one below the deepest; s is the sum of the logarithms of their children's weighted probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams = _numbers(batch.column("grams")[k])
                if not len(grams):
                    continue
                context, which = _contexts(grams)
                size = 256 * len(context)
                seen, n0, n1, s = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
                for _, _, first, node, zeros, ones in _nodes(grams, _numbers(batch.column("n")[k])):
                    place = which[first] * 256 + node
                    seen[place] = True
                    np.add.at(n0, place, zeros)
                    np.add.at(n1, place, ones)
                    np.add.at(s, place, log_kt(zeros.astype(float), ones.astype(float), np.log))
                at = np.flatnonzero(seen)
                columns = [pa.array(np.full(len(at), batch.column("bucket")[k].as_py(), np.int32)), pa.array(context[at >> 8]), pa.array((at & 255).astype(np.int32)), pa.array(n0[at]), pa.array(n1[at]), pa.array(s[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "context", "node", "n0", "n1", "s"])

    return counts.select("bucket", "grams", "n").mapInArrow(tidy(run), "bucket int, context long, node int, n0 long, n1 long, s double")


def _cut_off(context: Column, depth: int) -> Column:
    """The context without the bytes beyond `depth`."""
    return context.bitwiseAND(F.lit((1 << 8 * depth) - 1))


def _shorter(level: DataFrame, depth: int) -> DataFrame:
    """The nodes of the contexts of `depth`, from those of depth + 1."""
    kt, s = log_kt(F.col("n0").cast("double"), F.col("n1").cast("double"), F.log), F.col("s")
    weighted = F.greatest(kt, s) + F.log((1.0 + F.exp(-F.abs(kt - s))) / 2.0)
    cut = level.select(_cut_off(F.col("context"), depth).alias("context"), "node", "n0", "n1", weighted.alias("s"))
    return cut.groupBy("context", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("s").alias("s"))


def _shares(level: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """context, node, a0, a1, rest: what this depth and those above it give to a zero and a one, and the share left to the children."""
    own_columns = [c for c in level.columns if c == "bucket"]
    if above is None:
        level = level.withColumns({"a0": F.lit(0.0), "a1": F.lit(0.0), "rest": F.lit(1.0)})
    else:
        level = level.withColumn("shorter", _cut_off(F.col("context"), depth - 1)).join(above.withColumnRenamed("context", "shorter"), ["shorter", "node"])
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    kt, s = log_kt(n0, n1, F.log), F.col("s")
    own = F.col("rest") / (1.0 + F.exp(s - kt)) / (n0 + n1 + 1.0)
    rest = F.col("rest") / (1.0 + F.exp(kt - s))
    return level.select(*own_columns, "context", "node", (F.col("a0") + own * (n0 + 0.5)).alias("a0"), (F.col("a1") + own * (n1 + 0.5)).alias("a1"), rest.alias("rest"))


class _Table:
    """64-bit keys with values, looked up many at a time: a hash table at most half full, whose collisions move on by steps of one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several with one place, one stays
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        at = self._at(keys)
        miss = np.flatnonzero(self.keys[at] != keys)
        while len(miss):
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            miss = miss[self.keys[at[miss]] != keys[miss]]
        return self.values[at]


class _Model:
    """What a bucket knows: its contexts' shares, then its grams' probabilities, and its words' counts."""

    def __init__(self) -> None:
        self.shares: list[pa.RecordBatch] = []
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: dict[bytes, int] = {}
        self.sorted: tuple | None = None
        self.table: _Table | None = None

    def learn(self, grams: np.ndarray, counts: np.ndarray) -> None:
        if not len(grams):
            return
        if self.sorted is None:
            columns = [np.concatenate([x.column(c).to_numpy() for x in self.shares]) for c in ("context", "node", "a0", "a1", "rest")]
            order = np.argsort(columns[0], kind="stable")
            self.sorted = tuple(c[order] for c in columns)
        context, which = _contexts(grams)
        a, b = np.searchsorted(self.sorted[0], context[0]), np.searchsorted(self.sorted[0], context[-1], "right")
        contexts, nodes, *given = (c[a:b] for c in self.sorted)
        mine = np.searchsorted(context, contexts)
        own = context[mine] == contexts
        at = mine[own] * 256 + nodes[own]
        a0, a1, rest = (np.zeros(256 * len(context)) for _ in range(3))
        for x, values in zip((a0, a1, rest), given):
            x[at] = values[own]
        p = np.zeros(len(grams))
        for gram_node, bit, first, node, zeros, ones in _nodes(grams, counts):
            place, n = which[first] * 256 + node, zeros + ones + 1.0
            of0, of1 = a0[place] + rest[place] * (zeros + 0.5) / n, a1[place] + rest[place] * (ones + 0.5) / n
            p += np.log10(np.where(bit == 1, of1[gram_node], of0[gram_node]))
        self.known.append((grams, p))

    def answer(self, grams: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = _Table(*(np.concatenate(x) for x in zip(*self.known))) if self.known else _Table(np.zeros(0, np.int64), np.zeros(0))
        return self.table.get(grams)


def _answers(shares: DataFrame, counts: DataFrame, asked: DataFrame) -> DataFrame:
    """slice, grams, p, words, m: what each slice asked for, log10 of each gram's symbol after its context and each word's training count."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    given = [("context", "long"), ("node", "int"), ("a0", "double"), ("a1", "double"), ("rest", "double")]
    of_counts = [("n", "binary"), ("m", "binary")]
    first = shares.select("bucket", F.lit(0).alias("kind"), null("long", "slice"), *(c for c, _ in given), null("binary", "grams"), null("binary", "words"), *(null(k, c) for c, k in of_counts))
    then = counts.select("bucket", F.lit(1).alias("kind"), null("long", "slice"), *(null(k, c) for c, k in given), "grams", "words", *(c for c, _ in of_counts))
    # Of those that ask, the first byte of m says that there are words at all: the end's is the empty one.
    last = asked.select("bucket", F.lit(2).alias("kind"), "slice", *(null(k, c) for c, k in given), "grams", "words", null("binary", "n"), F.substring("m", 1, 1).alias("m"))
    rows = first.union(then).union(last).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, _Model()
        for batch in batches:
            for a, b in _runs(batch.column("bucket"), batch.column("kind")):
                bucket, kind = (batch.column(c)[a].as_py() for c in ("bucket", "kind"))
                if bucket != now:
                    now, model = bucket, _Model()
                part = batch.slice(a, b - a)
                if kind == 0:
                    model.shares.append(part)
                    continue
                out = []
                for k in range(len(part)):
                    grams, m = _numbers(part.column("grams")[k]), part.column("m")[k]
                    said = part.column("words")[k].as_py().split(b" ") if len(m.as_buffer()) else []
                    if kind == 1:
                        model.learn(grams, _numbers(part.column("n")[k]))
                        model.words.update(zip(said, _numbers(m).tolist()))
                    else:
                        out.append((part.column("slice")[k].as_py(), grams.tobytes(), model.answer(grams).tobytes(), b" ".join(said), np.array([model.words[w] for w in said], np.int64).tobytes()))
                if out:
                    slices, *packed = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["slice", "grams", "p", "words", "m"])

    return rows.mapInArrow(tidy(run), "slice long, grams binary, p binary, words binary, m binary")


class _Slice:
    """What the texts of one slice need of the model."""

    def __init__(self, depth: int, all_: int) -> None:
        self.depth, self.all = depth, all_
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        self.table: _Table | None = None
        self.words: dict[bytes, int] = {}

    def learn(self, part: pa.RecordBatch) -> None:
        for k in range(len(part)):
            self.known.append((_numbers(part.column("grams")[k]).copy(), _numbers(part.column("p")[k], np.float64).copy()))
            m = _numbers(part.column("m")[k])
            self.words.update(zip(_word_list(part.column("words")[k], m), m.tolist()))

    def score(self, texts: list[bytes]) -> list[pa.Array]:
        if self.table is None:
            self.table = _Table(*(np.concatenate(x) for x in zip(*self.known)))
            self.known = []
        score = np.zeros(len(texts))
        for found, whose, n in _grams(texts, self.depth):
            np.add.at(score, whose, np.add.reduceat(self.table.get(found), np.cumsum(n) - n))
        tokens, known, base = [], [], []
        for text in texts:
            said = words(text)
            said[b""] = 1
            n = np.array([self.words[w] for w in said], np.int64)
            times = np.array(list(said.values()), np.int64)
            tokens.append(int(times.sum()))
            known.append(int(times[n > 0].sum()))
            base.append(float((times * np.log10((n + 1) / self.all)).sum()))
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score)]


def _scored(answers: DataFrame, docs: DataFrame, depth: int, all_: int) -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, base_score, score: each slice's answers first, then its texts."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    packed = ["grams", "p", "words", "m"]
    first = answers.select("slice", F.lit(0).alias("kind"), *packed, null("long", "doc_id"), null("boolean", "held_out"), null("string", "text"))
    last = docs.select("slice", F.lit(1).alias("kind"), *(null("binary", c) for c in packed), "doc_id", "held_out", "text")
    rows = first.union(last).repartition("slice").sortWithinPartitions("slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, None
        for batch in batches:
            for a, b in _runs(batch.column("slice"), batch.column("kind")):
                slice_, kind = (batch.column(c)[a].as_py() for c in ("slice", "kind"))
                if slice_ != now:
                    now, model = slice_, _Slice(depth, all_)
                part = batch.slice(a, b - a)
                if kind == 0:
                    model.learn(part)
                    continue
                for i, j, texts in _texts(part.column("text")):
                    yield pa.RecordBatch.from_arrays([*(part.column(c).slice(i, j - i) for c in ("doc_id", "held_out")), *model.score(texts)], names=["doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame, depth: int = 5, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: a row for each row.

    docs: doc_id long, text string; other columns are ignored. Texts whose crc32(doc_id as text) modulo `folds` is not `held` are learned from; held_out says
    that it is. A null doc_id has no remainder: held_out is null and the text is scored, but not learned from. score: log10 of the model's
    probability of the text's bytes and its end (a null text is the empty one, which has its end only), contexts of up to `depth` bytes (2 to 6). base_score:
    the same of its words (A-Z in lower case) and one end, each as (c + 1) / (N + V + 1), c its number among the N training tokens of V kinds. Without
    training texts all counts are 0: every decision is even. Rows that repeat are texts of their own. An empty table gives no rows.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    most = min(SLICE_MOST, max(SLICE_LEAST, size // SLICES))
    rows = max(1, n * most // max(1, size))
    buckets = min(BUCKETS_MOST, max(BUCKETS_LEAST, size // BUCKET))
    remainder = remainder_of_id(F.col("doc_id"), folds)
    place = F.col("row").bitwiseAND(F.lit((1 << 40) - 1))
    placed = numbered(docs, ("doc_id", "text")).select(
        (F.col("row") - place + F.call_function("div", place, F.lit(rows))).alias("slice"), F.col("doc_id").cast("long").alias("doc_id"), (remainder == held).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("learned"), "text"
    )
    asked = written(_asked_of(placed, depth, buckets), "asked")
    counts = written(_counts_of(asked), "counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    levels = {depth - 1: written(_lowest(counts), "level")}
    for d in range(depth - 2, -1, -1):
        levels[d] = written(_shorter(levels[d + 1], d), "level")
    shares = None
    for d in range(depth):
        shares = _shares(levels[d], shares, d)
    answers = written(_answers(shares, counts, asked), "answers")
    forget(asked, counts, *levels.values())
    out = _scored(answers, placed, depth, tokens + kinds + 1)
    bits = -F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
