"""Mixing sources to target weights by Sainte-Laguë apportionment.

The targets of the sources are met in blocks of equally many words. Blocks go to sources by highest quotients, target / (2 k + 1)
for the next block after k, and each source's blocks go to its shards in the same way, by the shards' words. A shard is
a hash bucket of a source's documents, laid end to end in a seeded order; whole passes over it come first, and the
blocks left are picked at even steps from a seeded start. What a document gives is then arithmetic on its place in the shard.

Plans: texts are read once, to count words; all later steps work on (doc_id, source, size). The driver sees one row for
each source (at most MOST_SOURCES) and for each shard (at most SHARDS and one for each source); the broadcast tables have as
many rows. A source with a third of all rows has a third of all shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, DoubleType, StringType, StructField, StructType

from sondeflow.llm.common import WORD, tidy, written

MOST_SOURCES = 1_000_000
SHARDS = 1 << 15
SHARD_WORDS = 1 << 16
SHARD_ROWS = 1 << 12
BLOCK = 256
CAP = 3


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), none above its cap; ties go to the first. Fewer if all reach their caps."""
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    total, n = weights.sum(), len(weights)
    won = np.zeros(n, np.int64)
    if total <= 0 or seats <= 0:
        return won
    if (sure := seats - n) > 0:  # all quotients above a level at once, so few that the seats suffice
        won = np.minimum(np.floor(weights * (sure / total) + 0.5).astype(np.int64), caps)
        while won.sum() > seats:  # rounding of large numbers only
            won = np.maximum(won - 1, 0)
    left = int(seats - won.sum())
    heap = [(-w / (2 * k + 1), i) for i, (w, k, c) in enumerate(zip(weights, won.tolist(), caps.tolist())) if k < c and w > 0]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heap[0]
        won[i] += 1
        left -= 1
        if won[i] < caps[i]:
            heapq.heapreplace(heap, (-weights[i] / (2 * int(won[i]) + 1), i))
        else:
            heapq.heappop(heap)
    return won


def targets(sizes: np.ndarray, weights: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Shares of the total size by weight; what exceeds `cap` times a source's size is shared again by weight among the others."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), sizes.sum()
    while free.any():
        share = np.where(free, left * weights / weights[free].sum(), 0.0)
        over = free & (share > cap * sizes)
        if not over.any():
            return np.where(free, share, out)
        out[over] = cap * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def mix_plan(docs: DataFrame, seed: int = 0, cap: int = CAP, row: str | None = None) -> DataFrame:
    """What the mix takes of each document, a row for each row.

    docs: doc_id long, text string, source string; other columns are ignored. Sources in code point order, null last, weigh 1, 2, 3,
    repeating. Returns doc_id, source, size (words; 0 for a null text), source_size, target (of the source), taken (words,
    repeats counted), copies (whole passes), at (the document's place in its shard), and the shard's block, blocks, picked and
    phase. No document exceeds `cap` times its size. Rows that repeat a doc_id are counted each; rows are dealt to shards by doc_id and text, so texts of one or of no doc_id are spread. With `row`, a
    column of docs, the plan has that column too. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = [row] if row else []
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = written(docs.select(*own, "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("of_text")), "sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    found = per.orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    words = np.array([r["words"] for r in found], np.int64)
    rows = np.array([r["rows"] for r in found], np.int64)
    goal = targets(words, np.arange(len(found)) % 3 + 1, cap)
    positive = goal[goal > 0]
    block = int(np.clip(positive.min() // 256, 1, BLOCK)) if len(positive) else 1
    parts = np.minimum(SHARDS, 1 + words // max(SHARD_WORDS, 2 * int(words.sum()) // SHARDS) + rows // max(SHARD_ROWS, 2 * int(rows.sum()) // SHARDS))
    quota = sainte_lague(goal, round(float(goal.sum()) / block), cap * words // block)
    schema = StructType([StructField("name", StringType()), *(StructField(n, LongType()) for n in ("number", "source_size", "parts")), StructField("target", DoubleType())])
    sources = spark.createDataFrame([(r["source"], i, int(words[i]), int(parts[i]), float(goal[i])) for i, r in enumerate(found)], schema)
    dealt = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).withColumn("shard", F.pmod(_dealt(seed), F.col("parts")))

    shards = sorted((r["number"], r["shard"], r["words"]) for r in dealt.groupBy("number", "shard").agg(F.sum("size").alias("words")).collect())
    plan = []
    lo = 0
    for i in range(len(found)):
        hi = lo
        while hi < len(shards) and shards[hi][0] == i:
            hi += 1
        n = np.array([s[2] for s in shards[lo:hi]], np.int64)
        for (_, shard, size_), q in zip(shards[lo:hi], sainte_lague(n, int(quota[i]), cap * n // block).tolist()):
            take = q * block
            copies, rest = divmod(take, size_) if size_ else (0, 0)
            blocks = size_ // block
            picked = min(blocks, (rest + block // 2) // block)
            plan.append((i, shard, copies, blocks, picked, _seeded(seed, i, shard) % max(blocks, 1)))
        lo = hi
    schema = StructType([StructField(n, LongType()) for n in ("number", "shard", "copies", "blocks", "picked", "phase")])
    placed = dealt.join(F.broadcast(spark.createDataFrame(plan, schema)), ["number", "shard"])
    from pyspark.sql.window import Window

    order = Window.partitionBy("number", "shard").orderBy(_dealt(seed + 1), "doc_id", "size", "of_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))).withColumn("block", F.lit(block).cast("long"))
    taken = F.col("copies") * F.col("size") + _before(F.col("at") + F.col("size")) - _before(F.col("at"))
    return placed.select(*own, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "at", "block", "blocks", "picked", "phase")


def _dealt(seed: int) -> Column:
    """Rows of one doc_id with different texts are dealt apart; equal rows meet."""
    return F.xxhash64("doc_id", "of_text", F.lit(seed))


def _seeded(*numbers: int) -> int:
    x = 0x9E3779B97F4A7C15
    for n in numbers:
        x = (x ^ n) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x ^= x >> 31
    return x >> 1


def _picked_before(j: Column) -> Column:
    """Picked blocks among the first j of a shard: even steps, seeded phase."""
    blocks, picked, phase = F.greatest("blocks", F.lit(1)), F.col("picked"), F.col("phase")
    return F.call_function("div", (j + phase) * picked, blocks) - F.call_function("div", phase * picked, blocks)


def _before(x: Column) -> Column:
    """Words of picked blocks among the first x words of a shard; those past the last whole block are in none."""
    j = F.least(F.call_function("div", x, F.col("block")), F.col("blocks"))
    within = F.when(j < F.col("blocks"), x - j * F.col("block")).otherwise(F.lit(0))
    return _picked_before(j) * F.col("block") + within * (_picked_before(j + 1) - _picked_before(j))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken whole, and once more with the words of its picked blocks, if any.

    Documents that give nothing go; if docs has n_chars it becomes the length of the new text. The document's own doc_id goes with each row.
    Each row is taken by its own plan, also where a doc_id repeats or is null.
    """
    names = docs.columns
    docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    plan = mix_plan(docs, seed, row="__row").filter("taken > 0")
    plan = plan.select("__row", F.col("size").alias("__size"), *(F.col(n).alias(f"__{n}") for n in ("taken", "copies", "at", "block", "blocks", "picked", "phase")))
    joined = docs.join(plan, "__row").drop("__row")
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, texts = [], []
            plans = list(zip(*(batch.column(f"__{n}").to_pylist() for n in ("size", "taken", "copies", "at", "block", "blocks", "picked", "phase"))))
            for k, (text, (size, taken, copies, *where)) in enumerate(zip(batch.column(text_at).to_pylist(), plans)):
                new = [text] * copies
                if taken > copies * size:
                    new.append(_cut(text, *where))
                which += [k] * len(new)
                texts += new
            cols = [c.take(pa.array(which, pa.int64())) for c in batch.columns[: len(names)]]
            cols[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array([len(t) for t in texts], cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(tidy(run), docs.select(*names).schema)


def _cut(text: str, at: int, block: int, blocks: int, picked: int, phase: int) -> str:
    """The words of picked blocks, each with the white space that follows it."""
    import re

    starts = np.array([m.start() for m in re.finditer(WORD, text)] + [len(text)], np.int64)
    j = (at + np.arange(len(starts) - 1)) // block
    n = max(blocks, 1)
    hit = (j < blocks) & (((j + 1 + phase) * picked // n) > ((j + phase) * picked // n))
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    runs = zip(starts[np.flatnonzero(edge == 1)].tolist(), starts[np.flatnonzero(edge == -1)].tolist())
    return "".join(text[a:b] for a, b in runs).rstrip("\x20\t\n\x0b\x0c\r")
