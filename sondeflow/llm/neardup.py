"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Documents with equal shingle sets form a class; only one of a class goes on, as a node named by the smallest doc_id. Nodes that share
a band form a bucket; buckets with the same nodes count once. One rule holds for buckets of every size: each node is first compared
with one centre, the smallest node among its buckets' that its size allows, and takes the centre's label if they are linked. Then each bucket
that still holds several labels is cut into blocks by hash, at most BLOCK nodes and about WEIGHT shingles each, pairs of blocks are dealt as
tasks of their own, and a task compares nodes of different labels on their full sets, as a product of incidence matrices, giving back
only which labels hang together. Nodes of the bucket's largest label are not compared with each other. Components of labels are
found last, over labels only.

A bucket with more unlinked nodes than a block would cost the square of them. It is first parted by the shingles of prefixes: with shingles in one
order for all nodes, rare ones first, two linked sets share a shingle of the smaller's first n - 2pn/(1+p) + 1 and the larger's first n - pn + 1 (p: the least
similarity). Nodes that share such a shingle form a part, and parts take the bucket's place where they cost less. The order comes from SLOTS counters of
hashed shingles, so it is broadcast at a fixed size; it decides costs only.

With 32 bands of 4 coordinates a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8. Sets are compared as 64-bit hashes of
their shingles; among the few thousand shingles of a pair an accidental equality has probability below 1e-12.

Skew: classes collapse by map-side aggregation; a centre's comparisons are dealt over salted parts of about PART nodes, blocks are dealt by
hash, and joins with a possibly frequent key read tables on both sides, so that adaptive execution splits the key. Nothing but
counts reaches the driver, and tables that are no longer read are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import forget, text_slices, tidy, written
from sondeflow.llm.components import components
from sondeflow.llm.shingles import bands, fingerprints, shingle_sets, sketches

BINS, ROWS = 128, 4
PART, BLOCK, WEIGHT = 64, 256, 1 << 19
COLUMNS = 4096
SLOTS = 1 << 20


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, texts in text_slices(batch, "text"):
        yield part, *shingle_sets(texts, width)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (shingles), c1, c2 (fingerprint of the set), bands (array of long; empty without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, n in _sets(batch, width):
                c = fingerprints(sets, n).view(np.int64)
                b = bands(sketches(sets, n, BINS), ROWS)[n > 0].view(np.int64)
                at = np.concatenate(([0], np.cumsum((n > 0) * b.shape[1]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(c[0]), pa.array(c[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(b.ravel()))], names=["doc_id", "n", "c1", "c2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, c1 long, c2 long, bands array<long>")


def _node_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, c1, c2, and the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, n in _sets(batch, width):
                c, end = fingerprints(sets, n).view(np.int64), np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c[0]), pa.array(c[1]), pa.array([sets[b - k : b].tobytes() for b, k in zip(end, n)], pa.binary())], names=["doc_id", "c1", "c2", "items"])

    return docs.mapInArrow(tidy(run), "doc_id long, c1 long, c2 long, items binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """band, node, n, centre, centre_n: the nodes of each bucket of two or more, once for each set of nodes, with the bucket's smallest node."""
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band"), "shared")
    met = written(banded.join(shared, "band"), "met")
    print_ = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"f{k}") for k in (0, 1)]
    each = met.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("c"), *print_)
    once = each.groupBy("size", "c", "f0", "f1").agg(F.min("band").alias("band"))
    once = written(once.select("band", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")), "once")
    out = written(met.join(once, "band"), "buckets")
    forget(shared, met, once)
    return out


def _verified(pairs: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for each pair a, b of nodes. Pairs of one b are dealt over its `parts` by a's hash; the set of b goes to each."""
    dealt = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.col("a").alias("node"), F.lit(False).alias("centre"))
    every = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("node"), F.lit(True).alias("centre"))
    rows = dealt.union(every).join(sets, "node").repartition("b", "part").sortWithinPartitions("b", "part", F.desc("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            cols = [batch.column(k) for k in ("b", "part", "node", "centre")]
            items = batch.column("items")
            for k, (b, part, node, centre) in enumerate(zip(*(c.to_pylist() for c in cols))):
                x = np.frombuffer(items[k].as_buffer(), np.uint64)
                if (b, part) != now:
                    now, held = (b, part), []
                if centre:
                    held.append(x.copy())
                else:
                    out.append((node, b, any(_linked(x, y, percent) for y in held)))
            if out:
                a, b, linked = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.select("b", "part", "node", "centre", "items").mapInArrow(tidy(run), "a long, b long, linked boolean")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _open_buckets(named: DataFrame, percent: int) -> DataFrame:
    """band, main (its largest label), has_main, b1, b2 (blocks of the main label and of the others), k1, k2 (their nodes) of the buckets with several labels."""
    counts = named.groupBy("band", "label").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    main = counts.groupBy("band").agg(F.max(F.struct("k", "label", "w")).alias("m"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count("*").alias("labels"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    main = main.filter("labels > 1").filter(F.expr(f"k > 2 OR 100 * lo >= {percent} * hi"))  # two nodes too unlike in size can't be linked
    k = F.when(F.col("m.k") > 1, F.col("m.k")).otherwise(F.lit(0).cast("long"))  # without known links, no label is the main one
    w = F.when(k > 0, F.col("m.w")).otherwise(F.lit(0).cast("long"))
    blocks = lambda k, w: F.greatest(F.ceil(k / BLOCK), F.ceil(w / WEIGHT))
    return main.select("band", F.col("m.label").alias("main"), (k > 0).alias("has_main"), blocks(k, w).alias("b1"), blocks(F.col("k") - k, F.col("w") - w).alias("b2"), k.alias("k1"), (F.col("k") - k).alias("k2"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, its prefix of shingles against larger or equal sets and smaller ones, and how many of these are for larger or equal ones.

    sets: node, items; a table. Shingles that no other set holds are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for item in batch.column(0):
                total += np.bincount(_slots(np.frombuffer(item.as_buffer(), np.uint64)), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counts = sets.select("items").mapInArrow(tidy(counted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    often = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, smaller = [], []
            for item in batch.column(1):
                x = np.frombuffer(item.as_buffer(), np.uint64)
                n, seen = len(x), often.value[_slots(x)]
                order = np.lexsort((x, seen))
                larger = n - -(-2 * percent * n // (100 + percent)) + 1
                alone = int((seen == 1).sum())  # these come first
                order = order[alone : n - -(-percent * n // 100) + 1]
                found.append(x[order].view(np.int64))
                smaller.append(max(0, larger - alone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(smaller, pa.int64())], names=["node", "prefix", "larger"])

    return sets.select("node", "items").mapInArrow(tidy(run), "node long, prefix array<long>, larger long")


def _slots(x: np.ndarray) -> np.ndarray:
    return (x % np.uint64(SLOTS)).astype(np.int64)


def _parted(placed: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The parts of buckets that take less comparing than the buckets do, placed like buckets, and the bands that they replace.

    placed: band, node, n, label, cost; a table.
    """
    some = written(sets.join(placed.select("node").distinct(), "node", "left_semi"), "wide")
    prefix = written(_prefixes(some, percent), "prefixes")
    each = placed.join(prefix, "node").select("band", "node", "n", "label", "cost", "larger", F.posexplode("prefix").alias("at", "shingle"))
    # Pairs of which neither holds the shingle in its shorter prefix are not compared by it.
    each = written(each.select(F.xxhash64("band", "shingle").alias("part"), "band", "node", "n", "label", "cost", (F.col("at") >= F.col("larger")).alias("in_main")), "each")
    print_ = [F.bit_xor(F.xxhash64("node", "in_main", F.lit(k))).alias(f"f{k}") for k in (0, 1)]
    sums = [e.alias(c) for c, e in (("k1", F.count_if("in_main")), ("k2", F.count_if(~F.col("in_main"))), ("w1", F.sum(F.expr("if(in_main, n, 0)"))), ("w2", F.sum(F.expr("if(in_main, 0, n)"))))]
    parts = each.groupBy("band", "part").agg(F.first("cost").alias("cost"), (F.min("label") != F.max("label")).alias("apart"), *sums, *print_)
    parts = parts.filter("apart AND k2 > 0").groupBy("band", "cost", *(same := ["k1", "k2", "w1", "w2", "f0", "f1"])).agg(F.min("part").alias("part"))
    parts = written(parts, "parts")
    costs = parts.groupBy("band").agg(F.sum(F.col("k2") * (F.col("k1") + F.col("k2"))).alias("now"))
    bands_ = placed.select("band", "cost").distinct().join(costs, "band", "left").filter("coalesce(now, 0) < cost")
    cheap = written(bands_.select("band"), "cheap")
    once = parts.join(cheap, "band", "left_semi").groupBy(*same).agg(F.min("part").alias("part"))
    once = once.select("part", *(F.greatest(F.ceil(F.col(f"k{i}") / BLOCK), F.ceil(F.col(f"w{i}") / WEIGHT)).alias(f"b{i}") for i in (1, 2)))
    out = written(each.join(once, "part").select(F.col("part").alias("band"), "node", "label", "in_main", "b1", "b2"), "parted")
    forget(some, prefix, each, parts)
    return out, cheap


def _block_links(named: DataFrame, main: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: labels that hang together by links within a bucket. named: band, node, n, label; main: of _open_buckets; both tables."""
    in_main = F.col("has_main") & (F.col("label") == F.col("main"))
    placed = named.join(main, "band").select("band", "node", "label", in_main.alias("in_main"), "b1", "b2")
    if not main.filter("b2 > 1").isEmpty():
        wide = named.join(main.filter("b2 > 1"), "band").select("band", "node", "n", "label", F.expr("k2 * (k1 + k2)").alias("cost"))
        wide = written(wide, "placed")
        parted, cheap = _parted(wide, sets, percent)
        placed = placed.join(cheap, "band", "left_anti").union(parted)
        forget(wide)
    h = F.xxhash64("node")
    placed = placed.withColumn("block", F.when(F.col("in_main"), F.pmod(h, F.col("b1"))).otherwise(F.col("b1") + F.pmod(h, F.col("b2"))))
    others = F.sequence(F.when(F.col("in_main"), F.col("b1")).otherwise(F.lit(0).cast("long")), F.col("b1") + F.col("b2") - 1)
    spread = placed.select("band", "node", "label", "block", F.explode(others).alias("other"))
    rows = spread.select("band", "node", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "node")
    cut = ["band", "i", "j"]
    rows = rows.repartition(*cut).sortWithinPartitions(*cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, labels, held = None, [], []
        for batch in batches:
            items = batch.column("items")
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (*cut, "label")))):
                if key[:3] != now:
                    yield _block(labels, held, percent)
                    now, labels, held = key[:3], [], []
                labels.append(key[3])
                held.append(np.frombuffer(items[k].as_buffer(), np.uint64).copy())
        yield _block(labels, held, percent)

    return rows.select(*cut, "label", "items").mapInArrow(tidy(run), "a long, b long").distinct()


def _block(labels: list[int], sets: list[np.ndarray], percent: int) -> pa.RecordBatch:
    """A star of links over each set of labels that hang together: by a link between nodes of them."""
    out: list[tuple[int, int]] = []
    if len(labels) > 1:
        n = np.array([len(s) for s in sets], np.int64)
        common = _intersections(sets, n)
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        kinds, kind = np.unique(np.array(labels), return_inverse=True)
        near = np.zeros((len(kinds), len(kinds)), bool)
        i, j = np.nonzero(linked)
        near[kind[i], kind[j]] = True
        root = np.full(len(kinds), -1)
        for k in range(len(kinds)):
            if root[k] >= 0:
                continue
            front = np.zeros(len(kinds), bool)
            front[k] = True
            root[k] = k
            while front.any():
                front = near[front].any(axis=0) & (root < 0)
                root[front] = k
        out = [(int(kinds[k]), int(kinds[r])) for k, r in enumerate(root) if k != r]
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _intersections(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over COLUMNS shingles at a time."""
    _, kind, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    whose = np.repeat(np.arange(len(sets)), n)
    column = np.cumsum(count > 1) - 1  # shingles of one set alone are in no intersection
    keep = count[kind] > 1
    kind, whose = column[kind[keep]], whose[keep]
    order = np.argsort(kind, kind="stable")
    kind, whose = kind[order], whose[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for c in range(0, int(kind[-1]) + 1 if len(kind) else 0, COLUMNS):
        a, b = np.searchsorted(kind, (c, c + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[whose[a:b], kind[a:b] - c] = 1
        total += (m @ m.T).astype(np.int64)
    return total + np.diag(n - np.diag(total))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), a row for each row.

    docs: doc_id long, text string; other columns are ignored. Links: 100 * intersection >= percent * union of the sets of distinct
    `width`-word shingles. A null or empty text, or one without words, is linked with nothing. A row with a null
    doc_id takes no part in linking: its component_id is null and it is kept. Rows that repeat a doc_id with the same text
    are one document, given once each; those with other texts are linked each by its own, and the classes that such an id names are one node.
    An empty table gives no rows.
    """
    sig = written(signatures(docs, width), "signatures")
    some = sig.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.count("*").alias("rows"), F.first("bands").alias("bands")), "classes")
    met = _buckets(classes)
    wanted = written(met.select(F.col("node").alias("doc_id")).distinct(), "wanted")  # ids alone: a small table is broadcast by Spark's own rule
    nodes = written(wanted.join(classes.select(F.col("node").alias("doc_id"), "c1", "c2"), "doc_id"), "nodes")
    again = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = written(_node_sets(again, width).join(nodes, ["doc_id", "c1", "c2"]).dropDuplicates(["doc_id", "c1", "c2"]).select(F.col("doc_id").alias("node"), "items"), "sets")

    fits = F.expr(f"node <> centre AND 100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)")
    pairs = written(met.filter(fits).groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b")), "pairs")
    parts = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts")), "parts")
    star = written(_verified(pairs, parts, sets, percent).filter("linked").groupBy("a").agg(F.min("b").alias("b")), "star")
    named = written(met.select("band", "node", "n").join(star, F.col("node") == F.col("a"), "left").select("band", "node", "n", F.coalesce("b", "node").alias("label")), "named")
    forget(met, pairs, parts, nodes, wanted)
    main = written(_open_buckets(named, percent), "main")
    # A centre that is linked with a centre of its own has another label than the nodes it labels: a link between the two labels.
    centres = star.select(F.col("b").alias("label")).distinct()
    links = written(star.join(centres, F.col("a") == F.col("label"), "left_semi").union(_block_links(named, main, sets, percent)), "links")
    forget(named, main, sets)
    found = components(links)

    of_star = star.join(found, F.col("b") == F.col("vertex"), "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    labels = of_star.union(found.select(F.col("vertex").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))
    groups = classes.select("c1", "c2", "rows", "node").join(labels, "node", "left").filter("rows > 1 OR component IS NOT NULL")
    groups = written(groups.select("c1", "c2", F.coalesce("component", "node").alias("component_id")), "groups")
    forget(classes, star, links)
    out = sig.select("doc_id", "n", "c1", "c2").join(groups, ["c1", "c2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
