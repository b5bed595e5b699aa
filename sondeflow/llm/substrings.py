"""Removal of byte strings that repeat across documents, by suffix arrays over shards.

A string of LENGTH bytes is removed where it also starts in a document with a smaller doc_id. So that equal strings meet in
one shard, each is routed by an anchor that depends on nothing else: the leftmost smallest hash of its GRAM-byte grams.
Strings that start one after another and share an anchor travel as one region of text. A string reaches EXTEND bytes beyond its
anchor on one side at least, so a shard drops the regions that share neither that extension with another document, then the different regions that share
no LENGTH - FINE + 1 bytes at one place of their anchors, builds the suffix array of the others by induced sorting, and takes permuted common prefixes of neighbours in it: runs of neighbours with LENGTH bytes in common are
one string, and its smallest doc_id tells what is removed.

Equal regions, compared byte by byte, are entered once, with the smallest doc_id: on the map side within a slice, which sends the others on as
covered, dealt over all shards at random, and again in the shard. A region that a third of all documents hold so comes once
from each slice. Shards hold about SHARD bytes of regions each, whatever the input's size.

A line that very many documents hold between different neighbours gives as many different regions with one anchor. Anchors that would
fill a good part of a shard are therefore counted first, on a sample of the documents: about SAMPLE bytes of them, and one in HEAVY / 8 at least, so that
an anchor of HEAVY regions shows in it at any size of the input. Their strings are cut by their place at the anchor
into STEP-wide ranges, each routed by the bytes that all strings of the range share, and where those are frequent too every string is
routed by itself. The sample only deals the work: equal strings are routed alike whatever it holds. What it finds is kept as SLOTS bits at most, by hash, so
its size does not grow; an anchor that shares the bit of a frequent one is cut up too, which changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import U64, equal_spans, in_slices, mix64, span_hasher, text_slices, tidy, tidy_group, tidy_pair
from sondeflow.llm.suffixes import permuted_prefixes, suffix_array

LENGTH, GRAM = 50, 8
EXTEND = (LENGTH - GRAM) // 2
SLICE, CHUNK = 1 << 20, 1 << 18
MOST_HELD = 800_000
SHARD = 3 << 20
BUCKET = 4 << 20
SAMPLE, SLOTS = 16 << 20, 1 << 20
STEP, FINE = 11, 4
HEAVY = SHARD // 400  #: regions with one anchor, about a quarter of a shard, from which it is split
MOST_REPEATED = 100_000
GAP = 0xFF  #: no byte of UTF-8 text
#: Fields of a region as it travels; `offset` is the anchor's place in it, `tag` tells rows that repeat a doc_id apart (0 for all others).
FIELDS = {"doc": np.dtype("<i8"), "tag": np.dtype("<u8"), "start": np.dtype("<u4"), "size": np.dtype("u1"), "offset": np.dtype("u1")}


def _packed(fields: dict[str, np.ndarray]) -> bytes:
    """Fields one after another, documents as differences, each with its first bytes first, then its second, and so on."""
    out = []
    for name, kind in FIELDS.items():
        x = fields[name]
        if name == "tag" and not x.any():
            out.append(bytes(8 * len(x)))
            continue
        if name == "doc":
            x = np.concatenate((x[:1], x[1:] - x[:-1]))
        x = x.astype(kind, copy=False)
        out.append(x.tobytes() if kind.itemsize == 1 else x.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    return b"".join(out)


def _unpacked(raw: bytes, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields, and what follows them."""
    fields, at = {}, 0
    for name, kind in FIELDS.items():
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        fields[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        if name != "tag":
            fields[name] = fields[name].astype(np.int64)
        at += n * kind.itemsize
    fields["doc"] = np.cumsum(fields["doc"])
    return fields, np.frombuffer(raw, np.uint8, offset=at)


def _leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of the leftmost smallest by the upper 40 bits."""
    most = 1 << 24
    if len(h) > most:
        step = most - width + 1
        return np.concatenate([_leftmost_smallest(h[k : k + most], width) + k for k in range(0, len(h) - width + 1, step)])
    value, have = (h & ~U64(most - 1)) | np.arange(len(h), dtype=U64), 1
    while have < width:
        step = min(have, width - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return (value & U64(most - 1)).astype(np.int64)


def regions(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the texts end to end: the bytes; and for each region text number, start and end in those bytes, its anchor's place, and hashes of the region
    and of the anchor's gram. Texts are hashed some at a time, so that what is held at once is small."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    parts = [_regions(data[edge[i] : edge[j]], edge[i : j + 1] - edge[i], i, int(edge[i])) for i, j in in_slices(texts, np.diff(edge).tolist(), CHUNK)]
    return data, *(np.concatenate(c) for c in zip(*parts))


def _regions(data: np.ndarray, edge: np.ndarray, first: int, offset: int) -> tuple[np.ndarray, ...]:
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty, empty, empty.view(U64), empty.view(U64)
    if len(data) < LENGTH:
        return none
    hashed = span_hasher(data, lower=False)
    anchor = _leftmost_smallest(hashed.windows(GRAM), LENGTH - GRAM + 1)
    doc = np.repeat(np.arange(len(edge) - 1, dtype=np.int32), np.diff(edge))[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= edge[1:][doc]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(fresh & inside)
    if not len(start):
        return none
    stop = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + LENGTH
    anchor = anchor[start]
    return doc[start].astype(np.int64) + first, start + offset, stop + offset, anchor + offset, hashed(start, stop), hashed(anchor, anchor + GRAM)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans' bytes end to end."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def _once(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans with equal keys: which belong to the smallest document, and which to larger ones."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1]
    return order[d == least], order[d != least]


def _among(h: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether each hash is among the chosen ones (sorted)."""
    if not len(chosen):
        return np.zeros(len(h), bool)
    return chosen[np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)] == h


def _ranges(start: np.ndarray, end: np.ndarray, anchor: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The regions cut by the strings' places at their anchors: region number, start, end, and start of the LENGTH - step + 1 bytes that all strings
    of the range share, wherever the region ends."""
    least, most = (anchor - (end - LENGTH)) // step, (anchor - start) // step
    parts = most - least + 1
    which = np.repeat(np.arange(len(start)), parts)
    g = np.repeat(least, parts) + np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    core = anchor[which] - step * g
    a = np.maximum(start[which], core - step + 1)
    return which, a, np.minimum(end[which] - LENGTH, core) + LENGTH, core


def _counted(every: int):
    """Hashes of anchors (level 0) and of shared bytes of their ranges (level 1), with counts, a row for each slice of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch, 1, SLICE):
                data, doc, start, end, anchor, key, gram = regions(texts)
                if not len(doc):
                    continue
                one = np.unique(key, return_index=True)[1]
                hashed = span_hasher(data, lower=False)
                core = _ranges(start[one], end[one], anchor[one])[3]
                for level, h in ((0, gram[one]), (1, hashed(core, core + LENGTH - STEP + 1))):
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), level, np.int32)), pa.array(h.view(np.int64)), pa.array(n * every)], names=["level", "h", "n"])

    return run


def _heavy(texts: DataFrame, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots (sorted) of frequent anchors' hashes, and of frequent shared bytes', estimated on a sample of the documents; at most SLOTS of each."""
    every = max(1, min(n_bytes // SAMPLE, HEAVY // 8))
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) if every > 1 else texts
    counts = some.mapInArrow(tidy(_counted(every)), "level int, h long, n long").groupBy("level", "h").agg(F.sum("n").alias("n"))
    slots = counts.filter(F.col("n") >= HEAVY).select("level", F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().collect()
    return tuple(np.sort(np.array([r["slot"] for r in slots if r["level"] == k], np.int64).view(U64)) for k in (0, 1))


def _is_heavy(h: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return _among(h & U64(SLOTS - 1), slots)


def _tags(texts: list[bytes], ids: np.ndarray, repeated: np.ndarray | None) -> np.ndarray:
    """0, but for documents whose id repeats (None: any may) a 64-bit digest of the text."""
    own = _among(ids, repeated) if repeated is not None else np.ones(len(ids), bool)
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") if o else 0 for t, o in zip(texts, own)], U64)


def _map(shards: int, heavy: tuple[np.ndarray, np.ndarray], repeated: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n = 0
        for batch in batches:
            for part, texts in text_slices(batch.filter(batch.column(0).is_valid()), 1, SLICE):
                held.append(_slice(texts, part.column(0).to_numpy(), shards, heavy, repeated))
                n += len(held[-1]["to"])
                if n > MOST_HELD:
                    yield from _sent(held)
                    held, n = [], 0
        yield from _sent(held)

    return run


def _routed(data: np.ndarray, doc, start, end, anchor, key, gram, heavy) -> tuple[np.ndarray, ...]:
    """The regions, those of heavy anchors cut up: document, start, end, anchor, hash, and the hash that they are routed by."""
    hot = _is_heavy(gram, heavy[0])
    if not hot.any():
        return doc, start, end, anchor, key, gram
    hashed = span_hasher(data, lower=False)
    at = np.flatnonzero(hot)
    which, a, b, core = _ranges(start[at], end[at], anchor[at])
    which, own = at[which], hashed(core, core + LENGTH - STEP + 1)
    alone = _is_heavy(own, heavy[1])
    size = b - a - LENGTH + 1  # strings of each range
    each = np.repeat(np.flatnonzero(alone), size[alone])
    s = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(size[alone]) - size[alone], size[alone])
    string = hashed(s, s + LENGTH)
    parts = [(doc, start, end, anchor, key, gram), (doc[which], a, b, anchor[which], hashed(a, b), own), (doc[which[each]], s, s + LENGTH, anchor[which[each]], string, string)]
    return tuple(np.concatenate(c) for c in zip(*([x[keep] for x in part] for part, keep in zip(parts, (~hot, ~alone, slice(None))))))


def _slice(texts: list[bytes], ids: np.ndarray, shards: int, heavy: tuple[np.ndarray, np.ndarray], repeated: np.ndarray | None) -> dict[str, np.ndarray]:
    """The regions of the texts: twice the shard they go to, one more for those that are covered; fields; and where their text begins in `data`."""
    data, doc, *rest = regions(texts)
    doc, start, end, anchor, key, route = _routed(data, doc, *rest, heavy)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    to = np.empty(len(doc), np.int32)
    own, covered = _once(equal_spans(key, data, start, end - start)[1], ids[doc])
    scattered = mix64(start[covered].astype(U64) ^ (ids[doc[covered]].astype(U64) << U64(24)))
    for which, h, odd in ((own, route[own], 0), (covered, scattered, 1)):
        to[which] = ((h >> U64(20)) % U64(shards)).astype(np.int32) * 2 + odd
    fields = {"doc": ids[doc], "tag": _tags(texts, ids, repeated)[doc], "start": start - begins[doc], "size": end - start, "offset": anchor - start}
    return {"data": data, "to": to, "begin": start.astype(np.uint32), **{k: v.astype(FIELDS[k]) for k, v in fields.items()}}


def _sent(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What each shard gets, a row for those that enter and one for the covered ones."""
    if not held:
        return
    squeeze = zstandard.ZstdCompressor(level=4).compress
    by = np.concatenate([h["to"] for h in held])
    order = np.argsort(by, kind="stable")
    to = by[order]
    whole = {k: np.concatenate([h[k] for h in held])[order] for k in FIELDS}
    before = np.cumsum([0, *(len(h["data"]) for h in held[:-1])])
    begin = np.concatenate([h["begin"] + n for h, n in zip(held, before)])[order]
    data = np.concatenate([h["data"] for h in held])
    size = whole["size"].astype(np.int64)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
    # Some rows are put together at a time: their texts are gathered at once.
    for i, j in in_slices(cut[:-1], np.add.reduceat(size, cut[:-1]).tolist() if len(to) else [], SLICE):
        lo, hi = cut[i], cut[j]
        entered = to[lo:hi] % 2 == 0
        text = _gathered(data, begin[lo:hi][entered], size[lo:hi][entered])
        end = np.concatenate(([0], np.cumsum(np.where(entered, size[lo:hi], 0))))
        rows = []
        for a, b in zip(cut[i:j].tolist(), cut[i + 1 : j + 1].tolist()):
            rows.append(squeeze(_packed({k: whole[k][a:b] for k in FIELDS}) + text[end[a - lo] : end[b - lo]].tobytes()))
        first = to[cut[i:j]]
        yield pa.RecordBatch.from_arrays([pa.array(first // 2, pa.int64()), pa.array(first % 2 == 1), pa.array(np.diff(cut[i : j + 1]), pa.int64()), pa.array(rows, pa.binary())], names=["shard", "covered", "n", "packed"])


def _reduce(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Spans to remove, from all that one shard gets, packed for each bucket of documents."""
        open_ = zstandard.ZstdDecompressor().decompress
        out, fields, texts = [], [], []
        for covered, n, packed in zip(*(table.column(k).to_pylist() for k in ("covered", "n", "packed"))):
            f, text = _unpacked(open_(packed), n)
            if covered:
                out.append(np.stack((f["doc"], f["tag"].view(np.int64), f["start"], f["start"] + f["size"])))
            else:
                fields.append(f)
                texts.append(text)
        if fields:
            out.append(_shard({k: np.concatenate([f[k] for f in fields]) for k in FIELDS}, np.concatenate(texts)))
        spans = np.concatenate(out, axis=1)
        to = _bucket(spans[0], spans[1], buckets)
        spans = spans[:, np.lexsort((spans[2], spans[0], to))]
        to = np.sort(to)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = [squeeze(np.ascontiguousarray(spans[:, a:b]).view(np.uint8).reshape(-1, 8).T.tobytes()) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"bucket": pa.array(to[cut[:-1]], pa.int64()), "packed": pa.array(rows, pa.binary())})

    return run


def _bucket(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    """By the id and, where it repeats, the text."""
    return (mix64(doc.astype(np.int64).view(U64) + mix64(tag.view(U64))) % U64(buckets)).astype(np.int64)


def _shard(field: dict[str, np.ndarray], text: np.ndarray) -> np.ndarray:
    """Spans to remove, as far as this shard's strings tell: rows of documents, tags, starts and ends."""
    size, doc = field["size"], field["doc"]
    at = np.cumsum(size) - size
    whole, before, after = _keys(text, at, size, field["offset"])
    # Only regions whose anchor with EXTEND bytes before it, or after it, occurs in several documents.
    several = [k[_in_several(x[k], doc[k])] for x, k in ((before, np.flatnonzero(field["offset"] >= EXTEND)), (after, np.flatnonzero(size - field["offset"] - GRAM >= EXTEND)))]
    kept = np.union1d(*several)
    kind = equal_spans(whole[kept], text, at[kept], size[kept])[1]
    own, covered = _once(kind, doc[kept])
    out = [(kept[covered], np.zeros(len(covered), np.int64), size[kept[covered]])]
    one, same = _representatives(kind[own])
    own = kept[own]
    # Of distinct regions, those that share no FINE range with another have no other string to compare.
    only = own[one]
    some, first = _gathered(text, at[only], size[only]), np.cumsum(size[only]) - size[only]
    which, _, _, core = _ranges(first, first + size[only], first + field["offset"][only], FINE)
    several = np.unique(which[_in_several(span_hasher(some, lower=False)(core, core + LENGTH - FINE + 1), which)])
    chosen = only[several]
    if len(chosen):
        place = np.full(len(one), -1)
        place[several] = np.arange(len(several))
        cover = _covered_strings(text, at[chosen], size[chosen], doc[chosen])
        for k in np.flatnonzero(place[same] >= 0):
            runs = cover[place[same[k]]]
            if runs is not None:
                out.append((np.full(len(runs), own[k]), runs[:, 0], runs[:, 1]))
    which, a, b = (np.concatenate(c) for c in zip(*out))
    return np.stack((doc[which], field["tag"].view(np.int64)[which], field["start"][which] + a, field["start"][which] + b))


def _keys(text: np.ndarray, at: np.ndarray, size: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of regions, and of their anchors with EXTEND bytes before and after them (of no meaning where there are fewer), some text at a time."""
    out = np.zeros((3, len(at)), U64)
    cut = np.unique(np.append(np.searchsorted(at, np.arange(0, len(text), CHUNK)), len(at)))
    for i, j in zip(cut[:-1], cut[1:]):
        a, b = int(at[i]), int(at[j - 1] + size[j - 1])
        hashed, start = span_hasher(text[a:b], lower=False), at[i:j] - a
        end, gram = start + size[i:j], start + offset[i:j]
        out[0, i:j] = hashed(start, end)
        out[1, i:j] = hashed(np.maximum(gram - EXTEND, 0), gram + GRAM)
        out[2, i:j] = hashed(gram, np.minimum(gram + GRAM + EXTEND, b - a))
    return out[0], out[1], out[2]


def _in_several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose key occurs with more than one document."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    group = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
    mixed = np.zeros(int(group[-1]) + 1, bool)
    mixed[group[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])]] = True
    return np.sort(order[mixed[group]])


def _representatives(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place for each distinct key, and for each place the number of its key."""
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    return first, same


def _covered_strings(text: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> list[np.ndarray | None]:
    """For each region the spans (start, end within it) of strings that a region of a smaller document holds; None for none."""
    begin = np.cumsum(size + 1) - (size + 1)
    whole = np.full(int((size + 1).sum()), GAP, np.uint8)
    fill = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    whole[fill] = _gathered(text, at, size)
    region = np.repeat(np.arange(len(at)), size + 1)
    starts = np.arange(len(whole)) <= (begin + size - LENGTH)[region]
    order = suffix_array(whole)
    order = order[starts[order]]
    fresh = permuted_prefixes(whole, order, LENGTH)[order] < LENGTH
    fresh[0] = True
    edges = np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc[region[order]], edges)[np.cumsum(fresh) - 1]
    gone = np.zeros(len(whole), bool)
    gone[order] = least < doc[region[order]]
    flip = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    a, b = np.flatnonzero(flip == 1), np.flatnonzero(flip == -1)
    out: list = [None] * len(at)
    r = region[a]
    spans = np.stack((a - begin[r], b - begin[r] + LENGTH - 1), axis=1)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)])) if len(r) else np.zeros(1, int)
    for x, y in zip(cut[:-1], cut[1:]):
        out[r[x]] = spans[x:y]
    return out


def _boxed(buckets: int, repeated: np.ndarray | None):
    """Documents packed for each bucket: ids (null as 0), whether null, bytes, how often the row comes, and the texts. Rows of a batch that repeat an id and a text are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            null = np.array(batch.column(0).is_null().to_numpy(zero_copy_only=False), bool)
            ids = np.where(null, 0, np.nan_to_num(ids)).astype(np.int64) if null.any() else ids.astype(np.int64)
            texts = np.array([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()] + [None], object)[:-1]
            tag = _tags(texts, ids, repeated)
            times = np.ones(len(ids), np.int64)
            tagged = np.flatnonzero((tag != 0) & ~null)
            _, first, count = np.unique(np.stack((ids[tagged].view(U64), tag[tagged])), axis=1, return_index=True, return_counts=True)
            times[tagged] = 0
            times[tagged[first]] = count
            to = np.where(null, _bucket(np.arange(len(ids)), tag, buckets), _bucket(ids, tag, buckets))
            stay = times > 0
            for b in np.unique(to[stay]).tolist():
                at = np.flatnonzero(stay & (to == b))
                head = ids[at].tobytes() + null[at].tobytes() + np.array([len(t) for t in texts[at]], np.int64).tobytes() + times[at].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([squeeze(head + b"".join(texts[at]))], pa.binary())], names=["bucket", "n", "packed"])

    return run


def _cut(with_kept: bool, repeated: np.ndarray | None):
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64()] * 4 + [pa.string(), pa.binary()]
    n_cols = 5 + with_kept

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        """The documents of one bucket less their spans."""
        open_ = zstandard.ZstdDecompressor().decompress
        found = [np.ascontiguousarray(np.frombuffer(open_(p.as_py()), np.uint8).reshape(8, -1).T).view(np.int64).reshape(4, -1) for p in spans.column("packed")]
        doc, tag, start, end = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        order = np.argsort(doc, kind="stable")
        doc, tag, start, end = doc[order], tag[order].view(U64), start[order], end[order]
        parts = []
        for n, packed in zip(docs.column("n").to_pylist(), docs.column("packed")):
            raw = open_(packed.as_py())
            ids, null, sizes = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.bool_, n, 8 * n), np.frombuffer(raw, np.int64, n, 9 * n)
            times, at = np.frombuffer(raw, np.int64, n, 17 * n).tolist(), 25 * n
            lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            rows = []
            for k in range(n):
                text = raw[at : at + sizes[k]]
                at += int(sizes[k])
                mine = slice(lo[k], lo[k] if null[k] else hi[k])
                if lo[k] < hi[k] and not null[k]:
                    own = tag[mine] == _tags([text], ids[k : k + 1], repeated)[0]
                    cut = _less(text, start[mine][own], end[mine][own])
                else:
                    cut = _less(text, start[:0], end[:0])
                rows += [(None if null[k] else int(ids[k]), *cut)[:n_cols]] * times[k]
            parts.append(pa.table({name: pa.array(c, t) for name, c, t in zip(names, zip(*rows), types)}))
        return pa.concat_tables(parts) if parts else pa.table({name: pa.array([], t) for name, t in zip(names[:n_cols], types)})

    return run


def _less(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str, bytes]:
    if not len(start):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), text
    change = np.bincount(start, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
    gone = np.cumsum(change[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept


def without_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes left, and (with_kept) kept, those bytes.

    docs: doc_id long, text string; other columns are ignored. A null or empty text has no bytes. A row with a null doc_id is neither
    smaller nor larger than any: nothing is removed from it or for it. Rows that repeat a doc_id remove nothing from each
    other; if their texts differ, they are told apart by 64 bits of a digest. An empty table gives no rows.
    """
    texts = docs.select("doc_id", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = max(1, int(n_bytes * 3.3) // SHARD), max(1, n_bytes // BUCKET)
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id").limit(MOST_REPEATED + 1).collect()
    repeated = np.sort(np.array([r["doc_id"] for r in twice], np.int64)) if len(twice) <= MOST_REPEATED else None
    heavy = _heavy(texts.filter("doc_id IS NOT NULL"), n_bytes)
    sent = texts.mapInArrow(tidy(_map(shards, heavy, repeated)), "shard long, covered boolean, n long, packed binary")
    spans = sent.groupBy("shard").applyInArrow(tidy_group(_reduce(buckets)), "bucket long, packed binary")
    boxes = texts.mapInArrow(tidy(_boxed(buckets, repeated)), "bucket long, n long, packed binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return boxes.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(tidy_pair(_cut(with_kept, repeated)), schema)
