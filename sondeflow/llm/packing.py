"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are 1024 as often as it fits and then
the powers of two in the rest, longest first. Each piece is a sequence of its own, so no sequence
crosses documents, and as each length is a power of two none is padded. Sequences of equal
length share a bucket, and are numbered one after another within it: a batch is a run of ids.

No shuffle: each task tokenises its own rows. A sequence's id is made of the bucket, the task's partition
and a counter of the bucket there, as rereading a partition gives the same rows in the same order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sondeflow.llm.common import tidy

LENGTH = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Byte strings with their ids, and the added tokens, of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    byte_of, added = _byte_of(), [x["content"] for x in file["added_tokens"]]
    return {bytes(byte_of[c] for c in k): v for k, v in file["model"]["vocab"].items() if k not in added}, added


class Encoder:
    """Ids of a byte-level BPE file. Merging by rank gives the file's own ids where it splits texts in the byte-level way, without normaliser or
    added blank, and ids follow the order of merges (all checked when loading); other files, and texts that hold an added
    token, go through `tokenizers`."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        ranks, self.added = vocabulary(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of, split, model = _byte_of(), file.get("pre_tokenizer") or {}, file["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = [ranks.get(bytes(byte_of[c] for c in a + b), -1) for a, b in pairs]
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not file.get("normalizer")
        odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        self.ranked = plain and not odd and all(x < y for x, y in zip(order, order[1:])) and order[0] >= 256
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value: the split of byte-level BPE
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if self.ranked else None

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, longest: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: `longest` while it fits, then the powers of two in the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's tokens, which end with id 0; with_ids adds the piece's ids as an array.

    docs: doc_id long, text string; other columns are ignored. A null or empty text is the one token 0.
    A null doc_id stays null. Repeated rows are packed each. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition = encoder(tokenizer), TaskContext.get().partitionId() << 34
        serial = [(k << 58) + partition for k in range(longest.bit_length())]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple] = []
            for doc_id, text in zip(ids, texts):
                tokens = np.array([*encode(text.as_py() or ""), 0], "<u4")
                start, view = 0, memoryview(tokens).cast("B")
                for n in cuts(len(tokens), longest):
                    k = n.bit_length() - 1
                    out.append((doc_id, start, n, zlib.crc32(view[4 * start : 4 * (start + n)]), len(tokens), serial[k], 0, k, tokens[start : start + n] if with_ids else None))
                    start, serial[k] = start + n, serial[k] + 1
                if len(out) > 20_000:
                    yield _rows(out, with_ids)
                    out = []
            if out:
                yield _rows(out, with_ids)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA + ", ids array<int>" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
    types = [pa.int64()] * 7 + [pa.int32(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[: 8 + with_ids], types)], names=names[: 8 + with_ids])
