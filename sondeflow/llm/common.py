"""What the operators share: reading tables, cutting lineage, byte-level word arithmetic.

Executors import this package; ship it with --py-files or install it on the workers.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

U64 = np.uint64
#: Bytes of text that a kernel works on at a time.
SLICE = 1 << 18
#: White space that parts words in every contract: blank, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions without the setting, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets its own. Tables stay until it is cleared."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        root = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="sondeflow-"))
    return root.rstrip("/")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sondeflow-{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")  # what was shuffled for the table goes with the job that wrote it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns and `row`, a number of each row's own that is the same whenever it is read: the file's, in the order of names, and the place in it.

    A frame that is not read from Parquet files is written first. What is broadcast has a row for each file, which the driver lists anyway.
    """
    try:
        at = df.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        return numbered(written(df.select(*columns), "numbered"), columns)
    files = at.select("__file").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long"))
    files = df.sparkSession.createDataFrame(files.collect(), files.schema)
    row = F.shiftleft("__number", 40).bitwiseOR(F.col("__place"))
    return at.join(F.broadcast(files), "__file").select(*columns, row.alias("row"))


@functools.cache
def _libc():
    """The C library, told (if it is glibc) to map large arrays on their own, so that they go back to the system when freed, and to keep little that is free."""
    lib = ctypes.CDLL(None)
    if hasattr(lib, "mallopt"):
        lib.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD, fixed: it would grow with the arrays freed
        lib.mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
    return lib


def trim() -> None:
    """Give freed memory back to the system (glibc only)."""
    lib = ctypes.CDLL(None)
    if hasattr(lib, "malloc_trim"):
        lib.malloc_trim(0)


def _given_back() -> None:
    if POWERS.n > 1 << 22:
        POWERS.forget()
    trim()


def tidy(run: Callable) -> Callable:
    """Wrap a kernel over batches so that its worker, which stays for later tasks, gives freed memory back to the system."""

    @functools.wraps(run)
    def wrapped(batches):
        _libc()
        try:
            yield from run(batches)
        finally:
            POWERS.forget()
            _given_back()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a kernel over the table of one group."""

    def wrapped(table):
        _libc()
        try:
            return run(table)
        finally:
            _given_back()

    return wrapped


def tidy_pair(run: Callable) -> Callable:
    """The same for a kernel over two tables of one group."""
    one = tidy_group(lambda both: run(*both))
    return lambda left, right: one((left, right))


def from_text(kernel: Callable, returns: str, text: Column) -> Column:
    """A column made of the text alone: kernel gives an Arrow array for a list of texts in UTF-8 (empty for null), SLICE bytes of them at a time.

    Only the text travels to Python and only the result back; the row's other columns stay where they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _libc()
        try:
            for column in batches:
                part = pa.RecordBatch.from_arrays([column], names=["text"])
                got = [kernel(texts) for _, texts in text_slices(part, 0, SLICE)]
                yield pa.concat_arrays(got) if got else kernel([])
        finally:
            _given_back()

    return F.arrow_udf(run, returns)(text)


def remainder_of_id(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id has no remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of the odd base modulo 2**64, and of its inverse, grown on demand; threads may share them."""

    def __init__(self) -> None:
        self.forget()

    @property
    def n(self) -> int:
        return len(self.both[0]) - 1

    def forget(self) -> None:
        self.both = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        both = self.both
        if n >= len(both[0]):
            both = tuple(np.full(-(-n // SLICE) * SLICE + 1, b, U64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            for x in both:
                x[0] = 1
                np.multiply.accumulate(x, out=x)
            self.both = both
        return both


POWERS = _Powers()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end, each text followed by one blank, and the starts of the texts (one more than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8), at


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes that end with a blank."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    return edge[0::2], edge[1::2]


_LENGTHS = 0xD6E8FEB86659FD93


def span_hasher(data: np.ndarray, lower: bool = True):
    """A function of starts and ends giving 64-bit hashes of those bytes, with A-Z lower-cased: a polynomial in an odd base, mixed with the length.

    Its `windows` gives the hashes of all spans of one length.
    """
    up, down = POWERS.get(len(data))
    up, down = up[: len(data)], down[: len(data) + 1]
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(((_LOWER[data] if lower else data).astype(U64) + U64(1)) * up, out=total[1:])

    def hashed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(_LENGTHS))

    hashed.windows = lambda width: mix64((total[width:] - total[:-width]) * down[:-width] + U64(width * _LENGTHS % (1 << 64)))
    return hashed


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of equal sizes that start at a and at b hold the same bytes: eight bytes a step over the spans that still agree."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    same = np.ones(len(a), bool)
    open_ = np.flatnonzero((a != b) & (size > 0))
    for k in range(0, int(size.max(initial=0)), 8):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        x, y = word[a[open_] + k], word[b[open_] + k]
        left = size[open_] - k
        agree = ((x == y) | (np.arange(8) >= left[:, None])).all(axis=1)
        same[open_[~agree]] = False
        open_ = open_[agree]
    return same


def equal_spans(key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of span, and the kind of each, the same for spans with the same bytes only: hashes (key) find candidates, bytes decide."""
    key = key.copy()
    while True:
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        if not len(key):
            return first, kind
        other = first[kind]
        bad = (size != size[other]) | ~same_bytes(data, start, start[other], np.minimum(size, size[other]))
        if not bad.any():
            return first, kind
        key[bad] = mix64(key[bad] + U64(1))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hasher(data, lower)(start, end)


def text_slices(batch: pa.RecordBatch, column: int | str, most: int = SLICE):
    """Parts of a batch with about `most` bytes of text, one row at least, each with its texts as UTF-8 (empty for null), taken out only as it comes."""
    data = batch.column(column).cast(pa.binary())
    for i, j in in_slices(data, pc.fill_null(pc.binary_length(data), 0).to_pylist(), most):
        yield batch.slice(i, j - i), [t or b"" for t in data.slice(i, j - i).to_pylist()]


def in_slices(items, sizes: list[int], most: int = SLICE):
    """Cut a list so that each part has about `most` bytes, one item at least."""
    i = 0
    while i < len(items):
        j, n = i, 0
        while j < len(items) and (j == i or n + sizes[j] <= most):
            n += sizes[j]
            j += 1
        yield i, j
        i = j
