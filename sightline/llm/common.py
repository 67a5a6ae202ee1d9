"""Shared pieces of the training-data operators: the shared folder, table
writing, and numpy kernels over Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at once; bounds the kernels' memory whatever a text's length.
SLICE_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 4 << 20
#: Keys that hold at least one in so many rows are joined by broadcast (see join_counted).
HOT_KEYS = 4096
#: Bits of a key filter, at least and at most (8 MB).
FILTER_BITS = 1 << 16, 1 << 26

_made: list[str] = []


@functools.lru_cache(maxsize=1)
def _own_shared_dir() -> str:
    return tempfile.mkdtemp(prefix="sightline-shared-")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.
    Where it is unset, a local session makes one up; on a cluster that would be a
    folder of one machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_shared_dir()
    return f"{root.rstrip('/')}/sightline"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under shared_root()."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, Arrow batches hold BATCH_BYTES and a row more at most, whatever
    the rows' size; then the session's own bound holds again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, so that
    lineage ends there and a lost executor costs no recomputation."""
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the folders that shared_path() gave out, from the ``since``-th on, but
    those in ``keep``; tables read from them are gone."""
    for path in [p for p in _made[since:] if p not in keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def made() -> int:
    """How many folders shared_path() has given out that are still there."""
    return len(_made)


def last() -> tuple[str, ...]:
    """The folder that shared_path() gave out last."""
    return tuple(_made[-1:])


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """``left`` inner joined with ``right``, a written table with one row a key whose
    column ``count`` says how many of the ``n_rows`` left rows have it. Keys of more
    than one in HOT_KEYS rows, of which there are fewer than HOT_KEYS, are broadcast,
    so no task gets all rows of a frequent key; the others are shuffled."""
    hot = F.col(count) * HOT_KEYS > n_rows
    few = F.broadcast(right.where(hot))  # fewer than HOT_KEYS rows
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(few, keys).unionByName(rest)


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A bit table of the ``n`` 64-bit keys in the only column of ``keys``: a key
    whose bit is not set is none of them. Its size follows ``n`` up to FILTER_BITS;
    beyond, more keys that are none of them have their bit set."""
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << (16 * n).bit_length()))
    bit = F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.shiftright(bit, 6).alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of every 64-bit key whether key_filter() may have had it."""
    bit = keys.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def give_back() -> None:
    """Freed memory goes back to the system; workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(kernel):
    """``kernel`` over batches, after which the worker gives memory back."""

    def run(batches):
        yield from kernel(batches)
        give_back()

    return run


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, without a copy of the bytes where
    no text is null; nulls become empty texts."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n + 1, f, dtype=np.uint64) for f in (_MULTIPLIER, pow(_MULTIPLIER, -1, _MASK + 1)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    return up, down


def _hash_slice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for sorted, disjoint spans of one slice."""
    n = 1 << max(18, int(len(data)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix(((sums[ends] - sums[starts]) * down[starts]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owning row of every ``[^\\x20\\x09-\\x0D]+`` word."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased first; works through the
    bytes in slices that end between words."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        part = data[base : ends[upto - 1]]
        out[at:upto] = _hash_slice(LOWER[part] if lower else part, starts[at:upto] - base, ends[at:upto] - base)
        at = upto
    return out


def row_groups(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of rows holding about ``limit`` bytes each, at least one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, upto
        row = upto
