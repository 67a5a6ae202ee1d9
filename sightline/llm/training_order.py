"""Training-order materialisation as fixed-stride binary shards.

All token streams, joined in the order of the input's files and of the rows in
them, are one stream that is cut into sequences of ``length`` ids; only the last may
be shorter. The order of files and rows does not depend on how a scan splits them, so
neither do the sequences. A first pass counts the tokens of every run of rows that a
task reads of a file; running sums over the runs, one number for each input split,
tell where each begins in the stream. A second pass cuts the stream there.

Sequence ``i`` of ``n`` has the global slot feistel(i, n, key): a keyed Feistel network
over the next power of four, which walks its cycle until the image lies inside.
Slot ``s`` is record ``s mod k`` of shard ``s div k``, ``k`` records a shard, so any slot
is read by a seek, without an index. Range partitions of the slots write the shards;
the ids are shuffled once.

A record is a little-endian unsigned 32-bit count of tokens and ``length``
little-endian unsigned 16- or 32-bit ids, zeros after the count. Shards are
written under another name and moved, so a repeated task leaves the same file.

Null texts are empty texts, of which the stream has the closing id alone.
Repeated rows are written once each. An empty table gives no shard and an empty
index. Columns other than text are not read, but those to order by."""

from __future__ import annotations

import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .common import materialize, mix, shared_path, small_batches, trimmed

LENGTH = 1024
END_ID = 50256
SHARD_BYTES = 32 << 20
#: So many shards are written by one task.
TASK_SHARDS = 4
#: Ids that a task holds before it cuts them.
HELD_IDS = 1 << 20
ROUNDS = 6
RUNS = "file string, f long, first long, n_tokens long"
PIECES = "sequence long, slot long, start int, ids binary"
INDEX_SCHEMA = "slot long, sequence long, shard long, byte_offset long, n_tokens long, ids_crc32 long"


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size), for an array of indexes."""
    half = max(1, math.ceil(max(1, (size - 1).bit_length()) / 2))
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & ((1 << 64) - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (outside := out >= np.uint64(size)).any():  # the cycle comes back inside
        out[outside] = once(out[outside])
    return out


def located(spark: SparkSession, docs: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """file, f (a hash of it), row and text. What is not read from Parquet files
    directly, or is to be ordered by columns, is written to files first: in that
    order, so the same rows give the same stream however they were partitioned."""
    if not order_by:
        try:
            return docs.select(F.col("_metadata.file_path").alias("file"), F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("row"), "text")
        except AnalysisException:
            pass
    rows = docs.orderBy(*order_by).select("text") if order_by else docs.select("text")
    return located(spark, materialize(spark, rows, "ordered"))


def _runs(batches: Iterator[pa.RecordBatch], f: int, row: int, text: int):
    """(batch, first row, rows, f, whether a run begins) of stretches of one file: a
    run goes on through batches."""
    now = None
    for b in batches:
        files = b.column(f).to_numpy()
        cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield b, a, z, int(files[a]), files[a] != now
                now = files[a]


def token_runs(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Tokens, with the closing ids, of every run of rows of a file in a task."""

    def kernel(batches):
        bpe, run = byte_bpe.load(tokenizer_path), None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(run, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "f", "first", "n_tokens"])
        for b, a, z, f, begins in _runs(batches, 1, 2, 3):
            if begins:
                if run:
                    yield out()
                run = [b.column(0)[a].as_py(), f, b.column(2)[a].as_py(), 0]
            run[3] += sum(bpe.count(t.as_py()) + 1 for t in b.column(3).slice(a, z - a))
        if run:
            yield out()

    return docs.select("file", "f", "row", "text").mapInArrow(trimmed(kernel), RUNS)


def pieces(docs: DataFrame, starts: dict[tuple[int, int], int], total: int, length: int, end_id: int, key: int, tokenizer_path: str, wide: bool) -> DataFrame:
    """The parts of sequences that each task's runs hold: the sequence, its slot,
    where the part begins in it, and its ids. ``starts``: of each run (f, first row)
    its place in the stream."""
    n, dtype = -(-total // length), "<u4" if wide else "<u2"
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    def cut(at: int, ids: np.ndarray, last: bool):
        """Rows of what can be cut of a stream from ``at`` on, and what is left."""
        upto = len(ids) if last else max(0, (at + len(ids)) // length * length - at)
        if not upto:
            return None, ids
        edges = [0, *range(-at % length or length, upto, length), upto]
        of = np.array([(at + e) // length for e in edges[:-1]], dtype=np.int64)
        blobs = [ids[a:z].tobytes() for a, z in zip(edges, edges[1:])]
        columns = [pa.array(of), pa.array(feistel(of, n, key).astype(np.int64)), pa.array([(at + e) % length for e in edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["sequence", "slot", "start", "ids"]), ids[upto:]

    def kernel(batches):
        bpe, at, held, size = byte_bpe.load(tokenizer_path), 0, [], 0
        end = np.array([end_id], dtype=dtype)

        def flush(last: bool):
            nonlocal at, held, size
            if size:
                made, rest = cut(at, np.concatenate(held), last)
                at, held, size = at + size - len(rest), [rest], len(rest)
                if made:
                    yield made

        for b, a, z, f, begins in _runs(batches, 0, 1, 2):
            if begins:
                yield from flush(True)
                at, held, size = shared.value[f, b.column(1)[a].as_py()], [], 0
            for t in b.column(2).slice(a, z - a):
                ids = bpe.array(t.as_py())
                held += [ids.astype(dtype, copy=False), end]
                size += len(ids) + 1
                if size > HELD_IDS:
                    yield from flush(False)
        yield from flush(True)

    return docs.select("f", "row", "text").mapInArrow(trimmed(kernel), PIECES)


def _starts(runs: DataFrame) -> tuple[dict[tuple[int, int], int], int]:
    """Where each run begins in the stream, and the stream's length. Runs are as many
    as input splits, of each of which the driver keeps more than this anyway."""
    out, total = {}, 0
    for r in sorted(runs.collect(), key=lambda r: (r["file"], r["first"])):
        out[r["f"], r["first"]] = total
        total += r["n_tokens"]
    return out, total


def shard_records(length: int = LENGTH, shard_bytes: int = SHARD_BYTES, wide: bool = False) -> int:
    """Records of a shard."""
    return max(1, shard_bytes // (4 + length * (4 if wide else 2)))


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, length: int = LENGTH, end_id: int = END_ID, key: int = 0, tokenizer_path: str | None = None, shard_bytes: int = SHARD_BYTES, wide: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """Write shards and their index under ``folder`` (a path or URI that pyarrow's
    file systems and Spark both reach); the index, a row a slot."""
    path = tokenizer_path or byte_bpe.default_path()
    docs = located(spark, docs, order_by)
    with small_batches(spark):
        starts, total = _starts(token_runs(docs, path))
    stride, k = 4 + length * (4 if wide else 2), shard_records(length, shard_bytes, wide)
    made = pieces(docs, starts, total, length, end_id, key, path, wide)
    n_shards = max(1, -(-total // length // k))
    n_tasks = -(-n_shards // TASK_SHARDS) if n_shards > 8 * TASK_SHARDS else n_shards
    task = F.floor(F.col("slot") / F.lit(k * (TASK_SHARDS if n_shards > 8 * TASK_SHARDS else 1))).cast("int")
    dealt = made.repartitionById(n_tasks, task).sortWithinPartitions("slot", "start")
    dtype = "<u4" if wide else "<u2"

    def writer(batches):
        files, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(base, recursive=True)
        now, out, temp, record, index = -1, None, "", None, []

        def close():
            if out is not None:
                out.close()
                files.move(temp, posixpath.join(base, f"shard-{now:08d}.bin"))

        def put():
            """Write the record that is whole now: (slot, sequence, parts)."""
            nonlocal now, out, temp
            if record is None:
                return
            slot, sequence, parts = record
            ids = b"".join(parts)
            if slot // k != now:
                close()
                now = slot // k
                temp = posixpath.join(base, f".{uuid.uuid4().hex}.tmp")
                out = files.open_output_stream(temp)
            at = slot % k * stride
            if out.tell() != at:
                raise RuntimeError(f"slot {slot} does not follow its neighbour; the input has changed between the passes")
            n = len(ids) // np.dtype(dtype).itemsize
            out.write(n.to_bytes(4, "little") + ids.ljust(stride - 4, b"\0"))
            index.append((slot, sequence, now, at, n, zlib.crc32(ids)))

        def rows():
            nonlocal index
            columns, index = list(zip(*index, strict=True)) or [()] * 6, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32"])

        for b in batches:
            for sequence, slot, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if record is None or slot != record[0]:
                    put()
                    record = (slot, sequence, [])
                record[2].append(blob.as_py())
            yield rows()
        put()
        close()
        yield rows()

    with small_batches(spark):
        dealt.mapInArrow(trimmed(writer), INDEX_SCHEMA).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def read_from(folder: str, slot: int = 0, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, wide: bool = False) -> Iterator[np.ndarray]:
    """Sequences in training order from ``slot`` on, as arrays of ids."""
    stride, k = 4 + length * (4 if wide else 2), shard_records(length, shard_bytes, wide)
    files, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    shard, skip = divmod(slot, k)
    while files.get_file_info(path := posixpath.join(base, f"shard-{shard:08d}.bin")).type == pafs.FileType.File:
        with files.open_input_file(path) as f:
            f.seek(min(skip * stride, f.size()))
            while record := f.read(stride):
                n = int.from_bytes(record[:4], "little")
                yield np.frombuffer(record[4:], dtype="<u4" if wide else "<u2")[:n]
        shard, skip = shard + 1, 0


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_shards(spark, docs, shared_path(spark, "training-order"))
