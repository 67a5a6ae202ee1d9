"""Packing token sequences into fixed windows by non-negative least squares.

Documents are cut into full windows and a remainder. The lengths' histogram (at
most ``window`` bins) goes to the driver, where combinations of at most three
lengths that fill a window exactly are enumerated, their repeat counts solved
against the histogram under x >= 0, rounded, and the residual pieces packed by
best-fit decreasing. The plan has one entry per combination, whatever the number
of documents; every piece finds its place in it from its length and its rank
among the pieces of that length.

Null texts are empty texts, which hold the closing id alone. Repeated rows are
packed once each. A null ``doc_id`` is passed through. An empty table gives no
piece. Other columns of ``docs`` are ignored, so their names cannot clash."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import materialize, trimmed

WINDOW = 1024
END_ID = 0
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEQUENCE_SCHEMA = f"{PIECES_SCHEMA}, sequence_id long, offset long"
#: Ranks within a length are dealt by a hash over this many groups, or more so
#: that a group has about RANKED_ROWS rows however often one length occurs.
RANK_GROUPS, RANKED_ROWS = 64, 100_000


def cut(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: windows from its start on and a remainder.
    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit bytes."""
    path = tokenizer_path or byte_bpe.default_path()

    def kernel(batches):
        bpe = byte_bpe.load(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(bpe.array(text.as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                for at in range(0, len(ids), window):
                    part = ids[at : at + window].tobytes()
                    rows.append((doc.as_py(), at, len(part) // 4, zlib.crc32(part), len(ids), *([part] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(kernel), PIECES_SCHEMA + ", ids binary" * with_ids)


def combinations(window: int) -> np.ndarray:
    """Every multiset of two or three lengths with sum ``window``, and the whole
    window; ascending, zeros first."""
    a, b = np.meshgrid(np.arange(window // 3 + 1), np.arange(window // 2 + 1), indexing="ij")
    c = window - a - b
    keep = (a <= b) & (b <= c) & (b > 0)
    return np.concatenate([np.stack([a[keep], b[keep], c[keep]], axis=1), [[0, 0, window]]])


def solve(histogram: np.ndarray, combos: np.ndarray, rounds: int = 200) -> np.ndarray:
    """argmin |Ax - h| over x >= 0 by multiplicative updates, which keep x
    non-negative and never raise the residual."""
    h = histogram.astype(float)
    h[0] = 0
    used = (combos > 0).astype(float)
    back = lambda r: (r[combos] * used).sum(axis=1)
    size = len(h)
    forward = lambda x: np.bincount(combos.ravel(), weights=(used * x[:, None]).ravel(), minlength=size)
    # A combination with a length that does not occur can hold nothing.
    x = np.where((np.where(combos > 0, h[combos], np.inf) > 0).all(axis=1), 1.0, 0.0)
    target = back(h)
    for _ in range(rounds):
        x *= target / np.maximum(back(forward(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), covering every piece."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[tuple[int, ...], int]] = []
    combos = combinations(window)
    x = solve(histogram, combos)
    for i in np.lexsort((np.arange(len(x)), -x)):
        if x[i] < 1e-3:
            break
        lengths, repeats = np.unique(combos[i][combos[i] > 0], return_counts=True)
        n = min(int(np.ceil(x[i])), int((left[lengths] // repeats).min()))
        if n > 0:
            left[lengths] -= n * repeats
            made.append((tuple(int(v) for v in combos[i] if v), n))
    # Best-fit decreasing over the residual; open[f]: kinds of sequence with f free.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        if n:
            free = window - sum(lengths)
            made.append((lengths, n)) if free == 0 else open_.setdefault(free, []).append((lengths, n))

    for length in range(window, 0, -1):
        n = int(left[length])
        while n:
            free = min((f for f in open_ if f >= length), default=0)
            if free:
                lengths, k = open_[free].pop()
                if not open_[free]:
                    del open_[free]
                take = min(n, k)
                put(lengths, k - take)
                put((*lengths, length), take)
                n -= take
            else:
                each = window // length
                put((length,) * each, n // each)
                put((length,) * (n % each), 1 if n % each else 0)
                n = 0
    return made + [x for kinds in open_.values() for x in kinds]


def places(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: ranks
    from the first on, up to the next row's, take consecutive sequences."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in made:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked(pieces: DataFrame, n_rows: int) -> DataFrame:
    """``rank``: the piece's number among those of its length, from 0, without
    bringing one length's pieces together."""
    groups = max(RANK_GROUPS, n_rows // RANKED_ROWS)
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    counts = counts.select("length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "start", "ids_crc32"))
    return dealt.withColumn("_own", own).join(counts, ["length", "_g"]).withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_g", "_own", "_before")


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """Every piece with the sequence and the offset where it lies."""
    pieces = materialize(spark, cut(docs, window, end_id, tokenizer_path), "pieces")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `window` rows
        histogram[length] = n
    table = places(plan(histogram, window)) if histogram.sum() else np.zeros((0, 4), np.int64)
    table = spark.sparkContext.broadcast(table)  # bounded by the number of combinations

    def kernel(batches):
        rows = table.value
        keys = (rows[:, 0] << 44) | rows[:, 1]
        for b in batches:
            rank = b.column(5).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, (b.column(2).to_numpy(zero_copy_only=False) << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(rows[i, 2] + rank - rows[i, 1]), pa.array(rows[i, 3])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long")]
    return ranked(pieces, int(histogram.sum())).select(*columns).mapInArrow(kernel, SEQUENCE_SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
