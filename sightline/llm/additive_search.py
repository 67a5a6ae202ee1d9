"""Nearest neighbours by additive quantisation.

Vectors are scaled to unit length and coded as a sum of full-dimensional
codewords: codebooks are begun on residuals of a bounded sample, then all of them
are fitted together by least squares to the codes that a beam search picks, in
turns. The index stores of every vector the codes, the coded
sum's norm and the cosine between the two. A query block scores every coded row by
lookup tables (one inner product per codeword, added up and divided by the stored
norm). The rows of each block with the best scores give a k-th exact cosine in
double precision; the angles from the query to the coded sum and from there to the
vector bound every other row's cosine, and each row whose bound reaches the k-th is
ranked by its exact cosine too. A task keeps the k best of each of its queries
over the blocks of rows that it meets, which are a ``GROUPS``-th of all, so the rows
that go on grow with the queries alone. The k best of all are the k nearest,
whatever the number of rows and however alike they are.

The codebooks' sample is bounded (``SAMPLE`` rows chosen by a hash of the id);
every vector is indexed and every coded row is scored.

Vectors that are null, of another dimension than most, zero, or hold a null or
non-finite component take no part. Repeated rows are candidates each; a query
excludes its own id. Rows with a null id take no part. With few vectors all
candidates come back; an empty table gives an empty result. Columns other than
vec_id and embedding are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize

SAMPLE = 8192
BOOKS, WORDS, BEAM = 16, 256, 8
ROUNDS = 8
#: Turns of encoding and fitting, and passes over the books in a fit.
FITS, PASSES = 2, 6
#: So many rows of a block are ranked exactly before the bounds are looked at.
SHORTLIST = 256
QUERY_BLOCK, CODE_BLOCK = 4096, 8192
#: Bytes of vectors in a block of codes or of queries.
BLOCK_BYTES = 1 << 23
#: Groups of code blocks; a block of queries and such a group are worked on together.
GROUPS = 64
TOP_K = 5

INDEX = StructType().add("vec_id", "long").add("deal", "long").add("codes", "binary").add("norm", "double").add("cosine", "double").add("slack", "double").add("v", "binary")


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of each row: a beam search over the books in turn that keeps the
        ``beam`` partial sums nearest to the row."""
        n = len(x)
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        rest = x[:, None, :].astype(np.float32)
        for book in self.words:
            # |r - w|^2 without |r|^2 of its own beam entry would not compare across entries.
            cost = (rest**2).sum(-1)[:, :, None] - 2 * rest @ book.T + (book**2).sum(-1)
            width = min(beam, cost.shape[1] * len(book))
            flat = cost.reshape(n, -1)
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            entry, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            codes = np.concatenate([codes[row, entry], word[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[row, entry] - book[word]
        best = (rest**2).sum(-1).argmin(axis=1)
        return codes[np.arange(n), best]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.words))


def fitted(x: np.ndarray, codes: np.ndarray, words: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Codewords of all books that make the sum of |x - coded sum|^2 small together,
    the codes being given: least squares, book by book against all others' share,
    over and over, which never raises it. Words that no row uses stay."""
    words = words.astype(np.float64)
    rest = x - sum(book[codes[:, m]] for m, book in enumerate(words))
    for _ in range(passes):
        for m in range(len(words)):
            own = codes[:, m].astype(np.int64)
            rest += words[m][own]
            total, n = np.zeros_like(words[m]), np.bincount(own, minlength=len(words[m]))
            np.add.at(total, own, rest)
            words[m][n > 0] = total[n > 0] / n[n > 0, None]
            rest -= words[m][own]
    return words.astype(np.float32)


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7, fits: int = FITS) -> Codebooks:
    """Residual k-means, book after book; then ``fits`` times codes by beam search
    and one fit of all codewords to them."""
    rng = np.random.default_rng(seed)
    rest, made = x.astype(np.float32).copy(), []
    for _ in range(books):
        k = min(words, len(x))
        centres = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(ROUNDS):
            near = ((centres**2).sum(-1) - 2 * rest @ centres.T).argmin(axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, near, rest)
            n = np.bincount(near, minlength=k)
            centres[n > 0] = total[n > 0] / n[n > 0, None]
        made.append(centres)
        rest = rest - centres[((centres**2).sum(-1) - 2 * rest @ centres.T).argmin(axis=1)]
    found = Codebooks(np.stack(made))
    for _ in range(fits):
        codes = np.concatenate([found.encode(x[at : at + 1024]) for at in range(0, len(x), 1024)])
        found = Codebooks(fitted(x, codes, found.words))
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("embedding") == size[0]["d"]) if size else v


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in x], pa.binary())


def _stacked(column: pa.Array, dtype, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(n, -1)


def build_index(spark: SparkSession, vectors: DataFrame, sample: int = SAMPLE) -> tuple[Codebooks | None, DataFrame]:
    """Codebooks, and of every usable vector vec_id, a number to deal it by, codes,
    norm of the coded sum, its cosine with the vector, the most by which a score by
    lookup tables may be wrong, and the unit vector, as a table."""
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    books = train(_unit(_matrix(drawn.column(0).combine_chunks()))) if len(drawn) else None
    shared = spark.sparkContext.broadcast(books)

    def kernel(batches):
        books = shared.value
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                x = _unit(_matrix(part.column(2)))
                codes = books.encode(x)
                coded = books.decode(codes).astype(np.float64)
                norm = np.maximum(np.sqrt((coded**2).sum(axis=1)), 1e-12)
                # Rounding of single-precision products and sums, twice over.
                terms = sum(np.sqrt((book.astype(np.float64) ** 2).sum(axis=1))[codes[:, m]] for m, book in enumerate(books.words))
                slack = 2.0**-22 * (x.shape[1] + len(books.words)) * terms / norm
                columns = [part.column(0), part.column(1), _binary(codes), pa.array(norm), pa.array((x * coded).sum(axis=1) / norm), pa.array(slack), _binary(x)]
                yield pa.RecordBatch.from_arrays(columns, names=INDEX.names)

    # Rows are dealt by their number, so that repeats of one id do not meet in one block.
    dealt = vectors.select("vec_id", F.xxhash64(F.monotonically_increasing_id()).alias("deal"), "embedding")
    return books, materialize(spark, dealt.mapInArrow(kernel, INDEX), "additive-index")


def _blocks(df: DataFrame, key: str, rows: int, n: int) -> DataFrame:
    return df.withColumn("_block", F.pmod(F.xxhash64(key, F.lit("block")), F.lit(-(-n // rows) or 1)).cast("int"))


def _reach(s: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The largest cosine with a query of vectors whose coded sums have the cosine
    ``s`` with it and ``cosine`` with the vector."""
    s, cosine = np.clip(s, -1, 1), np.clip(cosine - 1e-12, -1, 1)
    return np.where(s >= cosine, 1.0, s * cosine + np.sqrt((1 - s * s) * (1 - cosine * cosine)))


def _merge(best: list, ids: np.ndarray, scores: np.ndarray, k: int) -> list:
    """The ``k`` best of (ids, scores) so far and of those given."""
    ids, scores = (np.concatenate([a, b]) for a, b in zip(best, (ids, scores), strict=True))
    order = np.lexsort((ids, -scores))[:k]
    return [ids[order], scores[order]]


def nearest(spark: SparkSession, queries: DataFrame, books: Codebooks, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of the index of largest cosine
    for each query. Blocks of queries meet blocks of codes; ties go to smaller ids."""
    shared = spark.sparkContext.broadcast(books)
    n_rows = index.count()

    def pack_queries(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _binary(_unit(_matrix(b.column(1))))], names=["vec_id", "_block", "v"])

    fit = max(1, BLOCK_BYTES // (8 * books.words.shape[2]))
    q = _blocks(queries, "vec_id", min(QUERY_BLOCK, fit), queries.count()).mapInArrow(pack_queries, "vec_id long, _block int, v binary")
    q = q.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("queries")).withColumnRenamed("_block", "_q")
    block = min(CODE_BLOCK, fit)
    groups = min(GROUPS, -(-n_rows // block))
    c = _blocks(index, "deal", block, n_rows).groupBy("_block").agg(F.collect_list(F.struct("vec_id", "codes", "norm", "cosine", "slack", "v")).alias("rows"))

    def score_pairs(batches):
        books, now, best = shared.value, None, {}

        def out():
            found = [(np.full(len(ids), j), ids, scores) for j, (ids, scores) in best.items()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(len(b)):
                if best and now != (b.column(2)[i].as_py(), b.column(3)[i].as_py()):
                    yield out()
                    best = {}
                now = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                qs, rows = b.column(0)[i].values, b.column(1)[i].values
                v, x = _stacked(qs.field(1), np.float64, len(qs)), _stacked(rows.field(5), np.float64, len(rows))
                ids, q_ids = (np.asarray(a.field(0)) for a in (rows, qs))
                codes = _stacked(rows.field(1), np.uint8, len(rows))
                norm, cosine, slack = (np.asarray(rows.field(f)) for f in (2, 3, 4))
                keep = min(max(SHORTLIST, k + 1), len(ids))
                for j in range(len(q_ids)):
                    table = np.einsum("d,mwd->mw", v[j].astype(np.float32), books.words)
                    s = table[0][codes[:, 0]]
                    for m in range(1, codes.shape[1]):
                        s = s + table[m][codes[:, m]]
                    s = s / norm
                    held = best.setdefault(int(q_ids[j]), [np.zeros(0, np.int64), np.zeros(0)])
                    other = ids != q_ids[j]
                    first = np.argpartition(s, len(s) - keep)[len(s) - keep :]
                    first = first[other[first]]
                    over, known = np.flatnonzero(other), np.concatenate([x[first] @ v[j], held[1]])
                    if len(known) >= k:
                        least = np.partition(known, len(known) - k)[len(known) - k]
                        over = np.flatnonzero(other & (_reach(s + slack, cosine) >= least - 1e-9))
                    exact = x[over] @ v[j]
                    if len(over) > k:
                        near = exact >= np.partition(exact, len(exact) - k)[len(exact) - k] - 1e-9
                        over = over[near]
                    # Summed row by row, so that equal vectors get equal scores wherever they lie.
                    best[int(q_ids[j])] = _merge(held, ids[over], (x[over] * v[j]).sum(axis=1), k)
        if best:
            yield out()

    # The stated query set meets all rows block by block; a code block is sent once for each query block.
    # The join's order brings one pair of query block and group together; where it does not, more rows go on.
    n_query_blocks = F.lit(q.agg(F.max("_q")).collect()[0][0])
    c = c.withColumn("_q", F.explode(F.sequence(F.lit(0), n_query_blocks))).withColumn("_group", F.col("_block") % groups)
    q = q.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = c.hint("merge").join(q, ["_q", "_group"]).select("queries", "rows", "_q", "_group")
    found = pairs.mapInArrow(score_pairs, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = TOP_K) -> DataFrame:
    v = usable(vectors)
    books, index = build_index(spark, v)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = v.where(is_query)
    if not queries.head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of rows that repeat a query's id the smallest vector asks.
    return nearest(spark, queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), books, index, k)


def op10_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(spark, vectors, F.col("vec_id") % 50 == 0)
