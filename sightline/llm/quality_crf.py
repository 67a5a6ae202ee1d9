"""Quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. A line's features are shares of character
kinds, repetition within the line and earlier in the document, and the same of
the lines before and after. Learning gives each line its document's label and
maximises the conditional likelihood of the chain; scoring runs forward-backward,
averages the marginals weighted by the lines' lengths, and calibrates that mean
by a logistic curve fitted on the sample.

The fit takes a bounded sample: ``max_docs`` labelled documents chosen by a hash
of the id, with all their lines.

Null and empty texts, and texts without a word, have no line and score 0. Rows
with a null id, and ids labelled both ways, take no part in learning. Without any
labelled row every score is 0. Repeated rows each get a row; an empty table gives
an empty result. Columns other than doc_id and text are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, text_buffers, trimmed, word_hashes, word_spans

#: Labelled documents of a fit, unless its argument says otherwise.
MAX_DOCS = 3000
ROUNDS = 120
L2 = 1e-4
THRESHOLD = 0.7
SLICE = 1 << 20


def _kind(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int32)
    table[list(chars)] = 1
    return table


#: Kinds of bytes whose share of a line is a feature.
KINDS = [_kind(b"#*$%&<>@^~=\\/{}[]"), _kind(b"|"), _kind(b"!?"), _kind(bytes(range(65, 91))), _kind(bytes(range(48, 58))), _kind(bytes(range(128, 256))), _kind(b".,;:")]
OWN = 7 + len(KINDS)
WIDTH = 1 + 3 * OWN


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Spans of about SLICE bytes that end with a document or a line."""
    breaks = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
    at, n = 0, len(data)
    while at < n:
        i = int(np.searchsorted(breaks, at + SLICE, side="right")) - 1
        upto = int(breaks[i]) if breaks[i] > at else int(breaks[i + 1]) if i + 1 < len(breaks) else n
        yield at, upto
        at = upto


def _slice_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one slice: owning row, length, features (OWN columns) and hash of every
    line with a word."""
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1, [0, len(data)]]))
    starts, ends, line = word_spans(data, bounds)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, OWN), np.float32), np.zeros(0, np.uint64)
    h = word_hashes(data, starts, ends, lower=False)
    used, first, n_words = np.unique(line, return_index=True, return_counts=True)
    lo, hi = bounds[used], bounds[used + 1]
    size = (hi - lo).astype(float)
    shares = []
    for table in KINDS:
        total = np.concatenate([[0], np.cumsum(table[data])])
        shares.append((total[hi] - total[lo]) / size)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    again = np.zeros(len(h))
    again[1:] = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
    nth = np.arange(len(h)) - np.repeat(first, n_words)
    key = np.add.reduceat(mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    x = np.stack(
        [
            np.log1p(size) / 8,
            np.log1p(n_words) / 6,
            np.add.reduceat(same, first) / n_words,
            np.add.reduceat(again, first) / n_words,  # lines are sorted, so positions of ``again`` fall in their own line
            np.minimum(np.add.reduceat((ends - starts).astype(float), first) / n_words / 16, 2),
            (n_words == 1).astype(float),
            np.zeros(len(used)),  # seen earlier in the document; set by lines()
            *[np.minimum(s * 4, 2) for s in shares],
        ],
        axis=1,
    )
    return np.searchsorted(offsets, lo, side="right") - 1, size, x.astype(np.float32), key


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owning row, length in bytes and all features of every line with a word."""
    parts = []
    for a, b in _slices(data, offsets):
        lo = int(np.searchsorted(offsets, a, side="right")) - 1
        hi = int(np.searchsorted(offsets, b, side="left"))
        row, *rest = _slice_lines(data[a:b], np.clip(offsets[lo : hi + 1], a, b) - a)
        parts.append((row + lo, *rest))
    if not parts or not sum(len(p[0]) for p in parts):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, WIDTH), np.float32)
    row, size, own, key = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((np.arange(len(row)), key, row))
    dup = np.zeros(len(row), dtype=bool)
    dup[1:] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    own[order, 6] = dup
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = row[1:] == row[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    return row, size, np.concatenate([np.ones((len(row), 1), np.float32), own, before, after], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray  # 2 x 2, from state to state; 1 is good
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, row: np.ndarray, pairs: bool = False):
        """P(good) of every line; with ``pairs`` also the sum of the marginals of
        neighbouring states. Chains run side by side, longest first."""
        emit = np.stack([np.zeros(len(x)), x @ self.weights], axis=1)
        _, first, length = np.unique(row, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else []
        alpha, beta = emit.copy(), np.zeros_like(emit)
        for t in range(1, len(active)):
            at = first[: active[t]] + t
            alpha[at] += np.logaddexp(alpha[at - 1][:, :1] + self.moves[0], alpha[at - 1][:, 1:] + self.moves[1])
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            inner = (emit[at] + beta[at])[:, None, :] + self.moves
            beta[at - 1] = np.logaddexp(inner[:, :, 0], inner[:, :, 1])
        both = alpha + beta
        total = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - total)
        if not pairs:
            return good
        inside = np.flatnonzero(row[1:] == row[:-1]) + 1
        joint = alpha[inside - 1][:, :, None] + self.moves + (emit[inside] + beta[inside])[:, None, :]
        return good, np.exp(joint - total[inside][:, None, None]).sum(axis=0)

    def doc_scores(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(row):
            mean = weighted(self.marginals(x, row), row, size, n)
            has = np.bincount(row, minlength=n) > 0
            out[has] = _sigmoid(self.slope * _logit(mean[has]) + self.shift)
        return out


def weighted(good: np.ndarray, row: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=good * size, minlength=n) / np.maximum(np.bincount(row, weights=size, minlength=n), 1e-9)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def learn(x: np.ndarray, row: np.ndarray, size: np.ndarray, labels: np.ndarray) -> Model:
    """``labels``: of each document 0..n-1, to which ``row`` refers."""
    x, y = x.astype(float), labels[row].astype(float)
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)))
    joined = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), 1)
    # Each document weighs 1, so that long ones don't decide alone.
    per_line = (1.0 / np.bincount(row))[row]
    first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, ROUNDS + 1):
        good, pairs = model.marginals(x, row, pairs=True)
        slope = np.concatenate([x.T @ ((y - good) * per_line) / len(labels), ((seen - pairs) / max(len(row), 1)).ravel()])
        slope -= L2 * np.concatenate([model.weights, model.moves.ravel()])
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights += move[:WIDTH]
        model.moves += move[WIDTH:].reshape(2, 2)
    v = _logit(weighted(model.marginals(x, row), row, size, len(labels)))
    has = np.bincount(row, minlength=len(labels)) > 0
    v, target = np.stack([v[has], np.ones(has.sum())], axis=1), labels[has]
    ab = np.array([1.0, 0.0])
    for _ in range(25):  # Newton's method; the small ridge keeps separable samples finite
        p = _sigmoid(v @ ab)
        ab -= np.linalg.solve((v * (p * (1 - p))[:, None]).T @ v + 0.1 * np.eye(2), v.T @ (p - target) + 0.1 * (ab - [1.0, 0.0]))
    model.slope, model.shift = float(ab[0]), float(ab[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, max_docs: int = MAX_DOCS) -> Model | None:
    """Learn from ``labels`` (doc_id, quality) where ``learn_from`` holds."""
    known = labels.where(learn_from & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("_q"))
    sample = known.where("q = _q").select("doc_id", "q").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "doc_id").limit(max_docs)

    def kernel(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            row, size, x = lines(data, offsets)
            for i in range(len(b)):
                own = slice(*np.searchsorted(row, [i, i + 1]))
                if own.stop > own.start:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1).cast(pa.string()), b.column(2).slice(i, 1).cast(pa.int32()), pa.array([size[own].tobytes()]), pa.array([x[own].tobytes()])], names=["doc_id", "q", "size", "x"]
                    )

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "q")  # at most max_docs ids
    rows = chosen.mapInArrow(trimmed(kernel), "doc_id string, q int, size binary, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    size = [np.frombuffer(r["size"]) for r in rows]
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32).reshape(-1, WIDTH)
    return learn(x, np.repeat(np.arange(len(rows)), [len(s) for s in size]), np.concatenate(size), np.array([r["q"] for r in rows]))


def score(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model)

    def kernel(batches):
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            found = np.zeros(len(b))
            if shared.value is not None:
                row, size, x = lines(data, offsets)
                found = shared.value.doc_scores(x, row, size, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "score"])

    one = docs.select("doc_id", "text")
    return one.mapInArrow(trimmed(kernel), one.select("doc_id").schema.add("score", "double"))


def label_lines(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (its number among lines with a word), p_good, good."""
    shared = spark.sparkContext.broadcast(model)

    def kernel(batches):
        for b in batches:
            row, _, x = lines(*text_buffers(b.column(1)))
            p = shared.value.marginals(x, row) if len(row) else np.zeros(0)
            first = np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - first), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "line", "p_good", "good"])

    one = docs.select("doc_id", "text")
    return one.mapInArrow(trimmed(kernel), one.select("doc_id").schema.add("line", "long").add("p_good", "double").add("good", "boolean"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels, F.col("doc_id").isNotNull() & ~held_out())
    return score(spark, docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
