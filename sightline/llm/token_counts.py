"""Token counts by a digest cache.

A document's key is the digest of its normalised content (null becomes empty)
and the digest of the tokenizer file. The distinct digests are joined to the
stored counts; contents that miss are encoded once each and appended to the
cache; then every document takes its count from the cache.

Texts stay where they are scanned as far as possible. A bit table of the digests
that are stored or occur twice or more tells the rows, most of them, whose content
surely misses and is nowhere else: these are encoded in place. Of the others, rows
that another bit table shows to be no miss are dropped in place, and only what is
left is shuffled, one row a content and task, to be encoded once. Contents that
many rows share get their counts by a broadcast of bounded size.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows each get a row.
A null ``doc_id`` is passed through. An empty table gives an empty result. Other
columns of ``docs`` are ignored, so their names cannot clash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .common import join_counted, key_filter, materialize, maybe_in, shared_root, small_batches, trimmed

TOKEN_LIMIT = 512
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # Two writers may have stored the same digest; both counts are the same.
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(bpe: byte_bpe.ByteBpe, digests: pa.Array, texts: pa.Array, tokenizer: str) -> pa.RecordBatch:
    n = [bpe.count(t.as_py()) for t in texts]
    return pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])


def _encode_in_place(keyed: DataFrame, unsure: np.ndarray, tokenizer_path: str, tokenizer: str) -> DataFrame:
    """Counts of the rows that no other row equals and the cache lacks for sure."""
    shared = keyed.sparkSession.sparkContext.broadcast(unsure)

    def kernel(batches):
        bpe = byte_bpe.load(tokenizer_path)
        for b in batches:
            b = b.filter(pa.array(~maybe_in(shared.value, b.column(2).to_numpy())))
            yield _encoded(bpe, b.column(0), b.column(1), tokenizer)

    return keyed.select("digest", "text", F.xxhash64("digest")).mapInArrow(trimmed(kernel), CACHE_SCHEMA)


def _encode_shuffled(keyed: DataFrame, unsure: np.ndarray, missing: np.ndarray, misses: DataFrame, tokenizer_path: str, tokenizer: str) -> DataFrame:
    """Counts of the other misses, each content once."""
    shared = keyed.sparkSession.sparkContext.broadcast((unsure, missing))

    def kept(batches):
        for b in batches:
            k = b.column(2).to_numpy()
            b = b.filter(pa.array(maybe_in(shared.value[0], k) & maybe_in(shared.value[1], k)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), b.column(1)], names=["digest", "text"])

    def kernel(batches):
        bpe = byte_bpe.load(tokenizer_path)
        for b in batches:
            yield _encoded(bpe, b.column(0), b.column(1), tokenizer)

    rows = keyed.select("digest", "text", F.xxhash64("digest")).mapInArrow(trimmed(kept), "digest binary, text string")
    # first() combines before the shuffle, so a content with many copies is sent once by each task.
    one = rows.groupBy("digest").agg(F.first("text").alias("text")).join(misses.select("digest"), "digest", "left_semi")
    return one.mapInArrow(trimmed(kernel), CACHE_SCHEMA)


def count_tokens(spark: SparkSession, docs: DataFrame, cache_path: str, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text)."""
    tokenizer_path = tokenizer_path or byte_bpe.default_path()
    tokenizer = byte_bpe.version(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    kinds = keyed.groupBy("digest").agg(F.count("*").alias("n"))
    kinds = materialize(spark, kinds.join(read_cache(spark, cache_path, tokenizer), "digest", "left"), "digests")
    misses = kinds.where("n_tokens IS NULL")
    unsure = kinds.where("n_tokens IS NOT NULL OR n > 1").select(F.xxhash64("digest").alias("k"))
    size = kinds.agg(F.sum("n"), F.count_if(F.expr("n_tokens IS NOT NULL OR n > 1")), F.count_if(F.expr("n_tokens IS NULL"))).collect()[0]
    if size[2]:
        unsure, missing = key_filter(unsure, size[1]), key_filter(misses.select(F.xxhash64("digest").alias("k")), size[2])
        made = _encode_in_place(keyed, unsure, tokenizer_path, tokenizer).unionByName(_encode_shuffled(keyed, unsure, missing, misses, tokenizer_path, tokenizer))
        with small_batches(spark):
            made.write.mode("append").parquet(cache_path)
    counted = materialize(spark, kinds.select("digest", "n").join(read_cache(spark, cache_path, tokenizer), "digest"), "counted")
    return join_counted(keyed.select("doc_id", "n_bytes", "digest"), counted, ["digest"], "n", size[0] or 0).select("doc_id", "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is kept beside the intermediate tables, one for each tokenizer, so
    later runs find what earlier ones have counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = f"{shared_root(spark)}/token-counts/{byte_bpe.version(byte_bpe.default_path())[:16]}"
    return count_tokens(spark, docs, cache).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
