"""The corpus pipeline: language, quality, near duplicates, packing.

Every stage takes all rows that the one before it kept, and returns the columns of
documents; the last returns pieces. Null, empty and letterless texts go at the first
stage, having no language. Repeated rows are near duplicates of one another, of which
one stays; a row with a null doc_id stays only where no linked row has an id. An
empty table gives empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import common, language_id, ngram_join, packing, quality_rules


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that are in a learned language with a score that the stage's
    operator takes for sure (language_id.MIN_SCORE)."""
    return language_id.keep_known(spark, docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep stay; those that labels
    call good are the trusted target."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest id."""
    return ngram_join.keep_one(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in packed sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again; what a stage
    has written besides is deleted with its end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = common.made()
        docs = common.materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(spark, before, keep=common.last())
    return docs


#: Kernel regression, hashed ratios and least squares have no SQL form.
ORACLE_SQL = None
