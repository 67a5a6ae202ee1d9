"""Quality rules: plain counts and a hashed n-gram log-likelihood ratio.

The n-grams are single words and neighbouring pairs, hashed into a fixed number of
buckets. Two multinomials over the buckets are counted over all documents: one of
the raw corpus, one of the trusted target. A document's score is the mean of
log(p_target / p_raw) over its n-grams, in thousandths, so that sums are exact, and
it is kept where that reaches a fixed threshold. What goes through the driver is
one number for each bucket. Everything is DataFrame functions.

The trusted target is a table of doc_ids (see trusted_ids(): documents that labels
call good). Where none is given, or no document is in it, a rule over the text says
which documents to trust.

Null texts are empty texts: no word, so the base rules fail. A corpus without
trusted documents gives a ratio of 0 to every bucket. Repeated rows each get a
row, a null ``doc_id`` is passed through, and an empty table gives an empty
result. Other columns of ``docs`` are carried in one struct, so no name clashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of single words, and as many of pairs.
BUCKETS = 1 << 16
#: A bucket's ratio is drawn to 1 as if so many more n-grams had been seen in it.
PRIOR = 20.0
#: In a trial with as many buckets (and another hash), of 811 held-out documents that
#: labels call good 810 reached it, of 129 bad ones none.
MIN_LLR = -0.06
MIN_WORDS = 50
#: Trusted ids that a fit takes, unless its argument says otherwise; they are broadcast.
MAX_TRUSTED = 50_000

_SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _longs(array: Column, empty_if: Column) -> Column:
    return F.when(empty_if, F.array().cast("array<bigint>")).otherwise(array)


def _with_words(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, text, words, n_words and hashes of 3-word windows and of n-gram
    buckets."""
    out = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = out.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("_hash", F.transform("words", lambda w: F.xxhash64(w)))
    n, low = F.size("words"), F.lit(BUCKETS - 1)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_hash", i), F.get("_hash", i + 1), F.get("_hash", i + 2)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get("_hash", i - 1), F.get("_hash", i)).bitwiseAND(low) + BUCKETS)
    out = out.withColumn("_windows", _longs(windows, n < 3)).withColumn("_n_kinds", F.size(F.array_distinct("_windows")))
    single = F.transform("_hash", lambda h: h.bitwiseAND(low))
    return out.withColumn("_ngrams", F.concat(single, _longs(pairs, n < 2))).drop("_hash")


def _symbols() -> Column:
    return (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long")


def plain_prose() -> Column:
    """The target where none is given: prose without symbols, with few capitals and
    few repeated windows."""
    n, capitals = F.size("_windows"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return (F.col("n_words") >= MIN_WORDS) & (200 * _symbols() <= F.col("n_words")) & (20 * (n - F.col("_n_kinds")) <= n) & (10 * capitals <= 3 * F.length("text"))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """doc_id of the documents that ``labels`` (doc_id, quality) only call good, but
    those whose crc32(doc_id as text) mod 4 is 2, kept to measure by; of more than
    ``max_trusted`` about so many, chosen by a hash."""
    good = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = good.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id")
    n = good.count()
    return good if n <= max_trusted else good.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(n)) < max_trusted)


def _counts(docs: DataFrame, trusted: DataFrame | None) -> list:
    """_b, raw and target of every bucket that occurs: a row a bucket."""
    if trusted is None:
        seen = _with_words(docs).withColumn("_t", F.coalesce(plain_prose(), F.lit(False)).cast("int"))
    else:
        marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id").distinct().withColumn("_t", F.lit(1))), "doc_id", "left")  # bounded by max_trusted
        seen = _with_words(marked, F.coalesce("_t", F.lit(0)).alias("_t"))
    # explode() would have its filter on the array pushed through the lambdas, which repeats them for every word.
    seen = seen.select("_t", F.explode_outer("_ngrams").alias("_b"))
    return seen.groupBy("_b").agg(F.count("*").alias("raw"), F.sum("_t").alias("target")).where("_b IS NOT NULL").collect()


def fit(docs: DataFrame, trusted: DataFrame | None = None) -> list[int]:
    """log(p_target / p_raw) of every bucket in thousandths, from all documents.
    ``trusted``: the target's doc_ids."""
    counts = _counts(docs, trusted)
    if trusted is not None and not sum(r["target"] for r in counts):
        counts = _counts(docs, None)
    raw, target_n = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    out = [0] * (2 * BUCKETS)
    if target_n:
        share = target_n / raw
        for r in counts:
            out[r["_b"]] = round(1000 * (math.log((r["target"] + PRIOR * share) / (r["raw"] + PRIOR)) - math.log(share)))
    return out


def _repeated() -> Column:
    """Words in 3-word windows found twice or more: equal neighbours in the order
    of hashes give the windows' places, whose spans are then united."""
    place = F.sort_array(F.arrays_zip(F.col("_windows").alias("h"), F.sequence(F.lit(0), F.size("_windows") - 1).alias("p")))
    return F.when(F.col("_n_kinds") < F.size("_windows"), place)


def score(docs: DataFrame, ratios: list[int]) -> DataFrame:
    """All columns of ``docs`` as struct ``_row``, the counts, base_failed, llr."""
    out = _with_words(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_row")).withColumn("_places", _repeated())
    again = F.filter("_places", lambda x, i: (F.get("_places", i - 1)["h"] == x["h"]) | F.coalesce(F.get("_places", i + 1)["h"] == x["h"], F.lit(False)))
    again = F.sort_array(F.transform(again, lambda x: x["p"]))
    united = F.aggregate(
        again,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<smallint>")  # folded into one literal
    out = out.select(
        "_row",
        "n_words",
        F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
        _symbols().alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_places").isNull(), F.lit(0)).otherwise(united).cast("long").alias("n_repeat_words"),
        (F.aggregate("_ngrams", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b.cast("int"))) / (1000 * F.greatest(F.size("_ngrams"), F.lit(1)))).alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rules(docs: DataFrame, trusted: DataFrame | None = None, min_llr: float = MIN_LLR) -> DataFrame:
    """``_row``, the counts, base_failed, llr and the verdict ``kept``."""
    return score(docs, fit(docs, trusted)).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= min_llr))


def keep_good(docs: DataFrame, trusted: DataFrame | None = None, min_llr: float = MIN_LLR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    # A filter on "kept" itself would be pushed below the projections and inline them into one another.
    return rules(docs, trusted, min_llr).select("_row", F.explode_outer(F.array("kept")).alias("_keep")).where("_keep").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules(docs, trusted).select("_row.doc_id", *COUNTS, "base_failed", "kept", "llr")
