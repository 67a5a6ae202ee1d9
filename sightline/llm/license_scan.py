"""License scans: MinHash bands over windows of words, then exact containment.

Words are lower-cased (A-Z) runs without white space or punctuation, so comment marks
and full stops do not matter; shingles are five words. A text's windows of shingles
have keys, one for each band, made of the windows' MinHashes; so have the templates'.

- Templates of fewer than ``SHORT`` shingles: windows of one shingle, one band. Any
  shared shingle collides.
- Longer templates contribute every window of ``WINDOW`` shingles that they have; a
  text has one every ``STRIDE``. A run of ``WINDOW + STRIDE - 1`` shingles in common
  holds a window with Jaccard 1, which collides for certain, and a window of
  Jaccard 0.8 collides in one of the ``BANDS`` bands of one row with probability
  1 - 0.2 ** BANDS > 0.998. Where single words were changed and 0.8 of the shingles
  are left, the longest run has 0.8 n / (n / 25 + 1) shingles or more, which is
  such a run from ``SHORT`` shingles on.

A template retrieved by any collision is verified: it matches where the text has
at least ``THRESHOLD`` of its distinct shingles. Templates are a table that is
broadcast, of at most ``MAX_BYTES``; their keys are one literal. Each row is worked
on alone, without a shuffle. Everything is DataFrame functions.

Null texts and texts of fewer than five words match nothing. Repeated rows each
get their matches, a null ``doc_id`` is passed through, and an empty table gives
an empty result. Columns other than doc_id and text are not read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

WORDS = 5
WINDOW, STRIDE, BANDS = 8, 4, 4
#: From so many shingles on, a template is looked for in windows of WINDOW.
SHORT = 31
THRESHOLD = 0.8
#: Of all templates' texts together, at most.
MAX_BYTES = 4 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that part words, as white space does.
_MARKS = ".,;:!?()[]{}<>/\\|*#\"'`=-_"


def shingles(text: str) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(_UPPER + _MARKS, _LOWER + " " * len(_MARKS))))
    return [" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def _key(window: Column, band: int) -> Column:
    """The key of a window (an array of hashes) in a band."""
    seed = F.lit((band + 1) * 0x1F3D5B79A1C3E5F7 % (1 << 62))
    return F.xxhash64(F.lit(band), F.array_min(F.transform(window, lambda x: x.bitwiseXOR(seed))))


def _windows(hashes: Column, size: int, stride: int, bands: int) -> Column:
    """Keys of all windows of ``size`` hashes, one every ``stride``; fewer hashes
    are one window."""
    if size == 1:
        return F.flatten(F.transform(hashes, lambda h: F.array(*[_key(F.array(h), b) for b in range(bands)])))
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - size, F.lit(0)), F.lit(stride))
    return F.flatten(F.transform(starts, lambda i: F.array(*[_key(F.slice(hashes, i + 1, size), b) for b in range(bands)])))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> list[dict]:
    """Of each template its number, license, shingle hashes and keys."""
    if sum(len(t.encode()) for texts in templates.values() for t in texts) > MAX_BYTES:
        raise ValueError("the templates are too large to be broadcast")
    rows = [(name, s) for name, texts in sorted(templates.items()) for s in map(shingles, texts) if s]
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "template int, license_id string, s array<string>")
    df = df.withColumn("o", F.transform("s", lambda x: F.xxhash64(x)))
    keys = F.when(F.size("o") < SHORT, _windows(F.col("o"), 1, 1, 1)).otherwise(_windows(F.col("o"), WINDOW, 1, BANDS))
    return [r.asDict() for r in df.select("template", "license_id", F.array_distinct("o").alias("s"), F.array_distinct(keys).alias("keys"), (F.size("o") < SHORT).alias("short")).orderBy("template").collect()]


def _held(keys: str, values: set[int]) -> Column:
    """Those of the array column ``keys`` that are in ``values``."""
    return F.expr(f"filter({keys}, k -> k IN ({', '.join(f'{v}L' for v in sorted(values))}))") if values else F.expr("CAST(array() AS array<bigint>)")


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license_id, template (its number), n_shingles, n_matched,
    containment and first_word of every template in every row of ``docs``."""
    table = template_table(spark, TEMPLATES if templates is None else templates)
    leads: dict[int, list[int]] = {}
    for r in table:
        for k in r["keys"]:
            leads.setdefault(k, []).append(r["template"])
    if not table:
        none = {"license_id": "string", "template": "int", "n_shingles": "long", "n_matched": "long", "containment": "double", "first_word": "long"}
        return docs.where(F.lit(False)).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    words = F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER + _MARKS, _LOWER + " " * len(_MARKS)), _SPACE)
    out = docs.select("doc_id", F.array_remove(words, "").alias("_w"))
    joined = F.transform(F.sequence(F.lit(0), F.size("_w") - WORDS), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("_w", i + 1, WORDS))))
    out = out.select("doc_id", F.when(F.size("_w") < WORDS, F.array().cast("array<bigint>")).otherwise(joined).alias("_s"))
    out = out.select("doc_id", "_s", _windows(F.col("_s"), 1, 1, 1).alias("_one"), _windows(F.col("_s"), WINDOW, STRIDE, BANDS).alias("_many"))
    short, long_ = ({k for r in table if r["short"] == kind for k in r["keys"]} for kind in (True, False))
    hit = F.array_distinct(F.concat(_held("_one", short), _held("_many", long_)))
    # The outer explodes keep what follows from being pushed below, where it would repeat the arrays.
    out = out.select("doc_id", F.explode_outer(F.array(F.struct("_s", hit.alias("hit")))).alias("_x")).where("size(_x.hit) > 0")
    numbers = F.split(F.lit(",".join(" ".join(map(str, v)) for v in leads.values())), ",")  # two foldable arrays, one literal map
    lead = F.map_from_arrays(F.split(F.lit(",".join(map(str, leads))), ",").cast("array<bigint>"), numbers)
    found = F.array_distinct(F.flatten(F.transform("_x.hit", lambda k: F.split(F.element_at(lead, k), " ").cast("array<int>"))))
    out = out.select("doc_id", F.col("_x._s").alias("_s"), F.explode_outer(found).alias("template"))
    known = spark.createDataFrame([(r["template"], r["license_id"], r["s"]) for r in table], "template int, license_id string, _t array<bigint>")
    out = out.join(F.broadcast(known), "template")  # at most MAX_BYTES of texts
    have = F.size(F.array_intersect("_s", "_t"))
    first = F.array_min(F.transform("_t", lambda h: F.nullif(F.array_position("_s", h), F.lit(0).cast("bigint"))))
    n = F.size("_t")
    out = out.select("doc_id", "license_id", "template", n.cast("long").alias("n_shingles"), have.cast("long").alias("n_matched"), (have / n).alias("containment"), (first - 1).alias("first_word"))
    return out.where(F.col("n_matched") >= F.lit(threshold) * F.col("n_shingles"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''")
    every = [(name, own) for name, texts in sorted(TEMPLATES.items()) for own in map(shingles, texts) if own]
    rows = [f"({i}, '{name}', '{quoted(s)}')" for i, (name, own) in enumerate(every) for s in sorted(set(own))]
    return f"""
    WITH t(template, license_id, s) AS (VALUES {", ".join(rows)}),
    size AS (SELECT template, license_id, count(*) AS n_shingles FROM t GROUP BY ALL),
    w AS (SELECT rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{quoted(_UPPER + _MARKS)}', '{_LOWER + " " * len(_MARKS)}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM (SELECT row_number() OVER () AS rn, doc_id, text FROM documents)),
    s AS (SELECT rn, doc_id, i - 1 AS pos, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
          FROM (SELECT rn, doc_id, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM w)),
    m AS (SELECT rn, doc_id, template, license_id, count(DISTINCT s.s) AS n_matched, min(pos) AS first_word FROM s JOIN t USING (s) GROUP BY ALL)
    SELECT doc_id, license_id, CAST(template AS INTEGER) AS template, n_shingles, n_matched, CAST(n_matched AS DOUBLE) / n_shingles AS containment, first_word
    FROM m JOIN size USING (template, license_id) WHERE n_matched >= {THRESHOLD} * n_shingles"""


OP4_SQL = _oracle()
