"""Queries that apply the column functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geometry, numbers, plates
from ..plans import views as v
from ..plans.registry import query


@query("normalize_plate", v.sql(f"SELECT id, plate AS key, substr(plate, 1, 2) || '-' || substr(plate, 3, 1) || '-' || substr(plate, 4, 3) || '-' || substr(plate, 7, 2) AS display, translate(plate, '0123456789', '{plates.PERSIAN_DIGITS}') AS persian FROM sightings", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("iran "), F.translate("plate", plates.ASCII_DIGITS, plates.ARABIC_DIGITS), F.lit(" ir"))
    s = v.sightings(spark, d)
    return s.select("id", plates.normalize_plate(noisy).alias("key"), plates.format_plate(noisy).alias("display"), plates.persian_digits(F.col("plate")).alias("persian"))


@query("split_plate", v.sql("SELECT id, nullif(substr(plate_norm, 1, 2), '') AS prefix, nullif(substr(plate_norm, 3, 1), '') AS letter, nullif(substr(plate_norm, 4, 3), '') AS serial, nullif(substr(plate_norm, 7, 2), '') AS region FROM sightings", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.sightings(spark, d).select("id", plates.split_plate(F.col("plate_norm")).alias("p")).select("id", "p.prefix", "p.letter", "p.serial", "p.region")


@query("validate_plate", v.sql("""x AS (SELECT id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 = 1 THEN substr(plate, 1, 6) || '05' WHEN id % 7 = 2 THEN '00' || substr(plate, 3) WHEN id % 7 = 3 THEN '12D345' || right(plate, 2) WHEN id % 7 = 4 THEN 'x' || plate ELSE plate END AS p FROM sightings);
    SELECT id, p AS normalized, CASE WHEN id % 7 = 0 THEN 'empty' WHEN id % 7 = 1 THEN 'invalid_province' WHEN id % 7 = 2 THEN 'zero_serial' WHEN id % 7 = 4 THEN 'invalid_structure' ELSE 'ok' END AS reason, CASE WHEN id % 7 = 3 THEN 'diplomatic' WHEN id % 7 IN (0, 4) THEN NULL ELSE 'standard' END AS pattern FROM x""", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("id") % 7
    text = F.when(m == 0, "").when(m == 1, F.concat(F.substring("plate", 1, 6), F.lit("05"))).when(m == 2, F.concat(F.lit("00"), F.substring("plate", 3, 9))).when(m == 3, F.concat(F.lit("12-d 345 "), F.right("plate", F.lit(2)))).when(m == 4, F.concat(F.lit("x"), "plate")).otherwise(F.concat(F.substring("plate", 1, 3), F.lit(" | "), F.substring("plate", 4, 9)))
    return v.sightings(spark, d).select("id", plates.validate_v2(text, nfkc=False).alias("r")).select("id", "r.normalized", "r.reason", "r.pattern")


@query("plate_distances", v.sql(f"""x AS (SELECT id, translate(observed_norm, '{plates.LETTERS}', 'abcdefghijklmnopqrstuvwx') AS o, translate(corrected_norm, '{plates.LETTERS}', 'abcdefghijklmnopqrstuvwx') AS c FROM feedback);
    SELECT id, levenshtein(o, c) AS edits, least(1.0, levenshtein(o, c) / greatest(1, length(c))) AS share, CASE WHEN o = '' THEN 0 ELSE hamming(o, c) END AS mismatches, o <> '' AND hamming(CASE WHEN o = '' THEN c ELSE o END, c) <= 1 AS can_migrate FROM x""", "feedback"))
def _(spark: SparkSession, d: str) -> DataFrame:
    o, c = F.col("observed_norm"), F.col("corrected_norm")
    return v.feedback(spark, d).select("id", plates.edit_distance(o, c).cast("long").alias("edits"), plates.normalised_distance(o, c).alias("share"), plates.mismatches(o, c).cast("long").alias("mismatches"), plates.can_migrate(o, c).alias("can_migrate"))


@query("jalali_round_trip", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = dates.to_jalali(F.col("o_orderdate"))
    back = dates.from_jalali(j["year"], j["month"], j["day"])
    return v.table(spark, d, "orders").select("o_orderkey", F.date_format(back, "yyyy-MM-dd").alias("day"))


@query("parse_jalali", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1400 + o_orderkey % 50 END AS year, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 + o_orderkey % 12 END AS month FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat_ws("/", F.when(k % 3 == 0, 3000).otherwise(1400 + k % 50).cast("string"), (1 + k % 12).cast("string"), F.lit("7"))
    p = dates.parse_date(plates.persian_digits(text))
    return v.table(spark, d, "orders").select("o_orderkey", p["year"].cast("long").alias("year"), p["month"].cast("long").alias("month"))


@query("combined_confidence", v.sql("b AS (SELECT id, 0.34 * confidence + 0.56 * (k / 100) + 0.10 * 0.5 AS base FROM sightings); SELECT id, round_even(greatest(0, least(1, CASE WHEN id % 3 = 0 THEN base + 0.08 ELSE base * 0.62 END)), 4) AS c FROM b", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    c = numbers.combined_confidence(F.col("confidence"), F.col("k") / 100, F.lit(0.5), F.col("id") % 3 == 0)
    return v.sightings(spark, d).select("id", c.alias("c"))


@query("severity_levels", v.sql("SELECT id, round(CASE WHEN k >= 92 THEN 2.7 + (k - 92) / 92 WHEN k >= 80 THEN 1.75 + 0.95 * (k - 80) / 12 WHEN k >= 65 THEN 1.0 + 0.75 * (k - 65) / 15 ELSE k / 65 END, 6) AS s FROM sightings", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.sightings(spark, d).select("id", F.round(numbers.severity(F.col("k").cast("double"), 65.0, 80.0, 92.0), 6).alias("s"))


@query("backoff", "SELECT o_orderkey, least(60.0, pow(2.0, greatest(o_orderkey % 9 - 1, 0))) AS wait FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").select("o_orderkey", numbers.backoff_seconds(F.col("o_orderkey") % 9).alias("wait"))


@query("framed_digests", "SELECT o_orderkey, sha256(unhex(lpad(hex(strlen(o_orderstatus)), 16, '0')) || o_orderstatus::BLOB || unhex(lpad(hex(strlen(o_orderpriority)), 16, '0')) || o_orderpriority::BLOB) AS digest FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").select("o_orderkey", numbers.framed_digest(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))


@query("lenient_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 WHEN o_orderkey % 4 = 1 THEN 0.0 ELSE o_totalprice END AS n FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "n/a").when(k == 1, (-F.col("o_totalprice")).cast("string")).otherwise(F.col("o_totalprice").cast("string"))
    return v.table(spark, d, "orders").select("o_orderkey", numbers.non_negative(text).alias("n"))


@query("box_continuity", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 50)::DOUBLE AS a, (l_suppkey % 10)::DOUBLE AS b FROM lineitem), y AS (SELECT *, greatest(0, 20 - abs(a - 25)) * greatest(0, 10 - abs(b - 5)) AS i FROM x) SELECT l_orderkey, l_linenumber, l_partkey, round(i / (400 - i), 6) AS iou, i / (400 - i) >= 0.08 OR sqrt(pow(a - 25, 2) + pow(b - 5, 2)) <= 9 AS near FROM y")
def _(spark: SparkSession, d: str) -> DataFrame:
    box = lambda a, b: F.struct(a.alias("x1"), b.alias("y1"), (a + 20).alias("x2"), (b + 10).alias("y2"))
    one = box((F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 10).cast("double"))
    two = box(F.lit(25.0), F.lit(5.0))
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(geometry.iou(one, two), 6).alias("iou"), geometry.continuous(one, two).alias("near"))


@query("compatibility_forms", v.sql("SELECT id, plate AS normalized, CASE WHEN substr(plate, 1, 2) = '00' OR substr(plate, 4, 3) = '000' THEN 'zero_serial' WHEN substr(plate, 7, 2) < '10' THEN 'invalid_province' ELSE 'ok' END AS reason FROM sightings", "sightings"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Full-width digits and marks that only compatibility normalisation takes out."""
    wide = F.concat(F.translate("plate", plates.ASCII_DIGITS, "０１２３４５６７８９"), F.lit("　"))
    return v.sightings(spark, d).select("id", plates.validate_v2(wide).alias("r")).select("id", "r.normalized", "r.reason")
